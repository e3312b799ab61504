"""Sinks: object rows back to PDF bytes, page operations on whole files, and offsets of updates in SQL."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.cos import Name, Ref, Stream, number, renumbered, untagged, write
from folioframe.functions.crypt import Locked
from folioframe.functions.document import Page, Pdf, load
from folioframe.functions.writing import write_file

_BATCH_BYTES = 16 << 20  # of an Arrow batch of files, about


def each_content(files: DataFrame, change: Callable[[Any, bytes], Iterator[tuple[Any, bytes]]]) -> DataFrame:
    """Files to files: ``change`` yields ids and contents for each file.

    What is changed is decrypted; content is null for files that are encrypted and that the
    password does not open.
    """

    def batch_of(held: list[tuple[Any, bytes | None]], kind: pa.DataType) -> pa.RecordBatch:
        keys, contents = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(contents, pa.binary())], ["file_id", "content"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, held, size = batch.column(0).type, [], 0
            for i in range(batch.num_rows):
                if batch.column(1)[i].is_valid:
                    own = batch.column(0)[i].as_py()
                    try:
                        made = list(change(own, batch.column(1)[i].as_py()))
                    except Locked:
                        made = [(own, None)]
                    for key, content in made:
                        held.append((key, content))
                        size += len(content or b"")
                        if size >= _BATCH_BYTES:
                            yield batch_of(held, kind)
                            held, size = [], 0
            if held:
                yield batch_of(held, kind)

    schema = files.select("file_id", "content").schema
    return files.select("file_id", "content").mapInArrow(emit, schema)


def row_object(value: str, raw: bytes | None) -> Any:
    head = untagged(json.loads(value))
    return head if raw is None else Stream(head, bytes(raw))


def write_objects(objects: DataFrame, trailer: DataFrame) -> DataFrame:
    """Full rewrite: ``file_id, content`` from object rows and trailer rows (``file_id, key, value``).

    A file's rows meet in one task, as a file must fit one row anyway.
    """
    rows = objects.select("file_id", "obj_num", "gen", "value", "raw", F.lit(None).cast("string").alias("key"))
    keys = trailer.select("file_id", F.lit(-1).cast("long").alias("obj_num"), F.lit(0).alias("gen"), "value", F.lit(None).cast("binary").alias("raw"), "key")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        found, head = {}, {}
        for r in table.to_pylist():
            if r["key"] is not None:
                head[r["key"]] = untagged(json.loads(r["value"]))
            else:
                value = row_object(r["value"], r["raw"])
                if not (isinstance(value, Stream) and value.dict.get("Type") in ("XRef", "ObjStm")):
                    found[Ref(r["obj_num"], r["gen"])] = value
        keep = {k: head[k] for k in ("Root", "Info", "ID") if k in head}
        return pa.table({"file_id": pa.array([key[0].as_py()], table.schema.field("file_id").type), "content": pa.array([write_file(found, keep)], pa.binary())})

    kind = objects.schema["file_id"].dataType.simpleString()
    return rows.unionByName(keys).groupBy("file_id").applyInArrow(build, f"file_id {kind}, content binary")


def update_offsets(sizes: DataFrame) -> DataFrame:
    """Where the objects of an incremental update start, and the runs of its cross-reference section, in SQL.

    ``sizes``: ``file_id, base, obj_num, n_bytes``. Runs are found as gaps and islands.
    """
    order = Window.partitionBy("file_id").orderBy("obj_num")
    before = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = F.col("obj_num") - F.row_number().over(order)
    placed = sizes.select("file_id", "obj_num", (F.col("base") + before).alias("offset"), run.alias("island"))
    first = F.min("obj_num").over(Window.partitionBy("file_id", "island"))
    return placed.select("file_id", "obj_num", "offset", first.alias("run_start"))


# ---- page operations ----


def subset(pdf: Pdf, wanted: list[Page]) -> bytes:
    """A file with these pages, in this order, repeats allowed: what they lead to is copied and renumbered (B8)."""
    if pdf.locked:
        raise Locked("encrypted, and not opened by the password")
    new: dict[Ref, Ref] = {}
    objects: dict[Ref, Any] = {}
    todo: list[Ref] = []

    def copy_of(ref: Ref) -> Ref:
        if ref not in new:
            new[ref] = Ref(len(new) + 3 + len(wanted), 0)
            todo.append(ref)
        return new[ref]

    def moved(value: Any) -> Any:
        if isinstance(value, Ref):
            target = pdf.get(value)
            return None if isinstance(target, dict) and target.get("Type") in ("Pages", "Page", "Catalog") else copy_of(value)
        if isinstance(value, Stream):
            return Stream(moved(value.dict), value.raw)
        if isinstance(value, dict):
            return {k: moved(v) for k, v in value.items()}
        return [moved(v) for v in value] if isinstance(value, list) else value

    kids = [Ref(3 + i, 0) for i in range(len(wanted))]
    for ref, page in zip(kids, wanted, strict=True):
        own = {k: v for k, v in page.dict.items() if k != "Parent"} | {"Resources": page.resources, "Rotate": page.rotate}
        if page.media_box:
            own["MediaBox"] = page.media_box
        objects[ref] = moved(own) | {"Type": Name("Page"), "Parent": Ref(2, 0)}
    while todo:
        ref = todo.pop()
        objects[new[ref]] = moved(pdf.get(ref))
    objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    objects[Ref(1, 0)] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    return write_file(objects, {"Root": Ref(1, 0)}, pdf.version or "1.7")


def extract_pages(files: DataFrame, indices: list[int]) -> DataFrame:
    """Each file cut to these page indices, in this order; indices that it lacks are left out."""

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        pdf = load(content)
        pages = pdf.pages()
        yield key, subset(pdf, [pages[i] for i in indices if 0 <= i < len(pages)])

    return each_content(files, change)


def split_every(files: DataFrame, n: int) -> DataFrame:
    """``file_id, part, content``: files of ``n`` pages, the last with the rest; none of a file that the empty password does not open."""
    if n < 1:
        raise ValueError("n must be positive")
    kind = files.schema["file_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pdf = load(batch.column(1)[i].as_py())
                pages = [] if pdf.locked else pdf.pages()
                for part, at in enumerate(range(0, len(pages), n)):
                    content = subset(pdf, pages[at : at + n])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([part], pa.int32()), pa.array([content], pa.binary())], ["file_id", "part", "content"])

    return files.select("file_id", "content").mapInArrow(emit, f"file_id {kind}, part int, content binary")


def merge_files(files: DataFrame, group: Column, order: Column) -> DataFrame:
    """One file for each value of ``group``, with the pages of its files in ``order``; numbers are shifted and remapped.

    The files of a group meet in one task, as their result is one row.
    """
    rows = files.select(group.alias("file_id"), order.alias("ord"), "content")
    kind = rows.schema["file_id"].dataType.simpleString()

    def build(key: tuple, table: pa.Table) -> pa.Table:
        objects: dict[Ref, Any] = {}
        kids: list[Ref] = []
        at = 3
        for r in sorted(table.to_pylist(), key=lambda r: r["ord"]):
            part = load(r["content"])
            piece = load(subset(part, part.pages()))
            shift = {ref: Ref(ref.num + at, 0) for ref, _, _ in piece.all_objects()}
            at = max((v.num for v in shift.values()), default=at)
            for page in piece.pages():
                kids.append(shift[page.ref])
            for ref, value, _ in piece.all_objects():
                label = value.get("Type") if isinstance(value, dict) else None
                if label in ("Catalog", "Pages"):
                    continue
                value = renumbered(value, shift)
                objects[shift[ref]] = value | {"Parent": Ref(2, 0)} if label == "Page" else value
        objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
        objects[Ref(1, 0)] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
        content = write_file(objects, {"Root": Ref(1, 0)})
        return pa.table({"file_id": pa.array([key[0].as_py()], table.schema.field("file_id").type), "content": pa.array([content], pa.binary())})

    return rows.groupBy("file_id").applyInArrow(build, f"file_id {kind}, content binary")


def plain_objects(pdf: Pdf) -> dict[Ref, Any]:
    """All objects of a file that has none of its own form: no cross-reference or object streams, and no encryption."""
    if pdf.locked:
        raise Locked("encrypted, and not opened by the password")
    held = ("XRef", "ObjStm")
    return {r: v for r, v, _ in pdf.all_objects() if r.num != pdf.closed and not (isinstance(v, Stream) and v.dict.get("Type") in held)}


def _rewritten(pdf: Pdf, changes: dict[Ref, Any]) -> bytes:
    objects = plain_objects(pdf)
    keep = {k: pdf.trailer[k] for k in ("Root", "Info", "ID") if k in pdf.trailer}
    return write_file(objects | changes, keep, pdf.version or "1.7")


def rotate_pages(files: DataFrame, degrees: int) -> DataFrame:
    """All pages turned by a multiple of 90 degrees."""
    if degrees % 90:
        raise ValueError("degrees must be a multiple of 90")

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        pdf = load(content)
        yield key, _rewritten(pdf, {p.ref: p.dict | {"Rotate": (p.rotate + degrees) % 360} for p in pdf.pages()})

    return each_content(files, change)


def watermark_matrix(width: Column, height: Column, rotation: float, vertical: float = 0.5) -> dict[str, Column]:
    """The transformation of a watermark: rotated about its place on the page."""
    cos, sin = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    return {"a": F.lit(cos), "b": F.lit(sin), "c": F.lit(-sin), "d": F.lit(cos), "e": width / 2, "f": height * vertical}


def watermark(files: DataFrame, text: str, *, size: float = 48, rotation: float = 45, gray: float = 0.75, vertical: float = 0.5, under: bool = False) -> DataFrame:
    """A text on every page, above or under its content."""

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        pdf = load(content)
        changes: dict[Ref, Any] = {}
        at = max((r.num for r, _, _ in pdf.all_objects()), default=0) + 1
        changes[Ref(at, 0)] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
        cos, sin = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
        raw = text.encode("cp1252", "replace")
        for i, p in enumerate(pdf.pages()):
            x0, y0, x1, y1 = p.media_box or [0, 0, 612, 792]
            place = [cos, sin, -sin, cos, abs(x1 - x0) / 2, abs(y1 - y0) * vertical]
            body = b"q\n%s cm\n%s rg\nBT /FWm %s Tf\n%s 0 Td %s Tj ET\nQ" % (
                b" ".join(write(float(v)) for v in place), b" ".join([write(float(gray))] * 3), write(float(size)), write(-len(raw) * size * 0.25), write(raw),
            )
            mark = Ref(at + 1 + i, 0)
            changes[mark] = Stream({}, body)
            old = pdf.resolve(p.dict.get("Contents"))
            old = old if isinstance(old, list) else [p.dict["Contents"]] if "Contents" in p.dict else []
            fonts = pdf.resolve(p.resources.get("Font"))
            resources = p.resources | {"Font": (fonts if isinstance(fonts, dict) else {}) | {"FWm": Ref(at, 0)}}
            changes[p.ref] = p.dict | {"Contents": [mark, *old] if under else [*old, mark], "Resources": resources}
        yield key, _rewritten(pdf, changes)

    return each_content(files, change)


OVERLAYS = ("full", "header", "footer", "top_left", "top_center", "top_right", "center_left", "center", "center_right", "bottom_left", "bottom_center", "bottom_right")


def overlay_placement(kind: Column, width: Column, height: Column) -> Column:
    """A struct x, y, w, h: where an overlay stands on a page of this size."""
    side = F.least(width, height) * 0.15
    split = lambda i: F.split(kind, "_")[i]
    vertical, across = split(0), F.when(kind == "center", "center").otherwise(split(1))
    x = F.when(across == "left", F.lit(10.0)).when(across == "right", width - side - 10).otherwise((width - side) / 2)
    y = F.when(vertical == "top", height - side - 10).when(vertical == "bottom", F.lit(10.0)).otherwise((height - side) / 2)
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    zero = F.lit(0.0)
    return (
        F.when(kind == "full", box(zero, zero, width, height))
        .when(kind == "header", box(width * 0.05, height - height * 0.15 - 20, width * 0.9, height * 0.15))
        .when(kind == "footer", box(width * 0.05, F.lit(20.0), width * 0.9, height * 0.1))
        .otherwise(box(x, y, side, side))
    )


def overlay(files: DataFrame, stamps: DataFrame, kind: str = "full") -> DataFrame:
    """Page ``min(i, last)`` of a stamp file drawn over page i as a form; ``stamps``: ``file_id, stamp``."""
    if kind not in OVERLAYS:
        raise ValueError(f"unknown overlay {kind}")
    joined = files.join(stamps, "file_id").select("file_id", "content", "stamp")
    schema = files.select("file_id", "content").schema

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = _stamped(load(batch.column(1)[i].as_py()), load(batch.column(2)[i].as_py()), kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([made], pa.binary())], ["file_id", "content"])

    return joined.mapInArrow(emit, schema)


def _place(kind: str, w: float, h: float) -> tuple[float, float, float, float]:
    if kind == "full":
        return 0, 0, w, h
    if kind == "header":
        return w * 0.05, h - h * 0.15 - 20, w * 0.9, h * 0.15
    if kind == "footer":
        return w * 0.05, 20, w * 0.9, h * 0.1
    side = min(w, h) * 0.15
    vertical, _, across = kind.partition("_")
    x = 10 if across == "left" else w - side - 10 if across == "right" else (w - side) / 2
    y = h - side - 10 if vertical == "top" else 10 if vertical == "bottom" else (h - side) / 2
    return x, y, side, side


def _stamped(pdf: Pdf, stamp: Pdf, kind: str) -> bytes:
    top = max((r.num for r, _, _ in pdf.all_objects()), default=0) + 1
    shift = {r: Ref(r.num + top, 0) for r, _, _ in stamp.all_objects()}
    changes: dict[Ref, Any] = {shift[r]: renumbered(v, shift) for r, v, _ in stamp.all_objects()}
    at = max([top, *(r.num for r in changes)]) + 1
    forms = []
    for k, p in enumerate(stamp.pages()):
        box = p.media_box or [0, 0, 612, 792]
        head = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box, "Resources": renumbered(p.resources, shift)}
        changes[Ref(at + k, 0)] = Stream(head, stamp.content(p))
        forms.append((Ref(at + k, 0), box))
    at += len(forms)
    for i, p in enumerate(pdf.pages() if forms else []):
        form, (fx, fy, gx, gy) = forms[min(i, len(forms) - 1)]
        x0, y0, x1, y1 = p.media_box or [0, 0, 612, 792]
        x, y, w, h = _place(kind, abs(x1 - x0), abs(y1 - y0))
        sx, sy = w / (abs(gx - fx) or 1), h / (abs(gy - fy) or 1)
        numbers = [sx, 0.0, 0.0, sy, x - fx * sx, y - fy * sy]
        changes[Ref(at + i, 0)] = Stream({}, b"q " + b" ".join(write(float(v)) for v in numbers) + b" cm /FxOv Do Q")
        old = pdf.resolve(p.dict.get("Contents"))
        old = old if isinstance(old, list) else [p.dict["Contents"]] if "Contents" in p.dict else []
        known = pdf.resolve(p.resources.get("XObject"))
        resources = p.resources | {"XObject": (known if isinstance(known, dict) else {}) | {"FxOv": form}}
        changes[p.ref] = p.dict | {"Contents": [*old, Ref(at + i, 0)], "Resources": resources}
    return _rewritten(pdf, changes)


def estimated_size(value: Any) -> int:
    """Bytes of a value, about: streams by their data, containers by their parts."""
    if isinstance(value, Stream):
        return len(value.raw) + 64
    if isinstance(value, bytes):
        return len(value) + 4
    if isinstance(value, list):
        return sum(estimated_size(v) for v in value) + 8
    if isinstance(value, dict):
        return sum(len(k) + estimated_size(v) + 4 for k, v in value.items()) + 8
    return 16


def real(value: Any) -> float:
    return number(value) or 0.0


# ---- information ----


def pdf_date(at: Column) -> Column:
    """A timestamp as a PDF date, in universal time."""
    return F.concat(F.lit("D:"), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMddHHmmss"), F.lit("+00'00'"))


def set_info(files: DataFrame, values: DataFrame) -> DataFrame:
    """Files with entries of the information dictionary set or, where the value is null, removed (``file_id, key, value``)."""
    pairs = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    by_file = values.groupBy("file_id").agg(F.to_json(pairs, {"ignoreNullFields": "false"}).alias("values"))
    joined = files.join(by_file, "file_id").select("file_id", F.concat(F.encode("values", "UTF-8"), F.lit(b"\0"), "content").alias("content"))

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        new, _, body = content.partition(b"\0")
        pdf = load(body)
        ref = pdf.trailer.get("Info")
        old = pdf.resolve(ref)
        if not isinstance(ref, Ref):
            ref = Ref(max((r.num for r in plain_objects(pdf)), default=0) + 1, 0)
            pdf.trailer["Info"] = ref
        entries = dict(old) if isinstance(old, dict) else {}
        for k, v in json.loads(new).items():
            entries.pop(k, None)
            if v is not None:
                entries[k] = text_bytes(v)
        yield key, _rewritten(pdf, {ref: entries})

    return each_content(joined, change)


def text_bytes(text: str) -> bytes:
    """A text string: the document encoding where it is ASCII, else UTF-16 with its mark."""
    return text.encode("ascii") if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be")


def anchor_rectangle(chunks: DataFrame, tag: str, width: float, height: float, in_front: bool = False) -> DataFrame:
    """``file_id, page_index, x0, y0, x1, y1``: where a field of this size stands that is anchored to the first chunk with ``tag``.

    It begins where the chunk does, or in front at the larger of 8 points and the font's size further right.
    """
    first = chunks.where(F.contains("text", F.lit(tag))).groupBy("file_id")
    first = first.agg(F.min_by(F.struct("page_index", "x", "y", "font_size"), F.struct("page_index", "seq")).alias("c"))
    x = F.col("c.x") + (F.greatest(F.col("c.font_size"), F.lit(8.0)) if in_front else 0.0)
    return first.select("file_id", "c.page_index", x.alias("x0"), (F.col("c.y") - height).alias("y0"), (x + width).alias("x1"), F.col("c.y").alias("y1"))
