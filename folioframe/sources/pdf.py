"""Tables of a collection of PDF files.

``files`` has a ``file_id`` of any type and ``content BINARY``. Each function parses the
files in one ``mapInArrow`` pass, a file at a time, and emits only the rows asked for, so
the file bytes are never shuffled. Files that do not load strictly give no rows in strict
mode (``recovery`` tells why); lenient mode takes what can be found. Persist or write a
table that several queries use.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from folioframe.functions.content import instructions, shown_codes, text_chunks
from folioframe.functions.cos import ParseError, Ref, Stream, kind, number, references, tagged, untagged
from folioframe.functions.document import HEADER_REACH, Page, Pdf, load
from folioframe.functions.filters import FilterError, decode, names
from folioframe.functions.fonts import Font, read_font

MOST_BYTES = 1 << 30  # of one file; larger ones are reported, not parsed
_BATCH_ROWS, _BATCH_BYTES = 2000, 16 << 20  # of an Arrow batch that a parse emits


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``file_id, length, content`` of the files under a path; content is null, and not read, of files over ``most_bytes``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = raw.where(F.col("length") <= most_bytes).select(F.col("path").alias("file_id"), "length", "content")
    large = raw.where(F.col("length") > most_bytes).select(F.col("path").alias("file_id"), "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def header_version(content: Column) -> Column:
    """``1.7`` of ``%PDF-1.7`` in the first 1,024 bytes, else null."""
    head = F.decode(F.substring(content, 1, HEADER_REACH), "ISO-8859-1")
    found = F.regexp_extract(head, r"%PDF-(\d\.\d)", 1)
    return F.when(found != "", found)


def each_file(files: DataFrame, rows: Callable[[Any, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """One Python pass over the files; ``rows`` yields tuples in the order of ``schema``, less the file id."""
    spark = files.sparkSession
    own = spark.createDataFrame([], schema).schema
    whole = StructType([StructField("file_id", files.schema["file_id"].dataType), *own.fields])
    arrow = to_arrow_schema(whole)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py()
                if content is None:
                    continue
                file_id = batch.column(0)[i].as_py()
                for row in rows(file_id, content):
                    held.append((file_id, *row))
                    size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
                    if len(held) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return files.select("file_id", "content").mapInArrow(emit, whole)


def opened(content: bytes, lenient: bool) -> Pdf | None:
    try:
        return load(content, lenient)
    except (ParseError, RecursionError):
        return None


def xref_sections(files: DataFrame, lenient: bool = False) -> DataFrame:
    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        for e in pdf.entries if pdf else []:
            yield (e.section, e.source, e.num, e.gen, e.kind, e.offset, e.next_free, e.container, e.index)

    return each_file(files, rows, "section_ord int, src string, obj_num long, gen int, kind string, offset long, next_free long, stm_num long, stm_idx int")


def xref_winners(sections: DataFrame) -> DataFrame:
    """The entry of each object number in its newest section (B2, 7.6: newest wins)."""
    columns = [c for c in sections.columns if c not in ("file_id", "obj_num")]
    best = F.min_by(F.struct(*columns), "section_ord").alias("w")
    return sections.groupBy("file_id", "obj_num").agg(best).select("file_id", "obj_num", "w.*")


def trailers(files: DataFrame, lenient: bool = False) -> DataFrame:
    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        for section, head in enumerate(pdf.trailers if pdf else []):
            for key, value in head.items():
                yield (section, key, json.dumps(tagged(value)))

    return each_file(files, rows, "section_ord int, key string, value string")


OBJECTS = (
    "obj_num long, gen int, kind string, type string, subtype string, value string, filters array<string>, raw binary, origin string, "
    "refs array<struct<path: string, num: long, gen: int>>"
)


def object_row(ref: Ref, value: Any, origin: str) -> tuple:
    head = value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}
    label = lambda k: str(head[k]) if isinstance(head.get(k), str) else None
    chain = head.get("Filter") if isinstance(value, Stream) else None
    refs = [{"path": p, "num": n, "gen": g} for p, n, g in references(value)]
    raw = value.raw if isinstance(value, Stream) else None
    return (ref.num, ref.gen, kind(value), label("Type"), label("Subtype"), json.dumps(tagged(value)), names(chain) if raw is not None else None, raw, origin, refs)


def objects(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Every object that parses; ``value`` is tagged JSON (use ``parse_json`` for a VARIANT)."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        for ref, value, origin in pdf.all_objects() if pdf else []:
            yield object_row(ref, value, origin)

    return each_file(files, rows, OBJECTS)


def object_counts(files: DataFrame, lenient: bool = False) -> DataFrame:
    """``file_id, n_objects``: how many rows ``objects`` has of each file, of which only the numbers leave the pass."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        if count := pdf.count_objects() if pdf else 0:
            yield (count,)

    return each_file(files, rows, "n_objects long").groupBy("file_id").agg(F.sum("n_objects").alias("n_objects"))


def refs(objects_table: DataFrame) -> DataFrame:
    """Edges of the object graph, one for each reference."""
    exploded = objects_table.select("file_id", F.col("obj_num").alias("src_num"), F.explode("refs").alias("r"))
    return exploded.select("file_id", "src_num", F.col("r.path").alias("key_path"), F.col("r.num").alias("dst_num"), F.col("r.gen").alias("dst_gen"))


_BOX = "struct<llx: double, lly: double, urx: double, ury: double>"


def _box(values: list[float] | None) -> dict[str, float] | None:
    return dict(zip(("llx", "lly", "urx", "ury"), values, strict=True)) if values else None


def pages(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Pages in document order, with inherited attributes (B4)."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        for p in pdf.pages() if pdf else []:
            yield (p.index, p.ref.num, p.ref.gen, _box(p.media_box), _box(p.crop_box), p.rotate, json.dumps(tagged(p.resources)))

    table = each_file(files, rows, f"page_index int, obj_num long, gen int, media_box {_BOX}, crop_box {_BOX}, rotate int, resources string")
    size = lambda hi, lo: F.abs(F.col(f"media_box.{hi}") - F.col(f"media_box.{lo}"))
    return table.withColumns({"width": size("urx", "llx"), "height": size("ury", "lly")})


def page_fonts(pdf: Pdf, page: Page, known: dict[int, Font]) -> dict[str, Font]:
    """The fonts of a page by resource name (B10: each ``Tf`` has its own)."""
    out: dict[str, Font] = {}
    table = pdf.resolve(page.resources.get("Font"))
    for name, ref in (table if isinstance(table, dict) else {}).items():
        font = pdf.resolve(ref)
        if not isinstance(font, dict):
            continue
        key = ref.num if isinstance(ref, Ref) else None
        if key is None or key not in known:
            made = read_font(font, pdf.resolve, pdf.decoded)
            if key is None:
                out[name] = made
                continue
            known[key] = made
        out[name] = known[key]
    return out


def text_chunk_table(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Positioned text: load, page tree, content, fonts and graphics state in one pass."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        known: dict[int, Font] = {}
        for page in pdf.pages() if pdf else []:
            for seq, c in enumerate(text_chunks(pdf.content(page), page_fonts(pdf, page, known))):
                yield (page.index, seq, c.text, c.x, c.y, c.font_size, c.font)

    return each_file(files, rows, "page_index int, seq int, text string, x double, y double, font_size double, font_res string")


def instruction_table(files: DataFrame, lenient: bool = False) -> DataFrame:
    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        for page in pdf.pages() if pdf else []:
            for seq, i in enumerate(instructions(pdf.content(page))):
                yield (page.index, seq, i.op, [json.dumps(tagged(v)) for v in i.operands], i.data)

    return each_file(files, rows, "page_index int, seq int, op string, operands array<string>, data binary")


def font_table(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Fonts by page and resource name, with widths and the ToUnicode map."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        known: dict[int, Font] = {}
        for page in pdf.pages() if pdf else []:
            for name, f in page_fonts(pdf, page, known).items():
                yield (page.index, name, f.name, f.subtype, f.ros, f.widths, f.missing, f.cmap.entries() if f.cmap else None)

    return each_file(files, rows, "page_index int, font_res string, base_font string, subtype string, ros string, widths map<int, double>, missing_width double, to_unicode map<int, string>")


def glyph_usage(files: DataFrame, lenient: bool = False) -> DataFrame:
    """``page_index, font_res, base_font, code, n``: how often pages show each code of each font."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        known: dict[int, Font] = {}
        for page in pdf.pages() if pdf else []:
            fonts = page_fonts(pdf, page, known)
            for (name, code), n in shown_codes(pdf.content(page), fonts).items():
                yield (page.index, name, fonts[name].name, code, n)

    return each_file(files, rows, "page_index int, font_res string, base_font string, code int, n int")


def recovery(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row a file: how it loads, strictly and leniently. Never fails. Files that ``read_files`` left unread are too large."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        if len(content) > most_bytes:
            yield (False, ["larger than the limit"], False, 0, 0, 0)
            return
        strict = opened(content, False)
        pdf = load(content, True)
        n = sum(1 for _ in pdf.all_objects())
        report = pdf.report
        yield (strict is not None, report.warnings, report.xref_recovered, report.objects_skipped, n, len(pdf.pages()))

    found = each_file(files, rows, "strict_ok boolean, warnings array<string>, xref_recovered boolean, objects_skipped int, n_objects int, n_pages int")
    if "length" not in files.columns:
        return found
    unread = files.where("content IS NULL AND length IS NOT NULL").selectExpr(
        "file_id", "false AS strict_ok", "array('larger than the limit') AS warnings", "false AS xref_recovered", "0 AS objects_skipped", "0 AS n_objects", "0 AS n_pages"
    )
    return found.unionByName(unread)


def doc_info(files: DataFrame, lenient: bool = False) -> DataFrame:
    """The information dictionary and the XMP packet."""
    keys = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        if not pdf:
            return
        info = pdf.resolve(pdf.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        values = [pdf.resolve(info.get(k)) for k in keys]
        xmp = pdf.resolve(pdf.catalog.get("Metadata"))
        try:
            packet = pdf.decoded(xmp).decode("utf-8") if isinstance(xmp, Stream) else None
        except (FilterError, UnicodeDecodeError):
            packet = None
        yield (*[text_string(v) for v in values], packet)

    snake = ("title", "author", "subject", "keywords", "creator", "producer", "creation_date", "mod_date")
    return each_file(files, rows, ", ".join(f"{k} string" for k in (*snake, "xmp")))


def text_string(value: Any) -> str | None:
    """A text string: UTF-16 or UTF-8 with its mark, else the PDF document encoding (as Windows-1252)."""
    if not isinstance(value, bytes):
        return None
    if value.startswith(b"\xfe\xff"):
        return value[2:].decode("utf-16-be", "replace")
    if value.startswith(b"\xef\xbb\xbf"):
        return value[3:].decode("utf-8", "replace")
    return value.decode("cp1252", "replace")


def outlines(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Outline items in preorder; ``path`` has the place among its siblings at each level. Loops end (B13)."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        if not pdf:
            return
        page_of = {p.ref.num: p.index for p in pdf.pages()}
        root = pdf.resolve(pdf.catalog.get("Outlines"))
        stack: list[tuple[Any, list[int]]] = [(root.get("First"), [0])] if isinstance(root, dict) else []
        seen: set[int] = set()
        while stack:
            ref, path = stack.pop()
            item = pdf.resolve(ref)
            if not isinstance(ref, Ref) or not isinstance(item, dict) or ref.num in seen:
                continue
            seen.add(ref.num)
            where, page, uri = destination(pdf, item, page_of)
            count = pdf.resolve(item.get("Count"))
            yield (path, len(path) - 1, ref.num, text_string(pdf.resolve(item.get("Title"))), isinstance(count, int) and count > 0, where, page, uri)
            stack.append((item.get("Next"), [*path[:-1], path[-1] + 1]))
            stack.append((item.get("First"), [*path, 0]))

    return each_file(files, rows, "path array<int>, depth int, obj_num long, title string, is_open boolean, dest_kind string, page_index int, uri string")


def destination(pdf: Pdf, item: dict[str, Any], page_of: dict[int, int]) -> tuple[str | None, int | None, str | None]:
    action = pdf.resolve(item.get("A"))
    action = action if isinstance(action, dict) else {}
    if action.get("S") == "URI":
        return "URI", None, text_string(pdf.resolve(action.get("URI")))
    target = pdf.resolve(item.get("Dest", action.get("D")))
    first = target[0] if isinstance(target, list) and target else None
    if action.get("S") == "GoToR":
        return "GoToR", first if isinstance(first, int) else None, text_string(pdf.resolve(action.get("F")))
    if isinstance(first, Ref):
        return "GoTo", page_of.get(first.num), None
    return ("GoTo", first, None) if isinstance(first, int) else (None, None, None)


# Bits of /Ff.
_PUSH, _RADIO, _COMBO = 0x10000, 0x8000, 0x20000


def field_kind(ft: str | None, flags: int) -> str:
    if ft == "Btn":
        return "push_button" if flags & _PUSH else "radio" if flags & _RADIO else "checkbox"
    if ft == "Ch":
        return "combo" if flags & _COMBO else "list"
    return {"Tx": "text", "Sig": "signature"}.get(ft or "", "unknown")


def form_fields(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Form fields, with all descendants; type, flags and value are inherited. ``is_root`` marks direct entries."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        form = pdf.resolve(pdf.catalog.get("AcroForm")) if pdf else None
        if not isinstance(form, dict):
            return
        top = pdf.resolve(form.get("Fields"))
        stack = [(ref, "", {}, i, True) for i, ref in reversed(list(enumerate(top if isinstance(top, list) else [])))]
        seen: set[int] = set()
        while stack:
            ref, prefix, above, order, is_root = stack.pop()
            node = pdf.resolve(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref) or ref.num in seen:
                continue
            seen.add(ref.num)
            own = above | {k: pdf.resolve(node[k]) for k in ("FT", "Ff", "V", "DA") if k in node}
            name = text_string(pdf.resolve(node.get("T")))
            full = ".".join(x for x in (prefix, name) if x)
            flags = own.get("Ff") if isinstance(own.get("Ff"), int) else 0
            rect = pdf.box(node.get("Rect"))
            da = text_string(own.get("DA"))
            yield (order, is_root, ref.num, name, full, field_kind(own.get("FT"), flags), flags, field_text(own.get("V")), da, _box(rect))
            kids = pdf.resolve(node.get("Kids"))
            stack.extend((k, full, own, i, False) for i, k in reversed(list(enumerate(kids if isinstance(kids, list) else []))))

    return each_file(files, rows, f"field_ord int, is_root boolean, obj_num long, name string, full_name string, kind string, flags int, value string, da string, rect {_BOX}")


def field_text(value: Any) -> str | None:
    """The exported value of a field: text, a name other than ``Off``, or lines of a list."""
    if isinstance(value, bytes):
        return text_string(value)
    if isinstance(value, str):
        return None if value == "Off" else str(value)
    if isinstance(value, list):
        return "\n".join(x for v in value if (x := field_text(v)) is not None)
    return None if number(value) is None else str(value)


def xfa_packets(files: DataFrame, lenient: bool = False) -> DataFrame:
    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, lenient)
        form = pdf.resolve(pdf.catalog.get("AcroForm")) if pdf else None
        xfa = pdf.resolve(form.get("XFA")) if isinstance(form, dict) else None
        pairs = list(zip(xfa[::2], xfa[1::2], strict=False)) if isinstance(xfa, list) else [(None, xfa)]
        for i, (name, stream) in enumerate(pairs):
            stream = pdf.resolve(stream) if pdf else None
            if isinstance(stream, Stream):
                yield (i, text_string(name), pdf.decoded(stream).decode("utf-8", "replace"))

    return each_file(files, rows, "ord int, name string, xml string")


def decoded_streams(objects_table: DataFrame) -> DataFrame:
    """``file_id, obj_num, data, failed`` of every stream object."""

    @F.arrow_udf("struct<data: binary, failed: string>")
    def decoded(raw: pa.Array, value: pa.Array) -> pa.Array:
        rows = []
        for r, v in zip(raw.to_pylist(), value.to_pylist(), strict=True):
            head = untagged(json.loads(v))
            try:
                rows.append({"data": decode(r, head.get("Filter"), head.get("DecodeParms")), "failed": None})
            except ValueError as e:
                rows.append({"data": None, "failed": str(e)})
        return pa.array(rows, pa.struct([("data", pa.binary()), ("failed", pa.string())]))

    streams = objects_table.where("kind = 'stream'")
    return streams.select("file_id", "obj_num", "type", "subtype", "raw", decoded("raw", "value").alias("d")).select("file_id", "obj_num", "type", "subtype", "raw", "d.*")
