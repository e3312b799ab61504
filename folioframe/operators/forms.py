"""Form data: FDF and XFDF in both directions, values, appearances and flattening."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.cos import Name, ParseError, Ref, Stream, parse, write
from folioframe.functions.document import Pdf, load
from folioframe.operators.writers import _rewritten, each_content
from folioframe.sources.pdf import field_kind, field_text, text_string


def xml_escape(x: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def export_xfdf(fields: DataFrame) -> DataFrame:
    """``file_id, xfdf`` of root fields with a name and a value, in their order."""
    item = F.concat(F.lit('<field name="'), xml_escape(F.col("name")), F.lit('"><value>'), xml_escape(F.col("value")), F.lit("</value></field>"))
    some = fields.where("is_root and name <> '' and value is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("field_ord", item.alias("item")))), lambda p: p["item"])
    body = F.array_join(ordered, "")
    head = '<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>'
    return some.groupBy("file_id").agg(F.concat(F.lit(head), body, F.lit("</fields></xfdf>")).alias("xfdf"))


def import_xfdf(xfdf: DataFrame) -> DataFrame:
    """``file_id, name, value``; of fields of one name the last counts."""
    found = F.regexp_extract_all("xfdf", F.lit(r'(?s)<field name="([^"]*)">\s*<value>(.*?)</value>'), F.lit(0))
    rows = xfdf.select("file_id", F.posexplode(found).alias("n", "m"))
    undo = lambda c: _unescape(F.regexp_extract("m", r'(?s)<field name="([^"]*)">\s*<value>(.*?)</value>', c))
    pairs = rows.select("file_id", "n", undo(1).alias("name"), undo(2).alias("value"))
    return pairs.groupBy("file_id", "name").agg(F.max_by("value", "n").alias("value"))


def _unescape(x: Column) -> Column:
    for plain, coded in (("'", "&apos;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        x = F.replace(x, F.lit(coded), F.lit(plain))
    return x


def fdf(pairs: list[tuple[str, str]]) -> bytes:
    """An FDF file of field names and values."""
    fields = [{"T": n.encode("cp1252", "replace"), "V": v.encode("cp1252", "replace")} for n, v in pairs]
    return b"%FDF-1.2\n1 0 obj\n" + write({"FDF": {"Fields": fields}}) + b"\nendobj\ntrailer\n" + write({"Root": Ref(1, 0)}) + b"\n%%EOF\n"


def export_fdf(fields: DataFrame) -> DataFrame:
    """``file_id, fdf`` of root fields with a name and a value, in their order."""
    some = fields.where("is_root and name <> '' and value is not null")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("field_ord", "name", "value"))), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fdf([(p["name"], p["value"]) for p in row]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["file_id", "fdf"])

    kind = fields.schema["file_id"].dataType.simpleString()
    return some.groupBy("file_id").agg(pairs.alias("pairs")).mapInArrow(emit, f"file_id {kind}, fdf binary")


def import_fdf(files: DataFrame) -> DataFrame:
    """``file_id, name, value`` of ``file_id, fdf``; of fields of one name the last counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = dict(parse_fdf(batch.column(1)[i].as_py() or b""))
                own = batch.column(0).take(pa.array([i] * len(pairs), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array(pairs.keys(), pa.string()), pa.array(pairs.values(), pa.string())], ["file_id", "name", "value"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "fdf").mapInArrow(emit, f"file_id {kind}, name string, value string")


def xfa_packet(packets: DataFrame, name: str) -> DataFrame:
    """``file_id, xml`` of the first packet of a name, whatever its case."""
    return packets.where(F.lower("name") == name.lower()).groupBy("file_id").agg(F.min_by("xml", "ord").alias("xml"))


def xfa_document(packets: DataFrame) -> DataFrame:
    """``file_id, xml``: all packets in their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "xml"))), lambda p: p["xml"])
    return packets.groupBy("file_id").agg(F.array_join(ordered, "").alias("xml"))


def parse_fdf(data: bytes) -> list[tuple[str, str]]:
    """Field names and values of an FDF file, names of nested fields joined by dots."""
    m = re.search(rb"obj\b", data)
    try:
        head, _ = parse(data, m.end()) if m else ({}, 0)
    except ParseError:
        return []
    out: list[tuple[str, str]] = []
    stack = [("", f) for f in reversed((head.get("FDF") or {}).get("Fields") or [])] if isinstance(head, dict) else []
    while stack:
        prefix, f = stack.pop()
        if isinstance(f, dict):
            name = ".".join(x for x in (prefix, text_string(f.get("T"))) if x)
            if "V" in f and (value := field_text(f["V"])) is not None:
                out.append((name, value))
            stack += [(name, k) for k in reversed(f.get("Kids") or [])]
    return out


def xfdf_pairs(text: str) -> list[tuple[str, str]]:
    return [(html.unescape(n), html.unescape(v)) for n, v in re.findall(r'(?s)<field name="([^"]*)">\s*<value>(.*?)</value>', text)]


def default_appearance(da: Column) -> dict[str, Column]:
    """Font, size and colour of a ``/DA`` string."""
    number = r"([-+]?[0-9.]+)"
    pick = lambda pattern, i: F.nullif(F.regexp_extract(da, pattern, i), F.lit(""))
    rgb = rf"{number}\s+{number}\s+{number}\s+rg\b"
    gray = pick(rf"{number}\s+g\b", 1).cast("double")
    font = rf"/(\S+)\s+{number}\s+Tf\b"
    colors = {c: F.coalesce(pick(rgb, i + 1).cast("double"), gray, F.lit(0.0)) for i, c in enumerate("rgb")}
    return {"font": pick(font, 1), "size": pick(font, 2).cast("double")} | colors


def set_values(files: DataFrame, values: DataFrame) -> DataFrame:
    """Files with new field values (``file_id, name, value``), a rewrite with ``NeedAppearances`` set."""
    by_file = values.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values"))
    joined = files.join(by_file, "file_id").select("file_id", "content", F.to_json("values").alias("values"))
    packed = joined.select("file_id", F.concat(F.encode("values", "UTF-8"), F.lit(b"\0"), "content").alias("content"))

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        import json

        new, _, body = content.partition(b"\0")
        new = json.loads(new)
        pdf = load(body)
        form = pdf.resolve(pdf.catalog.get("AcroForm")) or {}
        changes: dict[Ref, Any] = {}
        for ref in pdf.resolve(form.get("Fields")) or []:
            node = pdf.resolve(ref)
            name = text_string(node.get("T")) if isinstance(node, dict) else None
            if name in new:
                value = new[name]
                coded: Any = Name(value) if node.get("FT") == "Btn" else value.encode("cp1252") if _fits(value) else b"\xfe\xff" + value.encode("utf-16-be")
                changes[ref] = node | {"V": coded}
        root = pdf.trailer["Root"]
        changes[root] = pdf.catalog | {"AcroForm": form | {"NeedAppearances": True}}
        yield key, _rewritten(pdf, changes)

    return each_content(packed, change)


def _fits(text: str) -> bool:
    try:
        text.encode("cp1252")
    except UnicodeEncodeError:
        return False
    return True


def appearance(kind: str, value: str | None, width: float, height: float, da: str = "/Helv 12 Tf 0 g") -> bytes:
    """The content of a field's appearance, by its kind."""
    text = (value or "").encode("cp1252", "replace")
    size = re.search(r"([\d.]+)\s+Tf", da)
    points = float(size[1]) if size and float(size[1]) else min(12.0, height * 0.7)
    at = write((height - points) / 2 + points * 0.2)
    style = da.encode("latin-1", "replace")
    frame = b"q 0 0 %s %s re W n " % (write(float(width)), write(float(height)))
    if kind in ("text", "combo", "list", "signature"):
        lines = (value or "").split("\n") if kind in ("list", "text") else [value or ""]
        body = b" T* ".join(write(x.encode("cp1252", "replace")) + b" Tj" for x in lines)
        return b"/Tx BMC " + frame + b"BT " + style + b" %s TL 2 %s Td " % (write(points * 1.2), at) + body + b" ET Q EMC"
    if kind == "push_button":
        return frame + b"0.9 g 0 0 %s %s re f BT " % (write(float(width)), write(float(height))) + style + b" 2 %s Td " % at + write(text) + b" Tj ET Q"
    if kind in ("checkbox", "radio"):
        on = value not in (None, "", "Off")
        mark = b"BT /ZaDb %s Tf 2 %s Td (%s) Tj ET " % (write(points), at, b"4" if kind == "checkbox" else b"l") if on else b""
        return frame + mark + b"Q"
    return b""


def flatten(files: DataFrame) -> DataFrame:
    """Files whose form fields are drawn into their pages, and the form taken away."""

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        pdf = load(content)
        yield key, _flattened(pdf)

    return each_content(files, change)


def _flattened(pdf: Pdf) -> bytes:
    form = pdf.resolve(pdf.catalog.get("AcroForm")) or {}
    fields = {r for r in pdf.resolve(form.get("Fields")) or [] if isinstance(r, Ref)}
    pages = pdf.pages()
    top = max((r.num for r, _, _ in pdf.all_objects()), default=0) + 1
    changes: dict[Ref, Any] = {}
    drawn: dict[int, list[bytes]] = {}
    for ref in sorted(fields):
        node = pdf.resolve(ref)
        box = pdf.box(node.get("Rect")) if isinstance(node, dict) else None
        if box is None or not pages:
            continue
        home = next((p for p in pages if p.ref == node.get("P") or ref in (pdf.resolve(p.dict.get("Annots")) or [])), pages[0])
        flags = node.get("Ff") if isinstance(node.get("Ff"), int) else 0
        body = appearance(field_kind(node.get("FT"), flags), field_text(pdf.resolve(node.get("V"))), box[2] - box[0], box[3] - box[1], text_string(node.get("DA")) or "/Helv 12 Tf 0 g")
        drawn.setdefault(home.index, []).append(b"q 1 0 0 1 %s %s cm " % (write(box[0]), write(box[1])) + body + b" Q")
    helv = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
    for page in pages:
        annots = pdf.resolve(page.dict.get("Annots")) or []
        kept = [a for a in annots if a not in fields]
        new = {k: v for k, v in page.dict.items() if k != "Annots"} | ({"Annots": kept} if kept else {})
        if page.index in drawn:
            changes[Ref(top, 0)] = Stream({}, b"\n".join(drawn[page.index]))
            old = pdf.resolve(page.dict.get("Contents"))
            old = old if isinstance(old, list) else [page.dict["Contents"]] if "Contents" in page.dict else []
            fonts = pdf.resolve(page.resources.get("Font"))
            new |= {"Contents": [*old, Ref(top, 0)], "Resources": page.resources | {"Font": {"Helv": helv} | (fonts if isinstance(fonts, dict) else {})}}
            top += 1
        changes[page.ref] = new
    changes[pdf.trailer["Root"]] = {k: v for k, v in pdf.catalog.items() if k != "AcroForm"}
    return _rewritten(pdf, changes)
