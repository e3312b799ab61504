"""Seeded PDF collections: rows of the driver's tables rendered to PDF bytes, a file per row.

What a file looks like (version, page size, rotation, filters, cross-reference form, font
kind, damage) follows from its key, so the expected answers can be stated over the seed
tables. Nothing is written to disk; ``files`` columns are ``file_id BIGINT, content BINARY``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.cos import Hex, Name, Ref, Stream, write
from folioframe.functions.filters import encode
from folioframe.functions.writing import write_file, write_update, write_updates

LINE_CHARS, PAGE_LINES = 80, 40
FONT_SIZE, LEADING, TOP = 10, 12, 700
CHAINS: list[list[str]] = [[], ["FlateDecode"], ["ASCIIHexDecode"], ["ASCII85Decode", "FlateDecode"], ["RunLengthDecode"], ["LZWDecode"]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built(rows: DataFrame, build: Callable[[dict[str, Any]], bytes]) -> DataFrame:
    """Files from rows; ``file_id`` is the row's first column. Rows are dealt out first, as building costs more than moving them."""
    key = rows.columns[0]
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500).to_pylist()
                contents = pa.array([build(r) for r in part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in part], pa.int64()), contents], ["file_id", "content"])

    return rows.mapInArrow(emit, "file_id long, content binary")


def filtered(data: bytes, chain: list[str], extra: dict[str, Any] | None = None) -> Stream:
    head = dict(extra or {})
    if chain:
        head["Filter"] = [Name(c) for c in chain] if len(chain) > 1 else Name(chain[0])
    return Stream(head, encode(data, chain))


def text_lines(text: str | None) -> list[str]:
    flat = re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", text or "")
    return [flat[i : i + LINE_CHARS] for i in range(0, len(flat), LINE_CHARS)]


def needs_type0(key: int, text: str) -> bool:
    if key % 7 == 3:
        return True
    try:
        text.encode("cp1252")
    except UnicodeEncodeError:
        return True
    return False


def identity_font(objects: dict[Ref, Any], at: int, text: str) -> None:
    """A Type0 font at object ``at`` whose codes are numbered by first use, with a ToUnicode map."""
    chars = sorted(set(text))
    pairs = b"\n".join(b"<%04X> <%s>" % (i + 1, c.encode("utf-16-be").hex().upper().encode()) for i, c in enumerate(chars))
    cmap = b"/CMapName /X def\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n%d beginbfchar\n%s\nendbfchar\n" % (len(chars), pairs)
    info = {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}
    below = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Made"), "CIDSystemInfo": info, "DW": 600, "W": [1, [500], 2, 9, 550]}
    objects[Ref(at, 0)] = {
        "Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Made"), "Encoding": Name("Identity-H"),
        "DescendantFonts": [Ref(at + 1, 0)], "ToUnicode": Ref(at + 2, 0),
    }
    objects[Ref(at + 1, 0)] = below
    objects[Ref(at + 2, 0)] = filtered(cmap, ["FlateDecode"])


def shown(text: str, codes: dict[str, int] | None) -> bytes:
    if codes is None:
        return write(text.encode("cp1252"))
    return write(Hex(b"".join(codes[c].to_bytes(2, "big") for c in text)))


def page_stream(lines: list[str], codes: dict[str, int] | None) -> bytes:
    body = [b"BT /F1 %d Tf %d TL 1 0 0 1 50 %d Tm" % (FONT_SIZE, LEADING, TOP)]
    for i, line in enumerate(lines):
        body.append((b"" if i == 0 else b"T* ") + shown(line, codes) + b" Tj")
    return b"\n".join([*body, b"ET"])


def media_box(key: int) -> list[float]:
    return [[0, 0, 612, 792], [0, 0, 595, 842], [10, 20, 510 + key % 50, 720]][key % 3]


def permission_bits(key: int) -> int:
    """``/P`` as a signed 32-bit number: the eight user bits from the key, the rest as the standard sets them."""
    user = sum(1 << bit for i, bit in enumerate((2, 3, 4, 5, 8, 9, 10, 11)) if (key >> i) & 1)
    return (0xFFFFF0C0 | user) - (1 << 32)


def document_objects(key: int, text: str | None) -> tuple[dict[Ref, Any], dict[str, Any]]:
    """A document of fixed-width lines: catalog 1, page tree 2, font 3 to 5, info 6, pages from 10 in pairs."""
    lines = text_lines(text)
    flat = "".join(lines)
    composite = needs_type0(key, flat)
    codes = {c: i + 1 for i, c in enumerate(sorted(set(flat)))} if composite else None
    objects: dict[Ref, Any] = {}
    if composite:
        identity_font(objects, 3, flat)
    else:
        objects[Ref(3, 0)] = {
            "Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding"),
            "FirstChar": 32, "LastChar": 34, "Widths": [278, 278, 355],
        }
    count = max(1, -(-len(lines) // PAGE_LINES))
    resources = {"Font": {"F1": Ref(3, 0)}}
    kids = []
    for p in range(count):
        page, stream = Ref(10 + 2 * p, 0), Ref(11 + 2 * p, 0)
        kids.append(page)
        objects[page] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": stream}
        if key % 2 == 0:
            objects[page]["Resources"] = resources
        body = page_stream(lines[p * PAGE_LINES : (p + 1) * PAGE_LINES], codes)
        objects[stream] = filtered(body, CHAINS[key % len(CHAINS)])
    objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": kids, "Count": count, "MediaBox": media_box(key), "Rotate": 90 * (key % 4)}
    if key % 2:
        objects[Ref(2, 0)]["Resources"] = resources
    objects[Ref(1, 0)] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    objects[Ref(6, 0)] = {"Title": b"document %d" % key, "Producer": b"folioframe"}
    return objects, {"Root": Ref(1, 0), "Info": Ref(6, 0)}


def document_version(key: int) -> str:
    return f"1.{4 + key % 4}"


def document_pdf(row: dict[str, Any]) -> bytes:
    key = row["doc_id"]
    objects, trailer = document_objects(key, row["text"])
    stream = key % 3 == 0
    return write_file(objects, trailer, document_version(key), "stream" if stream else "table", packed=stream)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PDF for each document."""
    return built(table(spark, sf_dir, "documents").select("doc_id", "text"), document_pdf)


def damaged_pdf(row: dict[str, Any]) -> bytes:
    """By key: whole, no header, lost startxref, shifted offsets, a second copy of an object."""
    data, key = document_pdf(row), row["doc_id"]
    if key % 5 == 1:
        return data[9:]
    if key % 5 == 2:
        return data.replace(b"startxref", b"startxxxx")
    if key % 5 == 3:
        return data.replace(b"\n%\xe2\xe3\xcf\xd3\n", b"\n%\xe2\xe3\xcf\xd3 shifted\n", 1)
    if key % 5 == 4:
        return data[: data.rindex(b"startxref")]
    return data


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "documents").select("doc_id", "text"), damaged_pdf)


def _simple(extra: dict[Ref, Any], catalog: dict[str, Any], trailer: dict[str, Any] | None = None, pages: int = 1) -> tuple[dict[Ref, Any], dict[str, Any]]:
    """Blank pages at objects 3, 4, ... under catalog 1 and page tree 2."""
    kids = [Ref(3 + i, 0) for i in range(pages)]
    objects: dict[Ref, Any] = {k: {"Type": Name("Page"), "Parent": Ref(2, 0)} for k in kids}
    objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": kids, "Count": pages, "MediaBox": [0, 0, 612, 792]}
    objects[Ref(1, 0)] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | catalog
    return objects | extra, {"Root": Ref(1, 0)} | (trailer or {})


def info_pdf(row: dict[str, Any]) -> bytes:
    text = row["text"] or ""
    try:
        title = text.encode("cp1252") if row["item_id"] % 2 else b"\xfe\xff" + text.encode("utf-16-be")
    except UnicodeEncodeError:
        title = b"\xfe\xff" + text.encode("utf-16-be")
    escaped = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    xmp = (
        '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description '
        'xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">'
        f"{escaped}</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>"
    )
    extra = {
        Ref(20, 0): {"Title": title, "Author": b"author %d" % row["item_id"], "CreationDate": b"D:20240102030405+00'00'"},
        Ref(21, 0): filtered(xmp.encode(), ["FlateDecode"], {"Type": Name("Metadata"), "Subtype": Name("XML")}),
    }
    return write_file(*_simple(extra, {"Metadata": Ref(21, 0)}, {"Info": Ref(20, 0)}))


def test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PDF for each benchmark item, with information dictionary and XMP packet."""
    return built(table(spark, sf_dir, "benchmark").select("item_id", "text"), info_pdf)


def outline_pdf(row: dict[str, Any]) -> bytes:
    """An outline: the conversation, under it its turns, under each turn of the assistant a note."""
    turns = sorted(row["turns"], key=lambda t: t["turn"])
    objects: dict[Ref, Any] = {}
    top, root = Ref(1001, 0), Ref(1000, 0)
    at = 1002
    refs = []
    for t in turns:
        item = {"Title": f"{t['role']} {t['turn']}".encode("latin-1", "replace"), "Parent": top, "Dest": [Ref(3, 0), Name("XYZ"), 0, 700, None]}
        ref, at = Ref(at, 0), at + 1
        if t["role"] == "assistant":
            note, at = Ref(at, 0), at + 1
            objects[note] = {"Title": b"note", "Parent": ref, "A": {"S": Name("URI"), "URI": b"http://example.com/%d" % t["turn"]}}
            item |= {"First": note, "Last": note, "Count": -1}
        objects[ref] = item
        refs.append(ref)
    for a, b in zip(refs, refs[1:], strict=False):
        objects[a]["Next"], objects[b]["Prev"] = b, a
    if refs:
        objects[refs[-1]]["Next"] = refs[0]  # a loop, which readers must end
    head = {"Title": b"conversation %d" % row["conv_id"], "Parent": root, "Count": len(refs)}
    objects[top] = head | ({"First": refs[0], "Last": refs[-1]} if refs else {})
    objects[root] = {"Type": Name("Outlines"), "First": top, "Last": top}
    return write_file(*_simple(objects, {"Outlines": root}))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    return built(turns, outline_pdf)


def form_pdf(row: dict[str, Any]) -> bytes:
    """A form with a text field for each event type; each later event is an incremental update."""
    events = sorted(row["events"], key=lambda e: (e["ts"], e["event_id"]))
    kinds = sorted({e["event_type"] for e in events})
    ref = {k: Ref(100 + i, 0) for i, k in enumerate(kinds)}

    def field(e: dict[str, Any]) -> dict[str, Any]:
        rect = [10, 10, 110, 30]
        value = b"%d" % e["event_id"]
        return {"FT": Name("Tx"), "T": e["event_type"].encode(), "V": value, "Ff": e["event_id"] % 4, "Rect": rect, "DA": b"/Helv 9 Tf 0 0.5 1 rg"}

    first: dict[str, dict[str, Any]] = {}
    later = []
    for e in events:
        if e["event_type"] in first:
            later.append(e)
        else:
            first[e["event_type"]] = e
    fields = {ref[k]: field(e) for k, e in first.items()}
    data = write_file(*_simple(fields, {"AcroForm": {"Fields": [ref[k] for k in kinds]}}))
    return write_updates(data, [{ref[e["event_type"]]: field(e)} for e in later])


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PDF for each user of the events."""
    by_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("ts", "event_id", "event_type")).alias("events"))
    return built(by_user, form_pdf)


def graph_pdf(row: dict[str, Any]) -> bytes:
    """A customer's orders and their lines as objects. Orders of status F hang on nothing; equal parts are copies."""
    objects: dict[Ref, Any] = {}
    at, linked = 100, []
    for o in sorted(row["orders"], key=lambda o: o["o_orderkey"]):
        order, at = Ref(at, 0), at + 1
        lines = []
        for line in sorted(o["lines"] or [], key=lambda x: x["l_linenumber"]):
            part, ref, at = Ref(at, 0), Ref(at + 1, 0), at + 2
            objects[part] = filtered(b"part %d" % line["l_partkey"], [], {"Type": Name("Part"), "Key": line["l_partkey"]})
            objects[ref] = {"Type": Name("Line"), "Part": part, "Number": line["l_linenumber"], "Order": order}
            lines.append(ref)
        objects[order] = {"Type": Name("Order"), "Key": o["o_orderkey"], "Lines": lines}
        if o["o_orderstatus"] != "F":
            linked.append(order)
    return write_file(*_simple(objects, {"PieceInfo": {"Orders": linked}}))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    by_customer = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "lines")).alias("orders"))
    return built(by_customer, graph_pdf)


def image_pdf(row: dict[str, Any]) -> bytes:
    """Page p shows the part's image at a width of 72 * (p + 1) points; one font and one image are never used."""
    key = row["p_partkey"]
    width, height = 8 + key % 40, 2 + row["p_size"] % 5
    pixels = bytes((key + i) % 256 for i in range(width * height))
    head = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}
    uses = 1 + key % 3
    objects: dict[Ref, Any] = {
        Ref(50, 0): filtered(pixels, ["FlateDecode"], head),
        Ref(51, 0): filtered(pixels[::-1], [], head),
        Ref(52, 0): {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")},
    }
    resources = {"XObject": {"Im1": Ref(50, 0), "Im2": Ref(51, 0)}, "Font": {"F9": Ref(52, 0)}}
    kids = []
    for p in range(uses):
        body = b"q %d 0 0 %d 100 100 cm /Im1 Do Q\nq 9 0 0 9 0 0 cm BI /W 2 /H 2 /BPC 8 /CS /G ID \x01\x02\x03\x04 EI Q" % (72 * (p + 1), 10)
        kids.append(Ref(60 + 2 * p, 0))
        objects[Ref(61 + 2 * p, 0)] = filtered(body, [])
        objects[kids[-1]] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(61 + 2 * p, 0), "Resources": resources}
    objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": kids, "Count": uses, "MediaBox": [0, 0, 612, 792]}
    objects[Ref(1, 0)] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    return write_file(objects, {"Root": Ref(1, 0)})


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "part").select("p_partkey", "p_size"), image_pdf)


def revised_pdf(row: dict[str, Any]) -> bytes:
    """A file with an update that, by key, changes the information, adds a page's rotation, or deletes nothing."""
    key = row["s_suppkey"]
    extra = {Ref(20, 0): {"Title": row["s_name"].encode()}, Ref(21, 0): {"Kept": key}}
    data = write_file(*_simple(extra, {"Extra": Ref(21, 0)}, {"Info": Ref(20, 0)}, pages=2))
    changes: dict[Ref, Any] = {Ref(20, 0): {"Title": row["s_name"].encode() + b" again"}}
    if key % 2:
        changes[Ref(3, 0)] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Rotate": 90}
    if key % 3 == 0:
        changes[Ref(30, 0)] = {"Type": Name("Annot"), "Subtype": Name("Widget")}
    return write_update(data, changes)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), revised_pdf)


METHODS = ("RC4-40", "RC4-128", "AES-128")


def secret_pdf(row: dict[str, Any]) -> bytes:
    """A file encrypted by key: with each method, for anyone to read or under a password."""
    from folioframe.operators.security import encrypted_file

    key, text = row["s_suppkey"], row["s_name"].encode("cp1252", "replace")
    fonts = {"Font": {"F1": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}}}
    extra = {
        Ref(3, 0): {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(21, 0), "Resources": fonts},
        Ref(20, 0): {"Title": text},
        Ref(21, 0): filtered(b"BT /F1 12 Tf 72 700 Td " + write(b"Name " + text) + b" Tj ET", CHAINS[key % len(CHAINS)]),
    }
    data = write_file(*_simple(extra, {}, {"Info": Ref(20, 0)}), xref="stream" if key % 5 == 0 else "table", packed=key % 5 == 0)
    return encrypted_file(data, METHODS[key % 3], "secret" if key % 2 else "", "owner", -44)


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), secret_pdf)


def xfa_pdf(row: dict[str, Any]) -> bytes:
    key = row["c_custkey"]
    data = f"<data><name>{row['c_name']}</name><n>{key}</n></data>"
    extra = {Ref(20, 0): filtered(b"<template/>", ["FlateDecode"]), Ref(21, 0): filtered(data.encode(), CHAINS[key % len(CHAINS)])}
    xfa = [b"template", Ref(20, 0), b"Datasets" if key % 2 else b"datasets", Ref(21, 0)]
    return write_file(*_simple(extra, {"AcroForm": {"Fields": [], "XFA": xfa}}))


def xfa_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PDF with an XFA form for each customer."""
    return built(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), xfa_pdf)


def layered_pdf(row: dict[str, Any]) -> bytes:
    """Images with what they refer to: a soft mask, a colour profile of four components, a palette, and one that looks gray."""
    key = row["p_partkey"]
    width, height = 4 + key % 5, 3
    n = width * height
    head = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8}
    rgb = bytes((key + 60 * i) % 256 for i in range(3 * n))
    extra = {
        Ref(50, 0): filtered(rgb, ["FlateDecode"], head | {"ColorSpace": Name("DeviceRGB"), "SMask": Ref(54, 0)}),
        Ref(51, 0): filtered(bytes([0, 0, 0, key % 256]) * n, [], head | {"ColorSpace": [Name("ICCBased"), Ref(55, 0)]}),
        Ref(52, 0): filtered(bytes(i % 2 for i in range(n)), [], head | {"ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, Hex(bytes([1, 2, 3, 200, 100, 0]))]}),
        Ref(53, 0): filtered(bytes([key % 256] * 3) * n, [], head | {"ColorSpace": Name("DeviceRGB")}),
        Ref(54, 0): filtered(bytes(i % 256 for i in range(n)), ["FlateDecode"], head | {"ColorSpace": Name("DeviceGray")}),
        Ref(55, 0): filtered(b"profile", [], {"N": 4}),
    }
    return write_file(*_simple(extra, {"PieceInfo": {"Images": [Ref(50 + i, 0) for i in range(4)]}}))


def layered_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "part").select("p_partkey"), layered_pdf)
