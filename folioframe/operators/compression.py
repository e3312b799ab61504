"""Size reduction as passes over files, and a report of what each file gained."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.content import drawn_widths, instructions
from folioframe.functions.cos import Name, Ref, Stream, renumbered, targets, write
from folioframe.functions.document import Pdf, load
from folioframe.functions.filters import FilterError, encode, names
from folioframe.functions.writing import write_file
from folioframe.operators import images
from folioframe.operators.writers import each_content, estimated_size, plain_objects
from folioframe.sources.pdf import each_file, opened

# What a cleanup takes out of the catalog, of pages and of the information dictionary.
CATALOG_KEYS = ("Metadata", "StructTreeRoot", "MarkInfo", "PieceInfo", "OCProperties", "OutputIntents")
PAGE_KEYS = ("Metadata", "Thumb", "PieceInfo", "StructParents")
INFO_KEYS = ("Keywords", "Subject", "Creator", "Producer", "CreationDate", "ModDate")
CODED = frozenset(("DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode"))


@dataclass(frozen=True)
class Options:
    """Which passes run. ``pack`` writes object streams with a cross-reference stream (B6)."""

    cleanup: bool = True
    streams: bool = True
    dedup: bool = True
    unused: bool = True
    pack: bool = True
    linearized_mark: bool = False
    image_dpi: float | None = None  # images shown at a higher resolution are scaled down to it; None leaves images alone
    gray: bool = False  # images that look gray become gray, and CMYK ones RGB
    fonts: bool = False  # pages lose the fonts that they never select
    version: str | None = None  # of files that use neither AES nor XFA (R6)

    @staticmethod
    def preset(mode: str) -> Options:
        return {
            "extreme": Options(image_dpi=96, gray=True, fonts=True),
            "recommended": Options(image_dpi=150, fonts=True),
            "less": Options(unused=False, pack=False),
        }[mode]


def compress(files: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Smaller files with the same pages. The passes run in a fixed order: cleanup, images, fonts, streams, dedup, unused, version."""

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        pdf = load(content)
        yield key, _compressed(pdf, options)

    return each_content(files, change)


def _compressed(pdf: Pdf, options: Options, trace: list[tuple[str, int]] | None = None) -> bytes:
    objects = plain_objects(pdf)
    root, info = pdf.trailer["Root"], pdf.trailer.get("Info")
    keep = {k: pdf.trailer[k] for k in ("Root", "Info", "ID") if k in pdf.trailer}

    def passed(name: str) -> None:
        if trace is not None:
            trace.append((name, sum(estimated_size(v) for v in objects.values())))

    passed("start")
    if options.cleanup:
        catalog = {k: v for k, v in objects[root].items() if k not in CATALOG_KEYS}
        if isinstance(trees := pdf.resolve(catalog.get("Names")), dict):
            catalog["Names"] = {k: v for k, v in trees.items() if k != "EmbeddedFiles"}
        objects[root] = catalog
        for page in pdf.pages():
            objects[page.ref] = {k: v for k, v in objects[page.ref].items() if k not in PAGE_KEYS}
        if isinstance(info, Ref) and isinstance(objects.get(info), dict):
            objects[info] = {k: v for k, v in objects[info].items() if k not in INFO_KEYS}
        passed("cleanup")
    if options.image_dpi is not None or options.gray:
        objects = objects | reduced_images(pdf, options.image_dpi, options.gray)
        passed("images")
    if options.fonts:
        objects = objects | without_unused_fonts(pdf, objects)
        passed("fonts")
    if options.streams:
        objects = {r: recompressed(pdf, v) if isinstance(v, Stream) else v for r, v in objects.items()}
        passed("streams")
    if options.dedup:
        objects = deduplicated(objects)
        passed("dedup")
    if options.linearized_mark:
        objects[root] = objects[root] | {"Linearized": 1}
    if options.unused:
        objects = reachable_only(objects, keep)
        passed("unused")
    version = pdf.version or "1.7"
    form = pdf.resolve(pdf.catalog.get("AcroForm"))
    if options.version and not (isinstance(form, dict) and "XFA" in form) and not (pdf.crypt and "AESV2" in (pdf.crypt.strings, pdf.crypt.streams)):
        version = options.version
    return write_file(objects, keep, max(version, "1.5") if options.pack else version, "stream" if options.pack else "table", options.pack)


def shown_dpi(pdf: Pdf) -> dict[Ref, float]:
    """The least resolution at which each image is shown on a page; without a matrix it fills the page."""
    out: dict[Ref, float] = {}
    for page in pdf.pages():
        named = pdf.resolve(page.resources.get("XObject"))
        named = named if isinstance(named, dict) else {}
        width = abs(page.media_box[2] - page.media_box[0]) if page.media_box else 612.0
        for name, points in drawn_widths(pdf.content(page)):
            ref = named.get(name)
            image = pdf.resolve(ref)
            pixels = pdf.resolve(image.dict.get("Width")) if isinstance(image, Stream) and image.dict.get("Subtype") == "Image" else None
            points = width if points is None else points
            if isinstance(ref, Ref) and isinstance(pixels, int) and points > 0:
                out[ref] = min(out.get(ref, float("inf")), pixels / (points / 72))
    return out


def reduced_images(pdf: Pdf, most_dpi: float | None, gray: bool) -> dict[Ref, Any]:
    """Images anew, where they get smaller by it: scaled down to a resolution, gray or RGB. Coded ones and masks by colour stay."""
    dpi, out = shown_dpi(pdf), {}
    for ref, value, _ in pdf.all_objects():
        if not isinstance(value, Stream) or value.dict.get("Subtype") != "Image" or value.dict.get("ImageMask") or "Mask" in value.dict or CODED & set(names(value.dict.get("Filter"))):
            continue
        head = {k: pdf.resolve(v) for k, v in value.dict.items()}
        space = head.get("ColorSpace")
        head["ColorSpace"] = [pdf.resolve(v) for v in space] if isinstance(space, list) else space
        try:
            image = images.pixels(head, value.raw)
        except (ValueError, KeyError, IndexError, TypeError):
            continue
        height, width = image.shape[:2]
        if most_dpi is not None and dpi.get(ref, 0) > most_dpi:
            width, height = (max(1, math.floor(n * most_dpi / dpi[ref] + 0.5)) for n in (width, height))
            image = images.scaled(image, width, height)
        elif not gray:
            continue
        if gray and image.shape[2] == 3 and images.visually_gray(image):
            image = image[..., 1:2]
        data = encode(image.tobytes(), ["FlateDecode"])
        if len(data) < len(value.raw) or (width, height) != (head["Width"], head["Height"]):
            own = {k: v for k, v in value.dict.items() if k not in ("Filter", "DecodeParms", "Length", "Decode")}
            own |= {"Width": width, "Height": height, "ColorSpace": Name("DeviceGray" if image.shape[2] == 1 else "DeviceRGB"), "Filter": Name("FlateDecode")}
            out[ref] = Stream(own, data)
    return out


def without_unused_fonts(pdf: Pdf, objects: dict[Ref, Any]) -> dict[Ref, Any]:
    """Pages with the fonts that they select; those with forms that may borrow the page's fonts stay."""
    out: dict[Ref, Any] = {}
    for page in pdf.pages():
        fonts, forms = (pdf.resolve(page.resources.get(k)) for k in ("Font", "XObject"))
        drawn = [pdf.resolve(v) for v in forms.values()] if isinstance(forms, dict) else []
        if not isinstance(fonts, dict) or any(isinstance(x, Stream) and x.dict.get("Subtype") == "Form" and "Resources" not in x.dict for x in drawn):
            continue
        used = {str(i.operands[0]) for i in instructions(pdf.content(page)) if i.op == "Tf" and i.operands}
        if not set(fonts) <= used:
            out[page.ref] = objects[page.ref] | {"Resources": page.resources | {"Font": {k: v for k, v in fonts.items() if k in used}}}
    return out


def may_shrink(data: bytes) -> bool:
    """False where deflate surely does not shorten it: it takes 7 bytes and 10 bits, and 8 bits for each distinct byte."""
    return len(data) > 12 or len(data) > 8 + len(set(data))


def recompressed(pdf: Pdf, stream: Stream) -> Stream:
    """The stream deflated anew if that is smaller; coded images stay."""
    if not (stream.dict.keys() & {"Filter", "F"}) and not may_shrink(stream.raw) or CODED & set(names(stream.dict.get("Filter"))):
        return stream
    try:
        data = encode(pdf.decoded(stream), ["FlateDecode"])
    except FilterError:
        return stream
    if len(data) >= len(stream.raw):
        return stream
    head = {k: v for k, v in stream.dict.items() if k not in ("Filter", "DecodeParms", "Length")}
    return Stream(head | {"Filter": Name("FlateDecode")}, data)


def deduplicated(objects: dict[Ref, Any], least_entries: int = 4) -> dict[Ref, Any]:
    """Equal streams and larger dictionaries merged into the one of the smallest number (B7: with their dictionaries)."""
    alike: dict[tuple, list[Ref]] = {}  # equal objects have equal data and references, which most others have not
    for ref in sorted(objects):
        value = objects[ref]
        if isinstance(value, Stream):
            alike.setdefault((bytes(value.raw), *targets(value)), []).append(ref)
        elif isinstance(value, dict) and len(value) >= least_entries and value.get("Type") not in ("Page", "Pages", "Catalog"):
            alike.setdefault((None, *targets(value)), []).append(ref)
    new: dict[Ref, Ref] = {}
    for some in alike.values():
        first: dict[bytes, Ref] = {}
        for ref in some if len(some) > 1 else []:
            same = first.setdefault(write(objects[ref]), ref)
            if same is not ref:
                new[ref] = same
    return {r: renumbered(v, new) for r, v in objects.items() if r not in new} if new else objects


def reachable_only(objects: dict[Ref, Any], trailer: dict[str, Any]) -> dict[Ref, Any]:
    seen: set[Ref] = set()
    todo = targets(trailer)
    while todo:
        ref = todo.pop()
        if ref in seen or ref not in objects:
            continue
        seen.add(ref)
        targets(objects[ref], todo)
    return {r: v for r, v in objects.items() if r in seen}


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``file_id, bytes_before, bytes_after, reduction_pct``."""
    old = before.select("file_id", F.octet_length("content").cast("long").alias("bytes_before"))
    new = after.select("file_id", F.octet_length("content").cast("long").alias("bytes_after"))
    gain = F.round((1 - F.col("bytes_after") / F.col("bytes_before")) * 100, 2).alias("reduction_pct")
    return old.join(new, "file_id").select("file_id", "bytes_before", "bytes_after", gain)


def pass_report(files: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """``file_id, ord, pass, bytes``: about how many bytes the objects take after each pass."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        trace: list[tuple[str, int]] = []
        pdf = opened(content, False)
        if pdf and not pdf.locked:
            _compressed(pdf, options, trace)
        yield from ((i, name, size) for i, (name, size) in enumerate(trace))

    return each_file(files, rows, "ord int, pass string, bytes long")


def summary(passes: DataFrame) -> DataFrame:
    """``pass, files, saved, summary``: what each pass saved over all files."""
    before = F.lag("bytes").over(Window.partitionBy("file_id").orderBy("ord"))
    saved = passes.withColumn("saved", before - F.col("bytes")).where("saved is not null").groupBy("pass").agg(F.count("*").alias("files"), F.sum("saved").alias("saved"))
    return saved.withColumn("summary", F.format_string("%s: %d bytes saved in %d files", "pass", "saved", "files"))
