"""Registered resources, validation of content, reduced images, and reports of what passes save."""

import numpy as np
import pytest

from folioframe.functions.content import instructions
from folioframe.functions.content_writer import ContentWriter, Resources
from folioframe.functions.cos import Name, Ref, Stream
from folioframe.functions.document import load
from folioframe.functions.filters import decode
from folioframe.functions.writing import write_file
from folioframe.operators import compression, images, signatures, writers
from folioframe.sources import corpus


def page_of(writer, resources):
    page = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(20, 0), "Resources": resources.entries}
    return write_file(*corpus._simple(resources.objects | {Ref(3, 0): page, Ref(20, 0): Stream({}, writer.data())}, {}))


def test_registered_resources():
    resources = Resources(30, {"Font": {"F": Ref(9, 0)}})
    assert resources.font() == "F1" and resources.font("Courier") == "F2"
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    alpha = np.arange(8, dtype=np.uint8).reshape(2, 4)
    plain, shaded = resources.png(images.png(pixels)), resources.png(images.png(pixels, alpha))
    gray = resources.png(images.png(pixels[..., :1], alpha))
    form = resources.form(b"0 0 1 1 re f", [0, 0, 10, 10])
    assert len({plain, shaded, gray, form}) == 4
    writer = ContentWriter().draw_image(plain, 1, 2, 30, 40).draw_image(shaded, 0, 0, 5, 5)
    pdf = load(page_of(writer, resources))
    named = pdf.pages()[0].resources["XObject"]
    found = pdf.resolve(named[shaded])
    assert pdf.decoded(found) == pixels.tobytes() and pdf.decoded(pdf.resolve(found.dict["SMask"])) == alpha.tobytes()
    assert pdf.decoded(pdf.resolve(named[gray])) == pixels[..., 0].tobytes()
    assert [i.op for i in instructions(pdf.content(pdf.pages()[0]))].count("Do") == 2
    with pytest.raises(ValueError):
        resources.image(2, 2, b"short")
    with pytest.raises(ValueError):
        resources.png(b"junk")


def test_content_is_checked_and_closed():
    writer = ContentWriter().save_state().begin_text().show_text(b"x")
    assert writer.problems() == ["Tj without a font", "text is not ended", "states are not restored"]
    assert writer.close().data().endswith(b"ET\nQ") and writer.problems() == ["Tj without a font"]
    assert ContentWriter().restore_state().end_text().show_text(b"x").problems() == ["Q without q", "ET without BT", "Tj outside of text", "Tj without a font"]


def test_scaling():
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert images.scaled(image, 4, 4).tolist() == image.tolist()
    assert images.scaled(image, 1, 1).shape == (1, 1, 3) and abs(int(images.scaled(image, 1, 1)[0, 0, 0]) - image[..., 0].mean()) <= 1
    assert images.spot_to_gray(np.array([0, 255], np.uint8)).tolist() == [255, 0]
    assert images.soft_mask({"Width": 1, "Height": 1}, b"\x07", (2, 2, 3)) is None


def test_presets_and_reports(spark):
    gray = np.repeat(np.arange(200, dtype=np.uint8).repeat(200).reshape(200, 200, 1), 3, axis=2)
    noise = np.random.default_rng(1).integers(0, 255, (200, 200, 3), np.uint8)
    resources = Resources(30)
    names = [resources.image(200, 200, x.tobytes()) for x in (gray, noise)]
    used, unused = resources.font(), resources.font("Courier")
    writer = ContentWriter().draw_image(names[0], 0, 0, 400, 400).draw_image(names[1], 0, 0, 72, 72)
    writer.begin_text().set_font(Name(used), 9).show_text(b"x").end_text()
    data = page_of(writer, resources)
    assert len({compression.Options.preset(m) for m in ("extreme", "recommended", "less")}) == 3
    files = spark.createDataFrame([(1, data)], "file_id long, content binary")
    sizes = {}
    for mode in ("extreme", "recommended", "less"):
        made = compression.compress(files, compression.Options.preset(mode)).first().content
        pdf = load(bytes(made))
        page = pdf.pages()[0]
        sizes[mode] = len(made)
        first, second = (pdf.resolve(page.resources["XObject"][n]) for n in names)
        want = {"extreme": 96, "recommended": 150, "less": 200}[mode]
        assert second.dict["Width"] == want and len(pdf.decoded(second)) == want * want * 3
        assert first.dict["ColorSpace"] == ("DeviceGray" if mode == "extreme" else "DeviceRGB")
        assert set(page.resources["Font"]) == ({used, unused} if mode == "less" else {used})
    assert sizes["extreme"] < sizes["recommended"] < sizes["less"]
    passes = compression.pass_report(files, compression.Options.preset("extreme"))
    rows = {r["pass"]: r["bytes"] for r in passes.collect()}
    assert list(rows) and rows["images"] < rows["cleanup"] <= rows["start"]
    told = {r["pass"]: r for r in compression.summary(passes).collect()}
    assert told["images"].saved == rows["cleanup"] - rows["images"] and "1 files" in told["images"].summary


def test_version_is_kept_for_xfa_and_aes():
    options = compression.Options(pack=False, version="1.4")
    plain = write_file(*corpus._simple({}, {}))
    xfa = corpus.xfa_pdf({"c_custkey": 1, "c_name": "n"})
    assert compression._compressed(load(plain), options).startswith(b"%PDF-1.4")
    assert compression._compressed(load(xfa), options).startswith(b"%PDF-1.7")
    files = {"EmbeddedFiles": {"Names": []}, "Dests": {"Names": []}}
    kept = load(compression._compressed(load(write_file(*corpus._simple({}, {"Names": files}))), compression.Options()))
    assert set(kept.catalog["Names"]) == {"Dests"}


def test_jpeg_is_passed_through(spark):
    row = [(1, 5, "stream", "Image", ["DCTDecode"], b"jpeg"), (1, 6, "stream", "Image", ["FlateDecode"], b"x")]
    table = spark.createDataFrame(row, "file_id long, obj_num long, kind string, subtype string, filters array<string>, raw binary")
    assert [(r.obj_num, bytes(r.jpeg)) for r in images.jpeg_table(table).collect()] == [(5, b"jpeg")]


def test_certification_levels(spark):
    found = spark.createDataFrame([(i, 1, level) for i, level in enumerate([1, 2, 2, 3, 1, None])], "file_id long, obj_num long, mdp_level int")
    changes = [(0, "permitted", "Sig", None), (1, "unauthorized", "Annot", "Widget"), (2, "unauthorized", "Annot", "Text"), (3, "unauthorized", "Annot", "Text"), (4, "permitted", "Catalog", None)]
    table = spark.createDataFrame(changes, "file_id long, verdict string, type string, subtype string")
    assert {r.file_id: r.compliant for r in signatures.mdp_compliance(found, table).collect()} == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_information_is_set_and_removed(spark):
    data = write_file(*corpus._simple({}, {}))
    files = spark.createDataFrame([(1, data)], "file_id long, content binary")
    values = spark.createDataFrame([(1, "Title", "é"), (1, "Author", None)], "file_id long, key string, value string")
    pdf = load(bytes(writers.set_info(files, values).first().content))
    assert pdf.resolve(pdf.trailer["Info"]) == {"Title": b"\xfe\xff\x00\xe9"}
    assert decode(b"41>", "ASCIIHexDecode") == b"A"
