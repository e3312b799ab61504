"""Known vectors, round trips and damage for the PDF modules (no Spark)."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.functions import cos, filters, fonts
from folioframe.functions.content import instructions, multiply, text_chunks
from folioframe.functions.cos import Hex, Keyword, Name, Ref, Stream, parse, write
from folioframe.functions.document import find_startxref, load, stream_entries, unpack_objects
from folioframe.functions.writing import runs, write_file, write_update
from folioframe.operators import images, security
from folioframe.operators.forms import appearance, fdf, parse_fdf
from folioframe.operators.writers import estimated_size


@pytest.mark.parametrize(
    "text,want",
    [
        (b"(a\\(b\\)(c)\\101\\n\\\r\nd\\7)", b"a(b)(c)A\nd\x07"),
        (b"<48 65 6>", Hex(b"He`")),
        (b"/A#20B%c\n", Name("A B")),
        (b"[1 -2.5 +3 .5 4. true null 5 0 R(x)]", [1, -2.5, 3, 0.5, 4.0, True, None, Ref(5, 0), b"x"]),
        (b"<</A 1/B<</C[/D]>>/A 2>>", {"A": 2, "B": {"C": [Name("D")]}}),
        (b"% note\n12", 12),
        (b"(a\rb\r\nc)", b"a\nb\nc"),
        (b"<>", Hex(b"")),
    ],
)
def test_parse(text, want):
    got = parse(text)[0]
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("text", [b"", b"(open", b"<12", b"<</A>>", b"[1 2", b"]", b"<<1 2>>", b"[" * 500])
def test_parse_damage(text):
    with pytest.raises(cos.ParseError):
        parse(text)


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.binary(max_size=12) | st.binary(max_size=6).map(Hex)
    | st.text("abcXYZ #/()<>é", max_size=6).map(Name) | st.tuples(st.integers(1, 999), st.integers(0, 9)).map(lambda t: Ref(*t))
    | st.integers(-(10**6), 10**6).map(lambda n: n / 64),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text("abcXYZ é", min_size=1, max_size=5), inner, max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(values)
def test_write_then_parse(value):
    got, _ = parse(write(value) + b" ")
    norm = lambda v: [norm(x) for x in v] if isinstance(v, list) else {k: norm(x) for k, x in v.items()} if isinstance(v, dict) else round(v, 6) if isinstance(v, float) else v
    flat = norm(got)
    assert flat == norm(value) or repr(flat).replace(".0", "") == repr(norm(value)).replace(".0", "")
    assert cos.untagged(cos.tagged(value)) == value


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"a", b"ab", b"\0\0\0\0", b"zz"]), max_size=900).map(b"".join))
def test_filters_round_trip(data):
    for name in filters.ENCODERS:
        assert filters.decode(filters.encode(data, [name]), Name(name)) == data
    chain = ["ASCII85Decode", "LZWDecode", "RunLengthDecode"]
    assert filters.decode(filters.encode(data, chain), [Name(c) for c in chain]) == data


def test_lzw_long_inputs():
    """Past the width changes and the full table (B1: early change, rebuilt table)."""
    rng = random.Random(1)
    for data in (bytes(rng.randrange(256) for _ in range(20_000)), b"ab" * 20_000, bytes(range(256)) * 60):
        assert filters.lzw_decode(filters.lzw_encode(data)) == data
        assert filters.lzw_decode(filters.lzw_encode(data, 0), 0) == data
    assert filters.lzw_decode(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"


def test_filter_vectors():
    assert filters.ascii85_decode(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert filters.ascii_hex_decode(b"4 8656C6C6F7>zz") == b"Hellop"
    assert filters.run_length_decode(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD"
    assert filters.flate_decode(filters.encode(b"x" * 500, ["FlateDecode"])[:-4]) == b"x" * 500
    up = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    assert filters.predict(up, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert filters.predict(bytes([1, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3])
    assert filters.decode(b"x", [Name("DCT")]) == b"x"
    with pytest.raises(filters.FilterError):
        filters.decode(b"x", Name("JBIG2Decode"))


def sample(pages=3, **kw):
    kids = [Ref(3 + i, 0) for i in range(pages)]
    objects = {Ref(1, 0): {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, Ref(2, 0): {"Type": Name("Pages"), "Kids": kids, "Count": pages, "MediaBox": [0, 0, 10, 20]}}
    objects |= {k: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": [Ref(50, 0), Ref(50, 0)]} for k in kids}
    objects[Ref(50, 0)] = Stream({}, b"BT ET")
    return write_file(objects, {"Root": Ref(1, 0)}, **kw)


@pytest.mark.parametrize("kw", [{}, {"xref": "stream"}, {"xref": "stream", "packed": True}])
def test_load_and_update(kw):
    data = sample(**kw)
    pdf = load(data)
    assert len(pdf.pages()) == 3 and pdf.content(pdf.pages()[0]) == b"BT ET BT ET " and pdf.report.is_clean
    newer = write_update(data, {Ref(4, 0): {"Type": Name("Page"), "Parent": Ref(2, 0), "Rotate": 450}})
    newest = write_update(newer, {Ref(90, 0): 7})
    assert newest.startswith(data)
    pdf = load(newest)
    assert [p.rotate for p in pdf.pages()] == [0, 90, 0] and pdf.get(Ref(90, 0)) == 7
    assert len({e.section for e in pdf.entries}) == 3
    assert len(load(newest[: find_startxref(newest)], lenient=True).pages()) == 3


def test_loops_and_odd_trees():
    data = sample()
    start = find_startxref(data)
    looped = data.replace(b"/Size 51", b"/Prev %d" % start)
    assert len(load(looped, True).pages()) == 3  # B13
    objects = {Ref(1, 0): {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, Ref(2, 0): {"Type": Name("Pages"), "Kids": [Ref(2, 0), Ref(9, 0), 5, Ref(3, 0)]}, Ref(3, 0): {"Type": Name("Page")}}
    assert [p.ref.num for p in load(write_file(objects, {"Root": Ref(1, 0)})).pages()] == [3]
    chain = {Ref(i, 0): Ref(i + 1, 0) for i in range(1, 30)} | {Ref(30, 0): 1}
    pdf = load(write_file(chain | {Ref(40, 0): {"Type": Name("Catalog")}}, {"Root": Ref(40, 0)}))
    assert pdf.resolve(Ref(20, 0)) == 1 and pdf.resolve(Ref(2, 0)) is None


def test_indirect_length():
    """B11: a stream whose length is a reference."""
    body = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n2 0 obj\n<< /Length 3 0 R >>\nstream\nendstream inside\nendstream\nendobj\n3 0 obj\n16\nendobj\n"
    pdf = load(body + b"trailer << /Root 1 0 R >>", lenient=True)
    assert pdf.get(Ref(2, 0)).raw == b"endstream inside"


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_lenient_load_never_fails(seed):
    rng = random.Random(seed)
    data = bytearray(sample(xref=rng.choice(["table", "stream"])))
    for _ in range(rng.randrange(1, 12)):
        at = rng.randrange(len(data))
        if rng.random() < 0.5:
            data[at] = rng.randrange(256)
        else:
            del data[at : at + rng.randrange(1, 40)]
    pdf = load(bytes(data), lenient=True)
    list(pdf.all_objects())
    for p in pdf.pages():
        pdf.content(p)


def test_xref_stream_entries():
    rows = list(stream_entries(bytes([0, 5, 1, 7]), {"W": [0, 1, 1], "Index": [3, 1, 9, 1]}))
    assert rows == [(3, 1, 0, 5), (9, 1, 1, 7)]
    assert unpack_objects(b"4 0 6 3 12 (x)", 2, 8) == {4: 12, 6: b"x"}
    assert runs([1, 2, 5, 6, 9]) == [[1, 2], [5, 6], [9]]


def test_fonts():
    assert fonts.base_encoding("WinAnsiEncoding")[0x80] == "€" and fonts.base_encoding("StandardEncoding")[0x27] == "’"
    table = fonts.encoding({"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [65, Name("eacute"), Name("uni0416"), 90, Name("nosuch")]})
    assert table[65:67] == ["é", "Ж"] and table[90] == ""
    assert [fonts.glyph_char(g) for g in ("seven", "bar", "u1F600", "Ccaron", "A.alt", "uniD800", "braceright")] == ["7", "|", "\U0001f600", "Č", "A", None, "}"]
    cmap = fonts.parse_cmap(b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <01> <03> <0041> <05> <06> [<0061> <D83DDE00>] endbfrange 1 beginbfchar <02> <005A> endbfchar")
    assert cmap.entries() == {1: "A", 2: "Z", 3: "C", 5: "a", 6: "\U0001f600"} and cmap.get(9) is None
    assert fonts.cid_widths({"W": [1, [5, 6], 10, 12, 7], "DW": 9}, lambda x: x) == ({1: 5.0, 2: 6.0, 10: 7.0, 11: 7.0, 12: 7.0}, 9.0)
    assert fonts.simple_widths({"FirstChar": 65, "Widths": [1, 2], "FontDescriptor": {"MissingWidth": 3}}, lambda x: x) == ({65: 1.0, 66: 2.0}, 3.0)


def test_text_state():
    got = text_chunks(b"q 2 0 0 2 0 0 cm BT /F 10 Tf 5 7 Td (a) Tj 0 -3 TD (b) Tj T* (c) Tj ET Q BT /F 8 Tf 14 TL 1 0 0 1 3 4 Tm (d) Tj (e) ' 1 2 (f) \" [(g) -300 (h) 20 (i)] TJ ET", {})
    assert [(c.text, c.x, c.y, c.font_size) for c in got[:3]] == [("a", 10, 14, 20), ("b", 10, 8, 20), ("c", 10, 2, 20)]
    assert [(c.text, c.y) for c in got[3:]] == [("d", 4), ("e", -10), ("f", -24), ("g hi", -24)]
    font = fonts.Font("F", "Type1", False, fonts.base_encoding("WinAnsiEncoding"), None, {97: 500.0}, 0.0)
    a, b = text_chunks(b"BT /F 10 Tf (aa) Tj (b) Tj ET", {"F": font})
    assert (a.x, b.x) == (0, 10)  # B3: text advances by its width
    assert multiply((1, 0, 0, 1, 5, 6), (2, 0, 0, 3, 1, 1)) == (2, 0, 0, 3, 11, 19)
    assert [i.op for i in instructions(b"q BI /W 1 /H 1 ID \x00EI\x01 EI Q 1 2 m (broken")] == ["q", "BI", "Q", "m"]
    assert isinstance(parse(b"BT ")[0], Keyword)


def test_rc4_and_keys():
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert security.rc4(bytes([1, 2, 3, 4, 5]), bytes(16)).hex() == "b2396305f03dc027ccc3524a0a1118a8"
    for revision, length in ((2, 5), (3, 16)):
        owner = security.owner_entry(b"own", b"user", revision, length)
        key = security.file_key(b"user", owner, -44, b"id", revision, length)
        user = security.user_entry(key, b"id", revision)
        assert security.authenticate(b"user", owner, user, -44, b"id", revision, length) == ("user", key)
        assert security.authenticate(b"own", owner, user, -44, b"id", revision, length) == ("owner", key)
        assert security.authenticate(b"no", owner, user, -44, b"id", revision, length) == (None, None)


def test_images():
    rgb = images.pixels({"Width": 2, "Height": 1, "ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, b"\x01\x02\x03\xff\x00\x00"]}, b"\x01\x00")
    assert rgb.tolist() == [[[255, 0, 0], [1, 2, 3]]]
    cmyk = images.pixels({"Width": 1, "Height": 1, "ColorSpace": Name("DeviceCMYK")}, bytes([255, 0, 0, 0]))
    assert cmyk.tolist() == [[[0, 255, 255]]]
    gray = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    assert images.png(gray)[:8] == b"\x89PNG\r\n\x1a\n" and images.tiff(gray)[:4] == b"II*\0"
    assert images.visually_gray(gray) and not images.visually_gray(rgb)
    with pytest.raises(ValueError):
        images.pixels({"Width": 1, "Height": 1, "Filter": Name("DCTDecode")}, b"")


def test_forms_and_sizes():
    pairs = [("a", "x (y)"), ("b.c", "é")]
    assert parse_fdf(fdf(pairs)) == pairs and parse_fdf(b"junk") == []
    assert b"(on) Tj" in appearance("text", "on", 100, 20) and b"ZaDb" in appearance("checkbox", "Yes", 10, 10) and b"ZaDb" not in appearance("radio", "Off", 10, 10)
    assert estimated_size({"A": [1, b"xy"]}) == 8 + 1 + 4 + 8 + 16 + 6
    assert estimated_size(Stream({}, b"abc")) == 67
    assert math.isclose(cos.number(3), 3.0) and cos.number(True) is None


def test_blank_files():
    from folioframe.functions.building import blank_file

    pdf = load(blank_file("letter", 3, "1.4"))
    assert pdf.version == "1.4" and [p.media_box for p in pdf.pages()] == [[0, 0, 612, 792]] * 3
    assert load(blank_file((10.5, 20), 0)).pages() == []
    with pytest.raises(ValueError):
        blank_file((0, 1))
