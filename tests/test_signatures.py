"""Signed files built in the test: CMS with a small RSA key, checked field by field."""

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioframe.functions.content_writer import OPERATORS, ContentWriter, page_content, resource_name
from folioframe.functions.cos import Hex, Name, Ref, write
from folioframe.functions.der import chain, cms_info, oid, rsa_verifies
from folioframe.functions.writing import write_file, write_update
from folioframe.operators import security, signatures, xref_sql
from folioframe.sources import corpus, pdf


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def oid_bytes(text):
    a, b, *rest = map(int, text.split("."))
    out = bytearray([40 * a + b])
    for v in rest:
        parts = [v & 127]
        while v := v >> 7:
            parts.append(128 | (v & 127))
        out += bytes(reversed(parts))
    return tlv(6, bytes(out))


def prime(rng, bits):
    while True:
        n = rng.getrandbits(bits) | (3 << (bits - 2)) | 1
        if n % 65537 != 1 and all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11)):
            return n


@pytest.fixture(scope="module")
def key():
    rng = random.Random(7)
    p, q = prime(rng, 384), prime(rng, 384)
    return p * q, 65537, pow(65537, -1, (p - 1) * (q - 1))


def name(text):
    return tlv(0x30, tlv(0x31, tlv(0x30, oid_bytes("2.5.4.3"), tlv(0x0C, text.encode()))))


def certificate(key, subject, issuer, serial):
    spki = tlv(0x30, tlv(0x30, oid_bytes("1.2.840.113549.1.1.1")), tlv(3, b"\0" + tlv(0x30, number(key[0]), number(key[1]))))
    validity = tlv(0x30, tlv(0x17, b"200101000000Z"), tlv(0x18, b"20400101000000Z"))
    body = tlv(0x30, tlv(0xA0, number(2)), number(serial), tlv(0x30, oid_bytes("1.2.840.113549.1.1.11")), name(issuer), validity, name(subject), spki)
    return tlv(0x30, body, tlv(0x30, oid_bytes("1.2.840.113549.1.1.11")), tlv(3, b"\0x"))


def cms(key, digest, break_it=False):
    sha256 = tlv(0x30, oid_bytes("2.16.840.1.101.3.4.2.1"))
    attributes = tlv(0x30, oid_bytes("1.2.840.113549.1.9.4"), tlv(0x31, tlv(4, digest))) + tlv(0x30, oid_bytes("1.2.840.113549.1.9.5"), tlv(0x31, tlv(0x17, b"240102030405Z")))
    info = tlv(0x30, sha256, tlv(4, hashlib.sha256(tlv(0x31, attributes)).digest()))
    size = (key[0].bit_length() + 7) // 8
    block = b"\0\1" + b"\xff" * (size - 3 - len(info)) + b"\0" + info
    signature = pow(int.from_bytes(block, "big") + break_it, key[2], key[0]).to_bytes(size, "big")
    signer = tlv(0x30, number(1), tlv(0x30, name("root"), number(5)), sha256, tlv(0xA0, attributes), tlv(0x30, oid_bytes("1.2.840.113549.1.1.1")), tlv(4, signature))
    certs = tlv(0xA0, certificate(key, "leaf", "root", 5), certificate(key, "root", "root", 1))
    return tlv(0x30, oid_bytes("1.2.840.113549.1.7.2"), tlv(0xA0, tlv(0x30, number(1), tlv(0x31, sha256), tlv(0x30, oid_bytes("1.2.840.113549.1.7.1")), certs, tlv(0x31, signer))))


def signed_pdf(key, break_it=False, tamper=False):
    room = 2500
    sig = {"Type": Name("Sig"), "SubFilter": Name("adbe.pkcs7.detached"), "ByteRange": [0, 1111111111, 2222222222, 3333333333], "Reason": b"test", "Contents": Hex(bytes(room)),
           "Reference": [{"TransformMethod": Name("DocMDP"), "TransformParams": {"P": 1}}]}
    extra = {Ref(20, 0): {"FT": Name("Sig"), "T": b"s1", "V": Ref(21, 0)}, Ref(21, 0): sig}
    data = write_file(*corpus._simple(extra, {"AcroForm": {"Fields": [Ref(20, 0)]}}))
    start = data.index(b"<" + b"00" * 20)
    end = data.index(b">", start) + 1
    spans = b"[%d %d %d %d]" % (0, start, end, len(data) - end)
    data = data.replace(b"[0 1111111111 2222222222 3333333333]", spans.ljust(len(b"[0 1111111111 2222222222 3333333333]")))
    made = cms(key, hashlib.sha256(data[:start] + data[end:]).digest(), break_it)
    data = data[: start + 1] + made.hex().upper().encode().ljust(2 * room, b"0") + data[end - 1 :]
    return data.replace(b"(test)", b"(tset)") if tamper else data


def test_cms(key):
    info = cms_info(cms(key, b"d" * 32))
    assert (info.digest_name, info.message_digest, info.signature_ok, info.has_timestamp) == ("sha256", b"d" * 32, True, False)
    assert info.signing_time.replace(tzinfo=None) == datetime(2024, 1, 2, 3, 4, 5)
    assert [c.subject for c in chain(info.certificates, info.certificates[0])] == ["CN=leaf", "CN=root"]
    assert cms_info(cms(key, b"d" * 32, True)).signature_ok is False
    assert cms_info(b"junk") is None and cms_info(cms(key, b"d" * 32)[:200]) is None
    assert rsa_verifies(None, None, b"", b"") is None and oid(oid_bytes("2.16.840.1.101.3.4.2.1")[2:]) == "2.16.840.1.101.3.4.2.1"


def test_signature_table(spark, key):
    good = signed_pdf(key)
    rows = [("good", good), ("forged", signed_pdf(key, break_it=True)), ("tampered", signed_pdf(key, tamper=True)), ("later", write_update(good, {Ref(90, 0): {"Type": Name("Page")}}))]
    files = spark.createDataFrame([*rows, ("none", write_file(*corpus._simple({}, {})))], "file_id string, content binary")
    found = signatures.signatures(files)
    by_file = {r.file_id: r for r in found.collect()}
    assert set(by_file) == {"good", "forged", "tampered", "later"}
    state = {k: (r.digest_match, r.signature_ok) for k, r in by_file.items()}
    assert state == {"good": (True, True), "forged": (True, False), "tampered": (False, True), "later": (True, True)}
    assert by_file["good"].subjects == ["CN=leaf", "CN=root"] and by_file["good"].mdp_level == 1
    judged = {r.file_id: r for r in signatures.judged(found, files, ["cn=ROOT"], datetime(2030, 1, 1)).collect()}
    assert judged["good"].trusted and not judged["good"].expired and judged["good"].usf_warnings == [] and not judged["good"].swa_suspect and not judged["good"].ltv
    place = {r.file_id: r.revision for r in signatures.revision_of_signature(found, security.revisions(files)).collect()}
    assert place == {"good": 0, "forged": 0, "tampered": 0, "later": 0}


def test_byte_range_rules(spark):
    body = b"%PDF-1.7 " + b"x" * 60 + b"/Contents<00ZZ>tail"
    gap = body.index(b"<")
    cases = {
        "ok": ([0, gap, gap + 6, 4], {"gap contains non-hex characters"}),
        "short": ([0, 10, gap + 6, 4], {"first segment suspiciously short", "gap does not start with '<'", "gap contains non-hex characters"}),
        "three": ([0, 1, 2], {"ByteRange has 3 elements, expected 4"}),
        "long": ([0, gap, gap + 6, 400], {"second range exceeds the file", "gap contains non-hex characters"}),
        "overlap": ([0, gap + 8, gap, 4], {"ranges overlap"}),
        "negative": ([0, gap, gap + 6, -4], {"negative ByteRange values", "gap contains non-hex characters"}),
    }
    files = spark.createDataFrame([(k, body, v[0]) for k, v in cases.items()], "file_id string, content binary, r array<long>")
    found = files.select("file_id", security.byte_range_warnings(F.col("content"), F.col("r")).alias("w")).collect()
    assert {r.file_id: set(r.w) for r in found} == {k: v[1] for k, v in cases.items()}


def test_xref_stream_in_sql(spark):
    from folioframe.functions.document import stream_entries

    body = bytes(range(1, 31))
    cases = [(1, body, [1, 2, 1], [0, 3, 9, 2]), (2, body, [0, 3, 2], [5, 4]), (3, body[:7], [1, 2, 1], [0, 9]), (4, b"", [1, 2, 1], [0, 0])]
    table = spark.createDataFrame(cases, "file_id int, body binary, w array<int>, index array<int>")
    want = [(i, *row) for i, b, w, index in cases for row in stream_entries(b, {"W": w, "Index": index})]
    assert sorted(map(tuple, xref_sql.decode_entries(table).collect())) == sorted(want)


def test_content_writer(spark, sf):
    w = ContentWriter().save_state().transform(1, 0, 0, 1, 5.5, 6).begin_text().set_font(Name("F1"), 12).show_text_positioned([b"a", -300, b"b"]).end_text().restore_state()
    assert w.data() == b"q\n1 0 0 1 5.5 6 cm\nBT\n/F1 12 Tf\n[(a) -300 (b)] TJ\nET\nQ"
    with pytest.raises(ValueError):
        ContentWriter().line_to(1)
    assert len({op for op, _ in OPERATORS.values()}) == len(OPERATORS)
    assert resource_name("/Im 1") == "Im_1" and resource_name("a", ["a", "a1"]) == "a2"
    files = corpus.images(spark, sf).limit(5).cache()
    first = pdf.instruction_table(files)
    again = page_content(first).collect()
    from folioframe.functions.content import instructions

    want = {(r.file_id, r.page_index): [] for r in again}
    for r in first.orderBy("file_id", "page_index", "seq").collect():
        want[(r.file_id, r.page_index)].append((r.op, bytes(r.data) if r.data is not None else None))
    assert all([(i.op, i.data) for i in instructions(bytes(r.content))] == want[(r.file_id, r.page_index)] for r in again)
    assert write(Name("a")) == b"/a"
