"""Encrypted files, forged signatures and streams over the limit."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioframe.functions import crypt
from folioframe.functions.cos import Hex, Name, Ref, Stream
from folioframe.functions.der import cms_info, rsa_verifies, signed_blocks, verified
from folioframe.functions.document import load
from folioframe.functions.filters import FilterError, flate_decode
from folioframe.functions.writing import write_file, write_update
from folioframe.operators import compression, security, writers
from folioframe.sources import corpus, pdf, signing


def test_aes_is_the_standard():
    """The example vectors of the standard for AES-128."""
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    vector = bytes.fromhex("000102030405060708090a0b0c0d0e0f")
    coded = vector + bytes.fromhex("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")
    assert crypt.aes_decrypt(key, coded).hex() == "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51"
    for n in (0, 1, 15, 16, 17, 5000):
        data = bytes(i % 251 for i in range(n))
        assert crypt.aes_decrypt(key, crypt.aes_encrypt(key, data)) == data


@pytest.fixture(scope="module", params=["RC4-40", "RC4-128", "AES-128"])
def secret(request):
    extra = {Ref(20, 0): {"Title": b"kept (title)", "Author": Hex(b"\x01\x02")}, Ref(21, 0): Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"BT ET" * 50))}
    plain = write_file(*corpus._simple(extra, {"Extra": Ref(21, 0)}, {"Info": Ref(20, 0)}), xref="stream", packed=True)
    return plain, security.encrypted_file(plain, request.param, "user", "owner")


@pytest.mark.parametrize("lenient", [False, True])
def test_opening(secret, lenient):
    _, coded = secret
    data = coded.replace(b"startxref", b"startxxxx") if lenient else coded
    assert b"kept" not in data
    for password in (b"user", b"owner"):
        opened = load(data, lenient, password)
        assert not opened.locked and opened.resolve(Ref(20, 0)) == {"Title": b"kept (title)", "Author": b"\x01\x02"}
        assert opened.decoded(opened.resolve(Ref(21, 0))) == b"BT ET" * 50
    shut = load(data, lenient, b"wrong")
    assert shut.locked and shut.resolve(Ref(20, 0))["Title"] != b"kept (title)"
    assert "encrypted, and not opened by the password" in shut.report.warnings


def test_updates_stay_encrypted(secret):
    _, coded = secret
    with pytest.raises(crypt.Locked):
        write_update(coded, {Ref(20, 0): {"Title": b"new"}})
    later = write_update(coded, {Ref(20, 0): {"Title": b"new title"}}, b"user")
    assert b"new title" not in later and load(later, password=b"owner").resolve(Ref(20, 0)) == {"Title": b"new title"}


def test_rewrites_of_encrypted_files(spark, secret):
    plain, coded = secret
    files = spark.createDataFrame([(1, coded), (2, plain)], "file_id long, content binary")
    made = {r.file_id: r.content for r in writers.rotate_pages(files, 90).collect()}
    assert made[1] is None and load(bytes(made[2])).pages()[0].rotate == 90
    opened = security.decrypted(files, "user")
    for change in (opened, compression.compress(opened), writers.extract_pages(opened, [0])):
        again = load(bytes(change.where("file_id = 1").first().content))
        assert "Encrypt" not in again.trailer and not again.locked and len(again.pages()) == 1
    assert pdf.doc_info(opened).where("file_id = 1").first().title == "kept (title)"
    assert compression.compress(files).where("file_id = 1").first().content is None
    for method in ("RC4-40", "AES-128"):
        coded_again = security.encrypted(opened, method)
        assert pdf.doc_info(coded_again).select("title").distinct().collect() == [("kept (title)",)]
        assert coded_again.where(F.contains("content", F.lit(b"kept (title)"))).count() == 0


def test_forged_signatures():
    """What is checked is the whole block: no padding of another length, nothing behind the digest, no other digest."""
    n, e, d = signing.key(1)
    size = (n.bit_length() + 7) // 8
    digest = hashlib.sha256(b"x").digest()
    sign = lambda block: pow(int.from_bytes(block, "big"), d, n).to_bytes(size, "big")
    block = signed_blocks(digest, "sha256", size)[0]
    assert rsa_verifies(n, e, sign(block), digest) is True
    info = block[block.index(b"\0", 2) + 1 :]
    short = b"\0\1" + b"\xff" * 8 + b"\0" + info
    assert rsa_verifies(n, e, sign(short + bytes(size - len(short))), digest) is False
    assert rsa_verifies(n, e, sign(block[:-1] + b"!"), digest) is False
    assert rsa_verifies(n, e, sign(signed_blocks(digest[:20], "sha1", size)[0]), digest) is False
    assert rsa_verifies(n, e, sign(block) + b"\0", digest) is False
    big = random.Random(3).getrandbits(2048) | (1 << 2047) | 1
    forged = signing._cube_forgery(digest, 256)
    assert pow(int.from_bytes(forged, "big"), 3, big).to_bytes(256, "big").startswith(signed_blocks(digest, "sha256", 62)[0])
    assert rsa_verifies(big, 3, forged, digest) is False


def test_chains_are_verified():
    good, broken = (cms_info(signing.cms(bytes(32), "me", case)) for case in ("good", "broken"))
    assert good.own.subject == "CN=me" and good.certificates[0].subject == "CN=root"
    root = good.certificates[0]
    assert verified([good.own, root]) is True and verified([broken.own, root]) is False and verified([good.own]) is None


def test_streams_over_the_limit_are_errors():
    raw = zlib.compress(bytes(5000))
    assert flate_decode(raw, 5000) == bytes(5000)
    with pytest.raises(FilterError):
        flate_decode(raw, 4999)
    with pytest.raises(FilterError):
        flate_decode(raw[:-3] + b"bad", 4999)
