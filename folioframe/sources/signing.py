"""Synthetic signed files: certificates, CMS and PDF signatures made with small keys that anyone can compute.

They exist so that what reads signatures has something to read. The keys follow from a
seed; nothing here is fit to sign with.
"""

from __future__ import annotations

import functools
import hashlib
import random
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from folioframe.functions.cos import Hex, Name, Ref
from folioframe.functions.der import oid_bytes, signed_blocks
from folioframe.functions.writing import write_file, write_update
from folioframe.sources.corpus import _simple, built, table

ROOM = 3000  # bytes left for a signature

# Object identifiers.
SHA256, RSA, SHA256_RSA = "2.16.840.1.101.3.4.2.1", "1.2.840.113549.1.1.1", "1.2.840.113549.1.1.11"
DATA, SIGNED_DATA, MESSAGE_DIGEST, SIGNING_TIME, COMMON_NAME = "1.2.840.113549.1.7.1", "1.2.840.113549.1.7.2", "1.2.840.113549.1.9.4", "1.2.840.113549.1.9.5", "2.5.4.3"


def tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def integer(n: int) -> bytes:
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def _prime(rng: random.Random, bits: int) -> int:
    while True:
        n = rng.getrandbits(bits) | (3 << (bits - 2)) | 1
        if n % 65537 != 1 and all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11)):
            return n


@functools.cache
def key(seed: int) -> tuple[int, int, int]:
    """Modulus, public and private exponent."""
    rng = random.Random(seed)
    p, q = _prime(rng, 384), _prime(rng, 384)
    return p * q, 65537, pow(65537, -1, (p - 1) * (q - 1))


def sign(digest: bytes, own: tuple[int, int, int]) -> bytes:
    size = (own[0].bit_length() + 7) // 8
    return pow(int.from_bytes(signed_blocks(digest, "sha256", size)[0], "big"), own[2], own[0]).to_bytes(size, "big")


def name(text: str) -> bytes:
    return tlv(0x30, tlv(0x31, tlv(0x30, oid_bytes(COMMON_NAME), tlv(0x0C, text.encode()))))


def certificate(subject: str, public: tuple[int, int], issuer: str, by: tuple[int, int, int], serial: int, until: bytes, broken: bool = False) -> bytes:
    algorithm = tlv(0x30, oid_bytes(SHA256_RSA), b"\x05\x00")
    public_key = tlv(0x30, tlv(0x30, oid_bytes(RSA), b"\x05\x00"), tlv(3, b"\0" + tlv(0x30, integer(public[0]), integer(public[1]))))
    validity = tlv(0x30, tlv(0x17, b"200101000000Z"), tlv(0x18, until))
    body = tlv(0x30, tlv(0xA0, integer(2)), integer(serial), algorithm, name(issuer), validity, name(subject), public_key)
    signature = sign(hashlib.sha256(body).digest() if not broken else bytes(32), by)
    return tlv(0x30, body, algorithm, tlv(3, b"\0" + signature))


def _cube_forgery(digest: bytes, size: int) -> bytes:
    """What passes for a signature under exponent 3 with readers that do not look at the end of the block."""
    short = signed_blocks(digest, "sha256", 11 + 51)[0]
    target = int.from_bytes(short + bytes(size - len(short)), "big")
    low, high = 0, 1 << (8 * size // 3 + 1)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if middle**3 < target else (low, middle)
    return low.to_bytes(size, "big")


def cms(digest: bytes, signer: str, case: str) -> bytes:
    """Signed data with the signer's certificate, after that of its issuer. ``case``: good, forged, cube, broken, expired."""
    root, own = key(1), key(2)
    public = (own[0], own[1]) if case != "cube" else (random.Random(3).getrandbits(2048) | (1 << 2047) | 1, 3)
    until = b"20210101000000Z" if case == "expired" else b"20400101000000Z"
    certificates = certificate("root", root[:2], "root", root, 1, b"20400101000000Z") + certificate(signer, public, "root", root, 5, until, case == "broken")
    sha256 = tlv(0x30, oid_bytes(SHA256), b"\x05\x00")
    attributes = tlv(0x30, oid_bytes(MESSAGE_DIGEST), tlv(0x31, tlv(4, digest))) + tlv(0x30, oid_bytes(SIGNING_TIME), tlv(0x31, tlv(0x17, b"240102030405Z")))
    covered = hashlib.sha256(tlv(0x31, attributes)).digest()
    signature = _cube_forgery(covered, 256) if case == "cube" else sign(covered if case != "forged" else bytes(32), own)
    info = tlv(0x30, integer(1), tlv(0x30, name("root"), integer(5)), sha256, tlv(0xA0, attributes), tlv(0x30, oid_bytes(RSA)), tlv(4, signature))
    return tlv(0x30, oid_bytes(SIGNED_DATA), tlv(0xA0, tlv(0x30, integer(1), tlv(0x31, sha256), tlv(0x30, oid_bytes(DATA)), tlv(0xA0, certificates), tlv(0x31, info))))


CASES = ("good", "forged", "cube", "broken", "expired", "tampered", "later", "store")


def signed_pdf(row: dict[str, Any]) -> bytes:
    """A certified file. By key: good, a signature of something else, a forged one, a certificate nobody signed, one that
    has expired, content changed since, a page added since, a document security store."""
    number, case = row["s_suppkey"], CASES[row["s_suppkey"] % len(CASES)]
    places = [1111111111, 2222222222, 3333333333]
    sig = {"Type": Name("Sig"), "SubFilter": Name("adbe.pkcs7.detached"), "ByteRange": [0, *places], "Reason": b"test", "Contents": Hex(bytes(ROOM)),
           "Reference": [{"TransformMethod": Name("DocMDP"), "TransformParams": {"P": 1 + number % 3}}]}
    extra = {Ref(20, 0): {"FT": Name("Sig"), "T": row["s_name"].encode(), "V": Ref(21, 0)}, Ref(21, 0): sig}
    store = {"DSS": {"CRLs": [Ref(20, 0)], "Certs": [Ref(20, 0), Ref(21, 0)]}} if case == "store" else {}
    data = write_file(*_simple(extra, {"AcroForm": {"Fields": [Ref(20, 0)]}} | store))
    start = data.index(b"<" + b"00" * 20)
    end = data.index(b">", start) + 1
    mark = b"[0 %d %d %d]" % tuple(places)
    data = data.replace(mark, (b"[0 %d %d %d]" % (start, end, len(data) - end)).ljust(len(mark)))
    made = cms(hashlib.sha256(data[:start] + data[end:]).digest(), row["s_name"], case)
    data = data[: start + 1] + made.hex().upper().encode().ljust(2 * ROOM, b"0") + data[end - 1 :]
    if case == "tampered":
        data = data.replace(b"(test)", b"(tset)")
    return write_update(data, {Ref(90, 0): {"Type": Name("Page")}}) if case == "later" else data


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signed PDF for each supplier."""
    return built(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), signed_pdf)
