"""Reading DER: tags and lengths, CMS signed data, certificates, and RSA signatures.

What is not supported is reported as unknown (None), never as valid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

# Object identifiers.
DIGESTS = {"1.3.14.3.2.26": "sha1", "2.16.840.1.101.3.4.2.1": "sha256", "2.16.840.1.101.3.4.2.2": "sha384", "2.16.840.1.101.3.4.2.3": "sha512"}
RSA_DIGESTS = {"1.2.840.113549.1.1.5": "sha1", "1.2.840.113549.1.1.11": "sha256", "1.2.840.113549.1.1.12": "sha384", "1.2.840.113549.1.1.13": "sha512"}
MESSAGE_DIGEST, SIGNING_TIME, TIMESTAMP = "1.2.840.113549.1.9.4", "1.2.840.113549.1.9.5", "1.2.840.113549.1.9.16.2.14"
NAMES = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU"}


class DerError(ValueError):
    pass


@dataclass
class Tlv:
    tag: int
    head: int
    start: int
    end: int
    data: bytes = field(repr=False)

    @property
    def value(self) -> bytes:
        return self.data[self.start : self.end]

    @property
    def whole(self) -> bytes:
        return self.data[self.head : self.end]

    def children(self) -> list[Tlv]:
        return list(read_all(self.data, self.start, self.end))


def read(data: bytes, at: int, stop: int) -> Tlv:
    if at + 2 > stop:
        raise DerError("truncated")
    tag, n, p = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 0 < size <= 4 or p + size > stop:
            raise DerError("bad length")
        n, p = int.from_bytes(data[p : p + size], "big"), p + size
    if p + n > stop:
        raise DerError("length past the end")
    return Tlv(tag, at, p, p + n, data)


def read_all(data: bytes, at: int, stop: int) -> Iterator[Tlv]:
    while at < stop:
        item = read(data, at, stop)
        yield item
        at = item.end


def oid(raw: bytes) -> str:
    out, value = [str(min(raw[0] // 40, 2)), str(raw[0] - 40 * min(raw[0] // 40, 2))], 0
    for b in raw[1:]:
        value = (value << 7) | (b & 0x7F)
        if not b & 0x80:
            out.append(str(value))
            value = 0
    return ".".join(out)


def time_of(item: Tlv) -> datetime | None:
    text = item.value.decode("ascii", "ignore").rstrip("Z")
    try:
        if item.tag == 0x17:
            text = ("20" if int(text[:2]) < 50 else "19") + text
        return datetime.strptime(text[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None


@dataclass
class Certificate:
    raw: bytes
    body: bytes
    serial: int
    issuer: str
    subject: str
    not_before: datetime | None
    not_after: datetime | None
    modulus: int | None
    exponent: int | None
    digest_name: str | None  # of the issuer's RSA signature; None if it is of another kind
    signature: bytes


def distinguished_name(item: Tlv) -> str:
    parts = []
    for relative in item.children():
        for pair in relative.children():
            kind, value = pair.children()[:2]
            parts.append(f"{NAMES.get(oid(kind.value), oid(kind.value))}={value.value.decode('utf-8', 'replace')}")
    return ", ".join(parts)


def certificate(item: Tlv) -> Certificate:
    body, algorithm, signature = item.children()[:3]
    fields = body.children()
    fields = fields[1:] if fields[0].tag == 0xA0 else fields
    serial, _, issuer, validity, subject, key = fields[:6]
    before, after = validity.children()[:2]
    modulus = exponent = None
    try:
        bits = key.children()[1].value[1:]
        n, e = read(bits, 0, len(bits)).children()[:2]
        if n.tag == e.tag == 0x02:
            modulus, exponent = int.from_bytes(n.value, "big"), int.from_bytes(e.value, "big")
    except (DerError, IndexError, ValueError):
        pass
    return Certificate(item.whole, body.whole, int.from_bytes(serial.value, "big", signed=True), distinguished_name(issuer), distinguished_name(subject), time_of(before), time_of(after), modulus, exponent, RSA_DIGESTS.get(oid(algorithm.children()[0].value)), signature.value[1:])


def oid_bytes(text: str) -> bytes:
    """An object identifier as DER, with tag and length."""
    first, second, *rest = map(int, text.split("."))
    out = bytearray([40 * first + second])
    for v in rest:
        groups = [v & 0x7F]
        while v := v >> 7:
            groups.append(0x80 | (v & 0x7F))
        out += bytes(reversed(groups))
    return b"\x06" + bytes([len(out)]) + bytes(out)


def signed_blocks(digest: bytes, digest_name: str, size: int) -> list[bytes]:
    """All that a PKCS#1 v1.5 signature of a digest may hold: the algorithm's parameters are null or left out."""
    out = []
    for parameters in (b"\x05\x00", b""):
        algorithm = oid_bytes(next(k for k, v in DIGESTS.items() if v == digest_name)) + parameters
        algorithm = b"\x30" + bytes([len(algorithm)]) + algorithm
        info = algorithm + b"\x04" + bytes([len(digest)]) + digest
        info = b"\x30" + bytes([len(info)]) + info
        if size >= len(info) + 11:
            out.append(b"\x00\x01" + b"\xff" * (size - 3 - len(info)) + b"\x00" + info)
    return out


def rsa_verifies(modulus: int | None, exponent: int | None, signature: bytes, digest: bytes, digest_name: str | None = None) -> bool | None:
    """PKCS#1 v1.5: whether the signature is of this digest, by its whole block; None without an RSA key.

    The digest's algorithm is told by its length, where it is not named.
    """
    if not modulus or not exponent:
        return None
    digest_name = digest_name or {20: "sha1", 32: "sha256", 48: "sha384", 64: "sha512"}.get(len(digest))
    size = (modulus.bit_length() + 7) // 8
    value = int.from_bytes(signature, "big")
    if digest_name is None or len(signature) != size or value >= modulus:
        return False
    return pow(value, exponent, modulus).to_bytes(size, "big") in signed_blocks(digest, digest_name, size)


@dataclass
class Cms:
    digest_name: str | None
    message_digest: bytes | None
    signing_time: datetime | None
    has_timestamp: bool
    signature_ok: bool | None
    certificates: list[Certificate]
    own: Certificate | None = None  # the signer's


def cms_info(data: bytes) -> Cms | None:
    """What a CMS signed-data object says of its first signer; None if it cannot be read."""
    try:
        signed = read(data, 0, len(data)).children()[1].children()[0]
        parts = signed.children()
        certificates = [certificate(c) for p in parts if p.tag == 0xA0 for c in p.children() if c.tag == 0x30]
        signer = parts[-1].children()[0].children()
        digest_name = DIGESTS.get(oid(signer[2].children()[0].value))
        signed_attributes = next((p for p in signer if p.tag == 0xA0), None)
        unsigned = next((p for p in signer if p.tag == 0xA1), None)
        digest, when = None, None
        for a in signed_attributes.children() if signed_attributes else []:
            kind, values = a.children()[:2]
            first = values.children()[0]
            if oid(kind.value) == MESSAGE_DIGEST:
                digest = first.value
            elif oid(kind.value) == SIGNING_TIME:
                when = time_of(first)
        stamped = any(oid(a.children()[0].value) == TIMESTAMP for a in unsigned.children()) if unsigned else False
        ok = None
        serial = signer[1].children()[-1] if signer[1].tag == 0x30 else None
        own = next((c for c in certificates if serial is not None and c.serial == int.from_bytes(serial.value, "big", signed=True)), None)
        if own and signed_attributes and digest_name:
            body = b"\x31" + signed_attributes.whole[1:]
            ok = rsa_verifies(own.modulus, own.exponent, next(p for p in reversed(signer) if p.tag == 0x04).value, hashlib.new(digest_name, body).digest(), digest_name)
        return Cms(digest_name, digest, when, stamped, ok, certificates, own)
    except (DerError, IndexError, ValueError, StopIteration):
        return None


def chain(certificates: list[Certificate], leaf: Certificate) -> list[Certificate]:
    """The leaf and its issuers, as far as they are there; loops end."""
    out, seen = [leaf], {leaf.raw}
    while (above := next((c for c in certificates if c.subject == out[-1].issuer and c.raw not in seen), None)) is not None:
        out.append(above)
        seen.add(above.raw)
    return out


def verified(path: list[Certificate]) -> bool | None:
    """Whether each certificate of a chain is signed by the next, and the last by itself if it says so; None if one cannot be checked."""
    answers: list[bool | None] = []
    for i, c in enumerate(path):
        above = path[i + 1] if i + 1 < len(path) else c if c.issuer == c.subject else None
        if above is None or c.digest_name is None:
            answers.append(None)
        else:
            answers.append(rsa_verifies(above.modulus, above.exponent, c.signature, hashlib.new(c.digest_name, c.body).digest(), c.digest_name))
    return False if False in answers else None if None in answers else True
