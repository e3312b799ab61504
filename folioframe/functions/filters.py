"""Stream filters. Decoders keep what they could decode before damage, where the format allows."""

from __future__ import annotations

import re
import zlib
from typing import Any

MOST_BYTES = 256 << 20  # of one decoded stream

# Abbreviated filter names.
ABBREVIATIONS = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "LZW": "LZWDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
PASSED_THROUGH = frozenset(("CCITTFaxDecode", "DCTDecode", "JPXDecode", "Crypt"))


class FilterError(ValueError):
    pass


def flate_decode(raw: bytes, most: int = MOST_BYTES) -> bytes:
    """What can be decoded before damage; a stream of more than ``most`` bytes is an error, never a prefix."""
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(raw, most + 1)
            return _within(out, most)
        except zlib.error:
            d = zlib.decompressobj(bits)
            out = bytearray()
            try:
                for i in range(0, len(raw), 64):
                    out += d.decompress(raw[i : i + 64], most + 1)
                    _within(out, most)
            except zlib.error:
                if out:
                    return bytes(out)
    raise FilterError("no flate data")


def _within(out: bytes | bytearray, most: int) -> bytes | bytearray:
    if len(out) > most:
        raise FilterError(f"more than {most} bytes in a decoded stream")
    return out


def ascii_hex_decode(raw: bytes) -> bytes:
    digits = re.sub(rb"[\x00\t\n\x0c\r ]", b"", raw.split(b">", 1)[0])
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1"))
    except ValueError as e:
        raise FilterError(str(e)) from e


def ascii_hex_encode(raw: bytes) -> bytes:
    return raw.hex().upper().encode() + b">"


def ascii85_decode(raw: bytes) -> bytes:
    body = re.sub(rb"[\x00\t\n\x0c\r ]", b"", raw.split(b"~>", 1)[0].removeprefix(b"<~"))
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _base85(group).to_bytes(4, "big")
                group = []
        else:
            raise FilterError(f"byte {c} in ASCII85 data")
    if len(group) > 1:
        out += _base85(group + [84] * (5 - len(group))).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _base85(digits: list[int]) -> int:
    value = 0
    for d in digits:
        value = value * 85 + d
    if value >> 32:
        raise FilterError("ASCII85 group out of range")
    return value


def ascii85_encode(raw: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(raw), 4):
        part = raw[i : i + 4]
        value = int.from_bytes(part.ljust(4, b"\0"), "big")
        if not value and len(part) == 4:
            out += b"z"
            continue
        digits = []
        for _ in range(5):
            value, d = divmod(value, 85)
            digits.append(d + 0x21)
        out += bytes(reversed(digits))[: len(part) + 1]
    return bytes(out) + b"~>"


def run_length_decode(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n == 128:
            break
        if n < 128:
            if at + 2 + n > len(raw):
                raise FilterError("truncated run")
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if at + 2 > len(raw):
                raise FilterError("truncated run")
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def run_length_encode(raw: bytes) -> bytes:
    out = bytearray()
    for m in re.finditer(rb"(.)\1{1,127}|(?:(.)(?!\2)){1,128}", raw, re.DOTALL):
        run = m[0]
        out += bytes([257 - len(run)]) + m[1] if m[1] is not None else bytes([len(run) - 1]) + run
    return bytes(out) + b"\x80"


def lzw_decode(raw: bytes, early: int = 1) -> bytes:
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, previous, bits, have = bytearray(), 9, b"", 0, 0
    for byte in raw:
        bits, have = (bits << 8) | byte, have + 8
        if have < width:
            continue
        code = (bits >> (have - width)) & ((1 << width) - 1)
        have -= width
        bits &= (1 << have) - 1
        if code == 256:
            del table[258:]
            width, previous = 9, b""
            continue
        if code == 257:
            break
        if code < len(table) and (code < 256 or code > 257):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise FilterError(f"LZW code {code} before it was made")
        out += entry
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
        previous = entry
        size = len(table) + early
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def lzw_encode(raw: bytes, early: int = 1) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    out, acc, have, width, size = bytearray(), 0, 0, 9, 258

    def put(code: int) -> None:
        nonlocal acc, have
        acc, have = (acc << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append((acc >> have) & 255)
        acc &= (1 << have) - 1

    put(256)
    word = b""
    for i in range(len(raw)):
        longer = word + raw[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        # the decoder is one entry behind
        width = 9 if size - 1 + early < 512 else 10 if size - 1 + early < 1024 else 11 if size - 1 + early < 2048 else 12
        if size == 4095:
            put(256)
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        word = raw[i : i + 1]
    if word:
        put(table[word])
        size += 1
        width = 9 if size - 1 + early < 512 else 10 if size - 1 + early < 1024 else 11 if size - 1 + early < 2048 else 12
    put(257)
    if have:
        out.append((acc << (8 - have)) & 255)
    return bytes(out)


def predict(data: bytes, parms: dict[str, Any]) -> bytes:
    """Undoes the PNG and TIFF predictors of decode parameters."""
    predictor = parms.get("Predictor", 1)
    if predictor in (1, None):
        return data
    colors, depth, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    pixel, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if predictor == 2:
        if depth != 8:
            return data
        out = bytearray(data)
        for start in range(0, len(out), row):
            for i in range(start + pixel, min(start + row, len(out))):
                out[i] = (out[i] + out[i - pixel]) & 255
        return bytes(out)
    out, above = bytearray(), bytes(row)
    for start in range(0, len(data), row + 1):
        kind, line = data[start], bytearray(data[start + 1 : start + 1 + row].ljust(row, b"\0"))
        for i in range(row):
            left = line[i - pixel] if i >= pixel else 0
            up = above[i]
            corner = above[i - pixel] if i >= pixel else 0
            if kind == 1:
                guess = left
            elif kind == 2:
                guess = up
            elif kind == 3:
                guess = (left + up) // 2
            elif kind == 4:
                p = left + up - corner
                a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                guess = left if a <= b and a <= c else up if b <= c else corner
            else:
                guess = 0
            line[i] = (line[i] + guess) & 255
        out += line
        above = bytes(line)
    return bytes(out)


def names(filters: Any) -> list[str]:
    """The full filter names of a ``/Filter`` entry, in order."""
    listed = filters if isinstance(filters, list) else [] if filters is None else [filters]
    return [ABBREVIATIONS.get(str(f), str(f)) for f in listed]


def decode(raw: bytes, filters: Any, parms: Any = None) -> bytes:
    """Applies a chain of filters, left to right."""
    chain = names(filters)
    settings = parms if isinstance(parms, list) else [parms]
    for i, name in enumerate(chain):
        own = settings[i] if i < len(settings) and isinstance(settings[i], dict) else {}
        if name == "FlateDecode":
            raw = predict(flate_decode(raw), own)
        elif name == "LZWDecode":
            raw = predict(lzw_decode(raw, own.get("EarlyChange", 1)), own)
        elif name == "ASCIIHexDecode":
            raw = ascii_hex_decode(raw)
        elif name == "ASCII85Decode":
            raw = ascii85_decode(raw)
        elif name == "RunLengthDecode":
            raw = run_length_decode(raw)
        elif name not in PASSED_THROUGH:
            raise FilterError(f"unknown filter {name}")
        raw = _within(raw, MOST_BYTES)
    return raw


ENCODERS = {
    "FlateDecode": lambda b: zlib.compress(b, 9),
    "ASCIIHexDecode": ascii_hex_encode,
    "ASCII85Decode": ascii85_encode,
    "RunLengthDecode": run_length_encode,
    "LZWDecode": lzw_encode,
}


def encode(data: bytes, chain: list[str]) -> bytes:
    """The bytes that ``decode`` with this chain turns into ``data``."""
    for name in reversed(chain):
        data = ENCODERS[name](data)
    return data
