"""PDF values: lexing, parsing and serialising, without Spark.

Null, booleans, integers, reals, arrays and dictionaries are Python's own; strings are
``bytes``; the rest are the small classes below.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from functools import lru_cache, partial
from typing import Any, NamedTuple

MAX_DEPTH = 128


class Name(str):
    __slots__ = ()


class Hex(bytes):
    """A string that was, and will be, written in hexadecimal."""


class Ref(NamedTuple):
    num: int
    gen: int


_ref = partial(tuple.__new__, Ref)  # of a pair; quicker than the call by fields


@dataclass
class Stream:
    dict: dict[str, Any]
    raw: bytes = b""


class ParseError(ValueError):
    pass


_BLANK = rb"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[" + _BLANK + rb"]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^" + _BLANK + rb"()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)\Z")
_REFERENCE = re.compile(rb"(\d{1,10})[" + _BLANK + rb"]+(\d{1,5})[" + _BLANK + rb"]+R(?![^" + _BLANK + rb"()<>\[\]{}/%])")
# Most entries of dictionaries: a name without escapes, then a reference, an integer or such a name. All others are read piece by piece.
_PLAIN = rb"[^" + _BLANK + rb"()<>\[\]{}/%#]"
_ENDS = rb"(?![^" + _BLANK + rb"()<>\[\]{}/%])"
_ENTRY = re.compile(
    rb"[" + _BLANK + rb"]*/(" + _PLAIN + rb"+)" + _ENDS + rb"[" + _BLANK + rb"]*"
    rb"(?:(\d{1,10})[" + _BLANK + rb"]+(\d{1,5})[" + _BLANK + rb"]+R" + _ENDS + rb"|(-?\d+)" + _ENDS + rb"|/(" + _PLAIN + rb"+)" + _ENDS + rb")"
)
OBJECT_HEADER = re.compile(rb"(\d{1,10})[" + _BLANK + rb"]+(\d{1,5})[" + _BLANK + rb"]+obj(?![A-Za-z0-9])")
# An object that is a dictionary of such entries and of arrays of references: its number, generation, entries, their end, and whether a stream follows.
_GAP = rb"[" + _BLANK + rb"]++"
_PAIR = rb"\d{1,10}" + _GAP + rb"\d{1,5}" + _GAP + rb"R"
_REFERENCES = re.compile(rb"\[(?:" + _GAP + rb")?((?:" + _PAIR + rb"(?:" + _GAP + rb"|(?=\])))*+)\]")
_FORM = rb"(?:" + _GAP + rb")?/" + _PLAIN + rb"++(?:" + _GAP + rb")?(?:" + _PAIR + _ENDS + rb"|-?\d{1,18}+" + _ENDS + rb"|/" + _PLAIN + rb"++" + _ENDS + rb"|" + _REFERENCES.pattern.replace(rb"((", rb"(?:(") + rb")"
PLAIN_OBJECT = re.compile(
    rb"(?:" + _GAP + rb")?(\d{1,10})" + _GAP + rb"(\d{1,5})" + _GAP + rb"obj(?:" + _GAP + rb")?<<((?:" + _FORM + rb")*+)(?:" + _GAP + rb")?(>>)(?:" + _GAP + rb")?+(?:(stream)|(?!%))"
)
_FORM_PARTS = re.compile(rb"/(" + _PLAIN + rb"++)(?:" + _GAP + rb")?(?:(\d{1,10})" + _GAP + rb"(\d{1,5})" + _GAP + rb"R|(-?\d++)|/(" + _PLAIN + rb"++)|\[([^\]]*+))")
_HASH = re.compile(rb"#([0-9A-Fa-f]{2})")
_STRING_PART = re.compile(rb"[^()\\\r]+|\\(?:[0-7]{1,3}|\r\n|.)|\r\n?|[()]", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


@dataclass
class Keyword:
    word: bytes


def skip(data: bytes, at: int) -> int:
    if at < len(data) and data[at] > 0x25:  # neither white space nor a comment
        return at
    return _SKIP.match(data, at).end()


def read_string(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string whose opening parenthesis is at ``at``."""
    out, depth, at = bytearray(), 1, at + 1
    while m := _STRING_PART.match(data, at):
        piece, at = m[0], m.end()
        if piece == b"(":
            depth += 1
        elif piece == b")":
            depth -= 1
            if not depth:
                return bytes(out), at
        elif piece[:1] == b"\\":
            rest = piece[1:]
            if rest[:1].isdigit() and rest[:1] < b"8":
                piece = bytes([int(rest, 8) & 255])
            elif rest in (b"\n", b"\r", b"\r\n"):
                piece = b""
            else:
                piece = _ESCAPES.get(rest, rest)
        elif piece[:1] == b"\r":
            piece = b"\n"
        out += piece
    raise ParseError("unterminated string")


def read_hex(data: bytes, at: int) -> tuple[Hex, int]:
    end = data.find(b">", at)
    if end < 0:
        raise ParseError("unterminated hexadecimal string")
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
    return Hex(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), end + 1


@lru_cache(4096)
def _name(raw: bytes) -> Name:
    return Name(_HASH.sub(lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1"))


@lru_cache(4096)
def _key(raw: bytes) -> str:
    return str(_name(raw))


def read_name(data: bytes, at: int) -> tuple[Name, int]:
    m = _REGULAR.match(data, at + 1)
    raw = m[0] if m else b""
    return _name(raw), at + 1 + len(raw)


def parse(data: bytes, at: int = 0, depth: int = 0) -> tuple[Any, int]:
    """The value at ``at`` and the position after it; operators come as ``Keyword``."""
    if depth > MAX_DEPTH:
        raise ParseError("nested too deeply")
    at = skip(data, at)
    lead = data[at : at + 1]
    if not lead:
        raise ParseError("unexpected end")
    if lead == b"/":
        return read_name(data, at)
    if lead == b"(":
        return read_string(data, at)
    if data[at : at + 2] == b"<<":
        return _dictionary(data, at + 2, depth)
    if lead == b"<":
        return read_hex(data, at)
    if lead == b"[":
        if depth < MAX_DEPTH and (m := _REFERENCES.match(data, at)):
            return _references(m[1]), m.end()
        items: list[Any] = []
        at = skip(data, at + 1)
        while data[at : at + 1] != b"]":
            value, at = parse(data, at, depth + 1)
            if isinstance(value, Keyword):
                raise ParseError(f"{value.word!r} in an array")
            items.append(value)
            at = skip(data, at)
        return items, at + 1
    if lead.isdigit() and (m := _REFERENCE.match(data, at)):
        return Ref(int(m[1]), int(m[2])), m.end()
    m = _REGULAR.match(data, at)
    if not m:
        raise ParseError(f"unexpected {lead!r}")
    word = m[0]
    if _NUMBER.match(word):
        sign = -1 if word.lstrip(b"+")[:1] == b"-" else 1
        digits = word.lstrip(b"+-")
        return sign * (float(digits) if b"." in digits else int(digits)), m.end()
    constant = {b"true": True, b"false": False, b"null": None}
    return (constant[word] if word in constant else Keyword(word)), m.end()


def _references(listed: bytes) -> list[Ref]:
    words = listed.replace(b"\0", b" ").split()
    return [_ref((int(n), int(g))) for n, g in zip(words[::3], words[1::3], strict=True)]


def _plain_dictionary(data: bytes, begin: int, end: int) -> dict[str, Any]:
    """The entries of a ``PLAIN_OBJECT``."""
    found: dict[str, Any] = {}
    for key, num, gen, integer, name, listed in _FORM_PARTS.findall(data, begin, end):
        found[_key(key)] = _ref((int(num), int(gen))) if num else int(integer) if integer else _name(name) if name else _references(listed)
    return found


def _dictionary(data: bytes, at: int, depth: int) -> tuple[dict[str, Any], int]:
    """Duplicate keys: the last value in the first position."""
    found: dict[str, Any] = {}
    while True:
        while depth < MAX_DEPTH and (m := _ENTRY.match(data, at)):
            key, num, gen, integer, name = m.groups()
            found[_key(key)] = _ref((int(num), int(gen))) if num else int(integer) if integer else _name(name)
            at = m.end()
        at = skip(data, at)
        if data[at : at + 2] == b">>":
            return found, at + 2
        if data[at : at + 1] != b"/":
            raise ParseError("a dictionary key must be a name")
        key, at = read_name(data, at)
        value, at = parse(data, at, depth + 1)
        if isinstance(value, Keyword):
            raise ParseError(f"{value.word!r} as a dictionary value")
        found[str(key)] = value


def parse_indirect(data: bytes, at: int, length_of=None) -> tuple[Ref, Any, int]:
    """The indirect object at ``at``; ``length_of`` resolves a stream's length."""
    if m := PLAIN_OBJECT.match(data, at):
        value, at = _plain_dictionary(data, *m.span(3)), m.end(4)
        after = m.end() - 6 if m[5] else -1
    else:
        at = skip(data, at)
        m = OBJECT_HEADER.match(data, at)
        if not m:
            raise ParseError(f"no object at {at}")
        value, at = parse(data, m.end())
        if isinstance(value, Keyword):
            value = None
        after = skip(data, at)
        after = after if isinstance(value, dict) and data.startswith(b"stream", after) else -1
    if after >= 0:
        begin = after + 6
        begin += 2 if data[begin : begin + 2] == b"\r\n" else 1 if data[begin : begin + 1] in (b"\n", b"\r") else 0
        value, at = read_body(data, begin, value, length_of)
    return Ref(int(m[1]), int(m[2])), value, at


def read_body(data: bytes, begin: int, head: dict[str, Any], length_of=None) -> tuple[Stream, int]:
    """The stream body at ``begin``: by its length if ``endstream`` follows, else up to ``endstream``."""
    length = head.get("Length")
    if isinstance(length, Ref) and length_of:
        length = length_of(length)
    if isinstance(length, int) and 0 <= length <= len(data) - begin:
        end = begin + length
        if data.startswith(b"endstream", skip(data, end)):
            return Stream(head, data[begin:end]), end
    end = data.find(b"endstream", begin)
    if end < 0:
        raise ParseError("no endstream")
    body = data[begin:end]
    body = body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body
    return Stream(head, body), end


# ---- serialising ----

_PLAIN_NAME = frozenset(b"!\"$&'*+,-.0123456789:;=?@ABCDEFGHIJKLMNOPQRSTUVWXYZ\\^_`abcdefghijklmnopqrstuvwxyz|~")


@lru_cache(4096)
def write_name(name: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if c in _PLAIN_NAME else b"#%02X" % c for c in name.encode("latin-1"))


def write_string(raw: bytes) -> bytes:
    out = bytearray(b"(")
    for c in raw:
        if c in b"()\\":
            out += b"\\" + bytes([c])
        elif 0x20 <= c <= 0x7E:
            out.append(c)
        else:
            out += b"\\%03o" % c
    return bytes(out + b")")


def write_real(x: float) -> bytes:
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return b"0" if text in ("-0", "") else text.encode()


def write(value: Any) -> bytes:
    """The bytes of a value."""
    kind = type(value)
    if kind is dict:
        out = [b"<< "]
        for key, v in value.items():
            kind = type(v)
            if kind is Ref:
                out.append(b"%s %d %d R " % (write_name(key), *v))
            elif kind is Name:
                out.append(b"%s %s " % (write_name(key), write_name(v)))
            elif kind is int:
                out.append(b"%s %d " % (write_name(key), v))
            else:
                out.append(b"%s %s " % (write_name(key), write(v)))
        return b"".join(out) + b">>"
    if kind is list:
        return b"[" + b" ".join([b"%d %d R" % v if type(v) is Ref else write(v) for v in value]) + b"]"
    if kind is Stream:
        return write(value.dict | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    if kind is Ref:
        return b"%d %d R" % value
    if kind is Name:
        return write_name(value)
    if kind is int:
        return b"%d" % value
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return write_real(value)
    if isinstance(value, Hex):
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, bytes):
        return write_string(value)
    raise TypeError(f"no PDF value: {type(value)}")


def write_indirect(ref: Ref, value: Any) -> bytes:
    return b"%d %d obj\n" % ref + write(value) + b"\nendobj\n"


# ---- JSON with tags, for VARIANT columns ----


def tagged(value: Any) -> Any:
    """A JSON-able form: names, strings and references become one-key objects."""
    if isinstance(value, Name):
        return {"$n": str(value)}
    if isinstance(value, Ref):
        return {"$r": [value.num, value.gen]}
    if isinstance(value, Hex):
        return {"$h": base64.b64encode(value).decode()}
    if isinstance(value, bytes):
        return {"$s": base64.b64encode(value).decode()}
    if isinstance(value, list):
        return [tagged(v) for v in value]
    if isinstance(value, dict):
        return {k: tagged(v) for k, v in value.items()}
    if isinstance(value, Stream):
        return tagged(value.dict)
    return value


def untagged(value: Any) -> Any:
    if isinstance(value, list):
        return [untagged(v) for v in value]
    if isinstance(value, dict):
        if len(value) == 1:
            (key, inner), *_ = value.items()
            if key == "$n":
                return Name(inner)
            if key == "$r":
                return Ref(*inner)
            if key in ("$s", "$h"):
                return (Hex if key == "$h" else bytes)(base64.b64decode(inner))
        return {k: untagged(v) for k, v in value.items()}
    return value


def references(value: Any, path: str = "") -> list[tuple[str, int, int]]:
    """All references in a value with the path of keys to each."""
    if isinstance(value, Ref):
        return [(path, value.num, value.gen)]
    if isinstance(value, Stream):
        value = value.dict
    if isinstance(value, dict):
        return [r for k, v in value.items() for r in references(v, f"{path}/{k}")]
    if isinstance(value, list):
        return [r for i, v in enumerate(value) for r in references(v, f"{path}/{i}")]
    return []


def targets(value: Any, found: list[Ref] | None = None) -> list[Ref]:
    """What a value refers to, in the order of ``references``, without the paths."""
    found = [] if found is None else found
    if isinstance(value, Stream):
        value = value.dict
    for v in [value] if isinstance(value, Ref) else value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        kind = type(v)
        if kind is Ref:
            found.append(v)
        elif kind is not int and kind is not Name:
            targets(v, found)
    return found


def renumbered(value: Any, new: dict[Ref, Ref]) -> Any:
    """The value with references replaced where ``new`` has them."""
    kind = type(value)
    if kind is Ref:
        return new.get(value, value)
    if kind is int or kind is Name:
        return value
    if isinstance(value, Stream):
        return Stream(renumbered(value.dict, new), value.raw)
    if isinstance(value, dict):
        return {k: v if (kind := type(v)) is int or kind is Name else new.get(v, v) if kind is Ref else renumbered(v, new) for k, v in value.items()}
    if isinstance(value, list):
        return [renumbered(v, new) for v in value]
    return value


def kind(value: Any) -> str:
    for kinds, name in (
        (type(None), "null"), (bool, "bool"), (int, "integer"), (float, "real"), (Name, "name"), (Ref, "reference"),
        (Hex, "hexstring"), (bytes, "string"), (list, "array"), (dict, "dictionary"), (Stream, "stream"),
    ):
        if isinstance(value, kinds):
            return name
    raise TypeError(str(type(value)))


def number(value: Any) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


@dataclass
class Recovery:
    """What a load had to put up with."""

    warnings: list[str] = field(default_factory=list)
    xref_recovered: bool = False
    objects_skipped: int = 0

    @property
    def is_clean(self) -> bool:
        return not self.warnings and not self.xref_recovered and not self.objects_skipped
