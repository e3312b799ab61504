"""Content streams: instructions, the graphics state, text chunks and inline images."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from typing import Any

from folioframe.functions.cos import Keyword, Name, ParseError, parse, skip
from folioframe.functions.fonts import Font

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
KERN_SPACE = -250  # in a TJ array, a shift beyond this is a space

# Abbreviations in inline images.
INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
INLINE_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


@dataclass
class Instruction:
    op: str
    operands: list[Any]
    data: bytes | None = None  # of an inline image


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """``m`` applied first, then ``n`` (row vectors)."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


_END_IMAGE = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)")


def instructions(data: bytes) -> list[Instruction]:
    """The instructions of a content stream, up to damage if there is any."""
    out: list[Instruction] = []
    operands: list[Any] = []
    at = skip(data, 0)
    try:
        while at < len(data):
            value, at = parse(data, at)
            if not isinstance(value, Keyword):
                operands.append(value)
            elif value.word == b"BI":
                image, at = _inline(data, at)
                out.append(image)
                operands = []
            else:
                out.append(Instruction(value.word.decode("latin-1"), operands))
                operands = []
            at = skip(data, at)
    except ParseError:
        pass
    return out


def _inline(data: bytes, at: int) -> tuple[Instruction, int]:
    head: dict[str, Any] = {}
    while True:
        key, at = parse(data, at)
        if isinstance(key, Keyword):
            break
        value, at = parse(data, at)
        full = INLINE_KEYS.get(str(key), str(key))
        if full == "ColorSpace" and isinstance(value, Name):
            value = Name(INLINE_SPACES.get(value, value))
        head[full] = value
    if key.word != b"ID":
        raise ParseError("inline image without ID")
    begin = at + 1
    m = _END_IMAGE.search(data, begin)
    if not m:
        raise ParseError("inline image without EI")
    return Instruction("BI", [head], data[begin : m.start()]), m.end()


@dataclass
class State:
    ctm: Matrix = IDENTITY
    font: str | None = None
    size: float = 0.0
    leading: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 100.0
    rise: float = 0.0


@dataclass
class Chunk:
    text: str
    x: float
    y: float
    font_size: float
    font: str | None


def _numbers(values: list[Any], n: int) -> list[float] | None:
    got = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return got if len(got) == n == len(values) else None


def clean(text: str) -> str:
    """Without control characters other than line ends."""
    return re.sub(r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", text)


def text_chunks(data: bytes, fonts: dict[str, Font]) -> list[Chunk]:
    """Positioned text of a content stream. Strings of fonts that are not there are read as Latin-1."""
    state, stack, out = State(), [], []
    text: Matrix = IDENTITY
    line: Matrix = IDENTITY

    def show(raw: bytes) -> None:
        nonlocal text
        font = fonts.get(state.font or "")
        codes = font.codes(raw) if font else [(c, chr(c)) for c in raw]
        shown = clean("".join(t for _, t in codes))
        place = multiply(text, state.ctm)
        size = state.size * math.hypot(place[1], place[3])
        if shown:
            x, y = (state.rise * place[2] + place[4], state.rise * place[3] + place[5])
            out.append(Chunk(shown, x, y, size if size else state.size, state.font))
        advance = 0.0
        for code, _ in codes:
            width = font.width(code) if font else 0.0
            advance += (width / 1000 * state.size + state.char_space + (state.word_space if code == 32 and not (font and font.composite) else 0)) * state.scale / 100
        text = multiply((1, 0, 0, 1, advance, 0), text)

    def next_line(tx: float, ty: float) -> None:
        nonlocal text, line
        line = multiply((1, 0, 0, 1, tx, ty), line)
        text = line

    for i in instructions(data):
        op, args = i.op, i.operands
        if op == "q":
            stack.append(replace(state))
        elif op == "Q":
            if stack:
                state = stack.pop()
        elif op == "cm" and (n := _numbers(args, 6)):
            state.ctm = multiply(tuple(n), state.ctm)
        elif op == "BT":
            text = line = IDENTITY
        elif op == "Tf" and len(args) == 2 and isinstance(args[0], Name) and (n := _numbers(args[1:], 1)):
            state.font, state.size = str(args[0]), n[0]
        elif op in ("TL", "Tc", "Tw", "Tz", "Ts") and (n := _numbers(args, 1)):
            setattr(state, {"TL": "leading", "Tc": "char_space", "Tw": "word_space", "Tz": "scale", "Ts": "rise"}[op], n[0])
        elif op == "Tm" and (n := _numbers(args, 6)):
            text = line = tuple(n)
        elif op in ("Td", "TD") and (n := _numbers(args, 2)):
            if op == "TD":
                state.leading = -n[1]
            next_line(*n)
        elif op == "T*":
            next_line(0, -state.leading)
        elif op == "Tj" and args and isinstance(args[0], bytes):
            show(args[0])
        elif op == "'" and args and isinstance(args[0], bytes):
            next_line(0, -state.leading)
            show(args[0])
        elif op == '"' and len(args) == 3 and isinstance(args[2], bytes) and (n := _numbers(args[:2], 2)):
            state.word_space, state.char_space = n
            next_line(0, -state.leading)
            show(args[2])
        elif op == "TJ" and args and isinstance(args[0], list):
            joined = bytearray()
            font = fonts.get(state.font or "")
            wide = bool(font and font.composite)
            pending = 0.0
            for part in args[0]:
                if isinstance(part, bytes):
                    joined += part
                elif isinstance(part, (int, float)):
                    pending += part
                    if part < KERN_SPACE:
                        joined += b"\x00\x20" if wide else b" "
            show(bytes(joined))
            text = multiply((1, 0, 0, 1, -pending / 1000 * state.size * state.scale / 100, 0), text)
    return out


def drawn_widths(data: bytes) -> list[tuple[str, float | None]]:
    """Names that ``Do`` draws, with the width in points that the current matrix gives a unit (None without one)."""
    out: list[tuple[str, float | None]] = []
    stack: list[Matrix | None] = []
    ctm: Matrix | None = None
    for i in instructions(data):
        if i.op == "q":
            stack.append(ctm)
        elif i.op == "Q":
            ctm = stack.pop() if stack else ctm
        elif i.op == "cm" and (n := _numbers(i.operands, 6)):
            ctm = multiply(tuple(n), ctm or IDENTITY)
        elif i.op == "Do" and i.operands and isinstance(i.operands[0], Name):
            out.append((str(i.operands[0]), math.hypot(ctm[0], ctm[1]) if ctm else None))
    return out


def shown_codes(data: bytes, fonts: dict[str, Font]) -> dict[tuple[str, int], int]:
    """How often each code of each font is shown; strings without a font that is there are left out."""
    out: dict[tuple[str, int], int] = {}
    stack: list[str | None] = []
    current: str | None = None
    for i in instructions(data):
        if i.op == "q":
            stack.append(current)
        elif i.op == "Q":
            current = stack.pop() if stack else current
        elif i.op == "Tf" and i.operands and isinstance(i.operands[0], Name):
            current = str(i.operands[0])
        elif i.op in ("Tj", "'", '"', "TJ") and i.operands and current in fonts:
            last = i.operands[-1]
            for part in last if isinstance(last, list) else [last]:
                for code, _ in fonts[current].codes(part) if isinstance(part, bytes) else ():
                    out[current, code] = out.get((current, code), 0) + 1
    return out
