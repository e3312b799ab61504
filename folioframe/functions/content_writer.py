"""Writing content streams: a method for each operator, and instruction rows back to bytes."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.cos import Name, Ref, Stream, untagged, write
from folioframe.functions.filters import encode, flate_decode, predict

# Method, operator, number of operands (None: any).
OPERATORS = {
    "begin_text": ("BT", 0), "end_text": ("ET", 0), "set_font": ("Tf", 2), "move_to": ("Td", 2), "move_to_set_leading": ("TD", 2),
    "move_to_next_line": ("T*", 0), "set_text_matrix": ("Tm", 6), "set_char_spacing": ("Tc", 1), "set_word_spacing": ("Tw", 1),
    "set_horizontal_scaling": ("Tz", 1), "set_text_leading": ("TL", 1), "set_text_rise": ("Ts", 1), "set_text_render_mode": ("Tr", 1),
    "show_text": ("Tj", 1), "show_text_next_line": ("'", 1), "show_text_next_line_with_spacing": ('"', 3), "show_text_positioned": ("TJ", 1),
    "move_to_point": ("m", 2), "line_to": ("l", 2), "curve_to": ("c", 6), "curve_to_final": ("v", 4), "curve_to_initial": ("y", 4),
    "add_rect": ("re", 4), "close_path": ("h", 0), "stroke": ("S", 0), "fill": ("f", 0), "fill_even_odd": ("f*", 0), "stroke_and_close": ("s", 0),
    "fill_and_stroke": ("B", 0), "fill_and_stroke_even_odd": ("B*", 0), "close_fill_and_stroke": ("b", 0), "close_fill_and_stroke_even_odd": ("b*", 0),
    "clip": ("W", 0), "clip_even_odd": ("W*", 0), "end_path": ("n", 0), "set_line_width": ("w", 1), "set_line_cap": ("J", 1), "set_line_join": ("j", 1),
    "set_miter_limit": ("M", 1), "set_line_dash": ("d", 2), "set_rendering_intent": ("ri", 1), "set_flatness": ("i", 1), "set_graphics_state": ("gs", 1),
    "save_state": ("q", 0), "restore_state": ("Q", 0), "transform": ("cm", 6), "set_fill_rgb": ("rg", 3), "set_stroke_rgb": ("RG", 3),
    "set_fill_gray": ("g", 1), "set_stroke_gray": ("G", 1), "set_fill_cmyk": ("k", 4), "set_stroke_cmyk": ("K", 4), "set_fill_color_space": ("cs", 1),
    "set_stroke_color_space": ("CS", 1), "set_fill_color": ("scn", None), "set_stroke_color": ("SCN", None), "draw_xobject": ("Do", 1),
}


class ContentWriter:
    """``ContentWriter().begin_text().set_font(Name("F1"), 12).show_text(b"hi").end_text().data()``."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def add(self, operator: str, operands: Iterable[Any] = ()) -> ContentWriter:
        self.parts.append(b" ".join([*map(write, operands), operator.encode("latin-1")]))
        return self

    def __getattr__(self, method: str):
        if method not in OPERATORS:
            raise AttributeError(method)
        operator, arity = OPERATORS[method]

        def put(*operands: Any) -> ContentWriter:
            if arity is not None and len(operands) != arity:
                raise ValueError(f"{method} takes {arity} operands")
            return self.add(operator, operands)

        return put

    def draw_image(self, name: str, x: float, y: float, width: float, height: float) -> ContentWriter:
        return self.add("q").add("cm", [width, 0, 0, height, x, y]).add("Do", [Name(name)]).add("Q")

    def data(self) -> bytes:
        return b"\n".join(self.parts)

    def close(self) -> ContentWriter:
        """What is still open ended: text, and saved states."""
        depth, in_text = self._open()
        if in_text:
            self.add("ET")
        for _ in range(depth):
            self.add("Q")
        return self

    def problems(self) -> list[str]:
        """What readers would stumble over: unbalanced states and text, text shown without a font or outside of text."""
        out, depth, in_text, font = [], 0, False, False
        for op in self._operators():
            depth += (op == "q") - (op == "Q")
            if depth < 0:
                out.append("Q without q")
                depth = 0
            if op == "BT":
                if in_text:
                    out.append("BT within text")
                in_text = True
            elif op == "ET":
                if not in_text:
                    out.append("ET without BT")
                in_text = False
            elif op == "Tf":
                font = True
            elif op in ("Tj", "TJ", "'", '"'):
                if not in_text:
                    out.append(f"{op} outside of text")
                if not font:
                    out.append(f"{op} without a font")
        return out + ["text is not ended"] * in_text + ["states are not restored"] * (depth > 0)

    def _operators(self) -> list[str]:
        return [p.rsplit(b" ", 1)[-1].decode("latin-1") for p in self.parts]

    def _open(self) -> tuple[int, bool]:
        depth, in_text = 0, False
        for op in self._operators():
            depth = max(0, depth + (op == "q") - (op == "Q"))
            in_text = op == "BT" or in_text and op != "ET"
        return depth, in_text


class Resources:
    """A page's resources as they are registered; each gets a name that is not taken."""

    def __init__(self, start: int, taken: dict[str, dict[str, Any]] | None = None) -> None:
        self.entries = {k: dict(v) for k, v in (taken or {}).items()}
        self.objects: dict[Ref, Any] = {}
        self.next = start

    def _register(self, kind: str, value: Any, wanted: str) -> str:
        ref, self.next = Ref(self.next, 0), self.next + 1
        self.objects[ref] = value
        name = resource_name(wanted, self.entries.get(kind, ()))
        self.entries.setdefault(kind, {})[name] = ref
        return name

    def font(self, base: str = "Helvetica") -> str:
        return self._register("Font", {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": Name("WinAnsiEncoding")}, "F")

    def image(self, width: int, height: int, samples: bytes, channels: int = 3, alpha: bytes | None = None) -> str:
        """8-bit samples, deflated, with a soft mask if there is alpha."""
        if len(samples) != width * height * channels or channels not in (1, 3, 4) or alpha is not None and len(alpha) != width * height:
            raise ValueError("samples do not fill the image")
        head = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
        space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[channels]
        own = head | {"ColorSpace": Name(space)}
        if alpha is not None:
            mask, self.next = Ref(self.next, 0), self.next + 1
            self.objects[mask] = Stream(head | {"ColorSpace": Name("DeviceGray")}, encode(alpha, ["FlateDecode"]))
            own["SMask"] = mask
        return self._register("XObject", Stream(own, encode(samples, ["FlateDecode"])), "Im")

    def png(self, data: bytes) -> str:
        """A PNG of 8 bits a channel, not interlaced: gray or RGB, with or without alpha."""
        if not data.startswith(b"\x89PNG\r\n\x1a\n"):
            raise ValueError("no PNG")
        at, parts = 8, {}
        while at + 8 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + size]
            at += 12 + size
        width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
        channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
        if depth != 8 or channels is None or interlaced:
            raise ValueError("a PNG of another kind")
        flat = predict(flate_decode(parts[b"IDAT"]), {"Predictor": 15, "Colors": channels, "Columns": width})
        if channels in (1, 3):
            return self.image(width, height, flat, channels)
        pixels = [flat[i : i + channels] for i in range(0, len(flat), channels)]
        return self.image(width, height, b"".join(p[:-1] for p in pixels), channels - 1, b"".join(p[-1:] for p in pixels))

    def form(self, content: bytes, box: list[float], resources: dict[str, Any] | None = None) -> str:
        head = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box, "Resources": resources or {}}
        return self._register("XObject", Stream(head, content), "Fm")


def resource_name(wanted: str, taken: Iterable[str] = ()) -> str:
    """A valid name, made unique by a number."""
    base = re.sub(r"[^A-Za-z0-9_.-]", "_", wanted.lstrip("/")) or "X"
    known, name, n = set(taken), base, 1
    while name in known:
        name, n = f"{base}{n}", n + 1
    return name


def page_content(instructions: DataFrame) -> DataFrame:
    """``file_id, page_index, content`` from instruction rows, in order; inline images are written out in full keys."""

    def written(op: str, operands: list[str] | None, data: bytes | None) -> bytes:
        values = [untagged(json.loads(v)) for v in operands or []]
        if op == "BI":
            head = b" ".join(write(Name(k)) + b" " + write(v) for k, v in values[0].items())
            return b"BI " + head + b" ID " + (data or b"") + b" EI"
        return b" ".join([*map(write, values), op.encode("latin-1")])

    @F.arrow_udf("binary")
    def line(op: pa.Array, operands: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array([written(*row) for row in zip(op.to_pylist(), operands.to_pylist(), data.to_pylist(), strict=True)], pa.binary())

    rows = instructions.select("file_id", "page_index", "seq", F.hex(line("op", "operands", "data")).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"])
    return rows.groupBy("file_id", "page_index").agg(F.unhex(F.array_join(ordered, "0A")).alias("content"))
