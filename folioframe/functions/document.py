"""One PDF file: cross-reference sections, objects, pages and their content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from folioframe.functions import filters
from folioframe.functions.crypt import Crypt, handler
from folioframe.functions.cos import OBJECT_HEADER, PLAIN_OBJECT, Name, ParseError, Recovery, Ref, Stream, number, parse, parse_indirect, skip

HEADER_REACH = 1024
PAGE_DEPTH = 64
HOPS = 16
_HEADER = re.compile(rb"%PDF-(\d)\.(\d)")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")
_FIXED = re.compile(rb"[\r\n]*((?:\d{10} \d{5} [nf][ \r][\r\n])++)")  # entries of the form that the specification fixes, 20 bytes each
_SUBSECTION = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,10})[ \t]+(\d{1,10})(?=[\x00\t\n\x0c\r ])")


@dataclass(slots=True)
class Entry:
    """A cross-reference entry of one section; ``section`` 0 is the newest."""

    section: int
    source: str
    num: int
    gen: int
    kind: str  # free, in_use, compressed
    offset: int | None = None
    next_free: int | None = None
    container: int | None = None
    index: int | None = None


@dataclass
class Page:
    index: int
    ref: Ref
    dict: dict[str, Any]
    media_box: list[float] | None
    crop_box: list[float] | None
    rotate: int
    resources: dict[str, Any]


@dataclass
class Pdf:
    """A loaded file. ``winners`` has one entry for each object number, from the newest section."""

    data: bytes
    version: str | None = None
    entries: list[Entry] = field(default_factory=list)
    trailers: list[dict[str, Any]] = field(default_factory=list)
    winners: dict[int, Entry] = field(default_factory=dict)
    trailer: dict[str, Any] = field(default_factory=dict)
    report: Recovery = field(default_factory=Recovery)
    objects: dict[int, tuple[Ref, Any]] = field(default_factory=dict)
    containers: dict[int, dict[int, Any]] = field(default_factory=dict)
    failed: set[int] = field(default_factory=set)
    crypt: Crypt | None = None
    locked: bool = False  # encrypted, and not opened: strings and streams are as they stand in the file
    closed: int = -1  # number of the encryption dictionary, which is never encrypted

    # ---- objects ----

    def unlock(self, password: bytes) -> None:
        """Finds out how the file is encrypted, if it is; what is parsed from then on is decrypted."""
        entry = self.trailer.get("Encrypt")
        if entry is None or self.crypt:
            return
        ids = self.resolve(self.trailer.get("ID"))
        first = self.resolve(ids[0]) if isinstance(ids, list) and ids else b""
        self.crypt = handler(entry, bytes(first) if isinstance(first, bytes) else b"", password, self.resolve)
        self.locked = self.crypt is None
        self.closed = entry.num if isinstance(entry, Ref) else -1
        self.objects, self.containers, self.failed = {}, {}, set()

    def get(self, ref: Ref) -> Any:
        """The object of a reference, parsed on first use; None if it is not there."""
        num = ref.num
        if num in self.objects:
            return self.objects[num][1]
        entry = self.winners.get(num)
        if entry is None or entry.kind == "free" or num in self.failed:
            return None
        self.failed.add(num)  # until it is there: a cycle through a stream length ends
        try:
            if entry.kind == "in_use":
                found, value, _ = parse_indirect(self.data, entry.offset, lambda r: self.get(r))
                if found.num != num:
                    raise ParseError("another object is at this offset")
                if self.crypt and num != self.closed:
                    value = self.crypt.changed(found, value, True)
            else:
                value = self.container(entry.container)[num]
                found = Ref(num, 0)
        except (ParseError, KeyError, filters.FilterError, RecursionError):
            return None
        self.failed.discard(num)
        self.objects[num] = (found, value)
        return value

    def resolve(self, value: Any) -> Any:
        """Follows a chain of references, 16 at most."""
        for _ in range(HOPS):
            if not isinstance(value, Ref):
                return value
            value = self.get(value)
        return None

    def container(self, num: int) -> dict[int, Any]:
        """The objects of an object stream."""
        if num not in self.containers:
            stream = self.get(Ref(num, 0))
            if not isinstance(stream, Stream):
                raise ParseError(f"no object stream {num}")
            self.containers[num] = unpack_objects(self.decoded(stream), self.resolve(stream.dict.get("N")), self.resolve(stream.dict.get("First")))
        return self.containers[num]

    def decoded(self, stream: Stream) -> bytes:
        chain = self.resolve(stream.dict.get("Filter", stream.dict.get("F")))
        parms = self.resolve(stream.dict.get("DecodeParms", stream.dict.get("DP")))
        if isinstance(chain, list):
            chain = [self.resolve(f) for f in chain]
        if isinstance(parms, list):
            parms = [self.resolve(p) for p in parms]
        return filters.decode(stream.raw, chain, parms)

    def all_objects(self) -> Iterator[tuple[Ref, Any, str]]:
        """Every object that parses, by number, with where it came from."""
        for num in sorted(self.winners):
            entry = self.winners[num]
            if entry.kind == "free":
                continue
            value = self.get(Ref(num, entry.gen))
            if num in self.objects:
                yield self.objects[num][0], value, "objstm" if entry.kind == "compressed" else "direct"
            else:
                self.report.objects_skipped += 1

    def count_objects(self) -> int:
        """How many objects ``all_objects`` has. Those of a plain form are checked by one pattern, and only the others are read."""
        count = 0
        for num, entry in self.winners.items():
            if entry.kind == "free":
                continue
            m = PLAIN_OBJECT.match(self.data, entry.offset) if entry.kind == "in_use" and not self.crypt else None
            if m and int(m[1]) == num and (not m[5] or self.data.find(b"endstream", m.end()) >= 0):
                count += 1
            else:
                self.get(Ref(num, entry.gen))
                count += num in self.objects
        return count

    # ---- structure ----

    @property
    def catalog(self) -> dict[str, Any]:
        root = self.resolve(self.trailer.get("Root"))
        return root if isinstance(root, dict) else {}

    def pages(self) -> list[Page]:
        """Pages in document order with inherited attributes; broken and repeated nodes are left out."""
        found: list[Page] = []
        seen: set[int] = set()

        def walk(ref: Any, inherited: dict[str, Any], depth: int) -> None:
            node = self.resolve(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref) or ref.num in seen or depth > PAGE_DEPTH:
                return
            seen.add(ref.num)
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                for kid in kids:
                    walk(kid, own, depth + 1)
                return
            media = self.box(own.get("MediaBox"))
            rotate = number(self.resolve(own.get("Rotate"))) or 0
            resources = self.resolve(own.get("Resources"))
            found.append(
                Page(len(found), ref, node, media, self.box(own.get("CropBox")) or media, int(rotate) % 360, resources if isinstance(resources, dict) else {})
            )

        walk(self.catalog.get("Pages"), {}, 0)
        return found

    def box(self, value: Any) -> list[float] | None:
        value = self.resolve(value)
        if not isinstance(value, list) or len(value) != 4:
            return None
        numbers = [number(self.resolve(v)) for v in value]
        return None if None in numbers else numbers  # type: ignore[return-value]

    def content(self, page: Page) -> bytes:
        """The page's decoded content streams, a space after each."""
        contents = self.resolve(page.dict.get("Contents"))
        streams = contents if isinstance(contents, list) else [contents]
        out = []
        for s in streams:
            s = self.resolve(s)
            if isinstance(s, Stream):
                try:
                    out.append(self.decoded(s) + b" ")
                except filters.FilterError as e:
                    self.report.warnings.append(f"content of page {page.index}: {e}")
        return b"".join(out)


def unpack_objects(data: bytes, count: Any, first: Any) -> dict[int, Any]:
    """Objects of a decoded object stream by number."""
    if not isinstance(count, int) or not isinstance(first, int):
        raise ParseError("object stream without N or First")
    at, heads = 0, []
    for _ in range(count):
        num, at = parse(data, at)
        offset, at = parse(data, at)
        heads.append((num, offset))
    return {num: parse(data, first + offset)[0] for num, offset in heads}


def header_version(data: bytes) -> str | None:
    m = _HEADER.search(data[:HEADER_REACH])
    return f"{m[1].decode()}.{m[2].decode()}" if m else None


def find_startxref(data: bytes) -> int:
    tail = max(0, len(data) - HEADER_REACH)
    at = data.rfind(b"startxref", tail)
    if at < 0:
        raise ParseError("no startxref")
    value, _ = parse(data, at + 9)
    if not isinstance(value, int) or not 0 <= value < len(data):
        raise ParseError("startxref points outside of the file")
    return value


def read_sections(pdf: Pdf, start: int) -> None:
    """Walks cross-reference sections from the newest; every offset is visited once."""
    todo, seen, section = [start], set(), 0
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        at = skip(pdf.data, at)
        head = _table(pdf, at, section) if pdf.data.startswith(b"xref", at) else _stream(pdf, at, section)
        pdf.trailers.append(head)
        section += 1
        todo += [v for v in (head.get("XRefStm"), head.get("Prev")) if isinstance(v, int) and 0 <= v < len(pdf.data)]


def _table(pdf: Pdf, at: int, section: int) -> dict[str, Any]:
    data, at = pdf.data, at + 4
    while m := _SUBSECTION.match(data, at):
        first, count = int(m[1]), int(m[2])
        at = m.end()
        fixed = _FIXED.match(data, at)
        whole = min(count, (fixed.end(1) - fixed.start(1)) // 20) if fixed else 0
        if fixed:
            at = fixed.start(1)
        for i in range(whole):
            value, gen = int(data[at : at + 10]), int(data[at + 11 : at + 16])
            if data[at + 17] == 0x6E:
                pdf.entries.append(Entry(section, "table", first + i, gen, "in_use", value))
            else:
                pdf.entries.append(Entry(section, "table", first + i, gen, "free", None, value))
            at += 20
        for i in range(whole, count):
            e = _ENTRY.match(data, at)
            if not e:
                raise ParseError("bad cross-reference entry")
            at = e.end()
            value, gen = int(e[1]), int(e[2])
            if e[3] == b"n":
                pdf.entries.append(Entry(section, "table", first + i, gen, "in_use", offset=value))
            else:
                pdf.entries.append(Entry(section, "table", first + i, gen, "free", next_free=value))
    at = skip(data, at)
    if not data.startswith(b"trailer", at):
        raise ParseError("no trailer")
    head, _ = parse(data, at + 7)
    if not isinstance(head, dict):
        raise ParseError("the trailer is no dictionary")
    return head


def _stream(pdf: Pdf, at: int, section: int) -> dict[str, Any]:
    _, stream, _ = parse_indirect(pdf.data, at)
    if not isinstance(stream, Stream) or not isinstance(stream.dict.get("W"), list):
        raise ParseError("no cross-reference stream")
    body = filters.decode(stream.raw, stream.dict.get("Filter"), stream.dict.get("DecodeParms"))
    for num, kind, a, b in stream_entries(body, stream.dict):
        if kind == 0:
            pdf.entries.append(Entry(section, "stream", num, b, "free", next_free=a))
        elif kind == 1:
            pdf.entries.append(Entry(section, "stream", num, b, "in_use", offset=a))
        elif kind == 2:
            pdf.entries.append(Entry(section, "stream", num, 0, "compressed", container=a, index=b))
    return stream.dict


def stream_entries(body: bytes, head: dict[str, Any]) -> Iterator[tuple[int, int, int, int]]:
    """Object number, type and two fields of each entry; a type of width 0 is 1."""
    w = [int(x) for x in head["W"][:3]]
    index = head.get("Index") or [0, head.get("Size", 0)]
    at, size = 0, sum(w)
    for first, count in zip(index[::2], index[1::2], strict=False):
        for i in range(count):
            if at + size > len(body):
                return
            fields, p = [], at
            for width in w:
                fields.append(int.from_bytes(body[p : p + width], "big"))
                p += width
            yield first + i, fields[0] if w[0] else 1, fields[1], fields[2]
            at += size


def _merge(pdf: Pdf) -> None:
    """The newest section wins, for objects and for trailer keys."""
    for e in pdf.entries:
        pdf.winners.setdefault(e.num, e)
    for t in pdf.trailers:
        for k, v in t.items():
            pdf.trailer.setdefault(k, v)


def load(data: bytes, lenient: bool = False, password: bytes = b"") -> Pdf:
    """Loads a file. Strict loading raises ``ParseError``; lenient loading never does and reports instead.

    Encrypted files are decrypted if the password opens them (the empty one, that of files
    anyone may read, unless another is given); else they are ``locked``.
    """
    pdf = Pdf(data, header_version(data))
    if pdf.version is None:
        if not lenient:
            raise ParseError("no PDF header")
        pdf.report.warnings.append("no PDF header")
    try:
        read_sections(pdf, find_startxref(data))
        _merge(pdf)
        pdf.unlock(password)
        if lenient and (not pdf.catalog or not _offsets_hold(pdf)):
            raise ParseError("the cross-reference table does not fit the file")
        if not pdf.trailer.get("Root"):
            raise ParseError("no root")
    except (ParseError, filters.FilterError) as e:
        if not lenient:
            raise ParseError(str(e)) from e
        pdf.report.warnings.append(str(e))
        scan(pdf, password)
    if pdf.locked:
        pdf.report.warnings.append("encrypted, and not opened by the password")
    return pdf


def _offsets_hold(pdf: Pdf) -> bool:
    for e in pdf.winners.values():
        if e.kind == "in_use":
            m = OBJECT_HEADER.match(pdf.data, skip(pdf.data, e.offset))
            if not m or int(m[1]) != e.num:
                return False
    return True


def scan(pdf: Pdf, password: bytes = b"") -> None:
    """Finds objects by their headers, the last of a number winning, and a trailer where there is one."""
    data = pdf.data
    pdf.report.xref_recovered = True
    pdf.entries, pdf.trailers, pdf.winners, pdf.trailer = [], [], {}, {}
    pdf.objects, pdf.containers, pdf.failed = {}, {}, set()
    pdf.crypt, pdf.locked, pdf.closed = None, False, -1
    for m in OBJECT_HEADER.finditer(data):
        if m.start() and data[m.start() - 1 : m.start()].isdigit():
            continue
        entry = Entry(0, "scan", int(m[1]), int(m[2]), "in_use", offset=m.start())
        pdf.entries.append(entry)
        pdf.winners[entry.num] = entry
    for m in re.finditer(rb"trailer", data):
        try:
            head, _ = parse(data, m.end())
        except ParseError:
            continue
        if isinstance(head, dict):
            pdf.trailers.insert(0, head)
    streams = []
    for num in list(pdf.winners):
        value = pdf.get(Ref(num, pdf.winners[num].gen))
        if isinstance(value, Stream) and value.dict.get("Type") == "XRef":
            pdf.trailers.insert(0, value.dict)
        if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
            streams.append(num)
    pdf.trailer = {k: v for t in reversed(pdf.trailers) for k, v in t.items()}
    pdf.unlock(password)
    for num in streams:
        try:
            for index, inner in enumerate(pdf.container(num)):
                if inner not in pdf.winners:
                    pdf.winners[inner] = Entry(0, "scan", inner, 0, "compressed", container=num, index=index)
                    pdf.entries.append(pdf.winners[inner])
        except (ParseError, filters.FilterError) as e:
            pdf.report.warnings.append(f"object stream {num}: {e}")
    for t in pdf.trailers:
        for k, v in t.items():
            pdf.trailer.setdefault(k, v)
    if not pdf.catalog:
        for num in sorted(pdf.winners):
            value = pdf.get(Ref(num, pdf.winners[num].gen))
            if isinstance(value, dict) and value.get("Type") == Name("Catalog"):
                pdf.trailer["Root"] = Ref(num, pdf.winners[num].gen)
                pdf.report.warnings.append("root found by its type")
                break
