"""PDF bytes from objects: whole files and incremental updates."""

from __future__ import annotations

from typing import Any

from folioframe.functions.cos import Name, Ref, Stream, write, write_indirect
from folioframe.functions.crypt import Locked
from folioframe.functions.document import find_startxref, load
from folioframe.functions.filters import encode

PACKED = 200  # objects in an object stream, at most


def runs(numbers: list[int]) -> list[list[int]]:
    """Sorted numbers cut into runs of consecutive ones."""
    out: list[list[int]] = []
    for n in numbers:
        if out and out[-1][-1] == n - 1:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def _table(offsets: dict[int, tuple[int, int]], trailer: dict[str, Any], free_head: bool) -> bytes:
    out = [b"xref\n"]
    known = dict(offsets)
    if free_head:
        known[0] = (0, 65535)
    for run in runs(sorted(known)):
        out.append(b"%d %d\n" % (run[0], len(run)))
        for n in run:
            offset, gen = known[n]
            out.append(b"%010d %05d %s \n" % (offset, gen, b"f" if n == 0 else b"n"))
    out.append(b"trailer\n" + write(trailer) + b"\n")
    return b"".join(out)


def write_file(objects: dict[Ref, Any], trailer: dict[str, Any], version: str = "1.7", xref: str = "table", packed: bool = False) -> bytes:
    """A whole file: objects by number, one cross-reference section.

    ``xref`` is ``table`` or ``stream``; ``packed`` puts objects that may be there into
    object streams, which needs a cross-reference stream.
    """
    out = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode())
    offsets: dict[int, tuple[int, int]] = {}
    inside: dict[int, tuple[int, int]] = {}
    order = sorted(objects)
    size = max((r.num for r in order), default=0) + 1
    if packed and xref == "stream":
        loose = [r for r in order if not isinstance(objects[r], Stream) and not r.gen]
        for i in range(0, len(loose), PACKED):
            group = loose[i : i + PACKED]
            objects = objects | {Ref(size, 0): pack([(r.num, objects[r]) for r in group])}
            inside |= {r.num: (size, k) for k, r in enumerate(group)}
            size += 1
        order = [r for r in sorted(objects) if r.num not in inside]
    for ref in order:
        offsets[ref.num] = (len(out), ref.gen)
        out += write_indirect(ref, objects[ref])
    start = len(out)
    if xref == "table":
        out += _table(offsets, trailer | {"Size": size}, True)
    else:
        offsets[size] = (start, 0)
        rows = [(0, 0, 0, 65535)] + [(n, 1, o, g) for n, (o, g) in offsets.items()] + [(n, 2, c, k) for n, (c, k) in inside.items()]
        rows.sort()
        index = [x for run in runs([r[0] for r in rows]) for x in (run[0], len(run))]
        body = b"".join(bytes([k]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for _, k, a, b in rows)
        head = trailer | {"Type": Name("XRef"), "Size": size + 1, "W": [1, 4, 2], "Index": index, "Filter": Name("FlateDecode")}
        out += write_indirect(Ref(size, 0), Stream(head, encode(body, ["FlateDecode"])))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def pack(group: list[tuple[int, Any]]) -> Stream:
    """An object stream."""
    heads, body = [], bytearray()
    for num, value in group:
        heads.append(b"%d %d" % (num, len(body)))
        body += write(value) + b"\n"
    first = b" ".join(heads) + b"\n"
    head = {"Type": Name("ObjStm"), "N": len(group), "First": len(first), "Filter": Name("FlateDecode")}
    return Stream(head, encode(bytes(first + body), ["FlateDecode"]))


def write_update(original: bytes, changes: dict[Ref, Any], password: bytes = b"") -> bytes:
    """An incremental update: the original bytes, the changed objects, and a section that points back.

    Into an encrypted file the changed objects are written encrypted; ``Locked`` is raised if the password does not open it.
    """
    return write_updates(original, [changes], password)


def write_updates(original: bytes, updates: list[dict[Ref, Any]], password: bytes = b"") -> bytes:
    """Incremental updates one after the other, as by ``write_update``; the file is loaded once for all of them."""
    previous = find_startxref(original)
    old = load(original, password=password)
    if old.locked:
        raise Locked("encrypted, and not opened by the password")
    out = bytearray(original)
    size = old.trailer.get("Size", 0)
    keep = {k: old.trailer[k] for k in ("Root", "Info", "ID", "Encrypt") if k in old.trailer}
    for changes in updates:
        if old.crypt:
            changes = {r: old.crypt.changed(r, v, False) for r, v in changes.items()}
        as_stream = out[previous : previous + 4] != b"xref"
        if not out.endswith(b"\n"):
            out += b"\n"
        offsets: dict[int, tuple[int, int]] = {}
        for ref in sorted(changes):
            offsets[ref.num] = (len(out), ref.gen)
            out += write_indirect(ref, changes[ref])
        start = len(out)
        size = max([size, *(r.num + 1 for r in changes)])
        if previous != start and as_stream:
            rows = sorted([(n, o, g) for n, (o, g) in offsets.items()] + [(size, start, 0)])
            index = [x for run in runs([r[0] for r in rows]) for x in (run[0], len(run))]
            body = b"".join(b"\x01" + o.to_bytes(4, "big") + g.to_bytes(2, "big") for _, o, g in rows)
            head = keep | {"Type": Name("XRef"), "Size": size + 1, "W": [1, 4, 2], "Index": index, "Prev": previous}
            out += write_indirect(Ref(size, 0), Stream(head, body))
            size += 1
        else:
            out += _table(offsets, keep | {"Size": size, "Prev": previous}, False)
        out += b"startxref\n%d\n%%%%EOF\n" % start
        previous = start
    return bytes(out)
