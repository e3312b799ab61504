"""Permissions, standard-security keys, RC4 and signature structure."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.crypt import PAD, authenticate, encryption, file_key, object_key, owner_entry, rc4, user_entry  # noqa: F401
from folioframe.functions.cos import Ref, Stream
from folioframe.functions.document import load
from folioframe.functions.writing import write_file
from folioframe.operators.writers import _rewritten, each_content

# The bits of /P.
PERMISSIONS = {"print": 2, "modify": 3, "copy": 4, "annotate": 5, "fill_forms": 8, "accessibility": 9, "assemble": 10, "print_high": 11}


def permission_flags(p: Column) -> dict[str, Column]:
    """A boolean for each user permission of a ``/P`` value."""
    return {name: F.shiftright(p.cast("long"), bit).bitwiseAND(F.lit(1)) == 1 for name, bit in PERMISSIONS.items()}


def permission_value(p: Column) -> Column:
    """``/P`` as written: the two low bits clear, the two reserved ones after them set."""
    return p.bitwiseAND(F.lit(~3)).bitwiseOR(F.lit(192))


def flag_columns(flags: Column, bits: dict[str, int]) -> dict[str, Column]:
    return {name: F.shiftright(flags.cast("long"), bit).bitwiseAND(F.lit(1)) == 1 for name, bit in bits.items()}


def _md5(x: Column) -> Column:
    return F.unhex(F.md5(x))


def encryption_key(password: Column, owner: Column, p: Column, file_id: Column, revision: int, length: int) -> Column:
    """The file key (binary) in SQL: MD5 over padded password, O, P and file id, 50 more rounds from revision 3 on."""
    padded = F.substring(F.concat(password, F.lit(PAD)), 1, 32)
    seed = F.concat(padded, F.substring(owner, 1, 32), little_endian(p), file_id)
    digest = _md5(seed)
    if revision >= 3:
        digest = F.aggregate(F.sequence(F.lit(1), F.lit(50)), digest, lambda acc, _: _md5(F.substring(acc, 1, length)))
    return F.substring(digest, 1, length)


def little_endian(p: Column) -> Column:
    """The low 32 bits as four bytes, the least first."""
    word = F.lpad(F.hex(p.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*[F.substring(word, i, 2) for i in (7, 5, 3, 1)]))


def decrypt_streams(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """``objects`` with ``raw`` decrypted by ``keys`` (``file_id, key, method``: V2 by RC4, AESV2 by Spark's AES-CBC)."""
    salted = lambda salt: F.substring(
        _md5(F.concat("key", *[F.unhex(F.substring(F.lpad(F.hex(c), 6, "0"), i, 2)) for c, i in (("obj_num", 5), ("obj_num", 3), ("obj_num", 1), ("gen", 5), ("gen", 3))], *salt)),
        1,
        16,
    )

    @F.arrow_udf("binary")
    def rc4_udf(k: pa.Array, d: pa.Array, n: pa.Array) -> pa.Array:
        rows = zip(k.to_pylist(), d.to_pylist(), n.to_pylist(), strict=True)
        return pa.array([rc4(a[: min(16, c + 5)], b) if None not in (a, b) else None for a, b, c in rows], pa.binary())

    joined = objects.join(keys, "file_id", "left")
    by_rc4 = rc4_udf(salted([]), "raw", F.octet_length("key"))
    by_aes = F.try_aes_decrypt("raw", salted([F.lit(b"sAlT")]), F.lit("CBC"), F.lit("PKCS"))
    raw = F.when(F.col("method") == "V2", by_rc4).when(F.col("method") == "AESV2", by_aes).otherwise(F.col("raw"))
    return joined.withColumn("raw", raw).drop("key", "method")


def decrypted(files: DataFrame, password: str = "") -> DataFrame:
    """Files without encryption, as the user or the owner opens them; content is null where the password opens nothing."""

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        yield key, _rewritten(load(content, password=password.encode("latin-1", "replace")), {})

    return each_content(files, change)


def encrypted(files: DataFrame, method: str, user_password: str = "", owner_password: str = "", p: int = -4) -> DataFrame:
    """Files encrypted by ``RC4-40``, ``RC4-128`` or ``AES-128``, with permissions ``p``; other cross-reference forms become a table."""

    def change(key: Any, content: bytes) -> Iterator[tuple[Any, bytes]]:
        yield key, encrypted_file(content, method, user_password, owner_password, p)

    return each_content(files, change)


def encrypted_file(content: bytes, method: str, user_password: str = "", owner_password: str = "", p: int = -4) -> bytes:
    pdf = load(content)
    ids = pdf.resolve(pdf.trailer.get("ID"))
    file_id = bytes(ids[0]) if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b"folioframe-16-id"
    words = [w.encode("latin-1", "replace") for w in (user_password, owner_password or user_password)]
    crypt, head = encryption(method, *words, p, file_id)
    objects = {r: crypt.changed(r, v, False) for r, v, _ in pdf.all_objects() if not (isinstance(v, Stream) and v.dict.get("Type") in ("XRef", "ObjStm"))}
    own = Ref(max((r.num for r in objects), default=0) + 1, 0)
    keep = {k: pdf.trailer[k] for k in ("Root", "Info") if k in pdf.trailer}
    return write_file(objects | {own: head}, keep | {"ID": [file_id, file_id], "Encrypt": own}, pdf.version or "1.7")


# ---- signatures ----


def byte_range_digest(content: Column, r: Column) -> Column:
    """SHA-256 of the two signed ranges, in SQL."""
    part = lambda i: F.substring(content, (r[i] + 1).cast("int"), r[i + 1].cast("int"))
    return F.sha2(F.concat(part(0), part(2)), 256)


def byte_range_warnings(content: Column, r: Column) -> Column:
    """What is wrong with a byte range; an empty array if nothing is."""
    size = F.octet_length(content).cast("long")
    end = r[0] + r[1]
    gap = F.decode(F.substring(content, (end + 1).cast("int"), (r[2] - end).cast("int")), "ISO-8859-1")
    has_gap = (end < r[2]) & (end >= 0) & (r[2] <= size)
    n = F.size(r)
    rules = [
        (n != 4, F.format_string("ByteRange has %s elements, expected 4", n.cast("string"))),
        ((n == 4) & (r[0] != 0), F.lit("ByteRange does not start at 0")),
        ((n == 4) & F.exists(r, lambda v: v < 0), F.lit("negative ByteRange values")),
        ((n == 4) & (end > size), F.lit("first range exceeds the file")),
        ((n == 4) & (r[2] + r[3] > size), F.lit("second range exceeds the file")),
        ((n == 4) & (end > r[2]), F.lit("ranges overlap")),
        ((n == 4) & has_gap & ~F.startswith(gap, F.lit("<")), F.lit("gap does not start with '<'")),
        ((n == 4) & has_gap & ~F.endswith(gap, F.lit(">")), F.lit("gap does not end with '>'")),
        ((n == 4) & has_gap & F.regexp_like(gap, F.lit(r"(?s)^..*[^0-9A-Fa-f].*.$")), F.lit("gap contains non-hex characters")),
        ((n == 4) & (r[1] < 50), F.lit("first segment suspiciously short")),
    ]
    return F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))


def contents_misplaced(content: Column, r: Column) -> Column:
    """Whether ``/Contents`` is not within the 20 bytes before the gap."""
    start = r[0] + r[1]
    before = F.decode(F.substring(content, F.greatest(start - 19, F.lit(1)).cast("int"), F.least(start, F.lit(20)).cast("int")), "ISO-8859-1")
    return (F.size(r) == 4) & (start < r[2]) & (r[2] <= F.octet_length(content)) & ~F.contains(before, F.lit("/Contents"))


def revisions(files: DataFrame) -> DataFrame:
    """``file_id, revision, end``: where each ``%%EOF`` ends, with its line end; a revision is the file up to there."""
    text = F.decode("content", "ISO-8859-1")
    parts = F.split(text, "%%EOF")
    line_end = lambda s: F.length(F.regexp_extract(s, r"^(\r\n|\r|\n)?", 0))
    mark = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, s: a + F.length(s) + 5) + line_end(F.get(parts, i))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), mark)
    some = files.where(F.contains(text, F.lit("%%EOF")))
    return some.select("file_id", F.posexplode(ends).alias("revision", "end"))


def revision_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``file_id, obj_num, change``: a full outer join of two revisions' objects (added, deleted, modified)."""
    key = F.sha2(F.concat_ws("|", "kind", "value", F.coalesce(F.sha2("raw", 256), F.lit(""))), 256)
    old = before.select("file_id", "obj_num", key.alias("old"), F.col("type").alias("old_type"))
    new = after.select("file_id", "obj_num", key.alias("new"), "type", "subtype")
    joined = old.join(new, ["file_id", "obj_num"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return joined.select("file_id", "obj_num", change.alias("change"), "type", "subtype").where("change is not null")


def classify_change(changes: DataFrame) -> DataFrame:
    """Changes with ``verdict``: what a later signature or form filling may change is permitted, all else is not."""
    permitted = (
        ((F.col("change") == "added") & F.coalesce(F.col("type").isin("Sig", "DSS", "XRef", "ObjStm", "Metadata", "VRI"), F.lit(False)))
        | ((F.col("change") == "added") & (F.col("type") == "Annot") & F.coalesce(F.col("subtype") == "Widget", F.lit(False)))
        | ((F.col("change") == "modified") & F.coalesce(F.col("type").isin("Catalog", "XRef", "Metadata", "Page"), F.lit(False)) & (F.col("type") != "Page"))
    )
    tag = F.when(F.col("change") == "deleted", "shadow").when((F.col("type") == "Annot") & (F.col("subtype") != "Widget"), "annotation").when(F.col("type") == "Page", "page")
    verdict = F.when(F.coalesce(permitted, F.lit(False)), "permitted").otherwise("unauthorized")
    return changes.withColumn("verdict", verdict).withColumn("tag", F.when(verdict == "unauthorized", tag))
