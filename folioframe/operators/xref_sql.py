"""Cross-reference streams decoded in SQL alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(body: Column, at: Column, width: Column) -> Column:
    """A big-endian number of ``width`` bytes at the 1-based position ``at``; 0 if the width is 0."""
    digits = F.hex(F.substring(body, at.cast("int"), width.cast("int")))
    return F.when(width == 0, F.lit(0).cast("long")).otherwise(F.conv(digits, 16, 10).cast("long"))


def decode_entries(streams: DataFrame) -> DataFrame:
    """``file_id, obj_num, entry_type, a, b`` from ``file_id, body, w, index`` (decoded bytes, widths, pairs of first and count)."""
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("index") / 2 - 1).cast("int")),
        lambda i: F.struct(F.get(F.col("index"), 2 * i).cast("long").alias("first"), F.get(F.col("index"), 2 * i + 1).cast("long").alias("n")),
    )
    none = F.array().cast("array<long>")
    numbers = F.flatten(F.transform(pairs, lambda p: F.when(p["n"] > 0, F.sequence(p["first"], p["first"] + p["n"] - 1)).otherwise(none)))
    rows = streams.select("file_id", "body", "w", F.posexplode(numbers).alias("n", "obj_num"))
    w1, w2, w3 = (F.col("w")[i] for i in range(3))
    start = F.col("n") * (w1 + w2 + w3) + 1
    kind = F.when(w1 == 0, F.lit(1).cast("long")).otherwise(field(F.col("body"), start, w1))
    found = rows.where(start + w1 + w2 + w3 - 1 <= F.octet_length("body"))
    return found.select("file_id", "obj_num", kind.alias("entry_type"), field(F.col("body"), start + w1, w2).alias("a"), field(F.col("body"), start + w1 + w2, w3).alias("b"))
