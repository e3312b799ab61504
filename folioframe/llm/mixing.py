"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each document of a source stands in a shuffled queue and gets a virtual finish time:
the source's tokens up to and with it, divided by the source's target. A second pass
through the queue (the repeat) follows the first. All copies are then ordered by finish
time over the whole table and the order is truncated at the total budget.

Running sums never pull a source into one task. Within a source the shuffled order is cut
into 4,096 hash ranges: their sums are added up in a small table and only the rest of the
sum is taken inside a range. The global order is cut into ranges of finish time the same
way, the range in which the budget ends into ranges again until few copies are left in it,
and just these are sorted row by row. The shuffled order is that of MD5 hashes of the ids.

Defined results: a null text has size 0; a null source is a source of its own, the last
in order; documents of size 0 are never taken; equal rows are separate documents; an
empty table gives an empty result. Only the named columns are read, so other columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
_RANGES = 4096  # of the shuffled order (three hexadecimal digits), and of finish time from 0 to 1
_FEW = 100_000  # copies that one task sorts
_ROUNDS = 4  # in which ranges of finish time are cut; a double has no more digits


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, repeats: int) -> DataFrame:
    """Per source: size, weight and target.

    ``target = min(repeats * size, level * weight)``: the level at which the targets add
    up to the budget is found by walking the sources in order of the level at which they
    are exhausted.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("exhausted", "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    ranked = totals.select("source", "source_size", rank.alias("rank"), weight.alias("weight")).withColumn(
        "exhausted", repeats * F.col("source_size") / F.col("weight")
    )
    left = budget * F.sum("source_size").over(everything) - F.coalesce(repeats * F.sum("source_size").over(order), zero)
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), zero)
    levelled = ranked.withColumn("level", left / weights_left)
    open_level = F.when(F.col("exhausted") > F.col("level"), F.col("level"))
    levelled = levelled.withColumn("level", F.max(open_level).over(everything))
    cap = (repeats * F.col("source_size")).cast("double")
    target = F.when(F.col("level").isNull() | (F.col("exhausted") <= F.col("level")), cap)
    return levelled.select("source", "rank", "source_size", target.otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    budget: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``weights`` go to the sources in code point order, repeating; ``budget`` is the share
    of all words that the mix holds; no document is taken more than ``repeats`` times.
    """
    if repeats < 1 or not 0 < budget <= repeats or not all(w > 0 for w in weights):
        raise ValueError("weights must be positive and 0 < budget <= repeats")
    doc = F.col(id_col)
    sizes = cut(
        docs.select(
            doc.alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.coalesce(F.substring(F.md5(F.concat_ws(":", doc.cast("string"), F.lit(str(seed))).cast("binary")), 1, 16), F.lit("")).alias("place"),
        )
    )
    sources = cut(source_targets(sizes, weights, budget, repeats))
    ranged = sizes.withColumn("range", F.substring("place", 1, 3))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    ranges = (
        ranged.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .select("source", "range", before.alias("before"))
        .join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
        .select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), "before", "rank", "source_size", "target")
    )
    queue = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("within", F.sum("size").over(queue))
        .join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
        .withColumn("served", F.col("before") + F.col("within"))
        .select("doc_id", "source", "rank", "place", "size", "source_size", "target", "served")
    )
    placed = cut(placed)
    taken = F.lit(0).cast("long")
    finish = [(F.col("served") + copy * F.col("source_size")) / F.col("target") for copy in range(repeats)]
    keys = [
        F.when(F.col("size") > 0, F.struct(f.alias("finish"), "rank", "place", "doc_id", "size", F.lit(i).alias("copy")))
        for i, f in enumerate(finish)
    ]
    last = _last_taken(placed, keys, budget)
    for key in keys if last is not None else []:
        taken = taken + F.when(key <= last, F.col("size")).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _last_taken(placed: DataFrame, keys: list[Column], budget: float) -> Column | None:
    """The key of the last copy, in order of finish time, that fits the total budget; one row reaches the driver."""
    copies = placed.select(F.explode(F.array(*keys)).alias("key")).where(F.col("key").isNotNull())
    total, before = budget * (placed.agg(F.sum("size")).first()[0] or 0), 0
    inside, scaled, lower = copies, F.least(F.col("key.finish") * _RANGES, F.lit(2.0 * _RANGES)), []
    for _ in range(_ROUNDS):
        slot = F.floor(scaled)
        slots = inside.groupBy(slot.alias("slot")).agg(F.sum("key.size").alias("slot_size"), F.count("*").alias("copies"))
        upto = F.sum("slot_size").over(Window.orderBy("slot"))  # 2 * _RANGES rows at most
        ends = slots.select("slot", "copies", (before + upto - F.col("slot_size")).alias("before")).where(F.col("before") < total)
        edge = ends.orderBy(F.desc("slot")).first()
        if edge is None:
            return None
        lower.append(inside.where(slot < edge.slot))
        inside, before = inside.where(slot == edge.slot), edge.before
        if edge.copies <= _FEW:
            break
        scaled = (scaled - edge.slot) * _RANGES
    order = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("sum", before + F.sum("key.size").over(order)).where(F.col("sum") <= total).agg(F.max("key").alias("key")).first().key
    while found is None and lower:
        found = lower.pop().agg(F.max("key").alias("key")).first().key
    if found is None:
        return None
    kinds = copies.schema["key"].dataType
    return F.struct(*[F.lit(found[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields])
