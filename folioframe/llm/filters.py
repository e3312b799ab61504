"""Taking out a list of documents without shuffling all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 23


def text_mark(text: Column) -> Column:
    """32 bits of a hash of a text, which tell texts of one id apart."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def marked_by(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose id is surely not in ``ids`` (one column), and the others.

    A bitmap of 2^23 bits over the hashes of the ids (2^17 longs at most, whatever the
    input) is broadcast. Rows with a null id are surely not in it.
    """
    slot, bits = fresh(docs, "__slot"), fresh(docs, "__bits")

    def place(x: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(x), 64 - _BITS)

    def bit(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place(x).bitwiseAND(F.lit(63)).cast("int"))

    bad, own = F.col(ids.columns[0]).cast("long"), F.col(f"`{id_col}`").cast("long")
    slots = ids.where(bad.isNotNull()).groupBy(F.shiftright(place(bad), 6).cast("int").alias(slot)).agg(F.bit_or(bit(bad)).alias(bits))
    marked = docs.withColumn(slot, F.shiftright(place(own), 6).cast("int")).join(F.broadcast(slots), slot, "left")
    maybe = F.coalesce(F.col(bits).bitwiseAND(bit(own)) != 0, F.lit(False)) & own.isNotNull()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~maybe).select(columns), marked.where(maybe).select(columns)


def with_names(docs: DataFrame, id_col: str, text_col: str | None) -> tuple[DataFrame, list[str]]:
    """``docs`` with the id as a long and, if asked for, the text's mark, under names of their own; these names."""
    names = [fresh(docs, "__id")]
    docs = docs.withColumn(names[0], F.col(f"`{id_col}`").cast("long"))
    if text_col:
        names.append(fresh(docs, "__mark"))
        docs = docs.withColumn(names[1], text_mark(F.col(f"`{text_col}`")))
    return docs, names


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str | None = None) -> DataFrame:
    """``docs`` less the rows whose id is in ``bad`` (column ``bad_id``, repeats allowed).

    Where ``text_col`` is given, ``bad`` has a ``bad_text`` too (the text's mark): of an id
    that comes with unlike texts, only the rows with that text go. Rows that a bitmap of
    fixed size shows not to be there pass at once; only the others are shuffled and joined.
    Rows with a null id stay. Columns of ``docs`` may have any names.
    """
    bad = bad.select(F.col("bad_id").cast("long").alias("bad_id"), *["bad_text"] * bool(text_col)).where("bad_id is not null").distinct()
    sure, doubtful = marked_by(docs, bad.select("bad_id"), id_col)
    doubtful, names = with_names(doubtful, id_col, text_col)
    bad = bad.select(*[F.col(b).alias(n) for b, n in zip(bad.columns, names, strict=True)])
    return sure.unionByName(doubtful.join(bad, names, "left_anti").select([F.col(f"`{c}`") for c in docs.columns]))
