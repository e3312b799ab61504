"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over 4-grams of UTF-8 bytes, which pack into 32 bits: no word list, no
language-specific tokens, and prefixes and suffixes are shifts. It is trained on half of
the trusted documents (by hash of the id), all of them; texts that a bitmap of fixed size
shows not to be trusted are not shuffled. Counts, continuation counts and discounts are aggregates. Each
4-gram type of the corpus gets its probability by joins of count tables, sharded by
n-gram or context. Documents join with the scored types in packed blocks (see
``blocks``), which gives two measures of each text:

* ``perplexity`` per byte, of the text as a whole;
* ``surprise``, the bits by which bytes cost more than one picked at random among 256 would
  (8 bits), per byte: next to nothing in text like the trusted, however it varies, so a few
  words that trusted texts never hold show in it though the perplexity hardly moves.

The other half of the trusted documents gives the limits, quantiles by language: of the
perplexity, and of the surprise by classes of length too (a factor of 4 in bytes each), for
in short texts both vary more, and the shortest would set the limit for all. A quantile is
read off a histogram in steps of 1.1 %, at the upper end of the step in which it lies.
Classes with fewer than ``FEWEST`` texts take the limit of their language, languages
without trusted documents that over all of them. Documents over either limit are rejected.

Defined results: a null or empty text has no perplexity and is kept; so is everything
when there is no trusted document; a null language is a language of its own; repeated rows
get equal results, and rows of one id with unlike texts are judged each by its own text; an
empty table gives an empty result. Texts of any length are read whole. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.blocks import join_blocks, named, pack_blocks, pack_table, shard_bits, text_bytes
from folioframe.llm.filters import marked_by, without
from folioframe.llm.scratch import Scratch, cut
from folioframe.llm.textblocks import buffers, doc_ranges

ORDER = 4
SYMBOLS = 256
PAD = 0x0A  # a text begins as if after line ends
RANDOM = 8.0  # bits of a byte picked at random
STEPS = 64  # of a histogram, for a factor of 2
FEWEST = 30  # held-out texts of a class of length that has a limit of its own
_LITTLE = 2.0**-20  # added to measures before their logarithm
_MOST_LIMITS = 100_000  # rows of the table of limits that is broadcast


def text_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-gram that ends at each byte, and the document of each byte."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(data)) + (doc + 1) * (ORDER - 1)
    padded = np.full(len(data) + len(sizes) * (ORDER - 1), PAD, np.uint32)
    padded[at] = data
    gram = np.zeros(len(padded), np.uint32)
    for j in range(ORDER):
        gram[ORDER - 1 :] |= padded[ORDER - 1 - j : len(padded) - j] << np.uint32(8 * j)
    return gram[at], doc


def _type_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct 4-grams of text, trained: counts in training documents, 0 for types found elsewhere only."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        trained = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in doc_ranges(offsets, 1 << 20):
            grams, doc = text_grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            coded = np.sort((grams.astype(np.uint64) << np.uint64(1)) | trained[lo:hi][doc])
            if not len(coded):
                continue
            new = np.ones(len(coded), bool)
            new[1:] = coded[1:] != coded[:-1]
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(coded))) * (coded[first] & np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((coded[first] >> np.uint64(1)).astype(np.int64)), pa.array(counts)], ["gram", "count"])


def _blocks(bits: int):
    """Columns row, row_text, text: the blocks of a chunk of documents by shard."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = buffers(batch.column(2))
            for lo, hi in doc_ranges(offsets, 1 << 20):
                grams, doc = text_grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                coded = np.sort((spread(grams).astype(np.uint64) << np.uint64(16)) | doc.astype(np.uint64))
                new = np.ones(len(coded), bool)
                new[1:] = coded[1:] != coded[:-1]
                first = np.flatnonzero(new)
                counts = np.diff(np.append(first, len(coded)))
                keys, docs = coded[first] >> np.uint64(16), coded[first] & np.uint64(0xFFFF)
                yield pack_blocks((ids[lo:hi], texts[lo:hi]), keys << np.uint64(32), docs, counts, bits)

    return emit


_SPREAD = 2654435769


def spread(grams: np.ndarray) -> np.ndarray:
    """Packed 4-grams mapped one to one over all 32-bit numbers, so that shards are even."""
    return grams * np.uint32(_SPREAD)


def spread_column(gram: Column) -> Column:
    """The same in SQL: the product modulo 2^32, in two halves that do not overflow."""
    low, high = gram.bitwiseAND(F.lit(0xFFFF)) * _SPREAD, F.shiftright(gram, 16) * _SPREAD
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def discounts(ones: float, twos: float, threes: float, fours: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts, within their bounds where data are few."""
    if not ones or not twos:
        return 0.5, 0.75, 0.9
    y = ones / (ones + 2 * twos)
    d1 = 1 - 2 * y * twos / ones
    d2 = 2 - 3 * y * threes / twos
    d3 = 3 - 4 * y * fours / threes if threes else d2
    return min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.95)


def _context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))


def kneser_ney(counts: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to 4: ``gram, p`` of seen n-grams (interpolated down), and ``context, weight`` of the rest."""
    by_order = {ORDER: counts.where("count > 0").select("gram", F.col("count").alias("c"))}
    for order in range(ORDER, 1, -1):  # lower orders count the distinct words before them
        lower = by_order[order].groupBy(_suffix(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("c"))
        by_order[order - 1] = cut(lower)
    model: list[tuple[DataFrame, DataFrame]] = []
    for order in range(1, ORDER + 1):
        grams = by_order[order]
        row = grams.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
        d = discounts(*row)
        kind = F.least("c", F.lit(3))
        discount = F.element_at(F.array(*[F.lit(x) for x in d]), kind.cast("int"))
        mass = F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("weight")
        contexts = grams.groupBy(_context(F.col("gram")).alias("context")).agg(*mass)
        joined = grams.withColumn("context", _context(F.col("gram"))).join(contexts, "context")
        if order == 1:
            below = F.lit(1 / SYMBOLS)
        else:
            lower = model[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = joined.withColumn("suffix", _suffix(F.col("gram"), order)).join(lower, "suffix")
            below = F.col("below")
        p = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total") + F.col("weight") * below
        seen = scratch.put(joined.select("gram", p.alias("p")), f"p{order}")
        model.append((seen, scratch.put(contexts.select("context", "weight"), f"w{order}")))
    return model


def score_types(types: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``gram, logp``: log2 probability of the last byte of each 4-gram after the other three."""
    frame = types.select("gram")
    p: Column = F.lit(1 / SYMBOLS)
    for order, (seen, contexts) in enumerate(model, 1):
        own = F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1))
        frame = frame.withColumn("own", own).withColumn("head", _context(F.col("own")))
        frame = frame.join(seen.select(F.col("gram").alias("own"), F.col("p").alias(f"p{order}")), "own", "left")
        frame = frame.join(contexts.select(F.col("context").alias("head"), F.col("weight").alias(f"w{order}")), "head", "left")
        frame = frame.drop("own", "head")
        p = F.coalesce(f"p{order}", F.coalesce(f"w{order}", F.lit(1.0)) * p)
    return frame.select("gram", F.log2(p).alias("logp"))


def _step(measure: Column) -> Column:
    return F.floor(F.log2(measure + _LITTLE) * STEPS).cast("int")


def limits(held: DataFrame, measure: str, quantile: float, by: list[str]) -> DataFrame:
    """The quantile of a measure for each group: ``by``, ``n`` and ``limit``. Histograms are what is gathered."""
    bars = held.groupBy(*by, _step(F.col(measure)).alias("step")).agg(F.count("*").alias("bar"))
    group = Window.partitionBy(*[F.coalesce(c, F.lit("")) for c in by[:1]], *[F.col(c).isNull() for c in by[:1]], *by[1:])
    upto = F.sum("bar").over(group.orderBy("step"))
    summed = bars.select(*by, "step", upto.alias("upto"), F.sum("bar").over(group).alias("n"))
    edge = F.pow(F.lit(2.0), (F.min("step") + 1) / STEPS) - _LITTLE
    return summed.where(F.col("upto") >= F.ceil(F.col("n") * quantile)).groupBy(*by).agg(F.min("n").alias("n"), edge.alias("limit"))


def _named_limit(judged: DataFrame, table: DataFrame, by: list[str], name: str) -> DataFrame:
    """``judged`` with the limit of each row's group; the table of limits is broadcast if it is short, as it is unless languages are very many."""
    table = table.select(*[F.col(c).alias(f"l_{c}") for c in by], F.col("limit").alias(name))
    short = table.limit(_MOST_LIMITS + 1).count() <= _MOST_LIMITS
    match = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in by]
    return judged.join(F.broadcast(table) if short else table, match, "left").drop(*[f"l_{c}" for c in by])


def classify_quality(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = 0.999,
) -> DataFrame:
    """Per document ``doc_id, lang, n_bytes, perplexity, threshold, surprise, most_surprise, kept``.

    ``trusted`` lists the ids of trusted documents in its first column.
    """
    if not 0 < quantile <= 1:
        raise ValueError("quantile must be in (0, 1]")
    order = F.xxhash64(F.col("t_id"), F.lit(5))
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("t_id")).where("t_id is not null").distinct()
    half = F.pmod(order, F.lit(2))
    chosen = ids.where(half == 0)
    texts = named(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    with Scratch(docs.sparkSession) as scratch:
        sure, doubtful = marked_by(texts.select("doc_id", "text"), chosen, "doc_id")
        doubtful = doubtful.join(chosen, F.col("doc_id") == F.col("t_id"), "left").select("text", F.col("t_id").isNotNull().alias("t"))
        marked = sure.select("text", F.lit(False).alias("t")).unionByName(doubtful)
        types = marked.mapInArrow(_type_counts, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))
        types = scratch.put(types, "types")
        model = kneser_ney(types, scratch)
        scores = scratch.put(score_types(types, model), "scores")
        bits = shard_bits(scores.count())
        blocks = texts.select("row", "row_text", "text").mapInArrow(_blocks(bits), "shard int, block binary")
        over = F.greatest(-F.col("logp") - RANDOM, F.lit(0.0)).alias("over")
        table = scores.select(F.shiftleft(spread_column(F.col("gram")), 32).alias("key"), "logp", over, F.lit(1.0).alias("bytes"))
        sums = join_blocks(blocks, pack_table(table, bits), ["logp", "over", "bytes"], bits, text_bytes(texts)).groupBy("row", "row_text")
        sums = sums.agg(*[F.sum(c).alias(c) for c in ("logp", "over", "bytes")])  # of equal rows together, so in proportion
        sums = sums.select("row", "row_text", F.pow(F.lit(2.0), -F.col("logp") / F.col("bytes")).alias("perplexity"), (F.col("over") / F.col("bytes")).alias("surprise"))
        rows = texts.select("row", "row_text", "doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
        judged = rows.join(sums, ["row", "row_text"], "left").withColumn("size", F.floor(F.log2("n_bytes") / 2).cast("int"))
        judged = cut(judged.select("doc_id", "row_text", "lang", "n_bytes", "size", "perplexity", "surprise"))
        held = judged.join(ids.where(half == 1), F.col("doc_id") == F.col("t_id"), "left_semi").where("perplexity is not null")
        held = cut(held.select("lang", "size", "perplexity", "surprise"))
        found = judged
        for measure, name in (("perplexity", "threshold"), ("surprise", "most_surprise")):
            by_lang = limits(held, measure, quantile, ["lang"])
            overall = limits(held.withColumn("lang", F.lit("")), measure, quantile, ["lang"]).first()
            levels = [F.lit(overall.limit if overall else None).cast("double")]
            found = _named_limit(found, by_lang, ["lang"], "of_lang")
            levels.insert(0, F.col("of_lang"))
            if measure == "surprise":
                found = _named_limit(found, limits(held, measure, quantile, ["lang", "size"]).where(F.col("n") >= FEWEST), ["lang", "size"], "of_size")
                levels.insert(0, F.col("of_size"))
            found = found.withColumn(name, F.coalesce(*levels)).drop("of_lang", "of_size")
        kept = F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("surprise") <= F.col("most_surprise")), F.lit(True)).alias("kept")
        return cut(found.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "surprise", "most_surprise", kept, "row_text"))


def keep_quality(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rejected documents."""
    judged = classify_quality(docs, trusted, id_col=id_col, text_col=text_col, **options)
    return without(docs, judged.where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("row_text").alias("bad_text")), id_col, text_col)
