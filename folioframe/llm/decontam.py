"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the similarity of their shingle sets is tiny
and plain MinHash would hardly ever find them. Documents are therefore partitioned by size:
a class of sizes up to n has a one-permutation MinHash signature of 2n bins, whose values
are the least hash of each bin. So the signature grows with the documents of its class, and
a shingle that they share with an item is the least of its bin with probability ``FOUND`` or
more at any size.

Items are signed for all classes at once: of an item's shingles one may be the least of its
bin only in signatures of so many bins that no lesser one falls into its bin; that number
goes with its hash. The search joins the documents' signature values with those of items, and
a document is a candidate for an item if enough of them meet: the most that leave a miss,
by the binomial distribution, less likely than ``miss`` for a document at the threshold. Items
so short that not even one can be asked for are searched with signatures under further
hash functions too.

Candidates are verified exactly: the share of an item's distinct shingles that stand in
the document, compared as text.

Only bitmaps of fixed size (2^23 bits) with the items' signature values and shingles are
sent to the executors; they pass over what cannot match, and the joins decide. Nothing else
is broadcast by this module, and items and documents may both grow.

Defined results: null or empty texts and items contain nothing; an item with fewer words
than a shingle has its whole sequence as one, which matches a document of just these
words; repeated rows give repeated pairs once per id, and of an id with unlike texts each is
compared by its own text and that which shares the most counts; null ids match nothing; texts
of any length are read whole; empty tables give an empty result. Only the named id and text
columns are read; others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.filters import text_mark, without
from folioframe.llm.scratch import Scratch, cut
from folioframe.llm.textblocks import Words, as_long, chunks, mix, sequence_hashes

BITMAP_BITS = 23
SPARE = 1  # a signature has 2^SPARE bins for each shingle of the largest documents of its class
FOUND = 2**SPARE * (1 - math.exp(-(2.0**-SPARE)))  # probability that a shared shingle is the least of its bin, at the least


def _positions(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash, first word and word count of each shingle of a chunk."""
    sizes = np.diff(words.offsets)
    starts = np.arange(len(words.hashes))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    grams = sequence_hashes(words.hashes, k)
    whole = starts + k <= words.offsets[1:][doc]
    first = starts[whole]
    found, owner, span = grams[first], doc[first], np.full(len(first), k)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        hashes = [sequence_hashes(words.hashes[words.offsets[i] : words.offsets[i + 1]], int(sizes[i]))[0] for i in short]
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        owner = np.concatenate([owner, short])[order]
        found = np.concatenate([found, np.array(hashes, np.uint64)])[order]
        first = np.concatenate([first, words.offsets[short]])[order]
        span = np.concatenate([span, sizes[short]])[order]
    return owner, found, first, span


def _texts(words: Words, first: np.ndarray, span: np.ndarray) -> list[str]:
    out = []
    for f, n in zip(first.tolist(), span.tolist(), strict=True):
        parts = [words.data[words.starts[w] : words.ends[w]].tobytes() for w in range(f, f + n)]
        out.append(b" ".join(parts).decode("utf-8", "replace"))
    return out


def _item_shingles(k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for words in chunks(batch.column(1), lower=True):
                owner, found, first, span = _positions(words, k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(words.lo + owner)), as_long(found), pa.array(_texts(words, first, span), pa.string())],
                    ["item_id", "hash", "shingle"],
                )

    return emit


def bitmap_slots(hashes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for each hash: at most 2^17 longs reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    slot, bit = F.shiftright(place, 6).cast("int"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 as int))")
    rows = hashes.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint8)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def signed(found: np.ndarray, seed: int) -> np.ndarray:
    """The hash function ``seed`` of shingles."""
    return mix(found ^ np.uint64(0x51ED2701 * (seed + 1)))


def signature(owner: np.ndarray, found: np.ndarray, documents: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, number of bins (as a power of 2) and value of each bin that is not empty; bins grow with the document's size class."""
    sizes = np.bincount(owner, minlength=documents)
    bits = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) + SPARE
    bases = np.cumsum(1 << bits) - (1 << bits)
    hashed = signed(found, seed)
    bins = bases[owner] + (hashed >> (np.uint64(64) - bits[owner].astype(np.uint64))).astype(np.int64)
    least = np.full(int((1 << bits).sum()), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins, hashed)
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    doc = np.searchsorted(bases, full, side="right") - 1
    return doc, bits[doc], least[full]


def least_bits(values: np.ndarray) -> np.ndarray:
    """For the sorted hashes of an item: with so many bits of bins, each is the least of its bin."""
    out = np.zeros(len(values), np.int64)
    apart = values[1:] ^ values[:-1]
    high = np.zeros(len(apart), np.int64)
    for step in (32, 16, 8, 4, 2, 1):  # position of the highest bit in which neighbours differ
        big = apart >> np.uint64(step) > 0
        high[big] += step
        apart = np.where(big, apart >> np.uint64(step), apart)
    out[1:] = 64 - high
    return out


def most_asked(shared: int, miss: float) -> tuple[int, int]:
    """For an item that shares so many shingles with a document at the threshold: how many values must meet, over how many hash functions."""
    for repeats in range(1, 100):
        n, total, asked = shared * repeats, 0.0, 0
        while asked < n:
            total += math.comb(n, asked) * FOUND**asked * (1 - FOUND) ** (n - asked)
            if total > miss:
                break
            asked += 1
        if asked:
            return asked, repeats
    raise ValueError("miss is too small")


def _item_signatures(percent: int, miss: float):
    """Columns item_id, hashes (distinct): the signature values of each item, with what it takes to be a candidate."""
    memo: dict[int, tuple[int, int]] = {}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = hashes.values.to_numpy().view(np.uint64)
                shared = max(1, -(-len(own) * percent // 100))
                if shared not in memo:
                    memo[shared] = most_asked(min(shared, 1000), miss)
                asked, repeats = memo[shared]
                for seed in range(repeats):
                    values = np.sort(signed(own, seed))
                    n = len(values)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, item)), pa.array(np.full(n, seed, np.int32)), as_long(values), pa.array(least_bits(values)), pa.array(np.full(n, asked))],
                        ["item_id", "seed", "hash", "from_bits", "asked"],
                    )

    return emit


_SIGNED = "item_id long, seed int, hash long, from_bits long, asked long"
_HITS = "doc_id long, mark int, seed int, bits long, hash long, shingle string"


def _search(k: int, repeats: int, shared):
    """Per document: its signature values that may be an item's, and, if there are any, its shingles that may be (without seed)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_signatures, of_shingles = shared.value
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for words in chunks(batch.column(2), limit=1 << 20, lower=True):
                owner, found, first, span = _positions(words, k)
                if not len(owner):
                    continue
                candidate = np.zeros(words.hi - words.lo, bool)
                for seed in range(repeats):
                    doc, bits, value = signature(owner, found, words.hi - words.lo, seed)
                    at = np.flatnonzero(in_bitmap(of_signatures, value))
                    doc, bits, value = doc[at], bits[at], value[at]
                    candidate[doc] = True
                    if len(at):
                        row = words.lo + doc
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[row], pa.int64()), pa.array(marks[row]), pa.array(np.full(len(at), seed, np.int32)), pa.array(bits), as_long(value), pa.nulls(len(at), pa.string())],
                            ["doc_id", "mark", "seed", "bits", "hash", "shingle"],
                        )
                at = np.flatnonzero(candidate[owner] & in_bitmap(of_shingles, found))
                if len(at):
                    row = words.lo + owner[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row], pa.int64()), pa.array(marks[row]), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64()), as_long(found[at]), pa.array(_texts(words, first[at], span[at]), pa.string())],
                        ["doc_id", "mark", "seed", "bits", "hash", "shingle"],
                    )

    return emit


def candidates(hits: DataFrame, signatures: DataFrame) -> DataFrame:
    """``doc_id, mark, item_id`` where enough signature values meet; ``hits``: ``doc_id, mark, seed, bits, hash`` of documents."""
    values = hits.select("doc_id", "mark", "seed", "bits", "hash").distinct()
    met = values.join(signatures, ["seed", "hash"]).where(F.col("bits") >= F.col("from_bits"))
    met = met.groupBy("doc_id", "mark", "item_id").agg(F.count("*").alias("met"), F.max("asked").alias("asked"))
    return met.where(F.col("met") >= F.col("asked")).select("doc_id", "mark", "item_id")


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    miss: float = 1e-6,
    marked: bool = False,
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item`` where a document holds ``percent`` of an item's shingles.

    If ``marked``, ``mark`` tells texts of one id apart, else the text that shares the most stands for the id.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).alias("text")).where("doc_id is not null")
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null")
    with Scratch(spark) as scratch:
        known = scratch.put(tests.mapInArrow(_item_shingles(shingle), "item_id long, hash long, shingle string").distinct(), "items")
        sizes = known.groupBy("item_id").agg(F.count("*").alias("n_item"))
        sets = known.groupBy("item_id").agg(F.collect_set("hash").alias("hashes"))
        signatures = scratch.put(sets.mapInArrow(_item_signatures(percent, miss), _SIGNED), "signatures")
        repeats = (signatures.agg(F.max("seed")).first()[0] or 0) + 1
        shared = spark.sparkContext.broadcast((bitmap_slots(signatures.select("hash")), bitmap_slots(known.select("hash"))))
        hits = scratch.put(texts.mapInArrow(_search(shingle, repeats, shared), _HITS), "hits")
        found = candidates(hits.where("seed is not null"), signatures)
        shingles = hits.where("seed is null").select("doc_id", "mark", "hash", "shingle").distinct()
        pairs = found.join(known, "item_id").join(shingles, ["doc_id", "mark", "hash", "shingle"])
        pairs = pairs.groupBy("doc_id", "mark", "item_id").agg(F.count("*").alias("n_shared")).join(sizes, "item_id")
        pairs = pairs.where(F.col("n_shared") * 100 >= percent * F.col("n_item")).select("doc_id", "item_id", "n_shared", "n_item", "mark")
        if not marked:
            pairs = pairs.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
        return cut(pairs)


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    bad = find_contamination(docs, items, id_col=id_col, text_col=text_col, marked=True, **options)
    return without(docs, bad.select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_text")), id_col, text_col)
