"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes a set of word shingles with a signature of 200 minima. Texts with
   equal sets form a class at once; only its smallest document goes on.
2. Signatures are cut into 40 bands of 5. Within a bucket each member is paired with one
   centre, picked by hash, not with all others; over the bands a large group has up to 40.
3. Pairs are verified in sequence: signatures are compared 20 values at a time, and a pair
   is pruned as soon as the posterior probability of reaching the threshold, given the
   matches so far and a uniform prior, falls below the miss probability. Survivors are
   verified exactly on full sets.
4. Links give components. Buckets that still hold more than one component are compared
   in blocks, across components only, by the same sequence of tests; a pair within a
   component can add nothing. These pairs are never written out: only links leave the
   task. So no link between different texts that shares a band is lost, while a large
   group of near copies costs up to 40 pairs a member.

At similarity 0.8 a pair shares no band with probability 1.3e-7.

Classes have numbers of their own, so an id may come with unlike texts.

Defined results: a null or empty text has an empty set and links with nothing; a text with
fewer words than a shingle has its whole sequence as one; repeated rows and equal texts
share a component; rows of one id with unlike texts are documents of their own, each linked
by its own text, and a component is named by the least id in it; a null id is kept and links
with nothing; texts of any length are read whole; an empty table gives an empty result.
Only the id and text columns are read; others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.components import connected_components, least_names
from folioframe.llm.filters import marked_by, text_mark, with_names, without
from folioframe.llm.scratch import Scratch, cut
from folioframe.llm.streams import groups
from folioframe.llm.textblocks import Words, as_long, chunks, mix, sequence_hashes

BANDS, ROWS, BATCH = 40, 5, 20
HASHES = BANDS * ROWS
BLOCK = 1000
_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    grams = sequence_hashes(words.hashes, k)
    for i in range(words.hi - words.lo):
        lo, hi = int(words.offsets[i]), int(words.offsets[i + 1])
        if hi - lo >= k:
            found = np.sort(grams[lo : hi - k + 1])
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif hi > lo:
            yield sequence_hashes(words.hashes[lo:hi], hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 256):
        block = short[i : i + 256, None] * _MULTIPLY
        block += _ADD
        np.minimum(best, block.min(axis=0), out=best)
    return best


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """After so many compared values, the fewest matches that leave a pair in play.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survive(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs of rows of ``a`` and ``b`` that no batch of values prunes."""
    alive, seen, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int32)
    for n, least in bounds:
        matches = matches + (a[alive, seen:n] == b[alive, seen:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, seen = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, data = column.buffers()[1:]
    first = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint32, count=len(column) * HASHES, offset=first).reshape(-1, HASHES)


def _sketch(k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch.column(2), lower=True):
                size, one, two, signs = [], [], [], []
                for s in shingle_sets(words, k):
                    size.append(len(s))
                    one.append(mix(s).sum(dtype=np.uint64))
                    two.append(mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64))
                    signs.append(signature(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.lo, words.hi - words.lo),
                        batch.column(1).slice(words.lo, words.hi - words.lo),
                        pa.array(size, pa.int64()),
                        as_long(np.array(one, np.uint64)),
                        as_long(np.array(two, np.uint64)),
                        pa.array(signs, pa.binary()),
                    ],
                    ["doc_id", "mark", "n_shingles", "one", "two", "sign"],
                )

    return emit


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            signs = _signatures(part.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                keys = mix(keys ^ signs[:, :, r])
            ids = np.repeat(part.column(0).to_numpy(), BANDS)
            number = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([as_long(keys.ravel()), pa.array(number), pa.array(ids)], ["band", "band_no", "node"])


def _pruned(bounds: list[tuple[int, int]]):
    """Columns a, b, sign_a, sign_b: the pairs that stay in play."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                alive = pa.array(survive(_signatures(part.column(2)), _signatures(part.column(3)), bounds))
                yield pa.RecordBatch.from_arrays([part.column(0).take(alive), part.column(1).take(alive)], ["a", "b"])

    return emit


def _across(bounds: list[tuple[int, int]], k: int, percent: int):
    """Links between components, of sorted rows band, i, j, band_no, block, node, component, sign, text.

    Pairs are pruned and verified here and only links leave. A pair is looked at in its
    first common band alone, and not once its documents are in one component.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["band", "i", "j"]):
            block, ids, component = (group[c].to_numpy().copy() for c in ("block", "node", "component"))
            signs, number = _signatures(group["sign"]), group["band_no"][0].as_py()
            sets = [s for w in chunks(group["text"], lower=True) for s in shingle_sets(w, k)]
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            a, b = [], []
            for x in left:
                others = right[component[right] != component[x]]
                others = others[ids[others] > ids[x]] if i == j else others
                if not len(others):
                    continue
                others = others[survive(np.broadcast_to(signs[x], (len(others), HASHES)), signs[others], bounds)]
                same = (signs[others] == signs[x]).reshape(-1, BANDS, ROWS).all(axis=2)
                others = others[same.argmax(axis=1) == number]
                for y in others[_similar(sets[x], [sets[o] for o in others], percent)] if len(others) else []:
                    if component[y] != component[x]:
                        a.append(min(ids[x], ids[y]))
                        b.append(max(ids[x], ids[y]))
                        component[component == component[y]] = component[x]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return emit


def _similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets ``others`` reach the similarity with ``one``, exactly."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    both = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(one) + sizes - both)


def _exact(k: int, percent: int):
    """Columns a, b, text_a, text_b: the pairs whose full sets reach the threshold."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            out_a, out_b = [], []
            left, right = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                if known[0] != left[i]:
                    known = (left[i], _one_set(batch.column(2).slice(i, 1), k))
                other = _one_set(batch.column(3).slice(i, 1), k)
                both = len(np.intersect1d(known[1], other, assume_unique=True))
                if 100 * both >= percent * (len(known[1]) + len(other) - both):
                    out_a.append(left[i])
                    out_b.append(right[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return emit


def _one_set(column: pa.Array, k: int) -> np.ndarray:
    return next(shingle_sets(next(chunks(column, lower=True)), k))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    miss: float = 1e-7,
    marked: bool = False,
) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``, and the text's ``mark`` if asked for.

    Documents link at a Jaccard similarity of ``percent`` or more over shingles of
    ``shingle`` lower-cased words. ``miss`` is the probability at which the sequential test
    gives up a pair that would link.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the bands are laid out for thresholds from 50 to 100 percent")
    bounds = least_matches(percent / 100, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    pair_type = "a long, b long"
    with Scratch(docs.sparkSession) as scratch:
        sketches = scratch.put(
            texts.mapInArrow(_sketch(shingle), "doc_id long, mark int, n_shingles long, one long, two long, sign binary"), "sketches"
        )
        sets = sketches.where("n_shingles > 0 and doc_id is not null")
        key = ["one", "two", "n_shingles"]
        classes = sets.groupBy(*key).agg(F.min(F.struct("doc_id", "mark")).alias("head"))
        classes = classes.select(*key, F.col("head.doc_id").alias("head"), F.col("head.mark").alias("head_mark"), F.monotonically_increasing_id().alias("node"))
        classes = scratch.put_clean(classes, "classes")  # written, so numbers stay
        own = classes.select("node", F.col("head").alias("doc_id"), F.col("head_mark").alias("mark"), *key)
        heads = sets.join(own, ["doc_id", "mark", *key]).select("node", "doc_id", "mark", "sign").dropDuplicates(["node"])
        banded = heads.select("node", "sign").mapInArrow(_bands, "band long, band_no int, node long")
        centre = F.min_by("node", F.xxhash64("node", "band")).alias("centre")
        buckets = banded.groupBy("band").agg(centre, F.count("*").alias("members")).where("members > 1")
        buckets = scratch.put(buckets, "buckets")
        members = scratch.put(banded.join(buckets, "band").select("band", "band_no", "node", "centre", "members"), "members")
        wanted = scratch.put_clean(heads.join(members.select("node").distinct(), "node"), "wanted")
        _, there = marked_by(texts, wanted.select("doc_id"), "doc_id")
        known = wanted.join(there, ["doc_id", "mark"]).select("node", "sign", "text").dropDuplicates(["node"])
        known = scratch.put_clean(known, "known")

        def side(name: str, value: str) -> DataFrame:
            return known.select(F.col("node").alias(name), F.col(value).alias(f"{value}_{name}"))

        ends = F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")
        stars = members.where("node <> centre").select(*ends).distinct()
        signed = stars.join(side("a", "sign"), "a").join(side("b", "sign"), "b")
        played = signed.select("a", "b", "sign_a", "sign_b").mapInArrow(_pruned(bounds), pair_type)
        full = played.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
        links = scratch.put(full.mapInArrow(_exact(shingle, percent), pair_type), "links")
        found = connected_components(links)

        placed = members.join(found, "node", "left")
        placed = placed.withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        blocks = F.ceil(F.col("members") / BLOCK)
        rows = placed.join(mixed.select("band"), "band")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
        rows = rows.join(known, "node").select("band", i, j, "band_no", "block", "node", "component", "sign", "text")
        rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        more = scratch.put(rows.mapInArrow(_across(bounds, shingle, percent), pair_type), "crossing")
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))

        named = least_names(found, classes.select("node", "head"))
        by_class = classes.join(named, "node", "left").select(*key, F.coalesce("component_id", "head").alias("component_id"))
        columns = ["doc_id", "mark", "n_shingles", "component_id"]
        linked = sets.drop("sign").join(by_class, key).select(columns)
        alone = sketches.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id")).select(columns)
        result = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        return cut(result.select("doc_id", "n_shingles", "component_id", "kept", *["mark"] * marked))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with the least id; of rows with equal ids and texts, one stays."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, marked=True, **options)
    gone = found.where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_text"))
    kept = without(docs, gone, id_col, text_col)
    twice = found.where("kept and doc_id is not null").groupBy("doc_id", "mark").count().where("count > 1")
    single, repeated = marked_by(kept, twice.select("doc_id"), id_col)
    repeated, names = with_names(repeated, id_col, text_col)
    return single.unionByName(repeated.dropDuplicates(names).drop(*names))
