"""Sharded joins of documents with a table of values by key, in packed form.

A document's n-grams or words are keys; a table holds values for each key; wanted is each
document's sum of count times value. Joined row by row, every (document, key) pair would
be a shuffled row. Here a chunk of documents is packed, for each shard of the key space,
into one block: its distinct keys, and for each key the documents and counts, compressed.
Blocks and table rows are shuffled by shard; each task streams through its shards, holding
one shard's part of the table and one block, and adds up values per document. The number
of shards follows the table, the number of tasks the blocks: the blocks of a shard are dealt
out to several tasks by a salt, and the shard's part of the table goes to each of them.
Shard and salt make up the partition's number, so no two meet in a task by chance.

Nothing is broadcast, the table may be of any size (more shards), and a key that all
documents share is one key in each block.

A document is named by its id and 32 bits of a hash of its text, so rows of one id with
unlike texts stay apart; equal rows add up and share what is found for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.filters import text_mark
from folioframe.llm.scratch import cleaning

SHARD_KEYS = 1 << 20  # keys of the table in a shard, about
TASK_BYTES = 16 << 20  # of text whose blocks go to one task, about
MOST_PARTITIONS = 1 << 16
_codec = pa.Codec("zstd", compression_level=1)


def shard_bits(keys: int) -> int:
    """Shards are powers of two: eight at least, more so that each holds about SHARD_KEYS."""
    return max(3, (max(keys, 1) // SHARD_KEYS).bit_length())


def shard_column(key, bits: int):
    return F.shiftrightunsigned(key, 64 - bits).cast("int")


def salts(spark: SparkSession, bits: int, size: int) -> int:
    """Tasks for a shard of a table that is small beside ``size`` bytes of text: in all as many as these call for, and no
    fewer than the shuffle partitions. Where ``size`` is 0, the table is large: one, and more tasks come with more shards."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES) if size else 1
    return max(1, min(tasks, MOST_PARTITIONS) >> bits)


def to_place(df: DataFrame, places: int) -> DataFrame:
    """``df`` with the rows of each place (column ``place``, from 0) in one partition; neighbours share it where places are very many."""
    partitions = min(places, MOST_PARTITIONS)
    at = F.col("place") if partitions == places else F.floor(F.col("place") * F.lit(partitions / places)).cast("int")
    return df.repartitionById(partitions, at)


def named(docs: DataFrame) -> DataFrame:
    """``docs`` (columns doc_id, text, ...) with the two parts of a document's name, ``row`` and ``row_text``."""
    return docs.withColumn("row", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("row_text", text_mark(F.col("text")))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal significance together: high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: np.ndarray, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers, compressed by planes of bytes."""
    sizes = np.array([len(arrays), *[len(x) for x in arrays]], np.uint32)
    body = b"".join([sizes.tobytes(), *[_planes(x) for x in arrays]])
    return np.uint64(len(body)).tobytes() + _codec.compress(body, asbytes=True)


def unpack_arrays(payload: bytes, kinds: list[type]) -> list[np.ndarray]:
    """The first arrays of a block, of these kinds."""
    size = int(np.frombuffer(payload, np.uint64, 1)[0])
    raw = np.frombuffer(_codec.decompress(memoryview(payload)[8:], size, asbytes=True), np.uint8)
    arrays = int(raw[:4].view(np.uint32)[0])
    at, out = 4 + 4 * arrays, []
    for n, kind in zip(raw[4:at].view(np.uint32).astype(int), kinds, strict=False):
        width = n * np.dtype(kind).itemsize
        out.append(_unplanes(raw[at : at + width], n, kind))
        at += width
    return out


_BLOCK = [np.int64, np.int32, np.uint64, np.uint32, np.uint16, np.uint32]


def _pack(rows: tuple[np.ndarray, np.ndarray], keys: np.ndarray, spread: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(docs.astype(np.uint16), prepend=np.uint16(0))
    return pack_arrays([*rows, np.diff(keys, prepend=np.uint64(0)), spread.astype(np.uint32), gaps, counts.astype(np.uint32)])


def _unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    ids, texts, keys, spread, gaps, counts = unpack_arrays(payload, _BLOCK)
    return ids, texts, np.cumsum(keys, dtype=np.uint64), spread, np.cumsum(gaps, dtype=np.uint16), counts


def pack_blocks(rows: tuple[np.ndarray, np.ndarray], keys: np.ndarray, docs: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Blocks by shard: ``shard, block``. ``rows`` names the documents; ``keys`` is sorted, ``docs`` (positions in ``rows``) within each key."""
    shards, blocks = [], []
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        distinct = keys[first]
        spread = np.diff(np.append(first, len(keys)))
        edges = np.searchsorted(distinct, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        edges = np.append(edges, len(distinct))
        ends = np.append(first, len(keys))
        for shard in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            i, j = edges[shard], edges[shard + 1]
            a, b = ends[i], ends[j]
            there = np.zeros(len(rows[0]), bool)
            there[docs[a:b]] = True
            number = np.cumsum(there) - 1
            shards.append(shard)
            blocks.append(_pack((rows[0][there], rows[1][there]), distinct[i:j], spread[i:j], number[docs[a:b]], counts[a:b]))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])


def counted(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, document), sorted, and how often each comes; equal keys come in order of documents."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(new)
    return keys[first], docs[first], np.diff(np.append(first, len(keys)))


TABLE, BLOCK = 0, 1  # what a row of a sharded join holds; the table comes first


def sharded(keys: np.ndarray, bits: int) -> tuple[np.ndarray, Iterator[tuple[int, slice]]]:
    """An order of ``keys`` by shard (and sorted within), and each shard's slice of it."""
    order = np.argsort(keys)
    shards = keys[order] >> np.uint64(64 - bits)
    edges = [*np.flatnonzero(np.append(True, shards[1:] != shards[:-1])).tolist(), len(keys)] if len(keys) else []
    return order, ((int(shards[i]), slice(i, j)) for i, j in zip(edges, edges[1:], strict=False))


def pack_table(table: DataFrame, bits: int) -> DataFrame:
    """``shard, n, block``: the rows of a table in blocks by shard, its key first and then its columns of doubles (null is 0)."""
    columns = [c for c in table.columns if c != "key"]

    def flush(held: list) -> pa.RecordBatch:
        keys, values = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held], axis=1)
        order, parts = sharded(keys, bits)
        keys, values = keys[order], values[:, order]
        rows = [(s, at.stop - at.start, pack_arrays([keys[at], *values[:, at]])) for s, at in parts]
        return table_batch(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            values = np.array([batch.column(1 + c).fill_null(0.0).to_numpy() for c in range(len(columns))])
            held.append((batch.column(0).to_numpy().view(np.uint64), values))
            size += batch.num_rows
            if size > SHARD_KEYS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return table.select("key", *columns).mapInArrow(emit, "shard int, n int, block binary")


def table_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shards, sizes, blocks = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(sizes, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "n", "block"])


def meet(table: DataFrame, blocks: DataFrame, bits: int, dealt: int = 1) -> DataFrame:
    """``place, shard, kind, block``: the blocks of a table and others of a shard in one partition, the table first.

    The blocks that are no table's are dealt out to ``dealt`` partitions, to each of which the table goes.
    """
    first = F.col("shard") * dealt
    place = F.explode(F.sequence(first, first + (dealt - 1))) if dealt > 1 else F.col("shard")
    left = table.select(place.alias("place"), "shard", F.lit(TABLE).alias("kind"), "block")
    place = (first + F.pmod(F.xxhash64("block"), F.lit(dealt))).cast("int") if dealt > 1 else F.col("shard")
    right = blocks.select(place.alias("place"), "shard", F.lit(BLOCK).alias("kind"), "block")
    return to_place(left.unionByName(right), dealt << bits).sortWithinPartitions("shard", "kind")


def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """Shard, kind and block of the rows of ``meet``."""
    for batch in batches:
        for shard, kind, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            yield shard, kind, block.as_py()


def join_blocks(blocks: DataFrame, table: DataFrame, columns: list[str], bits: int, size: int, special: int = 0) -> DataFrame:
    """Per document ``row, row_text``, the sums of count * value for each column of values, and of counts where the last
    one is not 0 (its name with ``_found``), ``of_special`` and ``alike``.

    ``blocks``: ``shard int, block binary``; ``table``: the blocks of ``pack_table`` with these
    ``columns``; values of repeated keys add up, keys that it lacks count as 0. ``size`` is about
    the bytes of the texts. ``of_special`` is the count of the key ``special``, and ``alike`` the
    number of rows that have it. A document comes once for each shard: sum up.
    """
    width = len(columns)
    both = meet(table, blocks, bits, salts(table.sparkSession, bits, size))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        keys, values = np.zeros(0, np.uint64), np.zeros((width, 0))
        for shard, kind, payload in payloads(batches):
            if shard != last:
                last, parts = shard, []
                keys, values = np.zeros(0, np.uint64), np.zeros((width, 0))
            if kind == TABLE:
                parts.append(unpack_arrays(payload, [np.uint64] + [np.float64] * width))
                continue
            if parts:
                keys, values = _summed(np.concatenate([x[0] for x in parts]), np.concatenate([x[1:] for x in parts], axis=1))
                parts = []
            ids, texts, own, spread, docs, counts = _unpack(payload)
            value = np.zeros((width, len(own)))
            if len(keys):
                at = np.searchsorted(keys, own)
                at[at == len(keys)] = 0
                found = keys[at] == own
                value[:, found] = values[:, at[found]]
            out = [np.bincount(docs, np.repeat(v, spread) * counts, len(ids)) for v in value]
            out.append(np.bincount(docs, np.repeat(value[-1] != 0, spread) * counts, len(ids)).astype(np.int64))
            marked = np.repeat(own == np.uint64(special), spread)
            out.append(np.bincount(docs[marked], counts[marked], len(ids)).astype(np.int64))
            out.append(np.bincount(docs[marked], minlength=len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, texts, *out)], ["row", "row_text", *columns, f"{columns[-1]}_found", "of_special", "alike"])

    doubles = "".join(f"{c} double, " for c in columns)
    return both.mapInArrow(emit, f"row long, row_text int, {doubles}{columns[-1]}_found long, of_special long, alike long")


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed values."""
    order = np.argsort(keys)
    keys, values = keys[order], values[:, order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys, values) if len(first) == len(keys) else (keys[first], np.add.reduceat(values, first, axis=1))


def bitmap(tables: DataFrame, bits: int, most: int) -> np.ndarray:
    """Bits set at the leading bits of the keys of a table's blocks; 2^``most`` bits at most, in slices by shard."""
    n = tables.agg(F.sum("n")).first()[0] or 0
    size = min(most, max(bits + 6, (8 * n).bit_length()))
    width = size - bits  # bits of a slice, as a power

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.unique(unpack_arrays(b.as_py(), [np.uint64])[0] >> np.uint64(64 - size)) & np.uint64((1 << width) - 1) for b in batch.column(1)]
            packed = [pack_arrays([np.diff(p.astype(np.uint32), prepend=np.uint32(0))]) for p in places]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["place", "block"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, flags = None, np.zeros(1 << width, bool)
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if last is not None and shard != last:
                    yield one(last, flags)
                    flags[:] = False
                last = shard
                flags[np.cumsum(unpack_arrays(block.as_py(), [np.uint32])[0], dtype=np.uint32)] = True
        if last is not None:
            yield one(last, flags)

    def one(shard: int, flags: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])

    sliced = to_place(tables.select("shard", "block").mapInArrow(keys_only, "place int, block binary"), 1 << bits).sortWithinPartitions("place")
    out = np.zeros(1 << (size - 3), np.uint8)
    with cleaning(tables.sparkSession):
        slices = sliced.mapInArrow(merged, "shard int, bits binary").collect()  # as large as the bitmap
    for row in slices:
        out[row.shard << (width - 3) : (row.shard + 1) << (width - 3)] = np.frombuffer(row.bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - (len(bits).bit_length() - 1 + 3))
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
