"""Exact substring dedup by seed and extend.

Seeds: every window of ``window`` words has one anchor, the least hash among its k-grams
(winnowing; ties go to the rightmost), so equal windows have equal anchors at equal
offsets. Consecutive windows with one anchor form a run; a run's anchor and the hash of
its whole span go to the join.

Extend: runs with equal spans repeat each other as a whole, so the match extends both
ways over the span at once and only the smallest document keeps it. Where one anchor
stands in different spans, the match ends inside a run; for those runs alone, each window
around the anchor is hashed and the smallest document of each is found. Adjoining
windows merge into maximal repeats, which are removed from all later documents.

Sums of work are linear in the words: groups are reduced by ``min``, never paired up. Of
the texts that a task works on at once, a span that many hold is one row with all of them,
so the rows of a passage that most texts hold are as many as these chunks, not as the texts.

Texts are not shuffled but for those that may hold a repeat, as a bitmap of fixed size shows.

Defined results: a null or empty text has no words; a text shorter than ``window`` words
loses none; repeats within one document are kept; rows of one id, whether their texts are
equal or not, remove nothing from each other, and each is judged by its own text (they are
told apart by 32 bits of a hash of it); a row with a null id neither loses nor removes
anything; texts of any length are read whole; an empty table gives an empty result. Only
the id and text columns are read; others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioframe.llm.filters import fresh, marked_by, text_mark, with_names
from folioframe.llm.scratch import Scratch, cut
from folioframe.llm.textblocks import Words, as_long, chunks, mix, prefix_sums, sequence_hashes

KGRAM = 16
CHUNK = 1 << 20  # bytes of text that a task works on at once
_POSITION_BITS = 28


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, in two passes over blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def window_starts(words: Words, window: int) -> np.ndarray:
    """Which words of the chunk start a whole window of their document."""
    valid = np.zeros(len(words.hashes) + 1, np.int32)
    lo, hi = words.offsets[:-1], words.offsets[1:] - window + 1
    long = hi > lo
    np.add.at(valid, lo[long], 1)
    np.add.at(valid, hi[long], -1)
    return np.cumsum(valid[:-1]) > 0


def anchored_runs(words: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Per run: first window, number of windows, offset of the anchor, anchor hash."""
    grams = sequence_hashes(words.hashes, k)
    width = window - k + 1
    if len(grams) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    bits = np.uint64(_POSITION_BITS)
    top = np.uint64((1 << _POSITION_BITS) - 1)
    coded = (grams & ~top) | (top - np.arange(len(grams), dtype=np.uint64))
    least = sliding_min(coded, width)
    anchor = (top - (least & top)).astype(np.int64)
    starts = np.flatnonzero(window_starts(words, window)[: len(anchor)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    anchor = anchor[starts]
    doc = np.searchsorted(words.offsets, starts, side="right")
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(starts)))
    return starts[first], length, anchor[first] - starts[first], grams[anchor[first]]


def span_hashes(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sums, down = prefix_sums(words.hashes)
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


_RUNS = "chunk long, doc_id long, mark int, anchor long, span long, first int, length int, n int, others array<struct<doc_id: long, mark: int, first: int>>"


def _runs(window: int, k: int):
    """Runs; of those of a chunk with one span, that of the smallest document holds those of larger ones as ``others``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (task.partitionId() if (task := TaskContext.get()) else 0) << 32
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for words in chunks(batch.column(2), CHUNK):
                first, length, offset, anchor = anchored_runs(words, window, k)
                if not len(first):
                    continue
                chunk += 1
                doc = np.searchsorted(words.offsets, first, side="right") - 1
                span = span_hashes(words, first, first + length + window - 1) ^ mix(offset.astype(np.uint64))
                own, first = ids[words.lo + doc], first - words.offsets[doc]
                order = np.lexsort((own, length, span, anchor))
                own, mark, anchor, span = own[order], marks[words.lo + doc][order], anchor[order], span[order]
                first, length = first[order].astype(np.int32), length[order].astype(np.int32)
                new = np.ones(len(order), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1]) | (length[1:] != length[:-1])
                least = np.flatnonzero(new)[np.cumsum(new) - 1]
                held = own > own[least]
                behind = np.bincount(least[held], minlength=len(order))[~held]
                others = pa.StructArray.from_arrays([pa.array(x[held]) for x in (own, mark, first)], ["doc_id", "mark", "first"])
                bounds = pa.array(np.append(0, np.cumsum(behind)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(behind), chunk), pa.int64()),
                        pa.array(own[~held], pa.int64()),
                        pa.array(mark[~held]),
                        as_long(anchor[~held]),
                        as_long(span[~held]),
                        pa.array(first[~held]),
                        pa.array(length[~held]),
                        pa.array((1 + behind).astype(np.int32)),
                        pa.ListArray.from_arrays(bounds, others, mask=pa.array(behind == 0)),
                    ],
                    ["chunk", "doc_id", "mark", "anchor", "span", "first", "length", "n", "others"],
                )

    return emit


_SPANS = "doc_id long, mark int, first int, last int"


def _merged(window: int):
    """Spans of the runs of a chunk that stand in a smaller document too; spans of a text that meet are one."""

    def merge(runs: pa.Table) -> pa.Table:
        runs = runs.combine_chunks()
        columns = {c: runs[c].to_numpy() for c in ("doc_id", "mark", "first", "length", "owner")}
        gone = columns["doc_id"] > columns["owner"]
        listed = pa.concat_arrays(runs["others"].chunks) if runs["others"].num_chunks else pa.array([], runs["others"].type)
        others, of = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
        doc, mark, first = (np.append(columns[c][gone], others.field(c).to_numpy(zero_copy_only=False)) for c in ("doc_id", "mark", "first"))
        last = first + np.append(columns["length"][gone], columns["length"][of]) + (window - 1)
        order = np.lexsort((first, mark, doc))
        doc, mark, first, last = doc[order], mark[order], first[order].astype(np.int64), last[order].astype(np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
        shift = np.cumsum(new) << 32  # so that no text's spans meet another's
        reach = np.maximum.accumulate(last + shift)
        new[1:] |= first[1:] + shift[1:] > reach[:-1]
        at = np.flatnonzero(new)
        last = (np.maximum.reduceat(last, at) if len(at) else last).astype(np.int32)
        columns = [pa.array(doc[at], pa.int64()), pa.array(mark[at], pa.int32()), pa.array(first[at].astype(np.int32)), pa.array(last)]
        return pa.Table.from_arrays(columns, ["doc_id", "mark", "first", "last"])

    return merge


_WINDOWS = "anchor long, hash long, doc_id long, mark int, start int"


def _windows(window: int):
    """Hashes of the windows of contested runs; columns: doc_id, mark, text, runs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            runs = batch.column(3)
            bounds = runs.offsets.to_numpy().astype(np.int64)
            flat = runs.values
            first = flat.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
            length = flat.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
            anchor = flat.field("anchor").to_numpy(zero_copy_only=False)
            for words in chunks(batch.column(2), CHUNK):
                lo, hi = bounds[words.lo], bounds[words.hi]
                size = np.diff(bounds[words.lo : words.hi + 1])
                doc = np.repeat(np.arange(words.hi - words.lo), size)
                n = length[lo:hi]
                run = np.repeat(np.arange(hi - lo), n)
                start = first[lo:hi][run] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = words.offsets[doc[run]] + start
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[lo:hi][run], pa.int64()),
                        as_long(span_hashes(words, at, at + window)),
                        pa.array(ids[words.lo + doc[run]], pa.int64()),
                        pa.array(marks[words.lo + doc[run]]),
                        pa.array(start.astype(np.int32)),
                    ],
                    ["anchor", "hash", "doc_id", "mark", "start"],
                )

    return emit


def removed_words(n_words: int, spans: list[dict]) -> np.ndarray:
    """Which of a document's words are covered by the spans."""
    edge = np.zeros(n_words + 1, np.int32)
    for s in spans:
        edge[s["first"]] += 1
        edge[s["last"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = KGRAM) -> DataFrame:
    """``doc_id, mark, first, last``: word ranges whose windows all start in a smaller document too."""
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and window")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).alias("text")).where("doc_id is not null")
    with Scratch(docs.sparkSession) as scratch:
        runs = scratch.put(texts.mapInArrow(_runs(window, k), _RUNS), "runs")
        spans = runs.groupBy("anchor", "span").agg(F.min("doc_id").alias("owner"), F.sum("n").alias("runs"))
        anchors = spans.groupBy("anchor").agg(F.count("*").alias("spans"), F.sum("runs").alias("all_runs"))
        shared = anchors.where("all_runs > 1").select("anchor", "spans")
        groups = scratch.put_clean(spans.join(shared, "anchor").where("runs > 1 or spans > 1"), "groups")
        found = scratch.put_clean(runs.drop("n").join(groups, ["anchor", "span"]), "found")
        scratch.drop("runs")
        whole = found.where("doc_id > owner or others is not null").select("chunk", "doc_id", "mark", "first", "length", "owner", "others")
        whole = whole.groupBy("chunk").applyInArrow(_merged(window), _SPANS)
        contested = found.where("doc_id = owner and spans > 1").groupBy("doc_id", "mark")
        contested = contested.agg(F.collect_set(F.struct("first", "length", "anchor")).alias("runs"))
        contested = scratch.put_clean(contested, "contested")
        _, doubtful = marked_by(texts, contested.select("doc_id"), "doc_id")
        windows = doubtful.join(contested, ["doc_id", "mark"]).select("doc_id", "mark", "text", "runs").mapInArrow(_windows(window), _WINDOWS)
        windows = scratch.put_clean(windows, "windows")
        least = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most")
        edges = windows.join(least.select("anchor", "hash", "owner"), ["anchor", "hash"]).where("doc_id > owner")
        edges = edges.select("doc_id", "mark", F.col("start").alias("first"), (F.col("start") + window).alias("last"))
        return cut(whole.unionByName(edges))


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` in two parts: rows that surely lose nothing, and the others with an array of their spans (or null) in the column named last."""
    marks = cut(spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    sure, doubtful = marked_by(docs, marks.select("doc_id"), id_col)
    doubtful, names = with_names(doubtful, id_col, text_col)
    name = fresh(doubtful, "__spans")
    marks = marks.select(F.col("doc_id").alias(names[0]), F.col("mark").alias(names[1]), F.col("spans").alias(name))
    return sure, doubtful.join(marks, names, "left").drop(*names), name


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    k: int = KGRAM,
    with_text: bool = False,
) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256``, and the kept text if asked for.

    Kept words are joined by one space.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, k=k)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sure, marked, name = _with_spans(texts, spans, "doc_id", "text")
    rows = marked.unionByName(sure.withColumn(name, F.lit(None).cast(marked.schema[name].dataType)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts, marks = batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()  # the separators of bytes.split
                n, gone = len(words), 0
                if marks[i].is_valid:
                    covered = removed_words(n, marks[i].as_py())
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered, strict=True) if not c]
                kept = b" ".join(words)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if with_text else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (3 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            out = [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(out)])

    return rows.select("doc_id", "text", name).mapInArrow(emit, schema)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = KGRAM) -> DataFrame:
    """``docs`` with the repeated words cut out of the text; documents left without a word go.

    White space stays as it is outside of what is cut out; texts without repeats do not
    change. ``n_chars``, where there is such a column, follows the new text. Only documents
    with repeats pass through Python.
    """
    sure, marked, name = _with_spans(docs, repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, k=k), id_col, text_col)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    place = docs.columns.index(text_col)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[str | None] = []
            spans = batch.column(batch.num_columns - 1)
            for words in chunks(batch.column(place), hashes=False):
                for i in range(words.hi - words.lo):
                    lo, hi = int(words.offsets[i]), int(words.offsets[i + 1])
                    gone = removed_words(hi - lo, spans[words.lo + i].as_py())
                    kept.append(None if gone.all() else _cut_out(words, i, gone))
            out = batch.columns[:-1]
            out[place] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(out, batch.schema.names[:-1])

    plain = [f"c{i}" for i in range(len(docs.columns))]  # names with dots cannot go through mapInArrow
    schema = StructType([StructField(p, f.dataType) for p, f in zip(plain, docs.schema, strict=True)])
    changed = marked.where(F.col(name).isNotNull()).select(*columns, name).toDF(*plain, "spans").mapInArrow(emit, schema)
    changed = changed.where(F.col(plain[place]).isNotNull()).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length(F.col(f"`{text_col}`")).cast(docs.schema["n_chars"].dataType))
    return sure.unionByName(marked.where(F.col(name).isNull()).select(columns)).unionByName(changed)


def _cut_out(words: Words, i: int, gone: np.ndarray) -> str:
    """Document ``i`` without the words marked as gone, and without the white space after each."""
    lo, hi = int(words.offsets[i]), int(words.offsets[i + 1])
    starts, ends = words.starts[lo:hi], np.append(words.starts[lo + 1 : hi], words.doc_bytes[i + 1])
    keep = np.ones(int(words.doc_bytes[i + 1] - words.doc_bytes[i]), bool)
    base = words.doc_bytes[i]
    for s, e in zip(starts[gone] - base, ends[gone] - base, strict=True):
        keep[s:e] = False
    return words.data[base : words.doc_bytes[i + 1]][keep].tobytes().decode("utf-8", "replace")
