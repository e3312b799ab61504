"""Language identification of multilingual texts by mixture inference.

Each language has a likelihood over hashed byte trigrams, learned from labelled texts. A
document is taken as a mixture: expectation-maximisation estimates the proportions in
which the languages make up its trigrams. Language sets are then compared by penalised
likelihood (BIC): the likeliest single language, then the two, three, ... with the
largest proportions, each fitted again, until a larger set no longer pays. The answer is
the language with the largest proportion in the best set. Its score is that proportion,
times how likely this language is among all if just one is taken: next to 1 in any text of
some length, and the less the shorter a text. A text counts as standing between blanks, so
the shortest has a trigram too.

The model is a table of languages by buckets, so its size is fixed but for the number of
languages, which may not exceed ``MOST_LANGUAGES``; it is all that is broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
everything when no labelled text is there to learn from; among languages that are equally
likely the first in code point order is taken; a null id is neither learned from nor held
out; repeated rows get equal results, and rows of one id with unlike texts are judged each
by its own text; texts of any length are read whole; an empty table gives an empty result.
Only the named columns are read; the language is never used to predict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.scratch import cut
from folioframe.llm.textblocks import buffers, doc_ranges

BUCKETS = 4096
MOST_LANGUAGES = 1000
UNKNOWN = "und"
_CLASS = np.full(256, 0x20, np.uint8)  # letters in lower case, bytes of other scripts, blanks for the rest
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Documents by buckets: how often each hashed trigram occurs."""
    n = len(bounds) - 1
    sizes = np.diff(bounds) + 2
    x = np.full(int(sizes.sum()), 0x20, np.uint32)
    doc = np.repeat(np.arange(n), sizes)
    x[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(bounds)) + 1] = _CLASS[data]
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    ok = (doc[:-2] == doc[2:]) & (key != 0x202020)
    bucket = (key * np.uint32(2654435761)) >> np.uint32(20)
    at = doc[:-2][ok] * BUCKETS + bucket[ok]
    return np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)


def _has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    ascii_letter = (_CLASS[data] >= 97) & (_CLASS[data] < 123)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(ascii_letter)])
    out = sums[bounds[1:]] > sums[bounds[:-1]]
    for i in np.flatnonzero(~out):
        text = data[bounds[i] : bounds[i + 1]]
        if len(text) and text.max() >= 128:
            out[i] = any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))
    return out


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(column)
    for lo, hi in doc_ranges(offsets, 2 << 20):
        for a in range(lo, hi, 512):
            b = min(hi, a + 512)
            yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lo, hi, data, bounds in _parts(batch.column(0)):
            x = _trigrams(data, bounds)
            for lang in dict.fromkeys(langs[lo:hi]):
                total = totals.setdefault(lang, np.zeros(BUCKETS))
                total += x[langs[lo:hi] == lang].sum(axis=0)
        if len(totals) > 200:
            yield from _flush(totals)
            totals = {}
    yield from _flush(totals)


def _flush(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, total in totals.items():
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(total[bucket])],
            ["lang", "bucket", "count"],
        )


def fit_mixture(x: np.ndarray, likelihood: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
    """EM for the proportions of each row's languages; a share that starts at 0 stays there."""
    share, total = start.astype(np.float32), np.maximum(x.sum(axis=1, keepdims=True), 1)
    for _ in range(steps):
        new = share * ((x / (share @ likelihood)) @ likelihood.T) / total
        change = np.abs(new - share).max()
        share = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-30)
        if change < 1e-4:
            break
    return share


def log_likelihood(x: np.ndarray, likelihood: np.ndarray, share: np.ndarray) -> np.ndarray:
    return (x * np.log(share @ likelihood)).sum(axis=1, dtype=np.float64)


def infer(x: np.ndarray, likelihood: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """By row, proportions in the language set of the best penalised likelihood, and the posterior of each language alone."""
    rows, langs = len(x), len(likelihood)
    n = x.sum(axis=1, dtype=np.float64)
    single = (x @ np.log(likelihood).T).astype(np.float64)
    alone = np.exp(single - single.max(axis=1, keepdims=True))
    alone /= alone.sum(axis=1, keepdims=True)
    best = np.zeros((rows, langs), np.float32)
    best[np.arange(rows), single.argmax(axis=1)] = 1
    best_score = single.max(axis=1)
    if langs == 1:
        return best, alone
    full = fit_mixture(x, likelihood, np.full((rows, langs), 1 / langs), steps)
    order = np.argsort(-full, axis=1, kind="stable")
    open_rows = np.arange(rows)
    for k in range(2, langs + 1):
        start = np.zeros((len(open_rows), langs), np.float32)
        top = order[open_rows, :k]
        np.put_along_axis(start, top, np.take_along_axis(full[open_rows], top, 1) + np.float32(1e-3), 1)
        start /= start.sum(axis=1, keepdims=True)
        share = fit_mixture(x[open_rows], likelihood, start, steps)
        score = log_likelihood(x[open_rows], likelihood, share) - 0.5 * (k - 1) * np.log(np.maximum(n[open_rows], 2))
        better = score > best_score[open_rows]
        best[open_rows[better]] = share[better]
        best_score[open_rows[better]] = score[better]
        open_rows = open_rows[better]
        if not len(open_rows):
            break
    return best, alone


def _predict(shared, steps: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, likelihood = shared.value
        for batch in batches:
            for lo, hi, data, bounds in _parts(batch.column(2)):
                known = _has_letter(data, bounds)
                lang, score = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                rows = np.flatnonzero(known)
                if len(names) and len(rows):
                    share, alone = infer(_trigrams(data, bounds)[rows], likelihood, steps)
                    for r, s, p in zip(rows.tolist(), share, alone, strict=True):
                        top = int(s.argmax())
                        lang[r] = names[top]
                        mixed = np.count_nonzero(s) > 1  # then no language need be likely alone
                        score[r] = min(1.0, float(s[top]) * (1.0 if mixed else float(p[top])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return emit


def identify_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out: Column | None = None,
    steps: int = 20,
) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``.

    ``held_out`` tells which rows are not learned from (default: crc32 of the id as text,
    modulo 5, is 0).
    """
    spark = docs.sparkSession
    out = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0 if held_out is None else held_out
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = texts.where("not held_out and lang is not null").select("text", "lang")
    counts = labelled.mapInArrow(_counts, "lang string, bucket int, count double").groupBy("lang", "bucket").agg(F.sum("count").alias("count"))
    counts = cut(counts)
    names = [r.lang for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((len(names), BUCKETS), 0.1)
    place = {n: i for i, n in enumerate(names)}
    for r in counts.toLocalIterator():  # languages x buckets at most
        table[place[r.lang], r.bucket] += r["count"]
    table = (table / table.sum(axis=1, keepdims=True)).astype(np.float32) if names else table.astype(np.float32)
    shared = spark.sparkContext.broadcast((names, table))
    kept_out = F.coalesce("held_out", F.lit(False)).alias("held_out")
    return texts.select("doc_id", kept_out, "text").mapInArrow(_predict(shared, steps), "doc_id long, held_out boolean, lang_pred string, score double")
