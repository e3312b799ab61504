"""A passage that most texts hold: right results, and rows that do not grow with the texts."""

import hashlib
import random

import pyarrow as pa
import pytest

from folioframe.llm import substrings


def texts(n, seed=3):
    """Own words before and after, all or a part of one passage between; some hold it twice, some ids come twice."""
    dice = random.Random(seed)
    passage = [f"p{i}" for i in range(200)]
    rows = []
    for i in range(n):
        lo, hi = sorted(dice.sample(range(201), 2)) if i % 5 == 4 else (0, 200)
        own = lambda k: [f"w{dice.randrange(10**9)}" for _ in range(k)]
        words = own(dice.randrange(60)) + passage[lo:hi] + own(dice.randrange(60)) + (passage[50:140] if i % 7 == 0 else [])
        rows.append((i - i % 3 if i % 50 == 0 else i, " ".join(words)))
    return rows


def emitted(rows):
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(i, hash(t) >> 33, t) for i, t in rows]), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "mark", "text"])  # noqa: B905
    return [r for b in substrings._runs(50, 16)(iter([batch])) for r in b.to_pylist()]


def test_rows_of_a_common_passage_are_as_many_as_chunks():
    for n in (200, 800):
        rows = emitted([(i, t) for i, (_, t) in enumerate(texts(n)) if i % 5 != 4 and i % 7])
        inside = [r for r in rows if r["n"] > n / 2]
        assert len(inside) >= 5 and sum(r["n"] for r in rows) > 5 * n * 0.6
        spans = {(r["anchor"], r["span"]) for r in inside}
        assert len([r for r in rows if (r["anchor"], r["span"]) in spans]) == len(spans)  # before, one a text
        for r in rows:
            assert r["n"] == 1 + len(r["others"] or []) and all(x["doc_id"] > r["doc_id"] for x in r["others"] or [])


@pytest.mark.parametrize("partitions", [1, 7])
def test_common_passage(spark, partitions):
    rows = texts(300)
    first = {}
    for i, text in rows:
        words = text.split()
        for s in range(len(words) - 49):
            key = tuple(words[s : s + 50])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, text in rows:
        words = text.split()
        gone = {j for s in range(len(words) - 49) if first[tuple(words[s : s + 50])] < i for j in range(s, s + 50)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        want.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert sorted(map(tuple, substrings.dedup_substrings(docs).collect())) == sorted(want)
    assert sum(w[2] for w in want) > 100 * len(rows)
