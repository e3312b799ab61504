"""Operators on words of texts, against brute force, with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioframe.llm.components import connected_components
from folioframe.llm.decontam import decontaminate, find_contamination
from folioframe.llm.filters import without
from folioframe.llm.mixing import mix
from folioframe.llm.neardup import near_duplicates
from folioframe.llm.quality import classify_quality
from folioframe.llm.substrings import dedup_substrings
from folioframe.llm.suffix_tree import score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `component id` int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="session")
def rows(spark, sf):
    """The small table, and empty, null, short, long, equal and shifted texts."""
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = [w for d in docs[:40] for w in WORD.findall(d[1])]
    passage = " ".join(base[100:170])
    extra = [
        (9001, None, None, None),
        (9002, "", "en", "a"),
        (9003, " \t\n", "en", "a"),
        (9004, "one", "en", None),
        (9005, "One two\x1fthree", "en", "a"),
        (9006, "  \n".join(base[:6000]), "en", "zz"),
        (9007, " ".join(base[30:6010]), "de", "zz"),
        (9008, passage, "en", "zz"),
        (9009, "x " + passage + " y", "en", "é"),
        (9010, passage.upper(), "en", "é"),
        (9011, " ".join(base[100:149]), "fr", "a"),
        (9012, "one", "en", "b"),
        (9013, "\U0001f600 " * 60, "en", "b"),
        (9014, "\U0001f600 " * 61 + "z", "en", "b"),
        (9015, " ".join(["again"] * 120), "en", "b"),
        (9015, " ".join(["again"] * 120), "en", "b"),
    ]
    return docs + extra


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, rows, empty):
    first = {}
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for k in (16, 50):
        assert sorted(map(tuple, dedup_substrings(docs, k=k).collect())) == sorted(want)
    assert sum(w[2] for w in want) > 6000
    assert dedup_substrings(empty).count() == 0


def jaccard_components(rows, k):
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, *_ in rows)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, empty, k):
    found = near_duplicates(docs, shingle=k)
    assert sorted(map(tuple, found.collect())) == jaccard_components(rows, k)
    assert near_duplicates(empty, shingle=k).count() == 0


def test_near_duplicates_across_centres(spark):
    """Two groups around different centres that link through members only; null ids; a chain."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(12)]
    hot = [(100 + i, " ".join([*words[200:300], f"odd{i}"])) for i in range(60)]
    rows = [*chain, *hot, (None, " ".join(words[:100])), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, shingle=2)
    named = sorted(tuple(r) for r in found.collect() if r.doc_id is not None)
    assert named == jaccard_components([r for r in rows if r[0] is not None], 2)
    assert [r.kept for r in found.collect() if r.doc_id is None] == [True, True]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination(spark, docs, rows, empty, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(500, None), (501, ""), (502, "one"), (503, " ".join(WORD.findall(rows[0][1])[:7])), (None, "one"), (502, "one")]

    def shingles(text):
        w = WORD.findall(lower(text or ""))
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    want = set()
    for d, text, *_ in rows:
        own = shingles(text)
        for i, item in items:
            q = shingles(item)
            if i is not None and q and 100 * len(own & q) >= 80 * len(q):
                want.add((d, i, len(own & q), len(q)))
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    found = [tuple(r) for r in find_contamination(docs, table).collect()]
    assert len(want) > 4 and sorted(found) == sorted(want)
    kept = decontaminate(docs, table)
    assert kept.columns == docs.columns and kept.count() == len([r for r in rows if r[0] not in {w[0] for w in want}])
    assert find_contamination(empty, table).count() == 0 and find_contamination(docs, table.limit(0)).count() == 0


def test_base_scores(docs, rows, empty):
    def tokens(text):
        return [*WORD.findall(lower(text or "")), None]

    def out(i):
        return zlib.crc32(str(i).encode()) % 7 == 2

    counts = Counter(t for i, text, *_ in rows if not out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, text, *_ in rows:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        want[i] = (out(i), len(ts), sum(counts[t] > 0 for t in ts), n, base)
    found = score_texts(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert score_texts(empty).count() == 0


def test_tree_is_a_distribution():
    import numpy as np

    from folioframe.llm.suffix_tree import Tree

    tree = Tree(np.arange(4, dtype=np.uint64), np.array([0.3, 0.2, 0.1, 0.1, 0.2, 0.1]))
    contexts = np.array([0, 2], np.uint64)
    tree.grow(1, contexts, np.array([0, 0, 0, 1]), np.array([1, 2, 5, 3]), np.array([90.0, 5.0, 5.0, 60.0]))
    tree.grow(2, np.array([(0 << 16) | 1, (0 << 16) | 2], np.uint64), np.array([0, 0]), np.array([3, 4]), np.array([40.0, 2.0]))
    assert len(tree.parent) == 4 and tree.parent[3] == 0
    for state in range(len(tree.parent)):
        assert math.isclose(tree.probability(np.full(6, state), np.arange(6)).sum(), 1)


def test_quality(spark, docs, rows, empty, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = labels.where("quality = 1 and toxic = 0").select("doc_id")
    found = {r.doc_id: r for r in classify_quality(docs, trusted).collect()}
    assert len(found) == len({r[0] for r in rows})
    assert found[9001].perplexity is None and found[9001].kept and found[9002].kept
    good = {r.doc_id for r in trusted.collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    mean = lambda ids: sum(math.log(found[i].perplexity) for i in ids) / len(ids)
    assert mean(bad) > mean(good)
    assert sum(found[i].kept for i in good) >= 0.95 * len(good)
    assert classify_quality(empty, trusted).count() == 0
    assert all(r.kept for r in classify_quality(docs, trusted.limit(0)).collect())


def test_quality_is_interpolated_kneser_ney(spark):
    """Seen and unseen probabilities after each context add up to 1."""
    import numpy as np

    from folioframe.llm.quality import _type_counts, kneser_ney, score_types
    from folioframe.llm.scratch import Scratch

    text = "the cat sat on the mat and the cat ran to the man " * 3 + "that hat"
    frame = spark.createDataFrame([(text, True)], "text string, t boolean")
    counts = frame.mapInArrow(_type_counts, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))
    with Scratch(spark) as scratch:
        model = kneser_ney(counts, scratch)
        for context in (b"the", b"he ", b"qqq", b"xth"):
            head = int.from_bytes(context, "big") << 8
            types = spark.range(256).select((F.col("id") + head).alias("gram"))
            total = np.exp2([r.logp for r in score_types(types, model).collect()]).sum()
            assert math.isclose(total, 1, rel_tol=1e-9)


def test_mix(docs, rows, empty):
    size = {}
    for n, (i, text, _, source) in enumerate(rows):
        size[n] = (i, len(WORD.findall(text or "")), source)
    per = Counter()
    for _, s, source in size.values():
        per[source] += s
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, target, free = 1.5 * sum(per.values()), {}, set(order)
    while True:
        rest = budget - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * per[s]}
        if not full:
            break
        target |= {s: 2.0 * per[s] for s in full}
        free -= full
    target |= {s: level * weight[s] for s in free}
    found = mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in found) == sorted((i, s) for i, s, _ in size.values())
    taken, most = Counter(), Counter()
    for r in found:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == per[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert sum(taken.values()) <= budget
    for s in order:
        assert abs(taken[s] - target[s]) <= most[s] + 1
    assert sorted(map(repr, mix(docs).collect())) == sorted(map(repr, found))
    assert mix(empty).count() == 0


def test_without(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(500)] + [(None, "y")], "doc_id long, __slot string")
    bad = spark.range(0, 500, 3).withColumnRenamed("id", "bad_id")
    kept = without(docs, bad.unionByName(bad))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1, *[i for i in range(500) if i % 3]])


def test_tree_has_no_share_cuts(spark, docs, rows):
    """Words and contexts far below a share of all tokens count, as in a plain model of the same definition."""

    def tokens(text):
        return [*WORD.findall(lower(text or "")), None]

    def out(i):
        return zlib.crc32(str(i).encode()) % 7 == 2

    learned = [tokens(text) for i, text, *_ in rows if i is not None and not out(i)]
    single = Counter(t for ts in learned for t in ts)
    scale = sum(single.values()) + len(single) + 1
    levels = []

    def chance(symbol, before):
        p = (single[symbol] + 1) / scale
        for length, kept in enumerate(levels, 1):
            c = kept.get(tuple(before[-length:])) if len(before) >= length else None
            if c:
                weight = sum(c.values()) + sum(n > 1 for n in c.values())
                p = (c[symbol] if c[symbol] > 1 else 0) / weight + len(c) / weight * p
        return p

    for length in (1, 2):
        seen = {}
        for ts in learned:
            for i in range(length, len(ts)):
                seen.setdefault(tuple(ts[i - length : i]), Counter())[ts[i]] += 1
        kept = {}
        for context, c in seen.items():
            total, often = sum(c.values()), {s: n for s, n in c.items() if n > 1}
            above = {s: chance(s, context) for s in often}
            ones = total - sum(often.values())
            gain = sum(n * math.log(n / total / above[s]) for s, n in often.items())
            gain += ones and ones * math.log(ones / total / (1 - sum(above.values())))
            if often and gain > 0.5 * (len(often) + (ones > 0)) * math.log(total):
                kept[context] = c
        levels.append(kept)
    assert min(len(x) for x in levels) > 100
    texts = {i: tokens(text) for i, text, *_ in rows}
    for r in score_texts(docs).collect():
        ts = texts[r.doc_id]
        want = sum(math.log10(chance(t, ts[max(0, i - 2) : i])) for i, t in enumerate(ts))
        assert math.isclose(r.score, want, rel_tol=1e-9), (r, want)
    filler = [(i, " ".join(f"w{(i * 37 + j * j) % 997}" for j in range(1000)), "x") for i in range(60)]
    rare = [(100 + i, "zyx abc", "x") for i in range(3)] + [(200, "zyx abc", "x")]
    frame = spark.createDataFrame(filler + rare, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in score_texts(frame, held_out=F.col("doc_id") == 200).collect()}
    assert found[200].held_out and found[200].score - found[200].base_score > 2
