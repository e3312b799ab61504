"""Quality, language and decontamination against plain versions of their definitions; recall of searches."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from folioframe.llm.decontam import FOUND, find_contamination, least_bits, most_asked
from folioframe.llm.langid import BUCKETS, _trigrams, identify_languages
from folioframe.llm.quality import FEWEST, classify_quality, discounts
from folioframe.llm.queries import trusted_ids


def plain_kneser_ney(texts):
    """log2 P(byte | three before it), by dictionaries."""
    grams = Counter()
    for t in texts:
        padded = b"\n\n\n" + t
        grams.update(padded[i : i + 4] for i in range(len(t)))
    counts = {4: grams}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    parts = {}
    for order, seen in counts.items():
        d = discounts(*[sum(c == i for c in seen.values()) for i in (1, 2, 3, 4)])
        total, lost = Counter(), defaultdict(float)
        for g, c in seen.items():
            total[g[:-1]] += c
            lost[g[:-1]] += d[min(c, 3) - 1]
        parts[order] = seen, d, total, lost

    def p(gram):
        order = len(gram)
        below = 1 / 256 if order == 1 else p(gram[1:])
        seen, d, total, lost = parts[order]
        context, c = gram[:-1], seen.get(gram, 0)
        if not total[context]:
            return below
        return max(c - (d[min(c, 3) - 1] if c else 0), 0) / total[context] + lost[context] / total[context] * below

    return p


def test_quality_is_as_defined(spark, sf):
    """Every perplexity, surprise, limit and verdict, from plain counts of plain bytes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trusted = trusted_ids(spark, sf).distinct().withColumn("h", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(2))).collect()
    train, held = ({r.doc_id for r in trusted if r.h == h} for h in (0, 1))
    rows = {r.doc_id: r for r in docs.collect()}
    p = plain_kneser_ney([rows[i].text.encode() for i in train if i in rows and rows[i].text])
    known: dict[bytes, float] = {}
    want = {}
    for i, r in rows.items():
        data = (r.text or "").encode()
        padded = b"\n\n\n" + data
        bits = 0.0
        over = 0.0
        for k in range(len(data)):
            g = padded[k : k + 4]
            if g not in known:
                known[g] = -math.log2(p(g))
            bits += known[g]
            over += max(known[g] - 8, 0)
        want[i] = (2 ** (bits / len(data)), over / len(data), int(math.log2(len(data)) // 2)) if data else None
    found = {r.doc_id: r for r in classify_quality(docs, trusted_ids(spark, sf)).collect()}
    for i, w in want.items():
        if w:
            assert math.isclose(found[i].perplexity, w[0], rel_tol=1e-9) and math.isclose(found[i].surprise, w[1], rel_tol=1e-7, abs_tol=1e-9), i

    def limit(values):
        steps = sorted(math.floor(math.log2(v + 2**-20) * 64) for v in values)
        return 2 ** ((steps[math.ceil(len(steps) * 0.999) - 1] + 1) / 64) - 2**-20

    groups = defaultdict(list)
    for i in held:
        if i in want and want[i]:
            for key in ((), (rows[i].lang,), (rows[i].lang, want[i][2])):
                groups[key].append(found[i])
    for i, w in want.items():
        if not w:
            continue
        lang, size = (rows[i].lang,), (rows[i].lang, w[2])
        own = groups.get(lang) or groups[()]
        sized = groups[size] if len(groups.get(size, [])) >= FEWEST else own
        most = limit([x.perplexity for x in own]), limit([x.surprise for x in sized])
        assert math.isclose(found[i].threshold, most[0], rel_tol=1e-9) and math.isclose(found[i].most_surprise, most[1], rel_tol=1e-9)
        assert found[i].kept == (found[i].perplexity <= most[0] and found[i].surprise <= most[1])


def test_languages_are_as_defined(spark, sf):
    """Likelihoods by plain counts, single languages by Bayes, mixtures by a plain EM."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    two = {r.lang: r.text for r in docs.orderBy("doc_id").collect()}
    langs = sorted(two)
    more = [(9000 + k, two[a][:1500] + " " + two[b][:700], None) for k, (a, b) in enumerate([(langs[0], langs[1]), (langs[2], langs[3])])]
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([*more, (9100, "z", None)], "doc_id long, text string, lang string"))
    rows = frame.collect()

    def counts(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return _trigrams(data, np.array([0, len(data)]))[0].astype(float)

    def plain(text):
        x = "".join(c if c.isalpha() and c.isascii() else " " for c in text.lower())
        return Counter(t for t in (f" {x} "[i : i + 3] for i in range(len(x))) if t != "   ")

    ascii_text = "Some plain words, 12 of them"
    assert counts(ascii_text).sum() == sum(plain(ascii_text).values())
    table = {k: np.full(BUCKETS, 0.1) for k in langs}
    for r in rows:
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 5:
            table[r.lang] += counts(r.text)
    likelihood = np.array([table[k] / table[k].sum() for k in langs])
    found = {r.doc_id: r for r in identify_languages(frame).collect()}
    alone = 0
    for r in rows[:60] + rows[-3:]:
        x, got = counts(r.text), found[r.doc_id]
        single = np.log(likelihood) @ x
        posterior = np.exp(single - single.max())
        posterior /= posterior.sum()
        if got.score > 0.999 * posterior.max():
            alone += 1
            assert got.lang_pred == langs[int(single.argmax())]
        else:  # a mixture: its proportions are a fixed point of EM, and it beats the single language by more than its cost
            share = np.full(len(langs), 1 / len(langs))
            for _ in range(200):
                share = share * (likelihood @ (x / (share @ likelihood))) / x.sum()
            assert got.lang_pred == langs[int(share.argmax())] and abs(got.score - share.max()) < 0.1
            gain = (x * np.log(share @ likelihood)).sum() - single.max()
            assert gain > 0
    assert alone >= 50 and found[9000].score < 0.9 and found[9001].score < 0.9
    assert found[9100].lang_pred in langs and 1 / len(langs) <= found[9100].score < 1


def test_search_finds_what_the_exact_join_finds(spark):
    """Recall of the signature search at the threshold, over documents of all sizes: each shares just 80 % of an item."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [[word() for _ in range(rng.choice([9, 14, 24, 64]))] for _ in range(120)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for size in (30, 300, 3000):
            shingles = len(item) - 4
            keep = math.ceil(0.8 * shingles) + 4
            text = [word() for _ in range(size)]
            at = rng.randrange(size)
            text[at:at] = item[:keep]
            docs.append((len(docs), " ".join(text)))
            want.add((len(docs) - 1, i))
            docs.append((len(docs), " ".join([*text[:at], *item[: keep - 1], *text[at + keep :]])))
    found = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_signature_bounds():
    assert 0.78 < FOUND < 0.79
    for shared in (1, 4, 9, 40):
        asked, repeats = most_asked(shared, 1e-6)
        n = shared * repeats
        missed = sum(math.comb(n, k) * FOUND**k * (1 - FOUND) ** (n - k) for k in range(asked))
        assert missed <= 1e-6 and asked >= 1
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 200, np.uint64))
    bits = least_bits(values)
    for b in (4, 8, 12):
        bins = values >> np.uint64(64 - b)
        assert ((bits <= b) == np.append(True, bins[1:] != bins[:-1])).all()
