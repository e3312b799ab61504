"""Each pipeline stage, on all that its predecessor kept, against brute force."""

import re

import corpus_pipeline
from folioframe.llm.mixing import mix
from folioframe.llm.quality import classify_quality
from folioframe.llm.queries import trusted_ids
from tests.llm.test_text_operators import WORD, jaccard_components, lower

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut_repeats(rows):
    first, out = {}, {}
    for i, text in rows:
        w = WORD.findall(text)
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            first[key] = min(first.get(key, i), i)
    for i, text in rows:
        pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        w = [WORD.match(p)[0] for p in pieces]
        gone = {j for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for j in range(s, s + 50)}
        lead = re.match(r"[\x20\x09-\x0D]*", text)[0]
        if not gone:
            out[i] = text
        elif len(gone) < len(w):
            out[i] = lead + "".join(p for j, p in enumerate(pieces) if j not in gone)
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r.doc_id: r for r in docs.collect()}
    long = source[1].text + " " + source[2].text
    extra = [(5001, long, "en", None, len(long)), (5002, None, None, "x", None), (5003, "", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "decontamination", "source_mix"]

    kept = {r.doc_id for r in classify_quality(docs, trusted_ids(spark, sf)).collect() if r.kept}
    one = stages["quality"](spark, docs, sf)
    assert one.columns == COLUMNS
    rows = {r.doc_id: r for r in one.collect()}
    assert set(rows) == kept and len(kept) < docs.count()
    clean = {r.doc_id for r in trusted_ids(spark, sf).collect()}
    assert len(clean & kept) >= 0.97 * len(clean)

    two = stages["near_dedup"](spark, one, sf)
    assert two.columns == COLUMNS
    groups = jaccard_components([(i, r.text) for i, r in rows.items()], 5)
    rows = {r.doc_id: r for r in two.collect()}
    assert set(rows) == {i for i, _, _, head in groups if head}

    three = stages["substring_dedup"](spark, two, sf)
    assert three.columns == COLUMNS
    want = cut_repeats([(i, r.text or "") for i, r in rows.items()])
    rows = {r.doc_id: r for r in three.collect()}
    assert {i: r.text or "" for i, r in rows.items()} == want
    assert all(r.n_chars == len(r.text) for r in rows.values() if r.text)

    def shingles(text):
        w = WORD.findall(lower(text or ""))
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    four = stages["decontamination"](spark, three, sf)
    assert four.columns == COLUMNS
    bad = {i for i, r in rows.items() if any(q and 100 * len(q & shingles(r.text)) >= 80 * len(q) for q in items)}
    assert bad and {r.doc_id for r in four.collect()} == set(rows) - bad

    five = stages["source_mix"](spark, four, sf)
    assert sorted(map(repr, five.collect())) == sorted(map(repr, mix(four).collect()))


def test_run(spark, sf):
    found = corpus_pipeline.run(spark, sf).collect()
    assert found and sorted(map(repr, found)) == sorted(map(repr, corpus_pipeline.run(spark, sf).collect()))
