"""Rows of one id with unlike texts, repeated rows, long texts, empty tables and clashing columns."""

import math

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from folioframe.llm.decontam import find_contamination
from folioframe.llm.embeddings import embedding_duplicates
from folioframe.llm.filters import without
from folioframe.llm.html_text import extract_pages
from folioframe.llm.langid import identify_languages
from folioframe.llm.mixing import mix
from folioframe.llm.neardup import drop_near_duplicates, near_duplicates
from folioframe.llm.quality import classify_quality
from folioframe.llm.queries import trusted_ids
from folioframe.llm.substrings import dedup_substrings, remove_repeats
from folioframe.llm.suffix_tree import score_texts
from folioframe.llm.url_filter import host_rule, judge_urls, pattern_rule


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.fixture(scope="module")
def twice(spark):
    """Id 5 with three texts: a part of document 1, one of its own that is as long, and that again."""
    rows = [(1, words("a", 120)), (5, words("a", 60) + " " + words("t", 3)), (5, words("b", 63)), (5, words("b", 63)), (7, words("b", 55) + " end"), (None, words("a", 120)), (8, None), (8, "")]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, __mark string, spans int, `n.chars` string")


def test_substrings_of_one_id(twice):
    found = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in dedup_substrings(twice).collect())
    assert found == [(0, 120, 0), (1, 120, 0), (5, 63, 0), (5, 63, 0), (5, 63, 60), (7, 56, 55), (8, 0, 0), (8, 0, 0)]
    kept = remove_repeats(twice)
    assert kept.columns == twice.columns
    rows = [tuple(r) for r in kept.collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in rows) == sorted(
        [(0, words("a", 120)), (1, words("a", 120)), (5, words("t", 3)), (5, words("b", 63)), (5, words("b", 63)), (7, "end"), (8, ""), (8, "")]
    )
    assert {r[2:] for r in rows} == {("x", 1, "y")}


def test_near_duplicates_of_one_id(spark):
    rows = [(3, words("a", 100)), (4, words("a", 100) + " more"), (4, words("z", 80)), (4, words("z", 80)), (6, words("z", 80) + " more"), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    for _ in range(2):
        found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=2).collect())
        assert found == [(3, 99, 3, True), (4, 79, 4, True), (4, 79, 4, True), (4, 100, 3, False), (6, 80, 4, False), (9, 0, 9, True), (9, 0, 9, True)]
    left = drop_near_duplicates(docs, shingle=2)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(3, words("a", 100)), (4, words("z", 80)), (9, ""), (9, "")]


def test_embeddings_of_one_id(spark):
    far, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.05]
    rows = [(1, far), (1, near), (2, near), (3, near), (4, [1.0, 0.1, 0.0]), (None, far), (5, None)]
    found = embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found.collect()) == [
        (0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False), (5, 0, 5, True),
    ]


def test_contamination_of_one_id(spark):
    item = words("q", 20)
    docs = spark.createDataFrame([(1, words("q", 11)), (1, " ".join(item.split()[11:]) + " x"), (2, "a " + item), (2, "other"), (2, "a " + item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item, 0)], "item_id long, text string, doc_id int")
    assert [tuple(r) for r in find_contamination(docs, items).collect()] == [(2, 1, 16, 16)]


def test_scores_of_one_id(spark, sf):
    base = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(20).collect()]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(base)] + [(1, base[0]), (1, "rare"), (1, base[0])], "doc_id long, text string")
    alone = {len(r.text.split()): r.doc_id for r in docs.where("doc_id = 100").collect()}
    found = [r for r in score_texts(docs, held_out=F.col("doc_id") == 1).collect()]
    first = next(r for r in found if r.doc_id == 100)
    again = sorted((r.n_tokens, r.score) for r in found if r.doc_id == 1)
    assert alone and again[0][0] == 2 and [n for n, _ in again[1:]] == [first.n_tokens] * 2
    assert all(math.isclose(s, first.score, rel_tol=1e-9) for _, s in again[1:])
    judged = classify_quality(docs.withColumn("lang", F.lit(None).cast("string")), spark.createDataFrame([(100 + i,) for i in range(20)], "t long")).collect()
    same = {(r.n_bytes, r.perplexity) for r in judged if r.doc_id in (1, 100) and r.n_bytes > 4}
    assert len(same) == 1 and len(judged) == 23


def test_without_tells_texts_apart(spark):
    docs = spark.createDataFrame([(1, "a", "k"), (1, "b", "l"), (2, "a", "m")], "doc_id long, text string, __id string")
    from folioframe.llm.filters import text_mark

    bad = docs.where("doc_id = 1 and text = 'a'").select(F.col("doc_id").alias("bad_id"), text_mark(F.col("text")).alias("bad_text"))
    assert sorted(map(tuple, without(docs, bad, "doc_id", "text").collect())) == [(1, "b", "l"), (2, "a", "m")]


def test_long_texts(spark, sf):
    """Texts of a megabyte, one of them a copy of another but for its ends, among all others."""
    base = " ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").orderBy("doc_id").collect())
    body = (base * (1 + 1_000_000 // len(base)))[:1_000_000]
    body = " ".join(f"{w}{i}" if i % 50 == 0 else w for i, w in enumerate(body.split()))
    docs = spark.createDataFrame([(1, body, "en"), (2, "start " + body + " stop", "en"), (3, base[:3000], "de")], "doc_id long, text string, lang string")
    n = len(body.split())
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(docs).collect()}
    assert removed[1] == (n, 0) and removed[2] == (n + 2, n)
    near = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    items = spark.createDataFrame([(1, " ".join(body.split()[-30:]))], "item_id long, text string")
    assert sorted(r.doc_id for r in find_contamination(docs, items).collect()) == [1, 2]
    scores = {r.doc_id: r for r in score_texts(docs).collect()}
    assert scores[2].n_tokens == n + 3 and all(math.isfinite(r.score) for r in scores.values())
    judged = {r.doc_id: r for r in classify_quality(docs, docs.select("doc_id")).collect()}
    assert judged[1].n_bytes == len(body.encode()) and 1 < judged[1].perplexity < 256
    assert all(r.lang_pred in ("en", "de") for r in identify_languages(docs).collect())
    assert {r.doc_id: r.size for r in mix(docs.withColumn("source", F.lit("s"))).collect()}[1] == n


def test_rules_of_one_id(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x/9.html", "z"), (1, None, "z"), (None, "http://m.a.com/" + "y/" * 5000, "z")], "page_id long, url string, best string")
    patterns = [pattern_rule("block", "numbers", r"/[0-9]+\.html$", ("org",)), pattern_rule("block", "any com", r"\.com/", ("com",))]
    found = [(r.page_id or 0, r.rule, r.verdict, r.pattern) for r in judge_urls(pages, [host_rule("allow", "com")], patterns=patterns).collect()]
    assert {(p, r, n) for p, r, _, n in found} == {(0, "com/", None), (1, None, None), (1, None, "numbers")}
    assert {(p, v) for p, _, v, _ in found} == {(0, "allow"), (1, "allow"), (1, "block")}
    shown = extract_pages(spark.createDataFrame([(1, "<p>a"), (1, "<p>b")], "page_id long, html string")).collect()
    assert sorted(r.text for r in shown) == ["a", "b"]


def test_stages_on_odd_tables(spark, sf):
    """Repeated rows, nulls in every column, extra columns with clashing names, and an empty table through all stages."""
    base = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, base.first().text, None, None, 3), (70000, None, "en", "s", 0), (70001, "", None, None, None)], base.schema)
    docs = base.unionByName(base.limit(3)).unionByName(odd)
    for name in ("__id", "row", "mark", "node", "spans", "bad_id"):
        docs = docs.withColumn(name, F.lit(name))
    assert trusted_ids(spark, sf).count()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r["__id"] == "__id" and r["row"] == "row" and r["bad_id"] == "bad_id" for r in rows)
        kept = spark.createDataFrame(rows, docs.schema)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 70000 in ids and 70001 in ids
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert mix(kept).count() == len(ids)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
