"""Every PDF query against its SQL over the seed tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from folioframe.functions.cos import Name, Ref
from folioframe.functions.writing import write_file
from folioframe.operators import compression, security, text, writers
from folioframe.plans import queries as plans
from folioframe.sources import corpus, pdf
from folioframe.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, sf, duck, name):
    got = plans.queries()[name](spark, sf)
    want = duck.sql(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(columns).collect()]
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_keys_in_sql(spark, sf):
    import hashlib

    for r in plans.key_derivation_md5(spark, sf).limit(20).collect():
        word = b"user%d" % r.c_custkey
        owner = hashlib.sha256(word).digest()
        assert r.key_40 == security.file_key(word, owner, -44, b"0123456789abcdef", 2, 5).hex()
        assert r.key_128 == security.file_key(word, owner, -44, b"0123456789abcdef", 3, 16).hex()


def test_awkward_files(spark):
    """Empty, null, foreign and page-less files give no rows or a report, never an error."""
    bare = write_file({Ref(1, 0): {"Type": Name("Catalog")}}, {"Root": Ref(1, 0)})
    rows = [("a", None), ("b", b""), ("c", b"plain text"), ("d", bare), ("e", bare[:40])]
    files = spark.createDataFrame(rows, "file_id string, content binary")
    assert {r.file_id for r in pdf.objects(files).collect()} == {"d"}
    for table in (pdf.pages, pdf.text_chunk_table, pdf.outlines, pdf.form_fields, pdf.xfa_packets, pdf.instruction_table, pdf.font_table):
        assert table(files).count() == 0
        assert table(files.limit(0)).count() == 0
    report = {r.file_id: r for r in pdf.recovery(files).collect()}
    assert set(report) == {"b", "c", "d", "e"} and report["d"].strict_ok and not report["c"].strict_ok
    assert pdf.xref_sections(files, lenient=True).count() >= 2


def test_two_columns(spark):
    rows = [(1, 0, i, f"l{i}", 50.0, 700.0 - 12 * i, 10.0, "F") for i in range(5)] + [(1, 0, 5 + i, f"r{i}", 300.0, 700.0 - 12 * i, 10.0, "F") for i in range(5)]
    rows += [(1, 0, 20, "far", 50.0, 500.0, 10.0, "F")]
    chunks = spark.createDataFrame(rows, "file_id long, page_index int, seq int, text string, x double, y double, font_size double, font_res string")
    assert [(r.column_index, r.n_chunks) for r in text.columns(chunks).orderBy("column_index").collect()] == [(0, 6), (1, 5)]
    assert text.layout_text(chunks).first().text == "l0\nl1\nl2\nl3\nl4\n\nfar\nr0\nr1\nr2\nr3\nr4"
    assert text.page_text(chunks).first().text.startswith("l0 r0\nl1 r1")


def test_compression_keeps_text(spark, sf):
    files = corpus.documents(spark, sf).limit(30).cache()
    small = compression.compress(files, compression.Options.preset("extreme"))
    key = ["file_id", "page_index", "seq", "text"]
    before, after = (sorted(map(tuple, pdf.text_chunk_table(f).select(key).collect())) for f in (files, small))
    assert before and before == after
    assert compression.report(files, small).agg(F.avg("reduction_pct")).first()[0] > 0


def test_overlay(spark, sf):
    files = corpus.documents(spark, sf).limit(5).cache()
    stamps = files.select("file_id", F.col("content").alias("stamp"))
    drawn = writers.overlay(files, stamps, "footer")
    ops = pdf.instruction_table(drawn).where("op = 'Do'").groupBy("file_id").count().collect()
    pages = {r.file_id: r["count"] for r in pdf.pages(files).groupBy("file_id").count().collect()}
    assert {r.file_id: r["count"] for r in ops} == pages


def test_decrypt(spark):
    key = b"k" * 16
    by_rc4 = security.rc4(security.object_key(key, 7, 0), b"secret")
    rows = [("a", 7, 0, by_rc4), ("b", 7, 0, b"open")]
    objects = spark.createDataFrame(rows, "file_id string, obj_num long, gen int, raw binary")
    salted = security.object_key(key, 7, 0, aes=True)
    aes = spark.createDataFrame([("c", 7, 0, b"aes text", salted)], "file_id string, obj_num long, gen int, raw binary, k binary")
    aes = aes.withColumn("raw", F.aes_encrypt("raw", "k", F.lit("CBC"), F.lit("PKCS"))).drop("k")
    keys = spark.createDataFrame([("a", key, "V2"), ("c", key, "AESV2")], "file_id string, key binary, method string")
    found = {r.file_id: bytes(r.raw) for r in security.decrypt_streams(objects.unionByName(aes), keys).collect()}
    assert found == {"a": b"secret", "b": b"open", "c": b"aes text"}


def test_files_and_stream(spark, sf, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for r in corpus.documents(spark, sf).limit(4).collect():
        (inbox / f"{r.file_id}.pdf").write_bytes(r.content)
    batch = pdf.pages(pdf.read_files(spark, str(inbox))).count()
    target = str(tmp_path / "pages")
    query = ingest.ingest(ingest.stream_files(spark, str(inbox)), pdf.pages, target, str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(target).count() == batch >= 4


def test_page_tree_has_no_row_limit(spark, sf):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        assert __spark_entry__.queries()["page_tree_recursive"](spark, sf).count() > 100
    finally:
        spark.conf.set(key, before)


def test_large_files_are_reported(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 short")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 " + b"x" * 1000)
    files = pdf.read_files(spark, str(tmp_path), most_bytes=100)
    assert sorted((r.length, r.content is None) for r in files.collect()) == [(14, False), (1009, True)]
    found = {r.file_id.rsplit("/", 1)[1]: r.warnings for r in pdf.recovery(files).collect()}
    assert found["b.pdf"] == ["larger than the limit"] and found["a.pdf"] != found["b.pdf"] and len(found) == 2
