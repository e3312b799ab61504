"""The quality model learns from every trusted document of its half, however many there are."""

from pyspark.sql import functions as F

from folioframe.llm.quality import classify_quality


def test_all_trusted_documents_train(spark):
    order = F.xxhash64(F.col("id"), F.lit(5))
    half = [r.id for r in spark.range(42_000).where(F.pmod(order, F.lit(2)) == 0).orderBy(order, "id").collect()]
    assert len(half) > 20_500
    late = set(half[20_000:])
    docs = [(i, "zqxj vwkp " * 3 if i in late else "some words", "en") for i in range(42_000)] + [(50_000, "zqxj vwkp " * 3, "en")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in classify_quality(docs, docs.where("doc_id < 42000").select("doc_id")).where("doc_id >= 42000").collect()}
    assert found[50_000].surprise < 0.1
