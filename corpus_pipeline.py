"""Corpus pipeline: quality, near duplicates, repeated passages, test items, source mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet under the shared folder and reads again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``, whatever others there are.

Defined results of all stages: an empty table gives an empty result; texts of any length are
read whole; rows of one id with unlike texts are judged each by its own text; columns that a
stage does not name may hold anything. What each does with nulls, empty texts, ties and
repeated rows stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.decontam import decontaminate
from folioframe.llm.mixing import mix
from folioframe.llm.neardup import drop_near_duplicates
from folioframe.llm.quality import keep_quality
from folioframe.llm.queries import table, trusted_ids
from folioframe.llm.scratch import remove, shared_dir
from folioframe.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts stay, as do rows with a null id, and all rows where no document is
    trusted. A text right at a limit stays. Repeated rows get one verdict. A null language is
    a language of its own.
    """
    return keep_quality(docs, trusted_ids(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Texts right at a similarity of 0.8 are near duplicates. Null and empty texts resemble
    nothing and stay, as do rows with a null id. Of rows with equal ids and texts one stays.
    """
    return drop_near_duplicates(docs, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that stand in a document with a smaller id too go; the rest of a text stays as it is.

    Documents of which no word is left go. Null and empty texts stay, as do rows with a null
    id. Rows of one id, equal or not, take nothing from each other. ``n_chars`` follows the text.
    """
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of the shingles of a test item go.

    Null and empty texts and items hold nothing, and rows with a null id stay. Repeated rows
    get one verdict.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes.

    A null text has no words and is not taken; a null source is a source of its own, the
    last; null ids are documents like others; repeated rows count one by one; ties in the
    queue go by id, size and copy.
    """
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SQL cannot express the perplexities of stage 1, on which all that follows depends.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the whole ``documents`` table. A stage's rows go once the next has read them."""
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            remove(spark, f"{root}/{before}")
        before = name
    return docs
