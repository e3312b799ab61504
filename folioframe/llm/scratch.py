"""Shared-storage helpers: where intermediate tables go and how lineage is cut.

Every intermediate is written under the folder that the session names in
``spark.checkpoint.dir``, which driver and executors share, so a lost executor
costs a re-read and no recomputation of earlier stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from folioframe.plans.session import cut, remove, shared_dir

__all__ = ["Scratch", "cleaning", "cut", "remove", "shared_dir"]


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in the ``with`` block go as soon as it has run."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Parquet tables that live as long as the ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` written and read again; in a folder for each value of the column ``by``, if there is one."""
        path = f"{self.root}/{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_clean(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Like ``put``; the shuffle files that the writing took go at once, not when the driver collects its garbage."""
        with cleaning(self.spark):
            return self.put(df, name, by)

    def drop(self, *names: str) -> None:
        remove(self.spark, "/".join((self.root, *names)))

    def __exit__(self, *exc: object) -> None:
        remove(self.spark, self.root)
