"""A key-value cache as an append-only table: the last write of a key wins."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CACHE


def latest(cache: DataFrame) -> DataFrame:
    """Each key's last value; of equal times the larger value."""
    return cache.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("last")).select("key", "last.value", "last.ts")


def missing(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``wanted`` whose key the cache lacks."""
    return wanted.join(cache.select(F.col("key").alias(key)), key, "left_anti")


def present(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(cache.select(F.col("key").alias(key)), key, "left_semi")


class CacheTable:
    """The cache at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return latest(self.spark.read.schema(CACHE).parquet(self.path))
        except Exception as e:  # the table begins with the first append
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], CACHE)

    def append(self, rows: DataFrame) -> None:
        """``rows(key, value)``, stamped now."""
        rows.select("key", "value", F.lit(time.time()).alias("ts")).write.mode("append").parquet(self.path)

    def keys(self) -> DataFrame:
        return self.read().select("key")

    def __len__(self) -> int:
        return self.read().count()
