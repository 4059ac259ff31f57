"""Beyond the reference: new payload files into the cache as a stream.

The reference has no streaming; a rerun there skips what its cache holds.  Here
files that arrive are read once, payloads whose key the cache has are dropped,
and the rest is appended, in batches that can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cache import CacheTable, missing


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` from JSON lines with ``eid`` and ``payload``."""
    lines = spark.readStream.schema("value string").text(path)
    v = F.try_parse_json("value")
    return lines.select(F.concat(F.lit("sid:"), F.try_variant_get(v, "$.eid", "string")).alias("key"), F.to_json(F.try_variant_get(v, "$.payload", "variant")).alias("value")).where("key IS NOT NULL AND value IS NOT NULL")


def ingest_new(spark: SparkSession, incoming: str, cache: CacheTable, checkpoint: str) -> StreamingQuery:
    """Takes in what is there now and stops."""

    def merge(batch: DataFrame, _: int) -> None:
        cache.append(missing(batch.dropDuplicates(["key"]), cache.read()))

    return payload_stream(spark, incoming).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
