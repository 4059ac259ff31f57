"""Mixing sources to target weights (operator 6), in DataFrame operations only.

Efraimidis-Spirakis sampling: every document draws an exponential key divided
by its quality weight, from a hash of its id, so that reruns agree.  Whole
epochs of a source come first; what then is left of its target goes to the
documents with the smallest keys, by prefix sums within the source.  A source
may hold any share of the rows: keys are cut into buckets of about equal
probability, buckets are pre-aggregated and prefix-summed, and only then are
rows summed inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, discard, stored, table

WEIGHTS = (5, 2, 1)
#: The mix is so many halves of all sizes, and no source exceeds so many times its own.
HALVES, EPOCHS = 3, 2
#: Buckets of a source's keys: so many at least, and more where a source of all rows would have more rows in one.
BUCKETS, IN_BUCKET = 4096, 50_000
USUAL_WORD, LEAST_WEIGHT = 6.0, 0.5
SEED = "mix-1"


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size)``, one row each, to ``target``: shares by weight, capped and reshared until none is above.

    Sources by their fill level ``cap / weight``: those at the lower levels are
    capped, the rest share what is left, which is where resharing ends.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = totals.withColumn("place", F.row_number().over(by_name))
    rank = rank.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", epochs * F.col("source_size"))
    level = W.orderBy(F.col("cap") / F.col("weight"), "place")
    every = W.partitionBy()
    before = level.rowsBetween(W.unboundedPreceding, -1)
    rank = rank.withColumn("all", F.sum("source_size").over(every)).withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("heavy", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rank = rank.withColumn("capped", 2 * F.col("cap") * F.col("heavy") <= (halves * F.col("all") - 2 * F.col("caps")) * F.col("weight"))
    rank = rank.withColumn("given", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)).withColumn("sharing", F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(every))
    share = (halves * F.col("all") - 2 * F.col("given")) * F.col("weight") / (2 * F.col("sharing")).cast("double")
    return rank.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``, ``source``, ``quality``.

    Null and empty texts have size 0 and give nothing.  A null source is a
    source of its own, last in order.  The last document of a source is taken
    in part, so that taken words add up to the target's whole part.  Rows that
    agree in id and size draw the same key and are taken one after the other;
    rows without an id draw by their texts.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    long = F.col("chars") / F.when(F.col("size") > 0, F.col("size"))
    quality = F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1 / (1 + F.abs(long - USUAL_WORD) / USUAL_WORD)), F.lit(LEAST_WEIGHT))
    draw = (F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))), F.col("size").cast("string"))), F.lit(13)), 16, 10).cast("bigint") + 0.5) / 2.0**52
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("id", "source", "text", size.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    rows = rows.withColumn("quality", quality).withColumn("key", -F.log(draw) / F.col("quality"))
    rows = stored(rows.select("id", "source", "size", "quality", "key"))
    many = max(BUCKETS, rows.count() // IN_BUCKET)
    rows = rows.withColumn("bucket", F.least(F.lit(many - 1), F.floor(many * (1 - F.exp(-F.col("key") * LEAST_WEIGHT)))).cast("int"))

    buckets = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")))
    plan = stored(targets(buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, halves, epochs))
    prior = F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.withColumn("prior", prior).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "prior")
    offsets = stored(offsets.join(plan.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t"))
    discard(buckets, plan)

    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    within = W.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.withColumn("before", F.col("prior") + F.sum("size").over(within) - F.col("size"))
    budget = F.floor("target")
    epochs_done = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs_done * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before")))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (epochs_done * F.col("size") + part).cast("bigint").alias("taken"), "source", "quality")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars FROM documents
), weighed AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0.5, 1 / (1 + abs(chars / size::DOUBLE - 6.0) / 6.0)) ELSE 0.5::DOUBLE END AS quality,
         (('0x' || substr(md5('mix-1:' || doc_id || ':' || size), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM sized
), keyed AS (
  SELECT *, -ln(draw) / quality AS key FROM weighed
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM keyed GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM totals
), levels AS (
  SELECT *, sum(source_size) OVER () AS every, coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy
  FROM ranked
), capping AS (
  SELECT *, 2 * cap * heavy <= (3 * every - 2 * caps) * weight AS capped FROM levels
), shared AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS given, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS sharing FROM capping
), plan AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE ((3 * every - 2 * given) * weight)::DOUBLE / (2 * sharing)::DOUBLE END AS target FROM shared
), placed AS (
  SELECT k.*, p.source_size, p.target, floor(p.target)::BIGINT AS budget,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS done FROM placed
)
SELECT doc_id, size, source_size, target, (done * size + greatest(0, least(size, budget - done * source_size - before)))::BIGINT AS taken, source, quality
FROM epochs
"""
