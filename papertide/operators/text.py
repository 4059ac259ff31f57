"""Tokens and class-based TF-IDF.

The English stop words are those of Spark's ``StopWordsRemover``; other lists
differ in some words, and so do the terms then found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, stored

#: Letters, digits and underscores, two at least.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Words and bigrams that one task counts.
TERMS_IN_TASK = 2_000_000


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    stop_words = english_stop_words() if stop_words is None else stop_words
    return F.filter(found, lambda t: ~t.isin(stop_words)) if stop_words else found


def with_bigrams(words: Column) -> Column:
    """The words and their neighbours joined by a space; fewer than two words have no bigram."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def _words(docs: DataFrame, cluster_col: str, order_col: str, text_col: str, stop_words: list[str] | None) -> DataFrame:
    words = tokens(F.coalesce(F.col(text_col), F.lit("")), stop_words)
    return docs.where(F.col(cluster_col).isNotNull()).select(F.col(cluster_col).alias("cluster"), F.col(order_col).alias("ord"), words.alias("words")).where(F.size("words") > 0)


def cluster_terms(docs: DataFrame, cluster_col: str, order_col: str, text_col: str, stop_words: list[str] | None = None) -> DataFrame:
    """``(cluster, term, tf)``, stored, of all words and bigrams of a cluster's texts put together in order.

    Bigrams also join the last word of one text to the first of the next that
    has any.  Texts are never concatenated: a text's own words and bigrams are
    counted where it is, and only its first and last word meet its neighbours'.
    """
    ends = _ends(docs, cluster_col, order_col, text_col, stop_words)
    words = ends.agg(F.sum("n")).first()[0] or 0
    inner = _words(docs, cluster_col, order_col, text_col, stop_words).select("cluster", F.explode(with_bigrams(F.col("words"))).alias("term"))
    with _in_parts(docs.sparkSession, -(-2 * words // TERMS_IN_TASK)):
        tf = stored(inner.unionByName(_across(ends)).groupBy("cluster", "term").agg(F.count("*").alias("tf")))
    discard(ends)
    return tf


@contextmanager
def _in_parts(spark: SparkSession, least: int) -> Iterator[None]:
    """What is run inside shuffles to ``least`` partitions at least.

    Adaptive execution goes by compressed bytes, and a fixed number of
    partitions grows with the input: both let a task's memory grow.
    """
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in names}
    if least > spark.sparkContext.defaultParallelism:
        spark.conf.set(names[0], str(max(least, int(before[names[0]]))))
        spark.conf.set(names[1], "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _ends(docs: DataFrame, cluster_col: str, order_col: str, text_col: str, stop_words: list[str] | None) -> DataFrame:
    """The first and last word of each text and how many it has, stored by ranges."""
    each = _words(docs, cluster_col, order_col, text_col, stop_words)
    ends = each.select("cluster", "ord", F.element_at("words", 1).alias("first"), F.element_at("words", -1).alias("last"), F.size("words").cast("bigint").alias("n"))
    return ranged(ends, "cluster", "ord", "first", "last")


def _across(ends: DataFrame) -> DataFrame:
    before = with_previous(ends, "cluster", "last", "ord", "first", "last")
    return before.where("prev IS NOT NULL").select("cluster", F.concat_ws(" ", "prev", "first").alias("term"))


def seams(docs: DataFrame, cluster_col: str, order_col: str, text_col: str, stop_words: list[str] | None = None) -> DataFrame:
    """``(cluster, term)``: the bigrams that lie across two texts, one for each text with a word but a cluster's first.

    The order may be of any type that sorts, text ids as well as numbers.
    """
    return _across(_ends(docs, cluster_col, order_col, text_col, stop_words))


def ranged(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df``, stored by ranges of key and order: ``bucket`` numbers them in that order, so that a key of very many rows has many."""
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = stored(df)  # ranges are found by a pass of their own
    out = stored(once.repartitionByRange(many, key, *order).withColumn("bucket", F.spark_partition_id()))
    discard(once)
    return out


def with_previous(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``prev``: the value of the row before within the key; of each bucket of ``ranged`` only the last row crosses over."""
    in_bucket = W.partitionBy(key, "bucket").orderBy(*order)
    lasts = rows.groupBy(key, "bucket").agg(F.max_by(value, F.struct(*order)).alias("its_last"))
    carried = lasts.select(key, "bucket", F.lag("its_last").over(W.partitionBy(key).orderBy("bucket")).alias("carried"))
    inside = rows.withColumn("inside", F.lag(value).over(in_bucket)).withColumn("opens", F.row_number().over(in_bucket) == 1)
    return inside.join(carried, [key, "bucket"]).withColumn("prev", F.when(F.col("opens"), F.col("carried")).otherwise(F.col("inside"))).drop("bucket", "inside", "opens", "carried")


def ctfidf(docs: DataFrame, cluster_col: str = "cluster", order_col: str = "eid", text_col: str = "doc", top_n: int | None = 12, stop_words: list[str] | None = None) -> DataFrame:
    """``(cluster, term, score, rank)``: term frequency in the cluster times ln(1 + clusters / clusters with the term).

    The noise cluster -1 counts as a cluster.  Ties by term.  ``top_n`` None
    gives all terms without a rank.
    """
    tf = cluster_terms(docs, cluster_col, order_col, text_col, stop_words)
    # how many terms of a cluster have each frequency: a row for some hundreds of them at most
    levels = stored(tf.groupBy("cluster", "tf").agg(F.count("*").alias("many")))
    totals = levels.groupBy("cluster").agg(F.sum(F.col("tf") * F.col("many")).alias("in_cluster"))
    n = totals.agg(F.count("*")).scalar()
    score = (F.col("tf") / F.col("in_cluster") * F.log(1 + F.col("n") / F.col("df"))).alias("score")
    if top_n is None:
        scored = tf.withColumn("df", F.count("*").over(W.partitionBy("term"))).join(totals, "cluster").withColumn("n", n)
        return scored.select("cluster", "term", score)
    # the top_n most frequent terms score ln(2) for each use at least, no term more than ln(1 + n): a rarer one than that tells cannot be among the best
    above = levels.withColumn("above", F.sum("many").over(W.partitionBy("cluster").orderBy(F.desc("tf"))))
    bound = above.groupBy("cluster").agg(F.max(F.when(F.col("above") >= top_n, F.col("tf"))).alias("frequent")).join(totals, "cluster").withColumn("n", n)
    able = F.col("frequent").isNull() | (F.col("tf") * F.log(1 + F.col("n")) >= F.col("frequent") * (math.log(2) - 1e-9))
    likely = stored(tf.join(bound, "cluster").where(able).select("cluster", "term", "tf", "in_cluster", "n"))
    found = tf.join(likely.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    scored = likely.join(found, "term").select("cluster", "term", score)
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_n)
