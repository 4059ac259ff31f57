"""URL filter lists (operator 3), in DataFrame operations only.

A URL is expanded into expressions: every suffix of its host's labels with
every prefix of its path that ends in a slash.  Rules are kept under their host
and their path up to its last slash.  Both sides are hashed; they meet in an
equi-join on the first eight hex digits, then the full digests and the rest of
the rule's path are confirmed, and precedence picks one rule for each URL.
Expansion stops at the most labels and slashes that any rule has, which loses
no match and bounds the rows made from very long URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_ascii, table

#: The lists of the registered query: action, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
PREFIX_DIGITS = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(action, host, path)``; hosts in lower case, paths begin with a slash."""
    rows = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules)) if rules else F.expr("array()").cast("array<struct<action:string,host:string,path:string>>")
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def url_host(url: Column) -> Column:
    return fold_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, most_labels: int, most_slashes: int) -> Column:
    """Host suffixes of at most so many labels, each with path prefixes of at most so many slashes."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    n, slashes = F.size(labels), F.least(F.size(parts) - 1, F.lit(most_slashes))
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    paths = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), slashes), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains where the path starts with the
    rule's.  The longest rule wins; of equally long ones that with the longer
    host, then a blocking one.  Null URLs and those without ``://`` have empty
    host and path and, like all that no rule fits, a null rule and the default
    verdict.  Repeated rows and null ids are judged row by row.
    """
    size = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.size(F.split("path", "/")) - 1)).first()
    labels, slashes = size[0] or 1, size[1] or 0
    known = rules.select(
        "action",
        F.concat("host", "path").alias("rule"),
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.sha2(F.concat("host", F.regexp_extract("path", "^(?s:.*)/", 0)), 256).alias("rule_digest"),
    ).withColumn("short", F.left("rule_digest", F.lit(PREFIX_DIGITS)))
    parts = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    spread = parts.withColumn("expression", F.explode_outer(_expressions(F.col("host"), F.col("path"), labels, slashes)))
    spread = spread.withColumn("digest", F.sha2("expression", 256)).drop("expression").withColumn("short", F.left("digest", F.lit(PREFIX_DIGITS)))
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path")
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), (F.col("action") == "block").alias("c"), F.col("rule"), F.col("action")))).alias("best")
    # of one row all copies agree in id, host and path
    judged = spread.join(known, "short", "left").groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u FROM pages
), cut AS (
  SELECT r, page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM parts
), urls AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(action, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT r, h || p AS rule, action, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, action DESC) AS k
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)
"""
