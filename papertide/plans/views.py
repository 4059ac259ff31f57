"""The test tables seen as bibliographic ones, for Spark and, under the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import impact

AS_OF_YEAR = 2002
#: Rows of a partition, where a table is dealt out.
ROWS_IN_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` by key, some ROWS_IN_TASK of its ``rows`` in a partition; few rows are left to adaptive execution.

    Adaptive execution goes by compressed bytes: of narrow rows that compress
    well it packs so many into a task that the task's memory grows with the input.
    """
    many = -(-rows // ROWS_IN_TASK)
    return df.repartition(many, key) if many > df.sparkSession.sparkContext.defaultParallelism else df


def lines(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """These columns of the lines, ``eid`` among them, dealt out by it; the rows are counted from the files' footers."""
    line = table(spark, sf_dir, "lineitem")
    return dealt(line.select(F.col("l_orderkey").alias("eid"), *columns), "eid", line.count())


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("eid"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("citedby_count"))
    return impact(rows, AS_OF_YEAR)


def subfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types of an order are its labels, each once."""
    line = table(spark, sf_dir, "lineitem")
    typed = line.select(F.col("l_orderkey").alias("eid"), F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("subfield")), "p_partkey")
    labels = dealt(typed.select("eid", "subfield"), "eid", line.count()).distinct()
    return papers(spark, sf_dir).join(labels, "eid").select("eid", "year", "citedby_count", "citations_per_year", "subfield")


def keyworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of an order, the words of its part's name as keywords."""
    line = lines(spark, sf_dir, F.col("l_partkey").alias("p_partkey"))
    words = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_brand"), " ").alias("author_keywords"))
    return papers(spark, sf_dir).join(line, "eid").join(words, "p_partkey").select("eid", "year", "citedby_count", "author_keywords")


def authors(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    o = table(spark, sf_dir, "orders").where(where).select(F.col("o_orderkey").alias("eid"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("citedby_count"))
    line = lines(spark, sf_dir, F.col("l_suppkey").alias("auid"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("auid"), F.col("s_name").alias("name"))
    return o.join(line, "eid").join(names, "auid").select("eid", "year", "auid", "name", "citedby_count")



def affils(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lines(spark, sf_dir, F.col("l_suppkey").alias("s_suppkey"))
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("s_suppkey", F.col("n_nationkey").alias("afid"), F.col("n_name").alias("name"), F.col("r_name").alias("country"))
    return papers(spark, sf_dir).select("eid", "year", "citedby_count").join(line, "eid").join(places, "s_suppkey").select("eid", "year", "afid", "name", "country", "citedby_count")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as nullable marks."""
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = x.select("doc_id", (F.col("quality") == 1).alias("external_validation"), (F.col("toxic") == 1).alias("code_available"), (F.col("quality") == 1).alias("is_ai_relevant"))
    return d.select("doc_id", (1995 + F.col("doc_id") % 7).cast("int").alias("year"), F.when(F.col("lang") == "en", "multi_center").otherwise("unknown").alias("data_regime"), "lang", "source").join(marks, "doc_id", "left")


SQL = {
    "papers_v": """SELECT o_orderkey AS eid, 'Order ' || o_orderkey AS title, year(o_orderdate)::INT AS year, floor(o_totalprice / 1000)::BIGINT AS citedby_count,
        greatest(1, 2002 - year(o_orderdate) + 1)::INT AS years_since_pub, floor(o_totalprice / 1000)::BIGINT / greatest(1, 2002 - year(o_orderdate) + 1)::DOUBLE AS citations_per_year FROM orders""",
    "subfields_v": "SELECT eid, year, citedby_count, citations_per_year, subfield FROM papers_v JOIN (SELECT DISTINCT l_orderkey AS eid, p_type AS subfield FROM lineitem JOIN part ON l_partkey = p_partkey) USING (eid)",
    "keywords_v": "SELECT eid, year, citedby_count, unnest(string_split(p_name || ' ' || p_brand, ' ')) AS raw FROM papers_v JOIN lineitem ON l_orderkey = eid JOIN part ON l_partkey = p_partkey",
    "terms_v": "SELECT eid, year, citedby_count, lower(trim(raw)) AS term FROM keywords_v WHERE length(trim(raw)) > 1",
    "authors_v": "SELECT eid, year, citedby_count, l_suppkey AS auid, s_name AS name FROM papers_v JOIN lineitem ON l_orderkey = eid JOIN supplier ON l_suppkey = s_suppkey",
    "affils_v": "SELECT eid, year, citedby_count, n_nationkey AS afid, n_name AS name, r_name AS country FROM papers_v JOIN lineitem ON l_orderkey = eid JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "annotated_v": "SELECT d.doc_id, (1995 + d.doc_id % 7)::INT AS year, CASE WHEN lang = 'en' THEN 'multi_center' ELSE 'unknown' END AS data_regime, lang, source, quality = 1 AS external_validation, toxic = 1 AS code_available, quality = 1 AS is_ai_relevant FROM documents d LEFT JOIN labels USING (doc_id)",
    "counts_v": "SELECT year, subfield, count(*)::BIGINT AS n FROM subfields_v GROUP BY ALL",
    "mid_v": "SELECT list_sort(list(DISTINCT year)) AS ys, ys[len(ys) // 2 + 1] AS mid, ys[1] AS y0, ys[-1] AS y1 FROM counts_v",
}


def sql(body: str) -> str:
    """``body`` with the views it names, and those they name, before it."""
    wanted, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name in text and name not in wanted:
                wanted.add(name)
                todo.append(SQL[name])
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in SQL if n in wanted)
    return f"WITH {ctes}\n{body}" if ctes else body
