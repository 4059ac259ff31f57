"""The jobs as registered queries: each runs twice into one new folder and returns all that then is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.config import TAXONOMY
from papertide.plans.views import AS_OF_YEAR, sql
from papertide.storage import shared_dir

from . import label_corpus, trend_report


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_label_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents, and the counts of each language and label."""
    output = _folder(spark, "job1")
    for _ in range(2):
        # a stream of a single file wants a pattern
        label_corpus.run(spark, f"{sf_dir}/document[s].parquet", output)
    none = lambda kind: F.lit(None).cast(kind)
    documents = label_corpus.read_documents(spark, output).select(F.lit("document").alias("section"), "doc_id", "lang", "source", F.array_join("labels", "|").alias("label"), none("long").alias("n_docs"), "n_words", "text_hash")
    counts = label_corpus.label_counts(spark, output).select(F.lit("count").alias("section"), none("long").alias("doc_id"), "lang", none("string").alias("source"), "label", "n_docs", "n_words", none("string").alias("text_hash"))
    return documents.unionByName(counts)


_hit = lambda seeds: " OR ".join(f"contains(lower(text), '{s}')" for s in seeds)
_labels = ", ".join(f"CASE WHEN {_hit(seeds)} THEN '{label}' END" for label, seeds in TAXONOMY.items())
LABELS = rf"""WITH labelled AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, sha256(text) AS text_hash,
    list_sort(list_filter([{_labels}], lambda x: x IS NOT NULL)) AS labels FROM documents
)
SELECT 'document' AS section, doc_id, lang, source, array_to_string(labels, '|') AS label, NULL::BIGINT AS n_docs, n_words, text_hash FROM labelled
UNION ALL SELECT 'count', NULL, lang, NULL, label, count(*)::BIGINT, sum(n_words)::BIGINT, NULL
FROM (SELECT lang, n_words, unnest(CASE WHEN len(labels) > 0 THEN labels ELSE ['{label_corpus.UNLABELLED}'] END) AS label FROM labelled) GROUP BY lang, label"""


#: Where the test tables have what the report asks for.
TEST_TABLES = {
    "as_of_year": AS_OF_YEAR,
    "top_cited": 3,
    "tables": {
        "papers": [{"path": "orders.parquet", "columns": {"eid": "o_orderkey", "title": "concat('Order ', o_orderkey)", "year": "year(o_orderdate)", "citedby_count": "cast(floor(o_totalprice / 1000) AS bigint)"}}],
        "keywords": [{"path": "lineitem.parquet", "columns": {"eid": "l_orderkey", "part": "l_partkey"}}, {"path": "part.parquet", "on": ["part"], "columns": {"part": "p_partkey", "author_keywords": "split(concat_ws(' ', p_name, p_brand), ' ')"}}],
        "labels": [{"path": "lineitem.parquet", "columns": {"eid": "l_orderkey", "part": "l_partkey"}}, {"path": "part.parquet", "on": ["part"], "columns": {"part": "p_partkey", "subfield": "p_type"}}],
        "affiliations": [
            {"path": "lineitem.parquet", "columns": {"eid": "l_orderkey", "supplier": "l_suppkey"}},
            {"path": "supplier.parquet", "on": ["supplier"], "columns": {"supplier": "s_suppkey", "nation": "s_nationkey"}},
            {"path": "nation.parquet", "on": ["nation"], "columns": {"nation": "n_nationkey", "region": "n_regionkey"}},
            {"path": "region.parquet", "on": ["region"], "columns": {"region": "r_regionkey", "country": "r_name"}},
        ],
    },
}


def job2_trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "job2")
    for _ in range(2):
        trend_report.run(spark, sf_dir, output, TEST_TABLES)
    return trend_report.read_report(spark, output)


def _long(report: str, measures: dict[str, str], wide: str) -> str:
    return " UNION ALL ".join(f"SELECT item, '{m}' AS measure, ({e})::DOUBLE AS value, '{report}' AS report, year::INT AS year FROM ({wide}) WHERE ({e}) IS NOT NULL" for m, e in measures.items())


TRENDS = sql(
    " UNION ALL ".join(
        [
            _long("volume", {"n_papers": "n", "total_citations": "t", "mean_citations": "t / n::DOUBLE"}, "SELECT 'all papers' AS item, year, count(eid) AS n, sum(citedby_count) AS t FROM papers_v GROUP BY year"),
            _long(
                "subfields",
                {"n_papers": "coalesce(n, 0)", "share": "coalesce(n, 0) / every::DOUBLE", "mean_citations": "mean"},
                """SELECT subfield AS item, year, n, every, mean FROM (SELECT year, count(*) AS every FROM papers_v GROUP BY year) CROSS JOIN (SELECT DISTINCT subfield FROM subfields_v)
                LEFT JOIN (SELECT year, subfield, count(*) AS n, avg(citedby_count) AS mean FROM subfields_v GROUP BY ALL) USING (year, subfield)""",
            ),
            _long("countries", {"n_papers": "n"}, "SELECT country AS item, year, count(DISTINCT eid) AS n FROM affils_v GROUP BY country, year"),
            _long("keywords", {"n_uses": "n", "total_citations": "t"}, "SELECT term AS item, year, count(*) AS n, sum(citedby_count) AS t FROM terms_v GROUP BY term, year"),
            _long("top_cited", {"citedby_count": "citedby_count", "citations_per_year": "citations_per_year"}, "SELECT title AS item, year, citedby_count, citations_per_year FROM papers_v QUALIFY row_number() OVER (PARTITION BY year ORDER BY citedby_count DESC, eid) <= 3"),
        ]
    )
)

QUERIES = {"job1_label_corpus": job1_label_corpus, "job2_trend_report": job2_trend_report}
SQL = {"job1_label_corpus": LABELS, "job2_trend_report": TRENDS}
