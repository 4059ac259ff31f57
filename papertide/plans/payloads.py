"""Queries over payloads made from the test tables: nested JSON in, tidy rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import exploded
from ..functions.variant import coerced, salvaged
from ..operators import cache, candidates, ingest, taxonomy, text
from ..schemas import ANNOTATION
from ..storage import stored
from . import query, views
from .views import AS_OF_YEAR


def _one_or_many(items: Column) -> Column:
    """JSON of a list, collapsed as the source does it: one element alone, none as null."""
    return F.when(F.size(items) == 0, "null").when(F.size(items) == 1, F.to_json(items[0])).otherwise(F.to_json(items))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """``(eid, payload)``: an order as a record, its suppliers as authors and their nations as affiliations; every 11th has failed."""
    o, line, s = (views.table(spark, d, n) for n in ("orders", "lineitem", "supplier"))
    n, r = views.table(spark, d, "nation"), views.table(spark, d, "region")
    who = line.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).distinct().join(s, "s_suppkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    author = F.struct(F.col("s_suppkey").cast("string").alias("@auid"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("ce:indexed-name"), F.struct(F.concat(F.lit("P. "), "s_name").alias("ce:indexed-name")).alias("preferred-name"), F.col("s_nationkey").cast("string").alias("@seq"))
    place = F.struct(F.col("n_nationkey").cast("string").alias("@id"), F.col("n_name").alias("affilname"), F.col("r_name").alias("affiliation-country"))
    # an order has a few lines
    lists = who.groupBy("o_orderkey").agg(F.array_sort(F.collect_set(author)).alias("authors"), F.array_sort(F.collect_set(place)).alias("places"))
    rows = o.join(lists, "o_orderkey", "left")
    core = F.to_json(
        F.struct(
            F.concat(F.lit("SCOPUS_ID:"), "o_orderkey").alias("dc:identifier"),
            F.concat(F.lit("Order "), "o_orderkey").alias("dc:title"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("prism:coverDate"),
            F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(".7"))).otherwise("n/a").alias("citedby-count"),
        )
    )
    none = F.array()
    body = F.concat(
        F.lit('{"abstracts-retrieval-response":{"coredata":'),
        core,
        F.lit(',"authors":{"author":'),
        _one_or_many(F.coalesce("authors", none)),
        F.lit('},"affiliation":'),
        _one_or_many(F.coalesce("places", none)),
        F.lit(',"authkeywords":{"author-keyword":[{"$":"'),
        F.col("o_orderpriority"),
        F.lit('"},"'),
        F.col("o_orderstatus"),
        F.lit('",{"$":""}]}}}'),
    )
    return rows.select(F.col("o_orderkey").cast("string").alias("eid"), F.when(F.col("o_orderkey") % 11 == 0, F.lit('{"_error":"404"}')).otherwise(body).alias("body")).select("eid", F.try_parse_json("body").alias("payload"))


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    # the filter and each field read the payload: stored, it is not written and parsed anew for each
    return ingest.normalize(ingest.parse_records(stored(payloads(spark, d))), AS_OF_YEAR)


_WHO = "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_CITES = "CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice / 1000)::BIGINT ELSE 0 END"


@query(
    "tidy_papers",
    f"""SELECT o_orderkey::VARCHAR AS eid, o_orderkey::VARCHAR AS scopus_id, 'Order ' || o_orderkey AS title, year(o_orderdate)::INT AS year, {_CITES} AS citedby_count, coalesce(a, 0)::INT AS n_authors, coalesce(p, 0)::INT AS n_affiliations,
  coalesce(c, '') AS countries, o_orderpriority || '|' || o_orderstatus AS author_keywords, greatest(1, 2002 - year(o_orderdate) + 1)::INT AS years_since_pub, ({_CITES})::DOUBLE / greatest(1, 2002 - year(o_orderdate) + 1)::DOUBLE AS citations_per_year
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS a, count(DISTINCT n_nationkey) AS p, array_to_string(list_sort(list(DISTINCT r_name)), '|') AS c FROM {_WHO} GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 0""",
)
def tidy_papers(spark: SparkSession, d: str) -> DataFrame:
    p = _tables(spark, d)["papers"]
    return p.select("eid", "scopus_id", "title", "year", "citedby_count", "n_authors", "n_affiliations", F.array_join("countries", "|").alias("countries"), F.array_join("author_keywords", "|").alias("author_keywords"), "years_since_pub", "citations_per_year")


@query(
    "tidy_authors",
    f"SELECT o_orderkey::VARCHAR AS eid, year(o_orderdate)::INT AS year, s_suppkey::VARCHAR AS auid, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 'P. ' || s_name END AS name, s_nationkey::INT AS seq, {_CITES} AS citedby_count FROM orders JOIN {_WHO} ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 0",
)
def tidy_authors(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["paper_authors"]


@query("tidy_keywords", "SELECT o_orderkey::VARCHAR AS eid, year(o_orderdate)::INT AS year, lower(trim(unnest([o_orderpriority, o_orderstatus]))) AS keyword FROM orders WHERE o_orderkey % 11 <> 0")
def tidy_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["paper_keywords"]


@query("rich_fields", "SELECT o_orderkey::VARCHAR AS eid, o_orderkey % 11 <> 0 AS ok, false AS has_abstract, o_orderkey % 11 <> 0 AS has_author_keywords, o_orderkey % 11 <> 0 AS has_affiliations, false AS has_references FROM orders")
def rich_fields(spark: SparkSession, d: str) -> DataFrame:
    return ingest.rich_fields(payloads(spark, d))


@query(
    "coerced_annotations",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS is_ai_relevant, CASE WHEN doc_id % 4 < 3 THEN lang END AS clinical_task,
  CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source || '|' || lang ELSE '' END AS ai_methods, CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars END::BIGINT AS sample_size FROM documents""",
)
def coerced_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Answers in four shapes: clean, wrapped in prose, with stray lists, and no JSON at all."""
    docs, k = views.table(spark, d, "documents"), F.col("doc_id") % 4
    q = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    clean = F.concat(F.lit('{"is_ai_relevant":true,"clinical_task":'), q("lang"), F.lit(',"ai_methods":'), q("source"), F.lit(',"sample_size":"'), F.col("n_chars").cast("string"), F.lit('.9","more":1}'))
    prose = F.concat(F.lit('Here it is: {"is_ai_relevant":" No ","clinical_task":'), q("lang"), F.lit(',"ai_methods":['), q("source"), F.lit(",null,"), q("lang"), F.lit('],"sample_size":'), F.col("n_chars").cast("string"), F.lit("}. Done."))
    stray = F.concat(F.lit('{"is_ai_relevant":["y","n"],"clinical_task":['), q("lang"), F.lit('],"ai_methods":null,"sample_size":true}'))
    raw = F.when(k == 0, clean).when(k == 1, prose).when(k == 2, stray).otherwise("I cannot say")
    out = docs.select("doc_id", *coerced(salvaged(raw), ANNOTATION))
    return out.select("doc_id", "is_ai_relevant", "clinical_task", F.array_join("ai_methods", "|").alias("ai_methods"), "sample_size")


@query("cache_latest", "SELECT user_id::VARCHAR AS key, event_type AS value, event_id::DOUBLE AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    return cache.latest(views.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").cast("double").alias("ts")))


@query("search_predicate", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 2000 AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'low') OR contains(lower(o_orderpriority), '3'))")
def search_predicate(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("abstract"), F.lit(None).cast("array<string>").alias("author_keywords"))
    return candidates.matches_search(rows, Settings(as_of_year=2000, years_back=4, search_terms=("URGENT", "low", "3"))).select("o_orderkey")


@query("token_counts", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))::INT AS n_tokens, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda x: NOT list_contains(['the', 'and', 'of'], x)))::INT AS n_kept FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"), [])).alias("n_tokens"), F.size(text.tokens(F.col("text"), ["the", "and", "of"])).alias("n_kept"))


@query("long_table", "SELECT doc_id, lang, unnest(string_split(lang || '|' || source, '|')) AS label FROM documents WHERE doc_id % 5 <> 0")
def long_table(spark: SparkSession, d: str) -> DataFrame:
    """Exploding lists: null and empty ones give no rows, nor do null elements."""
    docs = views.table(spark, d, "documents")
    lists = F.when(F.col("doc_id") % 5 != 0, F.array("lang", "source", F.lit(None).cast("string"))).when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>"))
    return exploded(docs.withColumn("labels", lists), "labels", "label", "doc_id", "lang")


@query("canonical_labels", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Image segmentation' ELSE '' END AS labels FROM documents")
def canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.when(F.col("lang") == "en", "image SEGMENTATION").otherwise("unheard of"))
    return views.table(spark, d, "documents").select("doc_id", F.array_join(taxonomy.canonical(raw), "|").alias("labels"))
