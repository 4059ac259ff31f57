"""The registered queries over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import at, one_or_many, text_of, to_bool
from ..operators import annotate, cache, candidates, facts, graph, influence, taxonomy, text, trends, vectors
from ..storage import stored
from . import QUERIES, SQL, query, views
from .views import sql

TYPES = ("PROMO", "STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY")


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Sums of floating-point numbers depend on their order in the last digits, which are cut here."""
    return df.select(*(F.bround(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns))


@query("papers_per_year", sql("SELECT year, count(eid)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations, avg(citedby_count) AS mean_citations FROM papers_v GROUP BY year"))
def papers_per_year(spark: SparkSession, d: str) -> DataFrame:
    return trends.papers_per_year(views.papers(spark, d))


@query("subfield_volume_impact", sql("SELECT subfield, count(eid)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations, avg(citedby_count) AS mean_citations, round_even(avg(citations_per_year), 4) AS mean_cpy FROM subfields_v GROUP BY subfield"))
def subfield_volume_impact(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trends.hype_vs_impact(views.subfields(spark, d)), 4, "mean_cpy")


@query(
    "subfield_year_matrix",
    sql("SELECT year, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE subfield = '{t}'), 0)::BIGINT AS \"{t}\"" for t in TYPES) + " FROM counts_v GROUP BY year"),
)
def subfield_year_matrix(spark: SparkSession, d: str) -> DataFrame:
    return trends.subfield_year_matrix(views.subfields(spark, d), list(TYPES))


@query(
    "subfield_share",
    sql("SELECT year, subfield, coalesce(n / t::DOUBLE, 0) AS share FROM (SELECT DISTINCT year FROM papers_v) CROSS JOIN (SELECT DISTINCT subfield FROM counts_v) LEFT JOIN counts_v USING (year, subfield) LEFT JOIN (SELECT year, count(eid) AS t FROM papers_v GROUP BY year) USING (year)"),
)
def subfield_share(spark: SparkSession, d: str) -> DataFrame:
    return trends.subfield_share(views.subfields(spark, d), views.papers(spark, d))


@query(
    "subfield_growth",
    sql("""SELECT subfield, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE year <= mid), 0)::BIGINT AS early_count, coalesce(sum(n) FILTER (WHERE year > mid), 0)::BIGINT AS recent_count,
  (coalesce(sum(n) FILTER (WHERE year > mid), 0) - coalesce(sum(n) FILTER (WHERE year <= mid), 0))::BIGINT AS recent_minus_early,
  round_even(pow(coalesce(sum(n) FILTER (WHERE year = y1), 0)::DOUBLE / nullif(sum(n) FILTER (WHERE year = y0), 0)::DOUBLE, 1.0::DOUBLE / greatest(1, max(y1) - max(y0))) - 1, 6) AS cagr
FROM counts_v, mid_v GROUP BY subfield"""),
)
def subfield_growth(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trends.subfield_growth(views.subfields(spark, d)), 6, "cagr")


@query("term_emergence", sql("SELECT term, min(year)::INT AS first_year, max(year)::INT AS last_year, count(eid)::BIGINT AS total, sum(citedby_count)::BIGINT AS total_citations FROM terms_v GROUP BY term HAVING count(eid) >= 2"))
def term_emergence(spark: SparkSession, d: str) -> DataFrame:
    return trends.emergence(views.keyworded(spark, d))


@query(
    "term_trends",
    sql("""SELECT * FROM (SELECT *, 'rising' AS direction FROM (SELECT term, early, recent, recent - early AS delta, early + recent AS total FROM halves) ORDER BY delta DESC, term LIMIT 25)
UNION ALL SELECT * FROM (SELECT *, 'fading' AS direction FROM (SELECT term, early, recent, recent - early AS delta, early + recent AS total FROM halves) ORDER BY delta, term LIMIT 25)""".replace(
        "halves", "(SELECT term, (count(*) FILTER (WHERE year <= (SELECT ys[len(ys) // 2 + 1] FROM (SELECT list_sort(list(DISTINCT year)) AS ys FROM terms_v))))::BIGINT AS early, (count(*) FILTER (WHERE year > (SELECT ys[len(ys) // 2 + 1] FROM (SELECT list_sort(list(DISTINCT year)) AS ys FROM terms_v))))::BIGINT AS recent FROM terms_v GROUP BY term)"
    )),
)
def term_trends(spark: SparkSession, d: str) -> DataFrame:
    return trends.term_trends(views.keyworded(spark, d))


@query(
    "term_bursts",
    sql("""SELECT term, sum(n)::BIGINT AS total, arg_max(year, n * 10000 - year)::INT AS peak_year, max(n)::BIGINT AS peak_count, max(n)::DOUBLE / (sum(n)::DOUBLE / count(*)::DOUBLE) AS burst_score
FROM (SELECT term, year, count(*) AS n FROM terms_v GROUP BY ALL) GROUP BY term HAVING sum(n) >= 3"""),
)
def term_bursts(spark: SparkSession, d: str) -> DataFrame:
    return trends.burst_detection(views.keyworded(spark, d))


@query("top_cited_per_year", sql("SELECT year, title, citedby_count, citations_per_year FROM papers_v QUALIFY row_number() OVER (PARTITION BY year ORDER BY citedby_count DESC, eid) <= 3"))
def top_cited_per_year(spark: SparkSession, d: str) -> DataFrame:
    return trends.top_cited_per_year(views.papers(spark, d), 3)


@query("author_influence", sql("SELECT auid, name, count(DISTINCT eid)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations, avg(citedby_count) AS mean_citations, min(year)::INT AS first_year, max(year)::INT AS last_year FROM authors_v GROUP BY auid, name ORDER BY total_citations DESC, n_papers DESC, auid, name LIMIT 30"))
def author_influence(spark: SparkSession, d: str) -> DataFrame:
    return influence.author_influence(views.authors(spark, d))


@query("affil_influence", sql("SELECT afid, name, country, count(DISTINCT eid)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations, avg(citedby_count) AS mean_citations FROM affils_v GROUP BY afid, name, country ORDER BY n_papers DESC, total_citations DESC, afid, name, country LIMIT 30"))
def affil_influence(spark: SparkSession, d: str) -> DataFrame:
    return influence.affil_influence(views.affils(spark, d))


@query("country_trends", sql("SELECT year, country, count(DISTINCT eid)::BIGINT AS n_papers FROM affils_v GROUP BY year, country"))
def country_trends(spark: SparkSession, d: str) -> DataFrame:
    return influence.country_trends(views.affils(spark, d))


@query("subfield_by_affil", sql("SELECT name, s.subfield, count(*)::BIGINT AS n_papers FROM affils_v a JOIN subfields_v s USING (eid) GROUP BY ALL ORDER BY n_papers DESC, name, subfield LIMIT 20"))
def subfield_by_affil(spark: SparkSession, d: str) -> DataFrame:
    return influence.subfield_by_affil(views.affils(spark, d), views.subfields(spark, d))


@query("impact_by_term", sql("SELECT raw AS term, count(*)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations, round_even(avg(citedby_count), 1) AS mean_citations FROM keywords_v WHERE raw <> '' GROUP BY raw HAVING count(*) >= 2 ORDER BY total_citations DESC, term LIMIT 12"))
def impact_by_term(spark: SparkSession, d: str) -> DataFrame:
    return facts.impact_by_term(views.keyworded(spark, d), "author_keywords")


@query(
    "rigor_trend",
    sql("""SELECT year, count(*)::BIGINT AS n_papers, round_even(100 * avg(coalesce(external_validation, false)::INT), 1) AS pct_external_validation,
  round_even(100 * avg(coalesce(code_available, false)::INT), 1) AS pct_code_available, round_even(100 * avg((data_regime = 'multi_center')::INT), 1) AS pct_multi_center FROM annotated_v GROUP BY year"""),
)
def rigor_trend(spark: SparkSession, d: str) -> DataFrame:
    return facts.rigor_trend(views.annotated(spark, d))


@query(
    "yearly_brief",
    sql("""WITH sums AS (SELECT year, count(*)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations, round_even(sum(citations_per_year), 1) AS total_citations_age_adjusted FROM papers_v GROUP BY year),
tops AS (SELECT year, string_agg(subfield || ':' || n, ',' ORDER BY n DESC, subfield) AS top_subfields FROM (SELECT * FROM counts_v QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, subfield) <= 5) GROUP BY year),
best AS (SELECT year, string_agg(title || ':' || citedby_count, ',' ORDER BY citedby_count DESC, eid) AS top_cited FROM (SELECT * FROM papers_v QUALIFY row_number() OVER (PARTITION BY year ORDER BY citedby_count DESC, eid) <= 5) GROUP BY year)
SELECT * FROM sums JOIN tops USING (year) JOIN best USING (year)""").replace("\nWITH sums", ",\nsums", 1),
)
def yearly_brief(spark: SparkSession, d: str) -> DataFrame:
    out = facts.yearly_brief(views.papers(spark, d), views.subfields(spark, d))
    labels = F.array_join(F.transform(F.map_entries("top_subfields"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    best = F.array_join(F.transform("top_cited", lambda p: F.concat_ws(":", p["title"], p["citations"].cast("string"))), ",")
    return out.withColumn("top_subfields", labels).withColumn("top_cited", best)


@query("corpus_summary", sql("SELECT count(*)::BIGINT AS total_papers, sum(citedby_count)::BIGINT AS total_citations, round_even(sum(citations_per_year), 1) AS total_citations_age_adjusted, round_even(avg(citedby_count), 2) AS mean_citations_per_paper, min(year)::INT AS first_year, max(year)::INT AS last_year FROM papers_v"))
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return facts.corpus_summary(views.papers(spark, d)).select("*", F.col("year_range")[0].alias("first_year"), F.col("year_range")[1].alias("last_year")).drop("year_range")


@query("top_subfields_per_year", sql("SELECT year, subfield, n AS n_papers, row_number() OVER (PARTITION BY year ORDER BY n DESC, subfield)::INT AS rank FROM counts_v QUALIFY rank <= 5"))
def top_subfields_per_year(spark: SparkSession, d: str) -> DataFrame:
    return facts.top_subfields_per_year(views.subfields(spark, d))


@query(
    "impact_quadrants",
    sql("""SELECT *, median(n_papers) OVER ()::DOUBLE AS median_papers, median(mean_citations) OVER () AS median_citations FROM
(SELECT subfield, count(eid)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations, avg(citedby_count) AS mean_citations, round_even(avg(citations_per_year), 4) AS mean_cpy FROM subfields_v GROUP BY subfield)"""),
)
def impact_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trends.impact_quadrants(views.subfields(spark, d)), 4, "mean_cpy")


@query(
    "top_country_series",
    sql("SELECT year, " + ", ".join(f"count(DISTINCT eid) FILTER (WHERE country = '{c}')::BIGINT AS \"{c}\"" for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM affils_v GROUP BY year"),
)
def top_country_series(spark: SparkSession, d: str) -> DataFrame:
    return influence.top_country_series(views.affils(spark, d))


SEEDS = {"Function words": ("the", "and"), "Inner syllables": ("ation", "eau"), "Umlauts": ("ü", "ö"), "None": ("zzzzqq",)}
_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{s}{chr(39)})' for s in seeds)} THEN '{label}' END" for label, seeds in SEEDS.items()) + "], lambda x: x IS NOT NULL)"


@query("rule_labels", f"SELECT doc_id, array_to_string({_LABELS}, '|') AS labels FROM (SELECT doc_id, lower(coalesce(source, '') || ' ' || coalesce(text, '') || '   ') AS t FROM documents)")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"))
    return docs.select("doc_id", F.array_join(taxonomy.rule_labels(taxonomy.classification_text(docs), SEEDS), "|").alias("labels"))


@query(
    "label_union",
    sql("SELECT eid, array_to_string(list_sort(list_distinct(list_concat(list(subfield), ['PROMO', 'New label', CASE WHEN min(year) > 1998 THEN 'Late' ELSE 'PROMO' END]))), '|') AS labels FROM subfields_v GROUP BY eid"),
)
def label_union(spark: SparkSession, d: str) -> DataFrame:
    own = views.subfields(spark, d).groupBy("eid").agg(F.collect_list("subfield").alias("rules"), F.min("year").alias("year"))
    other = F.array(F.lit("PROMO"), F.lit("New label"), F.when(F.col("year") > 1998, "Late").otherwise("PROMO"))
    return own.select("eid", F.array_join(taxonomy.label_union(F.col("rules"), other), "|").alias("labels"))


@query("relevance_filter", sql("SELECT doc_id, year, lang FROM annotated_v WHERE coalesce(is_ai_relevant, true)"))
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.relevant(views.annotated(spark, d)).select("doc_id", "year", "lang")


@query("dedupe_candidates", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def dedupe_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates.first_of_each(views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


@query(
    "doc_terms_ctfidf",
    """WITH words AS (
  SELECT lang, doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda x: NOT list_contains(['the', 'de', 'der', 'la'], x))) AS w, generate_subscripts(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda x: NOT list_contains(['the', 'de', 'der', 'la'], x)), 1) AS i FROM documents
), terms AS (
  SELECT lang, w AS term FROM words
  UNION ALL SELECT lang, term FROM (SELECT lang, lag(w) OVER (PARTITION BY lang ORDER BY doc_id, i) || ' ' || w AS term FROM words) WHERE term IS NOT NULL
), tf AS (SELECT lang, term, count(*) AS tf FROM terms GROUP BY ALL),
scored AS (
  SELECT lang AS cluster, term, tf / (sum(tf) OVER (PARTITION BY lang))::DOUBLE * ln(1 + (SELECT count(DISTINCT lang) FROM tf)::DOUBLE / (count(*) OVER (PARTITION BY term))::DOUBLE) AS score FROM tf
)
SELECT cluster, term, round_even(score, 9) AS score, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term)::INT AS rank FROM scored QUALIFY rank <= 12""",
)
def doc_terms_ctfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents").select("doc_id", "lang", "text")
    return _rounded(text.ctfidf(docs, "lang", "doc_id", "text", 12, ["the", "de", "der", "la"]), 9, "score")


@query(
    "bigrams_across_texts",
    """WITH words AS (SELECT source, '2-s2.0-' || doc_id AS eid, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda x: NOT list_contains(['the', 'de', 'der', 'la'], x)) AS ws FROM documents)
SELECT cluster, term, count(*)::BIGINT AS n FROM (SELECT source AS cluster, lag(ws[-1]) OVER (PARTITION BY source ORDER BY eid) || ' ' || ws[1] AS term FROM words WHERE len(ws) > 0) WHERE term IS NOT NULL GROUP BY ALL""",
)
def bigrams_across_texts(spark: SparkSession, d: str) -> DataFrame:
    """In the order of text ids, as papers have them."""
    docs = views.table(spark, d, "documents").select(F.concat(F.lit("2-s2.0-"), "doc_id").alias("eid"), "source", "text")
    return text.seams(docs, "source", "eid", "text", ["the", "de", "der", "la"]).groupBy("cluster", "term").agg(F.count("*").alias("n"))


@query("json_props", "SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN json_extract_string(props, '$.k') END AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN 0 ELSE 1 END::INT AS n_values FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select("event_id", at(F.try_parse_json("props"), "k").alias("v"))
    return e.select("event_id", text_of(F.col("v")).alias("k"), F.size(one_or_many(F.col("v"))).alias("n_values"))


@query("coerce_bool", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) <> 0 WHEN 3 THEN true WHEN 4 THEN NULL ELSE false END AS flag FROM events")
def coerce_bool(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    k = F.col("event_id") % 6
    raw = F.when(k == 0, F.lit('" YES "')).when(k == 1, F.lit("false")).when(k == 2, F.get_json_object("props", "$.k")).when(k == 3, F.lit('["y", "no"]')).when(k == 4, F.lit('"maybe"')).otherwise(F.lit('"0"'))
    return e.select("event_id", to_bool(F.try_parse_json(raw)).alias("flag"))


@query("left_join_labels", "SELECT d.doc_id, d.lang, d.source, l.quality, CASE WHEN l.doc_id IS NOT NULL THEN 'label' END AS lang_llm FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("eid"), "lang", "source")
    marks = views.table(spark, d, "labels").select(F.col("doc_id").alias("eid"), "quality", F.lit("label").alias("lang"))
    return annotate.joined(docs, marks).withColumnRenamed("eid", "doc_id")


@query("cache_misses", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    known = views.table(spark, d, "labels").select(F.col("doc_id").alias("key"))
    return cache.missing(views.table(spark, d, "documents").select("doc_id"), known, "doc_id")


@query(
    "l2_normalize",
    "SELECT vec_id, round_even(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8))::FLOAT::DOUBLE)), 4) AS total, len(embedding)::INT AS dims FROM embeddings",
)
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", vectors.l2_normalized(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.bround(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.size("v").alias("dims"))


def _between(links: str, hops: int) -> str:
    """Credits of all nodes of ``links(eid, auid)``: distances by squaring, up to 2**hops arcs, and paths arc by arc."""
    squares = ",\n".join(f"d{k + 1} AS MATERIALIZED (SELECT a.s, b.t, min(a.d + b.d) AS d FROM d{k} a JOIN d{k} b ON a.t = b.s GROUP BY a.s, b.t)" for k in range(hops))
    return f"""(WITH RECURSIVE pairs AS (SELECT a.auid AS u, b.auid AS v, count(*)::BIGINT AS w FROM ({links}) a JOIN ({links}) b ON a.eid = b.eid AND a.auid <> b.auid GROUP BY ALL),
points AS (SELECT DISTINCT auid FROM ({links})),
d0 AS MATERIALIZED (SELECT u AS s, v AS t, w AS d FROM pairs UNION ALL SELECT auid, auid, 0 FROM points),
{squares},
tight AS MATERIALIZED (SELECT p.s, u, v FROM d{hops} p JOIN pairs ON u = p.t JOIN d{hops} q ON q.s = p.s AND q.t = v WHERE p.d + w = q.d),
walks AS (SELECT auid AS s, auid AS t, 1::DOUBLE AS c, 0 AS h FROM points UNION ALL SELECT tight.s, v, sum(c), h + 1 FROM walks JOIN tight ON tight.s = walks.s AND u = t GROUP BY tight.s, v, h),
ways AS MATERIALIZED (SELECT s, t, sum(c) AS c, any_value(d) AS d FROM walks JOIN d{hops} USING (s, t) GROUP BY s, t),
through AS (SELECT a.t AS auid, sum(a.c * b.c / p.c) AS credit FROM ways a JOIN ways b ON a.t = b.s AND a.s <> a.t AND b.s <> b.t JOIN ways p ON p.s = a.s AND p.t = b.t AND p.d = a.d + b.d GROUP BY a.t)
SELECT auid, coalesce(credit, 0) * CASE WHEN count(*) OVER () > 2 THEN 1::DOUBLE / ((count(*) OVER () - 1) * (count(*) OVER () - 2)) ELSE 0 END AS betweenness FROM points LEFT JOIN through USING (auid))"""


# the test tables have some 100 suppliers where SQL is run, so no way among them has 2**7 arcs
@query("betweenness", sql(f"SELECT auid, round_even(betweenness, 9) AS betweenness FROM {_between('SELECT DISTINCT eid, auid FROM authors_v', 7)}"))
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.betweenness(*graph.coauthor_graph(views.authors(spark, d))), 9, "betweenness")


_PLACES = "SELECT DISTINCT eid, afid AS auid FROM affils_v"


@query(
    "institution_centrality",
    sql(
        f"""SELECT auid, any_value(name) AS name, count(DISTINCT eid)::BIGINT AS papers, (SELECT count(DISTINCT b.auid) FROM ({_PLACES}) x JOIN ({_PLACES}) b USING (eid) WHERE x.auid = n.afid AND b.auid <> x.auid) / (SELECT count(DISTINCT afid) - 1 FROM affils_v)::DOUBLE AS degree_centrality,
  round_even(any_value(betweenness), 9) AS betweenness FROM affils_v n JOIN {_between(_PLACES, 5)} ON auid = afid GROUP BY auid, n.afid"""
    ),
)
def institution_centrality(spark: SparkSession, d: str) -> DataFrame:
    """The centrality table, first by betweenness, of institutions that share papers."""
    places = views.affils(spark, d).select("eid", "year", F.col("afid").alias("auid"), "name", "citedby_count")
    return _rounded(graph.centrality(*graph.coauthor_graph(places)), 9, "betweenness")


_ON = "(SELECT DISTINCT eid, year, auid FROM authors_v)"
_EDGES = f"SELECT a.auid AS src, b.auid AS dst, count(*)::BIGINT AS weight FROM {_ON} a JOIN {_ON} b ON a.eid = b.eid AND a.auid < b.auid GROUP BY ALL"


@query("coauthor_edges", sql(_EDGES))
def coauthor_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.coauthor_graph(views.authors(spark, d))[1]


QUERIES["coauthor_edges_all"], SQL["coauthor_edges_all"] = coauthor_edges, SQL["coauthor_edges"]


@query(
    "degree_centrality",
    sql(f"SELECT auid, coalesce(k, 0) / ((SELECT count(DISTINCT auid) FROM authors_v) - 1)::DOUBLE AS degree_centrality FROM (SELECT DISTINCT auid FROM authors_v) LEFT JOIN (SELECT auid, count(*) AS k FROM (SELECT unnest([src, dst]) AS auid FROM ({_EDGES})) GROUP BY auid) USING (auid)"),
)
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_centrality(*graph.coauthor_graph(views.authors(spark, d)))


QUERIES["degree_centrality_all"], SQL["degree_centrality_all"] = degree_centrality, SQL["degree_centrality"]


@query("edges_by_year", sql(f"SELECT a.year, a.auid AS src, b.auid AS dst, count(*)::BIGINT AS weight FROM {_ON} a JOIN {_ON} b ON a.eid = b.eid AND a.auid < b.auid GROUP BY ALL"))
def edges_by_year(spark: SparkSession, d: str) -> DataFrame:
    """A list of edges for each year."""
    return graph.edges_by_year(views.authors(spark, d))


QUERIES["edges_by_year_all"], SQL["edges_by_year_all"] = edges_by_year, SQL["edges_by_year"]


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with their labels as topics, a document's text for each."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("eid"), F.col("source").alias("title"), F.col("text").alias("doc"), F.col("n_chars").alias("citedby_count"))
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("eid"), F.col("label").alias("topic"))
    return docs.join(e, "eid").withColumn("topic_label", F.concat(F.lit("Topic "), F.col("topic")))


@query(
    "topic_summary",
    """WITH t AS (SELECT doc_id AS eid, source AS title, n_chars AS citedby_count, label AS topic FROM documents JOIN embeddings ON doc_id = vec_id)
SELECT topic, 'Topic ' || topic AS label, count(*)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations,
  (SELECT string_agg(title, ' | ' ORDER BY citedby_count DESC, eid) FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY citedby_count DESC, eid) AS r FROM t) x WHERE r <= 5 AND x.topic = t.topic) AS rep_titles FROM t GROUP BY topic""",
)
def topic_summary(spark: SparkSession, d: str) -> DataFrame:
    """Without the terms, which ``topic_terms`` has."""
    return vectors.topic_sums(_clustered(spark, d))


@query("topics")
def topics(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of all vectors, -1 for noise, with each one's similarity to its cluster's centre."""
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("eid"), F.col("embedding").alias("vector"))
    return _topics(e)


def _topics(e: DataFrame) -> DataFrame:
    found = stored(vectors.density_clusters(vectors.project(e, "eid", "vector", 5), "eid"))
    centres = vectors.topic_centres(e, found, "eid", "vector")
    near = F.aggregate(F.zip_with(vectors.l2_normalized(F.col("vector")), "centre", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return e.join(found, "eid").join(centres, "topic", "left").select("eid", "topic", F.bround(near, 4).alias("similarity"))


@query("facts_document")
def facts_document(spark: SparkSession, d: str) -> DataFrame:
    papers = views.keyworded(spark, d)
    words = papers.groupBy("eid").agg(F.array_distinct(F.flatten(F.collect_list("author_keywords"))).alias("author_keywords"))
    papers = views.papers(spark, d).join(words, "eid", "left")
    return facts.facts(papers, views.subfields(spark, d), views.authors(spark, d), views.affils(spark, d))


#: Sections of the facts: what an item is called by, and measures that are whole numbers or rounded.
FACTS = {
    "yearly": ("year", ("n_papers", "total_citations")),
    "subfield_growth": ("subfield", ("total", "early_count", "recent_count", "recent_minus_early")),
    "hype_vs_impact": ("subfield", ("n_papers", "total_citations")),
    "keyword_bursts": ("term", ("total", "peak_year", "peak_count")),
    "emerging_keywords": ("term", ("first_year", "last_year", "total", "total_citations")),
    "top_cited_overall": ("title", ("citations", "citations_per_year")),
    "top_authors": ("name", ("n_papers", "total_citations")),
    "top_institutions": ("name", ("n_papers", "total_citations")),
    "impact_keywords": ("term", ("n_papers", "total_citations", "mean_citations")),
}
_TERMS = "(SELECT eid, year, citedby_count, lower(trim(raw)) AS term FROM (SELECT DISTINCT eid, year, citedby_count, raw FROM keywords_v) WHERE length(trim(raw)) > 1)"
FACTS_SQL = {
    "yearly": "SELECT year, count(*) AS n_papers, sum(citedby_count) AS total_citations FROM papers_v GROUP BY year",
    "subfield_growth": """SELECT subfield, sum(n) AS total, coalesce(sum(n) FILTER (WHERE year <= mid), 0) AS early_count, coalesce(sum(n) FILTER (WHERE year > mid), 0) AS recent_count,
      coalesce(sum(n) FILTER (WHERE year > mid), 0) - coalesce(sum(n) FILTER (WHERE year <= mid), 0) AS recent_minus_early FROM counts_v, mid_v GROUP BY subfield""",
    "hype_vs_impact": "SELECT subfield, count(eid) AS n_papers, sum(citedby_count) AS total_citations FROM subfields_v GROUP BY subfield",
    "keyword_bursts": f"""SELECT term, sum(n) AS total, arg_max(year, n * 10000 - year) AS peak_year, max(n) AS peak_count FROM (SELECT term, year, count(*) AS n FROM {_TERMS} GROUP BY ALL) GROUP BY term HAVING sum(n) >= 3
      ORDER BY max(n) / (sum(n) / count(*)::DOUBLE) DESC, term LIMIT 15""",
    "emerging_keywords": f"SELECT term, min(year) AS first_year, max(year) AS last_year, count(eid) AS total, sum(citedby_count) AS total_citations FROM {_TERMS} GROUP BY term HAVING count(eid) >= 2 ORDER BY first_year DESC, total DESC, term LIMIT 20",
    "top_cited_overall": "SELECT title, citedby_count AS citations, round_even(citations_per_year, 1) AS citations_per_year FROM papers_v ORDER BY citedby_count DESC, eid LIMIT 5",
    "top_authors": "SELECT name, n_papers, total_citations FROM (SELECT auid, name, count(DISTINCT eid) AS n_papers, sum(citedby_count) AS total_citations FROM authors_v GROUP BY auid, name ORDER BY total_citations DESC, n_papers DESC, auid LIMIT 15)",
    "top_institutions": "SELECT name, n_papers, total_citations FROM (SELECT afid, name, country, count(DISTINCT eid) AS n_papers, sum(citedby_count) AS total_citations FROM affils_v GROUP BY afid, name, country ORDER BY n_papers DESC, total_citations DESC, afid LIMIT 15)",
    "impact_keywords": """SELECT raw AS term, count(*) AS n_papers, sum(citedby_count) AS total_citations, round_even(avg(citedby_count), 1) AS mean_citations FROM (SELECT DISTINCT eid, citedby_count, raw FROM keywords_v) WHERE raw <> ''
      GROUP BY raw HAVING count(*) >= 2 ORDER BY total_citations DESC, term LIMIT 12""",
}
_facts_rows = " UNION ALL ".join(f"SELECT '{section}' AS section, {item}::VARCHAR AS item, '{m}' AS measure, {m}::DOUBLE AS value FROM ({FACTS_SQL[section]})" for section, (item, measures) in FACTS.items() for m in measures)


@query(
    "facts_values",
    sql(f"{_facts_rows} UNION ALL SELECT 'corpus_summary', 'all', 'total_papers', count(*)::DOUBLE FROM papers_v UNION ALL SELECT 'corpus_summary', 'all', 'mean_citations_per_paper', round_even(avg(citedby_count), 2) FROM papers_v"),
)
def facts_values(spark: SparkSession, d: str) -> DataFrame:
    """The document's numbers as rows, read back from its JSON."""
    sections = {name: f"array<struct<{item}: string, {', '.join(f'{m}: double' for m in measures)}>>" for name, (item, measures) in FACTS.items()}
    schema = "corpus_summary struct<total_papers: double, mean_citations_per_paper: double>, " + ", ".join(f"{k} {v}" for k, v in sections.items())
    doc = stored(facts_document(spark, d)).select(F.from_json("facts", schema).alias("f")).select("f.*")

    def values(section: str, rows: DataFrame, item: Column, measures: tuple[str, ...]) -> DataFrame:
        v = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures)))
        return rows.select(F.lit(section).alias("section"), item.alias("item"), v.alias("v")).select("section", "item", "v.*")

    out = values("corpus_summary", doc.select("corpus_summary.*"), F.lit("all"), ("total_papers", "mean_citations_per_paper"))
    for name, (item, measures) in FACTS.items():
        out = out.unionByName(values(name, doc.select(F.inline(name)), F.col(item), measures))
    return out


@query("citation_aging", sql("SELECT subfield, year, count(eid)::BIGINT AS n_papers, avg(citedby_count) AS mean_citations FROM subfields_v GROUP BY ALL"))
def citation_aging(spark: SparkSession, d: str) -> DataFrame:
    return trends.citation_aging(views.subfields(spark, d))


@query("top_cited_overall", sql("SELECT title, year, citedby_count AS citations, round_even(citations_per_year, 1) AS citations_per_year FROM papers_v ORDER BY citedby_count DESC, eid LIMIT 5"))
def top_cited_overall(spark: SparkSession, d: str) -> DataFrame:
    return facts.top_cited(views.papers(spark, d)).select("title", "year", "citations", "citations_per_year")


@query("legacy_per_year", sql("SELECT year, count(*)::BIGINT AS n_papers, sum(citedby_count)::BIGINT AS total_citations, round_even(avg(citedby_count / nullif(2002 - year + 1, 0)::DOUBLE), 6) AS mean_citations_per_year FROM papers_v GROUP BY year"))
def legacy_per_year(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(candidates.legacy_per_year(views.papers(spark, d), views.AS_OF_YEAR), 6, "mean_citations_per_year")


@query("legacy_top", sql("SELECT eid, citedby_count FROM papers_v ORDER BY citedby_count DESC, eid LIMIT 25"))
def legacy_top(spark: SparkSession, d: str) -> DataFrame:
    return candidates.legacy_top(views.papers(spark, d)).select("eid", "citedby_count")


@query("legacy_fastest_growing", sql("SELECT eid, year, citedby_count, round_even(citedby_count / nullif(2002 - year + 1, 0)::DOUBLE, 6) AS citations_per_year FROM papers_v ORDER BY citedby_count / nullif(2002 - year + 1, 0)::DOUBLE DESC NULLS LAST, eid LIMIT 25"))
def legacy_fastest_growing(spark: SparkSession, d: str) -> DataFrame:
    top = candidates.legacy_top(candidates.legacy_scored(views.papers(spark, d), views.AS_OF_YEAR), "citations_per_year")
    return _rounded(top.select("eid", "year", "citedby_count", "citations_per_year"), 6, "citations_per_year")
