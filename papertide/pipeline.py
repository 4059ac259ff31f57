"""All stages in order; what several results read, and what models have answered, is written once."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.text import document_text
from .operators import annotate, cache, candidates, embed, facts, influence, ingest, taxonomy, trends, vectors
from .sources import rest, tables
from .storage import stored


class Namer(Protocol):
    def name_topic(self, terms: list[str], titles: list[str]) -> dict:
        """``label`` and ``summary`` of a topic."""


class Narrator(Protocol):
    def narrate(self, facts_json: str) -> str:
        """A report in markdown."""


@dataclass
class Results:
    tables: dict[str, DataFrame]
    labeled: DataFrame
    long: DataFrame
    trends: dict[str, DataFrame]
    influence: dict[str, DataFrame]
    facts: DataFrame
    embeddings: DataFrame
    topics: DataFrame
    topic_summary: DataFrame
    reports: dict[str, str] = field(default_factory=dict)


def acquire(hits: DataFrame, store: cache.CacheTable, url: str, fetch: rest.Fetch = rest.http_fetch) -> tuple[DataFrame, DataFrame]:
    """Candidates and parsed records from search hits ``(ord, payload)``; only ids that the cache lacks are looked up, failed ones once."""
    found = candidates.candidates(hits.withColumn("payload", F.try_parse_json("payload")))
    wanted = found.where("scopus_id <> ''").select(F.concat(F.lit("sid:"), "scopus_id").alias("key"), "scopus_id").distinct()
    store.append(rest.look_up(cache.missing(wanted, store.read()), url, fetch))
    return found, ingest.enrich(found, store.read())


def save_all(results: Results, path: str) -> list[str]:
    """Everything that a run gives; returns the names of the trend and influence tables that have rows.

    Tables, topics and embeddings as Parquet; trends, influence, topics and
    their summary as CSV; facts and reports as text.
    """
    tables.save_tables(results.tables, f"{path}/tables")
    written = tables.save_csv(results.trends, f"{path}/tables", "trend") + tables.save_csv(results.influence, f"{path}/tables", "influence")
    tables.save_parquet_and_csv(results.topics, f"{path}/tables", "topics")
    tables.save_parquet_and_csv(results.topic_summary, f"{path}/tables", "topic_summary")
    tables.save_tables({"topic_map": topic_map(results.topics), "embeddings": results.embeddings}, f"{path}/tables")
    tables.save_facts(results.facts, f"{path}/report", narrative(results.facts.first()[0]))
    for name, text in results.reports.items():
        tables.save_text(results.facts.sparkSession, f"{path}/{name}.md", text)
    return written


def topic_map(topics: DataFrame) -> DataFrame:
    """What a map of the topics shows: a point for each paper."""
    return topics.select("eid", "title", "year", "citedby_count", "umap_x", "umap_y", "topic", "topic_label")


def named_topics(summary: DataFrame, namer: Namer, store: cache.CacheTable | None = None) -> DataFrame:
    """The summary with a model's names; a topic is asked for by its terms and titles, and noise is not."""

    def call(rows: list[dict]) -> list[str]:
        return [json.dumps(namer.name_topic(r["top_terms"].split(", "), r["rep_titles"].split(" | "))) for r in rows]

    key = F.sha2(F.to_json(F.struct(F.lit(annotate.asked_as(namer) if hasattr(namer, "name") else type(namer).__name__).alias("model"), F.lit("topic").alias("kind"), "top_terms", "rep_titles")), 256)
    keyed = summary.where("topic >= 0").select("topic", key.alias("key"), "top_terms", "rep_titles")
    answered = annotate.ask(keyed.select("key", "top_terms", "rep_titles").dropDuplicates(["key"]), call, store)
    said = F.from_json("value", "label string, summary string")
    names = keyed.join(answered, "key").select("topic", said.alias("v")).select("topic", "v.label", "v.summary")
    return vectors.relabelled(summary, stored(names))


def reports_from(facts_json: str, narrators: dict[str, Narrator]) -> dict[str, str]:
    """A report by each model, all from the same frozen facts."""
    return {name: n.narrate(facts_json) for name, n in narrators.items()}


def report_again(spark: SparkSession, path: str, name: str, narrator: Narrator) -> str:
    """Another report from facts that ``save_all`` has written, without a run; saved beside them."""
    text = narrator.narrate(tables.load_facts(spark, f"{path}/report"))
    tables.save_text(spark, f"{path}/{name}.md", text)
    return text


def run_all(
    records: DataFrame,
    settings: Settings,
    annotator: annotate.Annotator | None = None,
    labeller: taxonomy.Labeller | None = None,
    encoder: embed.Encoder | None = None,
    namer: Namer | None = None,
    narrators: dict[str, Narrator] | None = None,
    store: cache.CacheTable | None = None,
    vectors_path: str | None = None,
) -> Results:
    """Parsed records to every result.

    Trends and facts see relevant papers only; influence sees all papers, and
    meets labels of the relevant ones.  The long table of labels comes in both
    kinds: as written (all papers) and as used (relevant ones).  Without models
    annotations, vectors and topic names are those of the offline ones, and
    there are no labels but the rules'.  With a ``store`` a second run asks
    models for nothing that it has answered.
    """
    annotator, encoder = annotator or annotate.RuleAnnotator(), encoder or embed.HashingEncoder()
    tables = ingest.normalize(records, settings.as_of_year)
    papers = tables["papers"]
    answered = annotate.ask(annotate.questions(papers, annotator), annotator.annotate, store)
    # answers are read by every result: each is asked for once
    extracted = tables["extractions"] = stored(annotate.extractions(papers, answered, annotator))
    described = annotate.joined(papers, extracted)
    labels = taxonomy.annotated_labels(described, labeller, store) if labeller else None
    labeled = stored(taxonomy.assign_subfields(described, labels, settings.taxonomy, settings.label_mode))
    tables["labeled"], tables["subfields_all"] = labeled, taxonomy.subfields_long(labeled)
    kept = taxonomy.relevant(labeled)
    long = taxonomy.subfields_long(kept)

    embeddings = embed.embed_once(kept, encoder, vectors_path)
    documents = kept.withColumn("doc", document_text(F.col("title"), F.col("abstract")))
    topics, summary = vectors.discover_topics(documents, embeddings.select("eid", "vector"), settings.cluster)
    summary = stored(summary)
    if namer:
        summary = named_topics(summary, namer, store)
        topics = topics.drop("topic_label").join(F.broadcast(summary.select("topic", F.col("label").alias("topic_label"))), "topic")
    frozen = stored(facts.facts(kept, long, tables["paper_authors"], tables["paper_affils"]))
    reports = reports_from(frozen.first()["facts"], narrators) if narrators else {}
    return Results(tables, kept, long, trends.compute_all(kept, long), influence.compute_all(tables["paper_authors"], tables["paper_affils"], long), frozen, embeddings, topics.drop("doc"), summary, reports)


def narrative(facts_json: str) -> str:
    """A report from the frozen facts alone; a model may write another from the same document."""
    f = json.loads(facts_json)
    s = f["corpus_summary"]
    lines = ["# Publication trends", "", f"{s['total_papers']} papers, {s['total_citations']} citations, {s.get('total_citations_age_adjusted')} adjusted for age."]
    if f.get("yearly"):
        lines += ["", "| year | papers | citations |", "|---|---|---|", *(f"| {y['year']} | {y['n_papers']} | {y['total_citations']} |" for y in f["yearly"])]
    for title, key, name in (("Growing labels", "subfield_growth", "subfield"), ("Bursts", "keyword_bursts", "term"), ("Authors", "top_authors", "name")):
        if f.get(key):
            lines += ["", f"## {title}", *(f"- {x[name]}" for x in f[key][:10])]
    return "\n".join(lines) + "\n"
