"""The facts document: every result a narrative may use, frozen as one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import influence, trends
from ..functions.text import exploded, strip_ws
from ..storage import stored


def corpus_summary(papers: DataFrame) -> DataFrame:
    """One row: papers, citations, the age-adjusted sum (1 digit), the mean (2 digits) and the range of years."""
    years = F.when(F.min("year").isNotNull(), F.array(F.min("year"), F.max("year"))).otherwise(F.array().cast("array<int>"))
    return papers.agg(
        F.count("*").alias("total_papers"),
        F.coalesce(F.sum("citedby_count"), F.lit(0)).alias("total_citations"),
        F.bround(F.coalesce(F.sum("citations_per_year"), F.lit(0.0)), 1).alias("total_citations_age_adjusted"),
        F.bround(F.avg("citedby_count"), 2).alias("mean_citations_per_paper"),
        years.alias("year_range"),
    )


def impact_by_term(papers: DataFrame, col: str, top_n: int = 12, min_papers: int = 2) -> DataFrame:
    """Terms as they are written, by the citations of their papers; empty ones are left out."""
    g = exploded(papers, col, "term", "citedby_count").where("term <> ''").groupBy("term")
    g = g.agg(F.count("*").alias("n_papers"), F.sum("citedby_count").alias("total_citations"), F.bround(F.avg("citedby_count"), 1).alias("mean_citations"))
    return g.where(F.col("n_papers") >= min_papers).orderBy(F.desc("total_citations"), "term").limit(top_n)


def rigor_trend(papers: DataFrame) -> DataFrame:
    """Percentages by year, null counted as false."""
    flags = [c for c in ("external_validation", "code_available", "data_available") if c in papers.columns]

    def percent(c: Column) -> Column:
        return F.bround(100 * F.avg(F.coalesce(c, F.lit(False)).cast("int")), 1)

    out = [percent(F.col(c)).alias(f"pct_{c}") for c in flags]
    if "data_regime" in papers.columns:
        out.append(percent(F.col("data_regime") == "multi_center").alias("pct_multi_center"))
    return papers.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n_papers"), *out).orderBy("year")


def _cited(papers: DataFrame) -> Column:
    """One paper's citation facts."""
    maybe = lambda c, kind: F.col(c) if c in papers.columns else F.lit(None).cast(kind)
    return F.struct(
        "title",
        "year",
        F.col("citedby_count").alias("citations"),
        F.coalesce(F.bround("citations_per_year", 1), F.lit(0.0)).alias("citations_per_year"),
        maybe("subfields", "array<string>").alias("subfields"),
        maybe("one_sentence_summary", "string").alias("summary"),
    )


def top_cited(papers: DataFrame, k: int = 5) -> DataFrame:
    """The most cited papers of all, ties by id."""
    return papers.orderBy(F.desc("citedby_count"), "eid").limit(k).select(_cited(papers).alias("paper")).select("paper.*")


def top_subfields_per_year(long: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent labels of each year; ties by label."""
    order = W.partitionBy("year").orderBy(F.desc("n_papers"), "subfield")
    return trends.subfield_counts(long).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def yearly_brief(papers: DataFrame, long: DataFrame, k: int = 5) -> DataFrame:
    """One row per year with its sums, top labels (a map) and most cited papers (a list)."""
    dated = papers.where("year IS NOT NULL")
    sums = dated.groupBy("year").agg(F.count("*").alias("n_papers"), F.sum("citedby_count").alias("total_citations"), F.bround(F.coalesce(F.sum("citations_per_year"), F.lit(0.0)), 1).alias("total_citations_age_adjusted"))
    in_rank = lambda what: F.transform(F.array_sort(F.collect_list(F.struct("rank", what))), lambda x: x["v"])
    labels = top_subfields_per_year(long, k).groupBy("year").agg(F.map_from_entries(in_rank(F.struct("subfield", "n_papers").alias("v"))).alias("top_subfields"))
    order = W.partitionBy("year").orderBy(F.desc("citedby_count"), "eid")
    best = dated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # at most k papers a year are collected
    best = best.groupBy("year").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", _cited(papers).alias("v")))), lambda x: x["v"]).alias("top_cited"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return sums.join(labels, "year", "left").join(best, "year", "left").withColumn("top_subfields", F.coalesce("top_subfields", none)).orderBy("year")


def _listed(df: DataFrame, *order: Column | str) -> Column:
    """A small, already limited table as one array of structs, in its order."""
    fields = F.struct(*df.columns)
    ranked = df.withColumn("__n", F.row_number().over(W.orderBy(*order)))
    by_place = F.array_sort(F.collect_list(F.struct("__n", fields.alias("v"))), lambda a, b: a["__n"] - b["__n"])
    return ranked.agg(F.transform(by_place, lambda x: x["v"]).alias("rows")).scalar()


TERM_COLUMNS = (("impact_methods", "ai_methods", 2), ("impact_model_families", "model_family", 2), ("impact_keywords", "author_keywords", 2), ("impact_benchmarks", "benchmarks_datasets", 1))
FLAGS = ("external_validation", "code_available", "data_available")


def _sums(papers: DataFrame) -> tuple[DataFrame, list[str]]:
    """``kind``, ``raw`` and ``year`` to sums over papers, in one pass: of each term column's terms as written, and, of kind '', of the papers themselves; and the names of the columns of shares.

    As many rows as terms and years.
    """
    kinds = [c for c in dict.fromkeys(("author_keywords", *(c for _, c, _ in TERM_COLUMNS))) if c in papers.columns]
    pair = lambda kind, raw: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"))
    none = F.array().cast("array<string>")
    of_kind = lambda c: F.transform(F.coalesce(F.col(c).cast("array<string>"), none), lambda x: pair(c, x))
    listed = F.concat(F.array(pair("", F.lit(""))), *(of_kind(c) for c in kinds))
    flags = {f"pct_{c}": F.coalesce(F.col(c), F.lit(False)) for c in FLAGS if c in papers.columns}
    if "data_regime" in papers.columns:
        flags["pct_multi_center"] = F.coalesce(F.col("data_regime") == "multi_center", F.lit(False))
    each = papers.select("eid", "year", "citedby_count", "citations_per_year", *(c.alias(n) for n, c in flags.items()), F.explode(listed).alias("t")).where("t.raw IS NOT NULL")
    sums = each.groupBy("t.kind", "t.raw", "year").agg(
        F.count("*").alias("n"),
        F.count("eid").alias("n_ids"),
        F.sum("citedby_count").alias("cites"),
        F.count("citedby_count").alias("n_cites"),
        F.sum("citations_per_year").alias("adjusted"),
        *(F.count_if(F.col(n)).alias(n) for n in flags),
    )
    return sums, list(flags)


def facts(papers: DataFrame, long: DataFrame, paper_authors: DataFrame, paper_affils: DataFrame) -> DataFrame:
    """One row ``(facts)``: the document as JSON.  Every table in it has a bound of its own: years, labels, or a top n.

    All tables come from four aggregates, which are stored: of papers by term
    and year, of labels by year, and the most cited papers of each year; authors
    and institutions are aggregated where they are read.
    """
    sums, flags = _sums(papers)
    sums = stored(sums)
    by_label = stored(long.where("subfield IS NOT NULL").groupBy("year", "subfield").agg(F.count("*").alias("n_papers"), F.count("eid").alias("n_ids"), F.sum("citedby_count").alias("cites"), F.count("citedby_count").alias("n_cites"), F.sum("citations_per_year").alias("adjusted"), F.count("citations_per_year").alias("n_adjusted")))
    place = F.row_number().over(W.partitionBy("year").orderBy(F.desc("citedby_count"), "eid"))
    best = stored(papers.select("eid", "year", "citedby_count", _cited(papers).alias("paper"), place.alias("rank")).where("rank <= 5"))

    years = sums.where("kind = ''")
    range_ = F.when(F.min("year").isNotNull(), F.array(F.min("year"), F.max("year"))).otherwise(F.array().cast("array<int>"))
    summary = years.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_papers"),
        F.coalesce(F.sum("cites"), F.lit(0)).alias("total_citations"),
        F.bround(F.coalesce(F.sum("adjusted"), F.lit(0.0)), 1).alias("total_citations_age_adjusted"),
        F.bround(F.try_divide(F.sum("cites"), F.sum("n_cites")), 2).alias("mean_citations_per_paper"),
        range_.alias("year_range"),
    )
    dated = years.where("year IS NOT NULL")
    counts = by_label.where("year IS NOT NULL").select("year", "subfield", "n_papers")
    rigor = dated.select("year", F.col("n").alias("n_papers"), *(F.bround(100 * (F.col(c) / F.col("n")), 1).alias(c) for c in flags))
    hype = by_label.groupBy("subfield").agg(F.sum("n_ids").alias("n_papers"), F.sum("cites").alias("total_citations"), F.try_divide(F.sum("cites"), F.sum("n_cites")).alias("mean_citations"), F.try_divide(F.sum("adjusted"), F.sum("n_adjusted")).alias("mean_cpy"))

    term = F.lower(strip_ws(F.col("raw")))
    words = sums.where("kind = 'author_keywords'").select(term.alias("term"), "year", "n", "n_ids", "cites").where(F.length("term") > 1)
    bursts = trends.bursts_of(words.where("year IS NOT NULL").groupBy("term", "year").agg(F.sum("n").alias("n"))).limit(15)
    emerging = words.groupBy("term").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("n_ids").alias("total"), F.sum("cites").alias("total_citations")).where("total >= 2")
    emerging = emerging.orderBy(F.desc_nulls_last("first_year"), F.desc("total"), "term").limit(20)

    authors = influence.author_influence(paper_authors, 15).withColumn("mean_citations", F.bround("mean_citations", 1))
    affils = influence.affil_influence(paper_affils, 15).withColumn("mean_citations", F.bround("mean_citations", 1))
    parts = {
        "corpus_summary": summary.select(F.struct("*")).scalar(),
        "top_cited_overall": _listed(best.orderBy(F.desc("citedby_count"), "eid").limit(5).select("paper.*"), F.desc("citations"), "title"),
        "yearly": _listed(_briefs(dated, counts, best), "year"),
        "subfield_growth": _listed(trends.growth_of(counts), F.desc("recent_minus_early"), "subfield"),
        "subfield_impact": _listed(hype.orderBy(F.desc("total_citations"), "subfield").limit(15), F.desc("total_citations"), "subfield"),
        "rigor_trend": _listed(rigor, "year"),
        "keyword_bursts": _listed(bursts, F.desc("burst_score"), "term"),
        "emerging_keywords": _listed(emerging, F.desc_nulls_last("first_year"), F.desc("total"), "term"),
        "hype_vs_impact": _listed(hype, F.desc("n_papers"), "subfield"),
        "top_authors": _listed(authors.select("name", "n_papers", "total_citations", "mean_citations", "first_year", "last_year"), F.desc("total_citations"), F.desc("n_papers"), "name"),
        "top_institutions": _listed(affils.select("name", "country", "n_papers", "total_citations", "mean_citations"), F.desc("n_papers"), F.desc("total_citations"), "name"),
    }
    for name, col, least in TERM_COLUMNS:
        if col in papers.columns:
            g = sums.where((F.col("kind") == col) & (F.col("raw") != "")).groupBy(F.col("raw").alias("term"))
            g = g.agg(F.sum("n").alias("n_papers"), F.sum("cites").alias("total_citations"), F.bround(F.try_divide(F.sum("cites"), F.sum("n_cites")), 1).alias("mean_citations")).where(F.col("n_papers") >= least)
            parts[name] = _listed(g.orderBy(F.desc("total_citations"), "term").limit(12), F.desc("total_citations"), "term")
    return papers.sparkSession.range(1, numPartitions=1).select(*(c.alias(k) for k, c in parts.items())).select(F.to_json(F.struct(*parts)).alias("facts"))


def _briefs(dated: DataFrame, counts: DataFrame, best: DataFrame) -> DataFrame:
    """``yearly_brief`` from sums, label counts and most cited papers of each year."""
    sums = dated.select("year", F.col("n").alias("n_papers"), F.col("cites").alias("total_citations"), F.bround(F.coalesce("adjusted", F.lit(0.0)), 1).alias("total_citations_age_adjusted"))
    place = F.row_number().over(W.partitionBy("year").orderBy(F.desc("n_papers"), "subfield"))
    labels = counts.withColumn("rank", place).where("rank <= 5").groupBy("year").agg(F.map_from_entries(_in_rank(F.struct("subfield", "n_papers"))).alias("top_subfields"))
    cited = best.groupBy("year").agg(_in_rank(F.col("paper")).alias("top_cited"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return sums.join(labels, "year", "left").join(cited, "year", "left").withColumn("top_subfields", F.coalesce("top_subfields", none)).orderBy("year")


def _in_rank(what: Column) -> Column:
    """A few rows of a group as an array, by ``rank``."""
    return F.transform(F.sort_array(F.collect_list(F.struct("rank", what.alias("v")))), lambda x: x["v"])
