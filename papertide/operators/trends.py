"""Volume, growth and terms by year.

Groups with a null key are left out, as each function says.  Sorts end in a
unique key, so that results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import exploded, terms


def papers_per_year(papers: DataFrame) -> DataFrame:
    """Papers and citations of each year; a null year is left out."""
    return papers.where("year IS NOT NULL").groupBy("year").agg(F.count("eid").alias("n_papers"), F.sum("citedby_count").alias("total_citations"), F.avg("citedby_count").alias("mean_citations")).orderBy("year")


def subfield_counts(long: DataFrame) -> DataFrame:
    """``(year, subfield, n_papers)`` where there are any."""
    return long.where("year IS NOT NULL AND subfield IS NOT NULL").groupBy("year", "subfield").agg(F.count("*").alias("n_papers"))


def labels_of(long: DataFrame) -> list[str]:
    """The labels in use: the columns of the wide tables."""
    return [r[0] for r in long.where("subfield IS NOT NULL").select("subfield").distinct().orderBy("subfield").collect()]


def subfield_year_matrix(long: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Counts, a row for each year and a column for each label; 0 where there are none."""
    labels = labels_of(long) if labels is None else labels
    wide = subfield_counts(long).groupBy("year").pivot("subfield", labels).agg(F.sum("n_papers"))
    return wide.na.fill(0).orderBy("year")


def subfield_share(long: DataFrame, papers: DataFrame) -> DataFrame:
    """``(year, subfield, share)`` of that year's papers, for every year of either table and every label; 0 where a side is missing."""
    totals = papers.where("year IS NOT NULL").groupBy("year").agg(F.count("eid").alias("n_total"))
    counts = subfield_counts(long)
    years = counts.select("year").union(totals.select("year")).distinct()
    # a grid of years and labels: both sides are grouped by few values; labels without a year count too
    labels = long.where("subfield IS NOT NULL").agg(F.array_sort(F.collect_set("subfield"))).scalar()
    grid = years.withColumn("subfield", F.explode(labels))
    share = F.coalesce(F.try_divide(F.col("n_papers"), F.col("n_total")), F.lit(0.0)).alias("share")
    return grid.join(counts, ["year", "subfield"], "left").join(totals, "year", "left").select("year", "subfield", share)


def subfield_share_matrix(long: DataFrame, papers: DataFrame) -> DataFrame:
    return subfield_share(long, papers).groupBy("year").pivot("subfield", labels_of(long)).agg(F.first("share")).orderBy("year")


def _middle(years: DataFrame) -> DataFrame:
    """One row: the middle of the distinct years (the later of two), the first and the last."""
    ordered = F.array_sort(F.collect_set("year"))
    return years.where("year IS NOT NULL").agg(ordered.alias("ys")).where(F.size("ys") > 0).select(F.element_at("ys", F.expr("int(size(ys) / 2) + 1")).alias("mid"), F.element_at("ys", 1).alias("y0"), F.element_at("ys", -1).alias("y1"))


def subfield_growth(long: DataFrame) -> DataFrame:
    """Early (to the middle year) against recent counts, and the yearly growth rate of the first to the last year's count.

    A first count of 0 gives a null rate, a last count of 0 gives -1.
    """
    return growth_of(subfield_counts(long))


def growth_of(counts: DataFrame) -> DataFrame:
    """``subfield_growth`` from the counts of ``subfield_counts``."""
    bounds = _middle(counts.select("year").distinct())

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n_papers")).otherwise(0))

    dated = counts.select("*", *(bounds.select(c).scalar().alias(c) for c in ("mid", "y0", "y1")))
    g = dated.groupBy("subfield", "y0", "y1").agg(F.sum("n_papers").alias("total"), total(F.col("year") <= F.col("mid")).alias("early_count"), total(F.col("year") > F.col("mid")).alias("recent_count"), total(F.col("year") == F.col("y0")).alias("a"), total(F.col("year") == F.col("y1")).alias("b"))
    rate = F.when(F.col("a") > 0, F.pow(F.col("b") / F.when(F.col("a") > 0, F.col("a")), 1.0 / F.greatest(F.lit(1), F.col("y1") - F.col("y0"))) - 1)
    return g.select("subfield", "total", "early_count", "recent_count", (F.col("recent_count") - F.col("early_count")).alias("recent_minus_early"), rate.alias("cagr")).orderBy(F.desc("recent_minus_early"), "subfield")


def emergence(papers: DataFrame, col: str = "author_keywords", min_count: int = 2) -> DataFrame:
    """First and last year, papers and citations of each term with at least ``min_count`` papers; null years count but do not date."""
    g = terms(papers, col).groupBy("term").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("eid").alias("total"), F.sum("citedby_count").alias("total_citations"))
    return g.where(F.col("total") >= min_count).orderBy(F.desc_nulls_last("first_year"), F.desc("total"), "term")


def term_trends(papers: DataFrame, col: str = "author_keywords", top_n: int = 25) -> DataFrame:
    """Terms by recent minus early occurrences: the ``top_n`` highest as rising, the lowest as fading, whatever their sign.

    A null year counts in neither half, and a term with null years only is left out.
    """
    sub = terms(papers, col).where("year IS NOT NULL")
    by_year = sub.groupBy("term", "year").agg(F.count("*").alias("n"))
    mid = _middle(by_year.select("year").distinct())
    g = by_year.select("*", mid.select("mid").scalar().alias("mid")).groupBy("term").agg(F.sum(F.when(F.col("year") <= F.col("mid"), F.col("n")).otherwise(0)).alias("early"), F.sum(F.when(F.col("year") > F.col("mid"), F.col("n")).otherwise(0)).alias("recent"))
    g = g.select("term", "early", "recent", (F.col("recent") - F.col("early")).alias("delta"), (F.col("early") + F.col("recent")).alias("total"))
    rising = g.orderBy(F.desc("delta"), "term").limit(top_n).withColumn("direction", F.lit("rising"))
    fading = g.orderBy("delta", "term").limit(top_n).withColumn("direction", F.lit("fading"))
    return rising.unionByName(fading)


def burst_detection(papers: DataFrame, col: str = "author_keywords", min_total: int = 3) -> DataFrame:
    """Each term's peak year against its mean over the years in which it occurs; of equal peaks the earliest."""
    return bursts_of(terms(papers, col).where("year IS NOT NULL").groupBy("term", "year").agg(F.count("*").alias("n")), min_total)


def bursts_of(by_year: DataFrame, min_total: int = 3) -> DataFrame:
    """``burst_detection`` from ``(term, year, n)``, each term and year once."""
    g = by_year.groupBy("term").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("year")).alias("y"))).alias("peak"), F.count("*").alias("n_years")).where(F.col("total") >= min_total)
    return g.select("term", "total", (-F.col("peak.y")).alias("peak_year"), F.col("peak.n").alias("peak_count"), (F.col("peak.n") / (F.col("total") / F.col("n_years"))).alias("burst_score")).orderBy(F.desc("burst_score"), "term")


def top_cited_per_year(papers: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` most cited papers of each year; ties by id.  Columns that the papers lack are left out."""
    order = W.partitionBy("year").orderBy(F.desc("citedby_count"), "eid")
    cols = [c for c in ("year", "title", "citedby_count", "citations_per_year", "subfields", "first_author") if c in papers.columns]
    return papers.where("year IS NOT NULL").withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).orderBy("year", F.desc("citedby_count"), "eid").select(*cols)


def hype_vs_impact(long: DataFrame) -> DataFrame:
    g = long.where("subfield IS NOT NULL").groupBy("subfield").agg(F.count("eid").alias("n_papers"), F.sum("citedby_count").alias("total_citations"), F.avg("citedby_count").alias("mean_citations"), F.avg("citations_per_year").alias("mean_cpy"))
    return g.orderBy(F.desc("n_papers"), "subfield")


def impact_quadrants(long: DataFrame) -> DataFrame:
    """Labels with the medians of volume and impact that divide the quadrants."""
    g = hype_vs_impact(long)
    return g.select("*", g.agg(F.median("n_papers")).scalar().alias("median_papers"), g.agg(F.median("mean_citations")).scalar().alias("median_citations"))


def model_family_adoption(papers: DataFrame) -> DataFrame:
    """Beyond the reference: papers of each model family by year."""
    return exploded(papers, "model_family", "family", "year").where("year IS NOT NULL").groupBy("year", "family").agg(F.count("*").alias("n_papers")).orderBy("year", "family")


def citation_aging(long: DataFrame) -> DataFrame:
    """Beyond the reference: mean citations of each label by the papers' year."""
    return long.where("year IS NOT NULL AND subfield IS NOT NULL").groupBy("subfield", "year").agg(F.count("eid").alias("n_papers"), F.avg("citedby_count").alias("mean_citations")).orderBy("subfield", "year")


def compute_all(papers: DataFrame, long: DataFrame) -> dict[str, DataFrame]:
    """The trend tables by name; lazy but for the labels in use."""
    out = {
        "papers_per_year": papers_per_year(papers),
        "subfield_year_matrix": subfield_year_matrix(long),
        "subfield_share_matrix": subfield_share_matrix(long, papers),
        "subfield_growth": subfield_growth(long),
        "keyword_emergence": emergence(papers, "author_keywords"),
        "keyword_trends": term_trends(papers, "author_keywords"),
        "keyword_bursts": burst_detection(papers, "author_keywords"),
        "top_cited_per_year": top_cited_per_year(papers, 3),
        "hype_vs_impact": hype_vs_impact(long),
    }
    for name, col in (("method_emergence", "ai_methods"), ("benchmark_emergence", "benchmarks_datasets")):
        if col in papers.columns:
            out[name] = emergence(papers, col)
    return out
