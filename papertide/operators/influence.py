"""People and places.  These run on all papers, not only the relevant ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import centrality, coauthor_graph


def author_influence(paper_authors: DataFrame, top_n: int | None = 30) -> DataFrame:
    """Distinct papers of each (author, name), with citations over all its rows; null authors and names are left out."""
    g = paper_authors.where("auid IS NOT NULL AND name IS NOT NULL").groupBy("auid", "name")
    g = g.agg(F.countDistinct("eid").alias("n_papers"), F.sum("citedby_count").alias("total_citations"), F.avg("citedby_count").alias("mean_citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    g = g.orderBy(F.desc("total_citations"), F.desc("n_papers"), "auid", "name")
    return g if top_n is None else g.limit(top_n)


def affil_influence(paper_affils: DataFrame, top_n: int | None = 30) -> DataFrame:
    """Distinct papers of each (institution, name, country); null keys are left out."""
    g = paper_affils.where("afid IS NOT NULL AND name IS NOT NULL AND country IS NOT NULL").groupBy("afid", "name", "country")
    g = g.agg(F.countDistinct("eid").alias("n_papers"), F.sum("citedby_count").alias("total_citations"), F.avg("citedby_count").alias("mean_citations"))
    g = g.orderBy(F.desc("n_papers"), F.desc("total_citations"), "afid", "name", "country")
    return g if top_n is None else g.limit(top_n)


def country_trends(paper_affils: DataFrame) -> DataFrame:
    """Papers by year and country, each country once per paper.

    Of a paper's rows with different years the first is meant; the earliest is
    taken, null years after all others, and papers left without a year are out.
    """
    once = paper_affils.where("country IS NOT NULL").groupBy("eid", "country").agg(F.min("year").alias("year"))
    return once.where("year IS NOT NULL").groupBy("year", "country").agg(F.count("*").alias("n_papers")).orderBy("year", "country")


def subfield_by_affil(paper_affils: DataFrame, long: DataFrame, top_n: int | None = 20) -> DataFrame:
    """Rows of each (institution name, label) after joining on the paper: by name, not id, and not distinct.

    A paper's affiliation rows and labels are counted per side before they
    meet, as every row of one side meets every row of the other.
    """
    affils = paper_affils.where("afid IS NOT NULL AND name IS NOT NULL").groupBy("eid", "name").agg(F.count("*").alias("a"))
    labels = long.where("subfield IS NOT NULL").groupBy("eid", "subfield").agg(F.count("*").alias("b"))
    g = affils.join(labels, "eid").groupBy("name", "subfield").agg(F.sum(F.col("a") * F.col("b")).alias("n_papers")).orderBy(F.desc("n_papers"), "name", "subfield")
    return g if top_n is None else g.limit(top_n)


def top_country_series(paper_affils: DataFrame, top_n: int = 8) -> DataFrame:
    """Yearly papers of the countries with most of them, one column each, 0 where none."""
    yearly = country_trends(paper_affils)
    top = yearly.groupBy("country").agg(F.sum("n_papers").alias("n")).orderBy(F.desc("n"), "country").limit(top_n)
    names = [r[0] for r in top.select("country").orderBy("country").collect()]
    return yearly.where(F.col("country").isin(names)).groupBy("year").pivot("country", names).agg(F.sum("n_papers")).na.fill(0).orderBy("year")


def compute_all(paper_authors: DataFrame, paper_affils: DataFrame, long: DataFrame) -> dict[str, DataFrame]:
    nodes, edges = coauthor_graph(paper_authors)
    return {
        "author_influence": author_influence(paper_authors),
        "affil_influence": affil_influence(paper_affils),
        "country_trends": country_trends(paper_affils),
        "subfield_by_affil": subfield_by_affil(paper_affils, long),
        "coauthor_centrality": centrality(nodes, edges),
    }
