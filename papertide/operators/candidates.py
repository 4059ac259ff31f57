"""The search predicate, locally and as a query string, and candidate papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEGACY_TERMS, Settings
from ..functions.text import bare_id, number, year_of


#: Columns of the older script's top lists.
LEGACY_COLUMNS = ("year", "cover_date", "citedby_count", "citations_per_year", "title", "authors", "doi")


def search_query(settings: Settings) -> str:
    """What the search source is asked for."""
    first = settings.as_of_year - settings.years_back + 1
    terms = " OR ".join(f'"{t}"' for t in settings.search_terms)
    return f"ISSN({settings.issn}) AND PUBYEAR > {first - 1} AND PUBYEAR < {settings.as_of_year + 1} AND TITLE-ABS-KEY({terms})"


def mentions(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether the lower-cased text has any of the terms, also inside words."""
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(F.lower(text), F.lit(t.lower()))
    return found


def matches_search(df: DataFrame, settings: Settings) -> DataFrame:
    """The same predicate over local rows with year, title, abstract and author_keywords."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.array_join(F.coalesce("author_keywords", F.array().cast("array<string>")), " "))
    return df.where(F.col("year").between(settings.as_of_year - settings.years_back + 1, settings.as_of_year) & mentions(text, settings.search_terms))


def candidates(hits: DataFrame) -> DataFrame:
    """One row per paper id from search hits ``(payload variant, ord bigint)``: the first hit of each id; hits without one are left out."""

    def text(key: str) -> Column:
        return F.try_variant_get("payload", f"$['{key}']", "string")

    rows = hits.select(
        "ord",
        text("eid").alias("eid"),
        bare_id(text("dc:identifier")).alias("scopus_id"),
        text("prism:doi").alias("doi"),
        text("dc:title").alias("title"),
        number(year_of(text("prism:coverDate")), "int").alias("year"),
        text("prism:coverDate").alias("cover_date"),
        text("dc:creator").alias("first_author"),
        F.coalesce(number(text("citedby-count"), "bigint"), F.lit(0)).alias("citedby_count"),
        text("subtypeDescription").alias("subtype"),
        text("prism:volume").alias("volume"),
        text("prism:issueIdentifier").alias("issue"),
        text("prism:pageRange").alias("page_range"),
    )
    return first_of_each(rows.where("eid IS NOT NULL"), "eid", "ord").drop("ord")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order; partial results are one row per key, so no key is gathered."""
    names = df.columns
    return df.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("row")).select("row.*")


def legacy_relevant(df: DataFrame) -> DataFrame:
    """The older script's filter over title and description; duplicates stay."""
    return df.where(mentions(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))), LEGACY_TERMS))


def legacy_window(df: DataFrame, as_of: str) -> DataFrame:
    """Papers of the ten years up to a day, by their full date; both ends count, and 29 February goes back to the 28th."""
    day = F.lit(as_of).cast("date")
    return df.where(F.to_date("cover_date").between(F.add_months(day, -120), day))


def legacy_per_year(df: DataFrame, as_of_year: int) -> DataFrame:
    """Per year papers, citations, and citations per year of age without a lower bound; an age of 0 gives null."""
    age = F.lit(as_of_year) - F.col("year") + 1
    return df.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n_papers"), F.sum("citedby_count").alias("total_citations"), F.avg(F.try_divide(F.col("citedby_count"), age)).alias("mean_citations_per_year")).orderBy("year")


def legacy_top(df: DataFrame, by: str = "citedby_count", n: int = 25) -> DataFrame:
    return df.orderBy(F.desc(by), "eid").limit(n)


def legacy_scored(df: DataFrame, as_of_year: int) -> DataFrame:
    """Dated papers with citations per year of age, without a lower bound; an age of 0 gives null."""
    return df.where("year IS NOT NULL").withColumn("citations_per_year", F.try_divide(F.col("citedby_count"), F.lit(as_of_year) - F.col("year") + 1))


def legacy_report(found: DataFrame, as_of_year: int, n: int = 25) -> dict[str, DataFrame]:
    """The older script's six tables; ``sources.tables.save_csv`` writes those that have rows.

    ``found`` has the columns of LEGACY_COLUMNS and ``eid``, ``title`` and
    ``description``.  Without a relevant paper only ``all_papers`` has rows.
    """
    kept = legacy_scored(legacy_relevant(found), as_of_year)
    per_year = legacy_per_year(kept, as_of_year)
    top = lambda by: legacy_top(kept, by, n).select(*LEGACY_COLUMNS)
    return {
        "all_papers": found,
        "relevant_papers": kept.orderBy(F.desc("year"), F.desc("citedby_count"), "eid"),
        "papers_per_year": per_year.select("year", "n_papers"),
        "citations_by_year": per_year.select("year", "total_citations"),
        "most_cited": top("citedby_count"),
        "fastest_growing": top("citations_per_year"),
    }
