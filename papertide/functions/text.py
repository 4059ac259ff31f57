"""Strings and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_ws(c: Column) -> Column:
    """Strips every kind of white space; ``trim`` knows only the space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def number(c: Column, kind: str) -> Column:
    """Numbers from text: whatever is no number is null, fractions are cut off."""
    return c.try_cast("double").cast(kind)


def year_of(cover_date: Column) -> Column:
    return F.left(F.coalesce(cover_date, F.lit("")), F.lit(4))


def id_of(eid: Column) -> Column:
    """The part after the last dash; an empty id stays empty."""
    return F.element_at(F.split(F.coalesce(eid, F.lit("")), "-"), -1)


def bare_id(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("SCOPUS_ID:"), F.lit(""))


def sorted_distinct(c: Column) -> Column:
    """Distinct non-empty values in code point order."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def length_of(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def exploded(df: DataFrame, col: str, as_: str, *keep: str) -> DataFrame:
    """One row for each element that is not null."""
    return df.select(*keep, F.explode(col).alias(as_)).where(F.col(as_).isNotNull())


def terms(df: DataFrame, col: str) -> DataFrame:
    """``(eid, year, citedby_count, term)``: elements stripped and lower-cased, those of one character left out."""
    return exploded(df, col, "term", "eid", "year", "citedby_count").withColumn("term", F.lower(strip_ws(F.col("term").cast("string")))).where(F.length("term") > 1)


def document_text(title: Column, abstract: Column) -> Column:
    """What is embedded: title, blank line, abstract."""
    return strip_ws(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(abstract, F.lit(""))))


def content_hash(model: str, texts: Column) -> Column:
    """The first 16 hex digits over the model's name and all texts, in the array's order."""
    return F.left(F.sha2(F.concat(F.lit(model), F.array_join(texts, "", "")), 256), F.lit(16))
