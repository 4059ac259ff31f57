"""From nested payloads to tidy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_id, length_of, number, sorted_distinct, strip_ws, year_of
from ..functions.variant import at, is_object, one_or_many, string_at, text_of

ROOT = "abstracts-retrieval-response"


def _texts(v: Column) -> Column:
    """Non-empty texts of a one-or-many value."""
    return F.filter(F.transform(one_or_many(v), text_of), lambda x: x.isNotNull() & (x != ""))


def _objects(v: Column) -> Column:
    return F.filter(one_or_many(v), is_object)


def _author(a: Column) -> Column:
    def name(key: str) -> Column:
        own = string_at(a, f"ce:{key}")
        return F.when(own != "", own).otherwise(string_at(a, "preferred-name", f"ce:{key}"))

    ids = F.transform(_objects(at(a, "affiliation")), lambda x: string_at(x, "@id"))
    return F.struct(string_at(a, "@auid").alias("auid"), name("indexed-name").alias("indexed_name"), name("given-name").alias("given_name"), name("surname").alias("surname"), string_at(a, "@seq").alias("seq"), ids.alias("affil_ids"))


def _references(bib: Column) -> Column:
    """The stated count, else the number of references; null without a bibliography."""
    there = is_object(bib) & (F.try_variant_get(bib, "$", "string") != "{}")
    return F.when(there, F.coalesce(number(string_at(bib, "@refcount"), "int"), F.size(one_or_many(at(bib, "reference")))))


def parse_records(raw: DataFrame) -> DataFrame:
    """``(eid, payload variant)`` to records; payloads that are null or carry an error marker are dropped."""
    payload = F.col("payload")
    # whole paths: a part of a payload that is taken out first is copied for each of its fields
    part = lambda *path: at(payload, ROOT, *path)
    data = lambda key: string_at(payload, ROOT, "coredata", key)
    ok = payload.isNotNull() & ~F.is_variant_null(payload) & at(payload, "_error").isNull()
    subject = lambda a: F.struct(text_of(a).alias("area"), string_at(a, "@code").alias("code"), string_at(a, "@abbrev").alias("abbrev"))
    affil = lambda a: F.struct(string_at(a, "@id").alias("afid"), string_at(a, "affilname").alias("name"), string_at(a, "affiliation-city").alias("city"), string_at(a, "affiliation-country").alias("country"))
    return raw.where(ok).select(
        "eid",
        bare_id(data("dc:identifier")).alias("scopus_id"),
        data("prism:doi").alias("doi"),
        data("dc:title").alias("title"),
        data("dc:description").alias("abstract"),
        year_of(data("prism:coverDate")).alias("year"),
        data("prism:coverDate").alias("cover_date"),
        data("citedby-count").alias("citedby_count"),
        data("subtypeDescription").alias("subtype"),
        data("prism:aggregationType").alias("aggregation_type"),
        _texts(part("authkeywords", "author-keyword")).alias("author_keywords"),
        _texts(part("idxterms", "mainterm")).alias("index_terms"),
        F.transform(_objects(part("subject-areas", "subject-area")), subject).alias("subject_areas"),
        F.transform(_objects(part("authors", "author")), _author).alias("authors"),
        F.transform(_objects(part("affiliation")), affil).alias("affiliations"),
        _references(part("item", "bibrecord", "tail", "bibliography")).alias("n_references"),
        data("openaccess").alias("openaccess"),
    )


def rich_fields(raw: DataFrame) -> DataFrame:
    """Whether a record came at all, and which of the full view's fields came with it."""
    payload, core = F.col("payload"), at(F.col("payload"), ROOT)
    ok = F.coalesce(is_object(payload) & at(payload, "_error").isNull(), F.lit(False))
    bib = at(core, "item", "bibrecord", "tail", "bibliography")
    return raw.select(
        "eid",
        ok.alias("ok"),
        (F.coalesce(string_at(core, "coredata", "dc:description"), F.lit("")) != "").alias("has_abstract"),
        at(core, "authkeywords").isNotNull().alias("has_author_keywords"),
        at(core, "affiliation").isNotNull().alias("has_affiliations"),
        (is_object(bib) & (F.coalesce(F.try_variant_get(bib, "$", "string"), F.lit("{}")) != "{}")).alias("has_references"),
    )


def by_doi(raw: DataFrame, doi: str) -> DataFrame:
    """The records of a DOI, in whatever case it is written."""
    return parse_records(raw).where(F.lower("doi") == doi.strip().lower())


def compare_views(full: DataFrame, meta: DataFrame) -> DataFrame:
    """Diagnostic: the abstract's length in two views of the same papers, and what the fuller one adds."""
    long = lambda df, name: df.select("eid", F.length(F.coalesce(string_at(F.col("payload"), ROOT, "coredata", "dc:description"), F.lit(""))).alias(name))
    return long(full, "full_length").join(long(meta, "meta_length"), "eid", "full_outer").withColumn("gained", F.coalesce("full_length", F.lit(0)) - F.coalesce("meta_length", F.lit(0)))


def normalize(records: DataFrame, as_of_year: int) -> dict[str, DataFrame]:
    """The tidy tables ``papers``, ``paper_authors``, ``paper_affils`` and ``paper_keywords``."""
    year, cites = number(F.col("year"), "int"), F.coalesce(number(F.col("citedby_count"), "bigint"), F.lit(0))
    base = records.withColumn("year", year).withColumn("citedby_count", cites)
    age = F.when(F.col("year").isNotNull(), F.greatest(F.lit(1), as_of_year - F.col("year") + 1))
    papers = base.select(
        "eid",
        "scopus_id",
        "doi",
        "title",
        "abstract",
        "year",
        "cover_date",
        "citedby_count",
        "subtype",
        length_of(F.col("authors")).alias("n_authors"),
        length_of(F.col("affiliations")).alias("n_affiliations"),
        sorted_distinct(F.transform("affiliations", lambda a: a["country"])).alias("countries"),
        "n_references",
        "openaccess",
        "author_keywords",
        "index_terms",
        F.transform("subject_areas", lambda a: a["area"]).alias("subject_areas"),
        age.alias("years_since_pub"),
        (F.col("citedby_count") / age).alias("citations_per_year"),
    )
    authors = base.select("eid", "year", "citedby_count", F.explode("authors").alias("a")).select("eid", "year", "a.auid", F.col("a.indexed_name").alias("name"), number(F.col("a.seq"), "int").alias("seq"), "citedby_count")
    affils = base.select("eid", "year", "citedby_count", F.explode("affiliations").alias("a")).select("eid", "year", "a.afid", "a.name", "a.country", "citedby_count")
    keywords = base.select("eid", "year", F.explode("author_keywords").alias("k")).select("eid", "year", F.lower(strip_ws(F.coalesce("k", F.lit("")))).alias("keyword"))
    return {"papers": papers, "paper_authors": authors, "paper_affils": affils, "paper_keywords": keywords}


def impact(papers: DataFrame, as_of_year: int) -> DataFrame:
    """Adds the age in years, one at least, and citations per year; null years give null."""
    age = F.when(F.col("year").isNotNull(), F.greatest(F.lit(1), as_of_year - F.col("year") + 1))
    return papers.withColumn("years_since_pub", age).withColumn("citations_per_year", F.col("citedby_count") / age)


def enrich(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates with the cached payload of their id, parsed; those not cached or failed are missing."""
    found = cache.select(F.regexp_replace("key", "^sid:", "").alias("scopus_id"), F.try_parse_json("value").alias("payload"))
    return parse_records(candidates.join(found, "scopus_id").select("eid", "payload"))
