"""Schemas of the engine's tables."""

from __future__ import annotations

CANDIDATES = "eid string, scopus_id string, doi string, title string, year int, cover_date string, first_author string, citedby_count bigint, subtype string, volume string, issue string, page_range string"
AUTHOR = "struct<auid:string,indexed_name:string,given_name:string,surname:string,seq:string,affil_ids:array<string>>"
AFFILIATION = "struct<afid:string,name:string,city:string,country:string>"
SUBJECT = "struct<area:string,code:string,abbrev:string>"
RECORDS = (
    "eid string, scopus_id string, doi string, title string, abstract string, year string, cover_date string, citedby_count string, subtype string, aggregation_type string, "
    f"author_keywords array<string>, index_terms array<string>, subject_areas array<{SUBJECT}>, authors array<{AUTHOR}>, affiliations array<{AFFILIATION}>, n_references int, openaccess string"
)
PAPERS = (
    "eid string, scopus_id string, doi string, title string, abstract string, year int, cover_date string, citedby_count bigint, subtype string, n_authors int, n_affiliations int, countries array<string>, "
    "n_references int, openaccess string, author_keywords array<string>, index_terms array<string>, subject_areas array<string>, years_since_pub int, citations_per_year double"
)
PAPER_AUTHORS = "eid string, year int, auid string, name string, seq int, citedby_count bigint"
PAPER_AFFILS = "eid string, year int, afid string, name string, country string, citedby_count bigint"
PAPER_KEYWORDS = "eid string, year int, keyword string"
SUBFIELDS_LONG = "eid string, year int, citedby_count bigint, citations_per_year double, subfield string"
CACHE = "key string, value string, ts double"
EMBEDDINGS = "eid string, vector array<float>, corpus string"

#: An annotation's fields by kind; extra fields are dropped, missing ones are null (lists: empty).
ANNOTATION = {
    "is_ai_relevant": "boolean",
    "clinical_task": "string",
    "ai_methods": "array",
    "model_family": "array",
    "imaging_modality": "array",
    "anatomy": "array",
    "disease": "array",
    "data_regime": "string",
    "sample_size": "integer",
    "external_validation": "boolean",
    "benchmarks_datasets": "array",
    "code_available": "boolean",
    "data_available": "boolean",
    "novelty_keywords": "array",
    "one_sentence_summary": "string",
}
SPARK_TYPE = {"boolean": "boolean", "string": "string", "array": "array<string>", "integer": "bigint"}
EXTRACTIONS = "eid string, " + ", ".join(f"{name} {SPARK_TYPE[kind]}" for name, kind in ANNOTATION.items())
