import json

import pytest
from pyspark.sql import functions as F

from papertide import pipeline
from papertide.config import Settings
from papertide.functions import text as T
from papertide.functions import variant as V
from papertide.operators import annotate, cache, candidates, ingest, taxonomy
from papertide.schemas import ANNOTATION
from papertide.sources import tables

FULL = {
    "coredata": {"dc:identifier": "SCOPUS_ID:77", "prism:doi": "10/x", "dc:title": "Deep learning of texture", "dc:description": "We segment 120 patients in a multicenter study.", "prism:coverDate": "2021-03-01", "citedby-count": "12.7", "subtypeDescription": "Article", "openaccess": "1"},
    "authkeywords": {"author-keyword": [{"$": "CT"}, {"$": ""}, "MRI\t", None]},
    "idxterms": {"mainterm": {"$": "Brain"}},
    "subject-areas": {"subject-area": {"$": "Radiology", "@code": "27", "@abbrev": "MEDI"}},
    "authors": {"author": [{"@auid": "1", "ce:indexed-name": "A B.", "@seq": "1", "affiliation": {"@id": "f1"}}, {"@auid": "2", "preferred-name": {"ce:indexed-name": "C D."}, "@seq": "x", "affiliation": [{"@id": "f1"}, {"@id": "f2"}, "odd"]}, "odd"]},
    "affiliation": [{"@id": "f1", "affilname": "Clinic", "affiliation-country": "Z"}, {"@id": "f2", "affilname": "Lab", "affiliation-country": "A"}, {"@id": "f3", "affiliation-country": ""}],
    "item": {"bibrecord": {"tail": {"bibliography": {"@refcount": "n/a", "reference": [1, 2, 3]}}}},
}
ONE = {"coredata": {"dc:identifier": "SCOPUS_ID:78", "dc:title": "One", "prism:coverDate": "2024"}, "authkeywords": {"author-keyword": {"$": "solo"}}, "authors": {"author": {"@auid": "9", "ce:indexed-name": "", "preferred-name": {"ce:indexed-name": "P"}}}, "item": {"bibrecord": {"tail": {"bibliography": {"@refcount": "41", "reference": []}}}}}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("2-s2.0-77", json.dumps({ingest.ROOT: FULL})), ("2-s2.0-78", json.dumps({ingest.ROOT: ONE})), ("2-s2.0-79", json.dumps({"_error": "404"})), ("2-s2.0-80", None), ("2-s2.0-81", json.dumps({ingest.ROOT: {}}))]
    return spark.createDataFrame(rows, "eid string, body string").select("eid", F.try_parse_json("body").alias("payload"))


def test_records(raw):
    got = {r.eid: r for r in ingest.parse_records(raw).collect()}
    assert set(got) == {"2-s2.0-77", "2-s2.0-78", "2-s2.0-81"}
    a, b, c = got["2-s2.0-77"], got["2-s2.0-78"], got["2-s2.0-81"]
    assert a.author_keywords == ["CT", "MRI\t"] and a.index_terms == ["Brain"] and a.scopus_id == "77" and a.year == "2021"
    assert [(x.area, x.code) for x in a.subject_areas] == [("Radiology", "27")]
    assert [(x.auid, x.indexed_name, x.affil_ids) for x in a.authors] == [("1", "A B.", ["f1"]), ("2", "C D.", ["f1", "f2"])]
    assert (a.n_references, b.n_references, c.n_references) == (3, 41, None)
    assert b.author_keywords == ["solo"] and b.authors[0].indexed_name == "P" and b.affiliations == []
    assert c.authors == [] and c.title is None and c.year == "" and c.scopus_id == ""


def test_tidy_tables(raw):
    t = ingest.normalize(ingest.parse_records(raw), 2024)
    p = {r.eid: r for r in t["papers"].collect()}
    a = p["2-s2.0-77"]
    assert (a.year, a.citedby_count, a.years_since_pub, a.citations_per_year) == (2021, 12, 4, 3.0)
    assert a.countries == ["A", "Z"] and (a.n_authors, a.n_affiliations) == (2, 3) and a.subject_areas == ["Radiology"]
    assert p["2-s2.0-81"].years_since_pub is None and p["2-s2.0-81"].citedby_count == 0
    assert sorted((r.auid, r.seq) for r in t["paper_authors"].collect()) == [("1", 1), ("2", None), ("9", None)]
    assert sorted(r.keyword for r in t["paper_keywords"].collect()) == ["ct", "mri", "solo"]
    assert t["paper_affils"].count() == 3


def test_rich_fields(raw):
    got = {r.eid: r for r in ingest.rich_fields(raw).collect()}
    assert tuple(got["2-s2.0-77"])[1:] == (True, True, True, True, True)
    assert tuple(got["2-s2.0-78"])[1:] == (True, False, True, False, True)
    assert not got["2-s2.0-79"].ok and not got["2-s2.0-80"].ok


def test_candidates(spark):
    hits = [{"eid": "a", "dc:identifier": "SCOPUS_ID:1", "prism:coverDate": "2020-01-01", "citedby-count": "3", "dc:creator": "X"}, {"eid": "a", "dc:title": "again"}, {"dc:title": "no id"}, {"eid": "b", "citedby-count": "abc", "prism:coverDate": "n.d."}]
    df = spark.createDataFrame([(i, json.dumps(h)) for i, h in enumerate(hits)], "ord long, body string").select("ord", F.parse_json("body").alias("payload"))
    got = {r.eid: r for r in candidates.candidates(df).collect()}
    assert set(got) == {"a", "b"} and (got["a"].scopus_id, got["a"].year, got["a"].citedby_count, got["a"].title) == ("1", 2020, 3, None)
    assert (got["b"].year, got["b"].citedby_count) == (None, 0)


def test_legacy_window_ends_in_february(spark):
    """The window starts on the same day ten years before, which is not moved to the end of its month."""
    df = spark.createDataFrame([("1996-02-27",), ("1996-02-28",), ("1996-02-29",), ("2006-02-28",), ("2006-03-01",), (None,)], "cover_date string")
    assert [r[0] for r in candidates.legacy_window(df, "2006-02-28").orderBy("cover_date").collect()] == ["1996-02-28", "1996-02-29", "2006-02-28"]
    df = spark.createDataFrame([("1998-02-27",), ("1998-02-28",), ("2008-02-29",)], "cover_date string")
    assert [r[0] for r in candidates.legacy_window(df, "2008-02-29").orderBy("cover_date").collect()] == ["1998-02-28", "2008-02-29"]


def test_search_predicate(spark):
    s = Settings(as_of_year=2026)
    q = candidates.search_query(s)
    assert q.startswith("ISSN(0195-6108) AND PUBYEAR > 2016 AND PUBYEAR < 2027 AND TITLE-ABS-KEY(\"artificial intelligence\" OR ") and q.count(" OR ") == 16
    df = spark.createDataFrame([("a", 2017, "Machine learning", None, None), ("b", 2016, "machine learning", None, None), ("c", 2020, "none", "x", ["A TRANSFORMER"]), ("d", 2020, "no", "z", [])], "eid string, year int, title string, abstract string, author_keywords array<string>")
    assert {r.eid for r in candidates.matches_search(df, s).collect()} == {"a", "c"}


def test_legacy(spark):
    df = spark.createDataFrame([("a", 2024, 4, "CNN of it", None, "2024-05-01"), ("a", 2024, 4, "CNN of it", None, "2024-05-01"), ("b", 2015, 3, "plain", "no", "2015-01-01"), ("c", 2016, 6, None, "Radiomics", "2016-07-01")], "eid string, year int, citedby_count long, title string, description string, cover_date string")
    assert sorted(r.eid for r in candidates.legacy_relevant(df).collect()) == ["a", "a", "c"]
    assert sorted(r.eid for r in candidates.legacy_window(df, "2026-07-01").collect()) == ["a", "a", "c"]
    assert [tuple(r) for r in candidates.legacy_per_year(df, 2024).collect()][-1] == (2024, 2, 8, 4.0)


def test_scalar_expressions(spark):
    r = spark.range(1).select(
        T.strip_ws(F.lit(" \t a b \n")).alias("s"),
        T.id_of(F.lit("2-s2.0-85")).alias("i"),
        T.id_of(F.lit("")).alias("e"),
        T.bare_id(F.lit("SCOPUS_ID:5")).alias("b"),
        T.number(F.lit("12.7"), "int").alias("n"),
        T.number(F.lit("abc"), "int").alias("x"),
        T.year_of(F.lit(None).cast("string")).alias("y"),
        T.document_text(F.lit("T"), F.lit(None).cast("string")).alias("d"),
        F.length(T.content_hash("m", F.array(F.lit("a"), F.lit("b")))).alias("h"),
    ).first()
    assert tuple(r) == ("a b", "85", "", "5", 12, None, "", "T", 16)


@pytest.mark.parametrize(
    "raw,expected",
    [("true", True), ("0", False), ("2.5", True), ('"Yes "', True), ('"n"', False), ('"maybe"', None), ("null", None), ("[]", None), ('["yes", "no"]', True), ('{"a": 1}', None), (None, None)],
)
def test_to_bool(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "v string").select(V.to_bool(F.try_parse_json("v")).alias("b")).first().b is expected


def test_coercion(spark):
    answer = {"is_ai_relevant": ["yes"], "clinical_task": ["detection", "x"], "ai_methods": "one", "model_family": None, "sample_size": "12.7", "code_available": 0, "extra": 1, "anatomy": ["brain", None, 3], "data_available": True}
    df = spark.createDataFrame([("Sure: " + json.dumps(answer) + " done",), ("no json",), (json.dumps({"sample_size": True}),)], "raw string")
    a, b, c = df.select(*V.coerced(V.salvaged(F.col("raw")), ANNOTATION)).collect()
    assert (a.is_ai_relevant, a.clinical_task, a.ai_methods, a.model_family, a.sample_size, a.code_available, a.data_available) == (True, "detection", ["one"], [], 12, False, True)
    assert a.anatomy == ["brain", "3"] and a.external_validation is None
    assert b.ai_methods == [] and b.sample_size is None and c.sample_size is None
    assert V.kinds_of({"properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "string"}}}) == {"a": "integer", "b": "string"}


def test_rules_match_inside_words(spark):
    df = spark.createDataFrame([("Texture of an organ", None, None)], "title string, abstract string, author_keywords array<string>")
    text = taxonomy.classification_text(df)
    loose, strict = df.select(taxonomy.rule_labels(text).alias("a"), taxonomy.rule_labels(text, whole_words=True).alias("b")).first()
    assert loose == ["Large language models / NLP", "Generative / diffusion models"] and strict == []


@pytest.mark.parametrize("mode,expected", [("union", ["B", "a", "b"]), ("llm", ["B", "b"]), ("rules", ["a", "b"])])
def test_label_sets(spark, mode, expected):
    a, b = F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.array(F.lit("B"), F.lit("b"))
    assert spark.range(1).select(taxonomy.label_union(a, b, mode).alias("x")).first().x == expected


def test_relevance_keeps_unmarked(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False)], "eid int, is_ai_relevant boolean")
    assert sorted(r.eid for r in taxonomy.relevant(df).collect()) == [1, 2]
    assert taxonomy.relevant(df.select("eid")).count() == 3


def test_join_suffixes_collisions(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "eid string, year int")
    b = spark.createDataFrame([("x", 9, "s")], "eid string, year int, extra string")
    assert sorted(tuple(r) for r in annotate.joined(a, b).collect()) == [("x", 1, 9, "s"), ("y", 2, None, None)]


def test_cache(spark, tmp_path):
    c = cache.CacheTable(spark, f"file://{tmp_path}/cache")
    assert len(c) == 0
    c.append(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
    c.append(spark.createDataFrame([("a", "3")], "key string, value string"))
    assert {r.key: r.value for r in c.read().collect()} == {"a": "3", "b": "2"} and len(c) == 2
    wanted = spark.createDataFrame([("a",), ("z",)], "key string")
    assert [r.key for r in cache.missing(wanted, c.read()).collect()] == ["z"] and [r.key for r in cache.present(wanted, c.read()).collect()] == ["a"]


def test_answers_are_cached(spark, tmp_path):
    papers = spark.createDataFrame([("a", "T", "x"), ("b", "T", "x"), ("c", "U", None)], "eid string, title string, abstract string")
    c, rules = cache.CacheTable(spark, f"file://{tmp_path}/llm"), annotate.RuleAnnotator()
    c.append(annotate.answers(papers, rules, c.read()))
    assert len(c) == 2 and annotate.answers(papers, rules, c.read()).count() == 0
    assert annotate.extractions(papers, c.read(), rules.name).count() == 3


def test_room_left():
    said = "This model's maximum context length is {} tokens. However, you requested 8192 output tokens\nand your prompt contains at least {} input tokens"
    assert annotate.room_left(said.format(4096, 3000)) == 968
    assert annotate.room_left("other") is None and annotate.room_left(said.format(3100, 3000)) is None


def test_whole_pipeline(raw):
    r = pipeline.run_all(ingest.parse_records(raw), Settings(as_of_year=2024))
    doc = json.loads(r.facts.first().facts)
    assert doc["corpus_summary"]["total_papers"] == r.labeled.count() >= 1
    assert [y["year"] for y in doc["yearly"]] and doc["top_authors"]
    assert r.tables["subfields_all"].count() >= r.long.count()
    assert "| 2021 | 1 | 12 |" in pipeline.narrative(json.dumps(doc))
    for df in (*r.trends.values(), *r.influence.values()):
        df.collect()


def test_acquire_and_save(spark, tmp_path):
    asked = f"{tmp_path}/asked"

    def fetch(url, params):
        with open(asked, "a") as f:
            f.write(url + "\n")
        return (200, {}, json.dumps({ingest.ROOT: FULL})) if url.endswith("/77") else (404, {}, "gone")

    hits = spark.createDataFrame([(i, json.dumps({"eid": f"2-s2.0-{n}", "dc:identifier": f"SCOPUS_ID:{n}"})) for i, n in enumerate((77, 78, 77))], "ord long, payload string")
    store = cache.CacheTable(spark, f"file://{tmp_path}/cache")
    for _ in range(2):
        found, records = pipeline.acquire(hits, store, "u", fetch)
        assert found.count() == 2 and [r.title for r in records.collect()] == ["Deep learning of texture"]
    assert sorted(open(asked).read().split()) == ["u/77", "u/78"]
    results = pipeline.run_all(records, Settings(as_of_year=2024))
    names = pipeline.save_all(results, f"file://{tmp_path}/out")
    assert "papers_per_year" in names and "author_influence" in names and "keyword_bursts" not in names
    assert spark.read.parquet(f"file://{tmp_path}/out/tables/labeled.parquet").count() == 1
    assert (tmp_path / "out" / "report_facts.json").exists() and (tmp_path / "out" / "report.md").exists()


def test_legacy_report(spark, tmp_path):
    rows = [("a", 2020, "2020-01-01", 9, "Deep learning", None, "X", "1"), ("b", 2024, "2024-01-01", 8, "CNN", "", "Y", None), ("c", 2024, "2024-02-01", 50, "Bones", None, "Z", "3"), ("d", None, None, 7, "cnn", None, None, None), ("e", 2024, "2024-03-01", 0, "Radiomics", None, "Y", None)]
    found = spark.createDataFrame(rows, "eid string, year int, cover_date string, citedby_count long, title string, description string, authors string, doi string")
    report = candidates.legacy_report(found, 2024, 2)
    assert [r.eid for r in report["relevant_papers"].collect()] == ["b", "e", "a"]
    assert [tuple(r) for r in report["papers_per_year"].collect()] == [(2020, 1), (2024, 2)]
    assert [tuple(r) for r in report["citations_by_year"].collect()] == [(2020, 9), (2024, 8)]
    assert [r.title for r in report["most_cited"].collect()] == ["Deep learning", "CNN"]
    assert [(r.title, r.citations_per_year) for r in report["fastest_growing"].collect()] == [("CNN", 8.0), ("Deep learning", 1.8)]
    assert report["most_cited"].columns == ["year", "cover_date", "citedby_count", "citations_per_year", "title", "authors", "doi"]
    assert sorted(tables.save_csv(report, f"file://{tmp_path}", "legacy")) == sorted(report)
    assert spark.read.csv(f"file://{tmp_path}/legacy_most_cited.csv", header=True).count() == 2
    assert tables.save_csv(candidates.legacy_report(found.where("eid = 'c'"), 2024), f"file://{tmp_path}/none", "legacy") == ["all_papers"]
