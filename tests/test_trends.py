import json
import math

import pytest
from pyspark.sql import functions as F

from papertide.operators import facts, trends

PAPERS = "eid string, title string, year int, citedby_count long, citations_per_year double, author_keywords array<string>, ai_methods array<string>"


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(
        [
            ("p1", "A", 2020, 10, 2.0, ["CT", " ct\t", "x", None], ["Net"]),
            ("p2", "B", 2020, 10, 2.25, [" MRI ", "ct"], None),
            ("p3", "C", 2021, 0, 0.0, [], ["Net", "net"]),
            ("p4", "D", 2023, 7, 3.5, ["mri", "MRI", "ct"], ["Net", ""]),
            ("p5", "E", None, 99, None, ["ct", "old"], ["Net"]),
            (None, "F", 2023, 1, 0.5, None, None),
        ],
        PAPERS,
    )


@pytest.fixture(scope="module")
def long(spark):
    rows = [("p1", 2020, "a"), ("p1", 2020, "b"), ("p2", 2020, "a"), ("p3", 2021, "b"), ("p4", 2023, "c"), ("p4", 2023, "a"), ("p9", 2024, "c"), ("p5", None, "a"), ("p5", 2023, None)]
    return spark.createDataFrame([(e, y, 5, 1.0, s) for e, y, s in rows], "eid string, year int, citedby_count long, citations_per_year double, subfield string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_papers_per_year(papers):
    assert rows(trends.papers_per_year(papers)) == [(2020, 2, 20, 10.0), (2021, 1, 0, 0.0), (2023, 1, 8, 4.0)]


def test_matrix_and_share(long, papers):
    assert rows(trends.subfield_year_matrix(long)) == [(2020, 2, 1, 0), (2021, 0, 1, 0), (2023, 1, 0, 1), (2024, 0, 0, 1)]
    share = {(r.year, r.subfield): r.share for r in trends.subfield_share(long, papers).collect()}
    assert len(share) == 12 and share[2020, "a"] == 1.0 and share[2020, "b"] == 0.5 and share[2024, "c"] == 0.0 and share[2021, "a"] == 0.0
    assert trends.subfield_share_matrix(long, papers).columns == ["year", "a", "b", "c"]


def test_growth_takes_the_later_middle_year_as_early(long):
    got = {r.subfield: r for r in trends.subfield_growth(long).collect()}
    # years 2020, 2021, 2023, 2024: the middle is 2023
    assert (got["a"].total, got["a"].early_count, got["a"].recent_count, got["a"].cagr) == (3, 3, 0, -1.0)
    assert got["c"].cagr is None and got["c"].recent_minus_early == 0
    assert [r.subfield for r in trends.subfield_growth(long).collect()] == ["c", "b", "a"]


def test_single_year_is_all_early(long):
    got = trends.subfield_growth(long.where("year = 2020")).collect()
    assert all(r.recent_count == 0 and r.early_count == r.total and r.cagr == 0.0 for r in got)


def test_growth_of_published_rates():
    assert math.isclose((6 / 2) ** (1 / 9) - 1, 0.12983, abs_tol=1e-5)


def test_emergence(papers):
    got = rows(trends.emergence(papers))
    # null years count but do not date; one-character terms are out; NBSP and tab are stripped
    assert got == [("mri", 2020, 2023, 3, 24), ("ct", 2020, 2023, 5, 136)] or got == [("ct", 2020, 2023, 5, 136), ("mri", 2020, 2023, 3, 24)]
    assert got[0][0] == "ct"


def test_term_trends_repeat_terms_in_both_directions(papers):
    got = trends.term_trends(papers, top_n=2).collect()
    # of the years 2020 and 2023 the middle is the later one, so all occurrences are early
    assert {(r.term, r.early, r.recent, r.delta, r.total) for r in got} == {("ct", 4, 0, -4, 4), ("mri", 3, 0, -3, 3)}
    assert [(r.term, r.direction) for r in got] == [("mri", "rising"), ("ct", "rising"), ("ct", "fading"), ("mri", "fading")]


def test_bursts_take_the_earliest_peak(papers):
    got = {r.term: r for r in trends.burst_detection(papers).collect()}
    assert (got["ct"].peak_year, got["ct"].peak_count, got["ct"].total) == (2020, 3, 4) and got["ct"].burst_score == 1.5
    assert got["mri"].peak_year == 2023 and "old" not in got


def test_top_cited_ties_by_id(papers):
    got = trends.top_cited_per_year(papers, 1)
    assert got.columns == ["year", "title", "citedby_count", "citations_per_year"]
    assert [(r.year, r.title) for r in got.collect()] == [(2020, "A"), (2021, "C"), (2023, "D")]


def test_hype_and_quadrants(long):
    got = {r.subfield: r for r in trends.impact_quadrants(long).collect()}
    assert got["a"].n_papers == 4 and {r.median_papers for r in got.values()} == {2.0}


def test_empty_tables_keep_columns(papers, long):
    none, nothing = papers.limit(0), long.limit(0)
    for name, df in trends.compute_all(none, nothing).items():
        assert df.count() == 0 and df.columns, name
    assert facts.corpus_summary(none).first().total_papers == 0
    assert facts.yearly_brief(none, nothing).count() == 0


def test_impact_by_term_is_literal(papers):
    got = rows(facts.impact_by_term(papers, "ai_methods"))
    assert got == [("Net", 4, 116, 29.0)]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([("e1", 1, 2.25, 2020), ("e2", 1, 0.0, 2020)], "eid string, citedby_count long, citations_per_year double, year int").selectExpr("*", "'t' AS title")
    assert facts.top_cited(df).first().citations_per_year == 2.2
    assert facts.corpus_summary(df).first().total_citations_age_adjusted == 2.2


def test_rigor_counts_null_as_false(spark):
    df = spark.createDataFrame([(2020, True, None), (2020, None, "multi_center"), (2020, False, "x"), (None, True, None)], "year int, code_available boolean, data_regime string")
    assert rows(facts.rigor_trend(df)) == [(2020, 3, 33.3, 33.3)]


def test_yearly_brief(papers, long):
    got = {r.year: r for r in facts.yearly_brief(papers, long).collect()}
    assert got[2020].top_subfields == {"a": 2, "b": 1} and [p.title for p in got[2020].top_cited] == ["A", "B"]
    assert got[2020].total_citations_age_adjusted == 4.2 and list(got) == [2020, 2021, 2023]


def test_facts_are_what_each_operator_gives(spark):
    """The document comes from shared sums; null years, terms and labels, and columns that are missing, change nothing."""
    rows = [(f"e{k}", f"T{k}", None if k % 9 == 0 else 2018 + k % 4, k % 7, (k % 7) / 3 if k % 9 else None, ["MRI ", "ct", None, "x", ""][: k % 6], ["cnn"] if k % 3 else None, k % 2 == 0 if k % 5 else None, "multi_center" if k % 4 else None) for k in range(40)]
    papers = spark.createDataFrame(rows, "eid string, title string, year int, citedby_count long, citations_per_year double, author_keywords array<string>, ai_methods array<string>, code_available boolean, data_regime string")
    labels = [(r[0], r[2], r[3], r[4], lab) for k, r in enumerate(rows) for lab in ["A", "B", None][: k % 4]]
    long = spark.createDataFrame(labels, "eid string, year int, citedby_count long, citations_per_year double, subfield string")
    authors = spark.createDataFrame([(r[0], r[2], "a", "A", 1, r[3]) for r in rows], "eid string, year int, auid string, name string, seq int, citedby_count long")
    affils = spark.createDataFrame([(r[0], r[2], "f", "F", "X", r[3]) for r in rows], "eid string, year int, afid string, name string, country string, citedby_count long")
    doc = json.loads(facts.facts(papers, long, authors, affils).first().facts)

    def plain(df):
        return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]

    assert [doc["corpus_summary"]] == plain(facts.corpus_summary(papers))
    assert doc["yearly"] == plain(facts.yearly_brief(papers, long))
    assert doc["subfield_growth"] == plain(trends.subfield_growth(long))
    assert doc["rigor_trend"] == plain(facts.rigor_trend(papers))
    assert doc["keyword_bursts"] == plain(trends.burst_detection(papers).limit(15))
    assert doc["emerging_keywords"] == plain(trends.emergence(papers).limit(20))
    assert doc["top_cited_overall"] == plain(facts.top_cited(papers).orderBy(F.desc("citations"), "title"))
    assert doc["impact_keywords"] == plain(facts.impact_by_term(papers, "author_keywords"))
    assert doc["impact_methods"] == plain(facts.impact_by_term(papers, "ai_methods"))
    hype = plain(trends.hype_vs_impact(long))
    assert [{k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.items()} for r in doc["hype_vs_impact"]] == hype
    assert "impact_benchmarks" not in doc and "impact_model_families" not in doc
