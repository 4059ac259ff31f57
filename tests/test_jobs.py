"""The jobs, by runs over growing and changing input."""

import hashlib
import json
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import label_corpus, queries, trend_report

SEEDS = {"Learning": ["deep learning", "neural"], "Text": ["text", "texture"]}
CONFIG = {"taxonomy": SEEDS, "whole_words": False, "bytes_per_batch": 1 << 30}
FIRST = [(1, "Deep Learning of texture", "en", "a"), (2, None, "de", "b"), (3, "nothing here", None, None), (4, "", "en", "a")]
MORE = [(5, "NEURAL text", "en", "c"), (1, "deep learning again", "fr", "a"), (None, "text", "en", "a"), (6, "nichts", "es", "a")]


def put(spark, rows, path):
    spark.createDataFrame([(*r, 0) for r in rows], label_corpus.TEXTS).coalesce(1).write.mode("append").parquet(path)


def labels_of(text):
    return [k for k, seeds in sorted(SEEDS.items()) if any(s in (text or "").lower() for s in seeds)]


def expected(rows):
    docs = sorted(((i, s, len((t or "").split()), None if t is None else hashlib.sha256(t.encode()).hexdigest(), labels_of(t), g) for i, t, g, s in rows), key=str)
    counts = {}
    for _, _, n, _, found, g in docs:
        for label in found or [label_corpus.UNLABELLED]:
            k, words = counts.get((g, label), (0, 0))
            counts[g, label] = (k + 1, words + n)
    return docs, counts


def state(spark, out):
    docs = sorted((tuple(r) for r in label_corpus.read_documents(spark, out).select("doc_id", "source", "n_words", "text_hash", "labels", "lang").collect()), key=str)
    return docs, {(r.lang, r.label): (r.n_docs, r.n_words) for r in label_corpus.label_counts(spark, out).collect()}


def files_of(root, what):
    return {str(p): p.stat().st_mtime_ns for p in Path(root, what).rglob("*.parquet")}


def test_only_what_is_new_is_taken(spark, tmp_path, caplog):
    caplog.set_level("INFO", "jobs.label_corpus")
    incoming, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, FIRST, incoming)
    before = dict(spark.conf.getAll)
    label_corpus.run(spark, incoming, out, CONFIG)
    assert state(spark, out) == expected(FIRST)
    assert "read 4 new documents" in caplog.text and "wrote 4 documents" in caplog.text
    assert dict(spark.conf.getAll) == before

    first = files_of(tmp_path, "out/documents")
    label_corpus.run(spark, incoming, out, CONFIG)
    assert files_of(tmp_path, "out/documents") == first and "read 0 new documents" in caplog.text

    put(spark, MORE, incoming)
    label_corpus.run(spark, incoming, out, CONFIG)
    assert state(spark, out) == expected(FIRST + MORE)
    assert first.items() <= files_of(tmp_path, "out/documents").items()

    once = f"file://{tmp_path}/once"
    label_corpus.run(spark, incoming, once, CONFIG)
    assert state(spark, once) == expected(FIRST + MORE)


def test_a_batch_is_repeated_without_a_trace(spark, tmp_path):
    incoming, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in (FIRST, MORE):
        put(spark, rows, incoming)
        label_corpus.run(spark, incoming, out, CONFIG)
    before = state(spark, out)
    # as if the last batch had been written, but the run had ended before it was noted
    for name in ("1", ".1.crc"):
        (tmp_path / "out/checkpoint/commits" / name).unlink(missing_ok=True)
    label_corpus.run(spark, incoming, out, CONFIG)
    assert state(spark, out) == before == expected(FIRST + MORE)


def test_small_batches_and_the_taxonomy_of_the_library(spark, tmp_path):
    incoming, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for row in FIRST + MORE:
        put(spark, [row], incoming)
    label_corpus.run(spark, incoming, out, {**CONFIG, "bytes_per_batch": 1})
    assert state(spark, out) == expected(FIRST + MORE)
    assert len(list((tmp_path / "out/documents").glob("batch=*"))) == len(FIRST + MORE)
    label_corpus.run(spark, incoming, f"{out}2")
    assert "Foundation models / self-supervised" not in {k for _, k in state(spark, f"{out}2")[1]}
    assert "Large language models / NLP" in {k for _, k in state(spark, f"{out}2")[1]}


def test_files_without_rows(spark, tmp_path):
    put(spark, [], f"file://{tmp_path}/in")
    label_corpus.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", CONFIG)
    put(spark, FIRST, f"file://{tmp_path}/in")
    label_corpus.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", CONFIG)
    assert state(spark, f"file://{tmp_path}/out") == expected(FIRST)


@pytest.fixture
def tidy(spark, tmp_path):
    d = f"file://{tmp_path}/tables"

    def write(papers):
        spark.createDataFrame(papers, "eid string, title string, year int, citedby_count long, author_keywords array<string>").write.mode("overwrite").parquet(f"{d}/papers.parquet")
        spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "Y"), ("b", "X"), ("n", "Y")], "eid string, subfield string").write.mode("overwrite").parquet(f"{d}/paper_labels.parquet")
        spark.createDataFrame([("a", "P"), ("a", "P"), ("b", "Q"), ("b", "P"), ("c", None)], "eid string, country string").write.mode("overwrite").parquet(f"{d}/paper_affils.parquet")
        return d

    return write


PAPERS = [("a", "A", 2000, 10, [" Deep ", "x", "mri"]), ("b", "B", 2000, 4, ["deep", None]), ("c", "C", 2001, 7, None), ("n", "N", None, 99, ["deep"])]


def report(spark, out):
    return {(r.report, r.year, r.item, r.measure): r.value for r in trend_report.read_report(spark, out).collect()}


def test_report(spark, tidy, tmp_path, caplog):
    caplog.set_level("INFO", "jobs.trend_report")
    out = f"file://{tmp_path}/report"
    config = {**trend_report.settings(), "top_cited": 1}
    trend_report.run(spark, tidy(PAPERS), out, config)
    got = report(spark, out)
    assert got == {
        ("volume", 2000, "all papers", "n_papers"): 2,
        ("volume", 2000, "all papers", "total_citations"): 14,
        ("volume", 2000, "all papers", "mean_citations"): 7,
        ("volume", 2001, "all papers", "n_papers"): 1,
        ("volume", 2001, "all papers", "total_citations"): 7,
        ("volume", 2001, "all papers", "mean_citations"): 7,
        ("subfields", 2000, "X", "n_papers"): 2,
        ("subfields", 2000, "X", "share"): 1,
        ("subfields", 2000, "X", "mean_citations"): 7,
        ("subfields", 2000, "Y", "n_papers"): 1,
        ("subfields", 2000, "Y", "share"): 0.5,
        ("subfields", 2000, "Y", "mean_citations"): 10,
        ("subfields", 2001, "X", "n_papers"): 0,
        ("subfields", 2001, "X", "share"): 0,
        ("subfields", 2001, "Y", "n_papers"): 0,
        ("subfields", 2001, "Y", "share"): 0,
        ("countries", 2000, "P", "n_papers"): 2,
        ("countries", 2000, "Q", "n_papers"): 1,
        ("keywords", 2000, "deep", "n_uses"): 2,
        ("keywords", 2000, "deep", "total_citations"): 14,
        ("keywords", 2000, "mri", "n_uses"): 1,
        ("keywords", 2000, "mri", "total_citations"): 10,
        ("top_cited", 2000, "A", "citedby_count"): 10,
        ("top_cited", 2000, "A", "citations_per_year"): 10 / 3,
        ("top_cited", 2001, "C", "citedby_count"): 7,
        ("top_cited", 2001, "C", "citations_per_year"): 3.5,
    }
    assert f"wrote {len(got)} rows of 5 reports" in caplog.text and "reading 4 rows of" in caplog.text
    trend_report.run(spark, tidy(PAPERS), out, config)
    assert report(spark, out) == got
    trend_report.run(spark, tidy(PAPERS[:2]), out, config)
    left = report(spark, out)
    assert left == {k: v for k, v in got.items() if k[1] == 2000}


def test_only_the_years_asked_for_are_read(spark, tidy, tmp_path):
    out = f"file://{tmp_path}/report"
    trend_report.run(spark, tidy(PAPERS), out)
    plan = trend_report.read_report(spark, out).where("report = 'volume' AND year = 2001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report" in plan


def test_two_calls_do_not_meet(spark):
    assert queries._folder(spark, "x") != queries._folder(spark, "x")


@pytest.mark.parametrize("job", ["label_corpus", "trend_report"])
def test_command_line(job, tmp_path):
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--help"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "--config" in done.stdout
    assert json.loads((root / f"jobs/{job}.json").read_text())


def test_texts_are_lower_cased_once(spark):
    texts = spark.createDataFrame([(1, "A Chatbot", "en", "s", 9)], label_corpus.TEXTS)
    out = label_corpus.labelled(texts, label_corpus.settings())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "chatbot" in plan


def test_labels_are_shuffled_once(spark):
    papers = spark.createDataFrame([(1, "t", 2000, 5)], "eid long, title string, year int, citedby_count long")
    terms = spark.createDataFrame([(1, ["a b"])], "eid long, author_keywords array<string>")
    labels = spark.createDataFrame([(1, "x"), (1, "x")], "eid long, subfield string")
    places = spark.createDataFrame([(1, "y"), (1, "y")], "eid long, country string")
    wide = trend_report.reports(papers, terms, labels, places, 2002, 3)
    for report, column in (("subfields", "subfield"), ("countries", "country")):
        plan = wide[report]._jdf.queryExecution().executedPlan().toString()
        assert f", {column}#" not in "".join(x for x in plan.split("hashpartitioning(eid#")[1:] for x in [x.split(")")[0]])
        assert [r.n_papers for r in wide[report].collect()] == [1]
