"""A whole run with a model server that is made up, and what it leaves on disk."""

import json
import os

import numpy as np
import pytest

from papertide import pipeline
from papertide.config import ClusterSettings, Settings
from papertide.operators import annotate, cache, embed, ingest, taxonomy
from papertide.schemas import RECORDS
from papertide.sources import model_server, tables
from papertide.sources.model_server import ModelServer

FIELDS = [f.split()[0] for f in "eid, title, abstract, year, citedby_count, author_keywords".split(", ")]
GROUPS = [("Segmentation of lesions", "u-net finds tumors in mri scans", ["u-net"]), ("Chatbots for reports", "language models write text of findings", ["llm"]), ("Prognosis of stroke", "survival and recurrence after outcome prediction", ["stroke"])]


def server(asked):
    """Answers each kind of question and writes down that it was asked."""

    def post(url, body):
        system, user = (m["content"] for m in body["messages"])
        kind = "label" if "LABELS:" in user else "topic" if user.startswith("TERMS") else "report" if user.startswith("{") else "paper"
        with open(asked, "a") as f:
            f.write(kind + "\n")
        title = user.split("TITLE: ")[-1].split("\n")[0]
        answer = {
            "label": 'Sure: {"subfields": ["Multimodal AI", null]}' if "Chatbots" in title else "none",
            "topic": json.dumps({"label": "Named " + user.split("TERMS: ")[-1].split(",")[0], "summary": "It is."}),
            "report": "# Report of " + body["model"],
            "paper": json.dumps({"is_ai_relevant": "stroke 2" not in title, "ai_methods": ["seen " + user.split("KEYWORDS: ")[-1]], "sample_size": 5}),
        }[kind]
        if body.get("stream"):
            return 200, "\n".join(f"data: {json.dumps({'choices': [{'delta': {'content': c}}]})}" for c in answer) + "\ndata: [DONE]\n"
        return 200, json.dumps({"choices": [{"message": {"content": answer}}]})

    return post


@pytest.fixture
def records(spark):
    rows = [(f"2-s2.0-{g}{i}", f"{title} {i}", f"{abstract} {i % 3}", str(2015 + i % 5), str(i), words) for g, (title, abstract, words) in enumerate(GROUPS) for i in range(8)]
    given = spark.createDataFrame(rows, "eid string, title string, abstract string, year string, citedby_count string, author_keywords array<string>")
    others = [f for f in spark.createDataFrame([], RECORDS).schema if f.name not in FIELDS]
    from pyspark.sql import functions as F

    return given.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in others))


def test_run_with_models(spark, records, tmp_path):
    asked = f"{tmp_path}/asked"
    post = server(asked)
    model, other = ModelServer("u", "one", post), ModelServer("u", "two", post)
    store = cache.CacheTable(spark, f"file://{tmp_path}/answers")
    settings = Settings(as_of_year=2020, cluster=ClusterSettings(min_cluster_size=4))
    run = lambda: pipeline.run_all(records, settings, model, model, embed.HashingEncoder(32), model, {"report_one": model, "report_two": other}, store, f"file://{tmp_path}/vectors")
    r = run()
    got = {x.eid: x for x in r.labeled.collect()}
    assert len(got) == 23 and "2-s2.0-22" not in got
    assert all(("Multimodal AI" in x.subfields) == e.startswith("2-s2.0-1") for e, x in got.items())
    assert got["2-s2.0-00"].ai_methods == ["seen u-net"] and got["2-s2.0-00"].subfields_rule and got["2-s2.0-00"].subfields_llm == []
    assert r.tables["extractions"].count() == 24
    topics = r.topics.collect()
    assert {x.eid for x in topics} == set(got) and {x.topic for x in topics if x.topic >= 0}
    summary = r.topic_summary.collect()
    assert sum(s.n_papers for s in summary) == 23 and all(s.label.startswith("Named ") == (s.topic >= 0) for s in summary)
    assert {x.topic_label for x in topics} == {s.label for s in summary}
    assert r.embeddings.count() == 23 and r.reports == {"report_one": "# Report of one", "report_two": "# Report of two"}
    first = open(asked).read().split()
    assert first.count("paper") == first.count("label") == 24 and first.count("report") == 2

    os.remove(asked)
    again = run()
    assert set(open(asked).read().split()) == {"report"}
    assert again.topic_summary.collect() == summary and sum(x.startswith("corpus=") for x in os.listdir(f"{tmp_path}/vectors")) == 1

    out = f"file://{tmp_path}/out"
    pipeline.save_all(r, out)
    left = set(os.listdir(f"{tmp_path}/out/tables"))
    assert {"extractions.parquet", "labeled.parquet", "topics.parquet", "topics.csv", "topic_summary.parquet", "topic_summary.csv", "topic_map.parquet", "embeddings.parquet", "subfields_all.parquet"} <= left
    assert spark.read.parquet(f"{out}/tables/topic_map.parquet").columns == ["eid", "title", "year", "citedby_count", "umap_x", "umap_y", "topic", "topic_label"]
    assert {"report.md", "report_facts.json", "report_one.md", "report_two.md"} <= set(os.listdir(f"{tmp_path}/out"))
    assert pipeline.report_again(spark, out, "report_three", other) == "# Report of two"
    assert (tmp_path / "out" / "report_three.md").exists()


@pytest.mark.parametrize("mode,expected", [("rules", False), ("llm", True), ("union", True)])
def test_label_modes(spark, records, tmp_path, mode, expected):
    papers = ingest.normalize(records, 2020)["papers"]
    labels = taxonomy.annotated_labels(papers, ModelServer("u", "m", server(f"{tmp_path}/asked")))
    out = {x.eid: x.subfields for x in taxonomy.assign_subfields(papers, labels, mode=mode).collect()}
    assert ("Multimodal AI" in out["2-s2.0-10"]) == expected
    assert bool(out["2-s2.0-00"]) == (mode != "llm")


def test_keys_follow_the_prompt(spark):
    a, b = ModelServer("u", "m", None), ModelServer("u", "m", None, max_tokens=7)
    df = spark.createDataFrame([("t", "a", ["k"]), ("t", "a", ["l"]), ("t", "a", None)], "title string, abstract string, author_keywords array<string>")
    keys = [r.k for m in (a, b) for kind in ("annotation", "labels") for r in df.select(annotate.prompt_key(m, df, kind).alias("k")).collect()]
    assert len(set(keys)) == 12


def test_known_answers_and_streams():
    bodies = []

    def post(url, body):
        bodies.append(body)
        return 200, 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{}}]}\ndata: [DONE]' if body.get("stream") else json.dumps({"choices": [{"message": {"content": "whole"}}]})

    m = ModelServer("u", "m", post, known={})
    assert m.narrate("{}") == m.narrate("{}") == "a" and len(bodies) == 1 and bodies[0]["stream"]
    assert m.narrate("{}", force=True) == "a" and len(bodies) == 2
    assert m.chat([{"role": "user", "content": "x"}]) == "whole" and len(m.known) == 2


def test_second_model(monkeypatch):
    monkeypatch.delenv("SECOND_MODEL_URL", raising=False)
    assert model_server.second_model() is None
    monkeypatch.setenv("SECOND_MODEL_URL", "v/")
    monkeypatch.setenv("SECOND_MODEL_NAME", "n")
    m = model_server.second_model()
    assert (m.base_url, m.name, m.max_tokens) == ("v", "n", 8192)


def test_pooled_encoder():
    vectors = np.arange(20).reshape(10, 2)
    load = lambda: (lambda texts: [[int(w) for w in t.split()] for t in texts], lambda ids, mask: vectors[ids])
    mean = embed.PooledEncoder("toy", load, most_tokens=3).encode(["1 2 3 9 9", "4", ""])
    assert np.allclose(mean, [vectors[[1, 2, 3]].mean(0), vectors[4], [0, 0]])
    assert np.allclose(embed.PooledEncoder("toy", load, pooling="first").encode(["5 1", ""]), [vectors[5], [0, 0]])


def test_vectors_are_encoded_once(spark, tmp_path):
    class Counting(embed.HashingEncoder):
        def encode(self, texts):
            with open(f"{tmp_path}/n", "a") as f:
                f.write("x" * len(texts))
            return super().encode(texts)

    df = spark.createDataFrame([(str(i), f"t{i}", None) for i in range(6)], "eid string, title string, abstract string")
    for _ in range(2):
        assert embed.embed_once(df, Counting(8), f"file://{tmp_path}/v").count() == 6
    assert len(open(f"{tmp_path}/n").read()) == 6
    assert embed.embed_once(df.limit(3), Counting(8), f"file://{tmp_path}/v").count() == 3


def test_views_and_dois(spark):
    record = lambda text, doi: json.dumps({ingest.ROOT: {"coredata": {"dc:description": text, "prism:doi": doi}}})
    from pyspark.sql import functions as F

    make = lambda rows: spark.createDataFrame(rows, "eid string, p string").select("eid", F.try_parse_json("p").alias("payload"))
    full, meta = make([("a", record("long text", "10.1/AB")), ("b", record(None, "x"))]), make([("a", record("lo", None)), ("c", record("z", None))])
    assert sorted(map(tuple, ingest.compare_views(full, meta).collect())) == [("a", 9, 2, 7), ("b", 0, None, 0), ("c", None, 1, -1)]
    assert [r.eid for r in ingest.by_doi(full, " 10.1/ab ").collect()] == ["a"]


def test_json_array(spark, tmp_path):
    tables.save_json(spark.createDataFrame([(1, None), (2, ["a"])], "i int, l array<string>"), f"file://{tmp_path}/j", array=True)
    part = next(f for f in os.listdir(f"{tmp_path}/j") if f.startswith("part"))
    assert json.load(open(f"{tmp_path}/j/{part}")) == [{"i": 1, "l": None}, {"i": 2, "l": ["a"]}]
