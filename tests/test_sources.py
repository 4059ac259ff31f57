import json

import pytest
from pyspark.sql import functions as F

from papertide.operators.cache import CacheTable
from papertide.sources import rest, tables
from papertide.streaming.incremental import ingest_new

ENTRIES = [{"eid": f"e{i}", "n": i} for i in range(7)]


def server(url, params):
    start, count = int(params["start"]), int(params["count"])
    entries = ENTRIES[start : start + count] or [{"error": "empty"}]
    return 200, {}, json.dumps({"search-results": {"opensearch:totalResults": str(len(ENTRIES)), "entry": entries}})


@pytest.mark.parametrize("count,most,expected", [(3, None, 7), (25, None, 7), (3, 4, 4), (7, None, 7), (3, 0, 0)])
def test_paging(count, most, expected):
    got = list(rest.search("u", "q", server, count, most, sleep=lambda s: None))
    assert got == ENTRIES[:expected]


def test_empty_search():
    nothing = lambda u, p: (200, {}, json.dumps({"search-results": {"opensearch:totalResults": "0", "entry": [{"error": "none"}]}}))
    assert list(rest.search("u", "q", nothing, sleep=lambda s: None)) == []


def test_retries():
    waits, answers = [], [OSError("down"), (429, {"Retry-After": "7"}, ""), (503, {}, ""), (200, {}, '{"a": 1}')]

    def flaky(url, params):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert rest.get("u", {}, flaky, sleep=waits.append) == {"a": 1} and waits == [1, 7.0, 4.0, 0.15]
    with pytest.raises(rest.ApiError) as e:
        rest.get("u", {}, lambda u, p: (404, {}, "gone"), sleep=waits.append)
    assert e.value.status == 404
    with pytest.raises(rest.ApiError):
        rest.get("u", {}, lambda u, p: (500, {}, "x"), sleep=lambda s: None)


class Local(rest.CitationSearch):
    @staticmethod
    def fetch(url, params):
        entries = [{"eid": f"e{i}"} for i in range(7)]
        start, count = int(params["start"]), int(params["count"])
        return 200, {}, json.dumps({"search-results": {"opensearch:totalResults": "7", "entry": entries[start : start + count] or [{"error": "x"}]}})

    @classmethod
    def name(cls):
        return "local_search"


def test_data_source(spark):
    spark.dataSource.register(Local)
    df = spark.read.format("local_search").option("url", "u").option("query", "q").option("pageSize", 3).option("maxResults", 5).load()
    assert [(r["ord"], json.loads(r.payload)["eid"]) for r in df.orderBy("ord").collect()] == [(i, f"e{i}") for i in range(5)]


def test_look_up_keeps_failures(spark):
    def fetch(url, params):
        return (200, {}, '{"ok": 1}') if url.endswith("/1") else (404, {}, "no")

    df = spark.createDataFrame([("sid:1", "1"), ("sid:2", "2")], "key string, scopus_id string")
    got = {r.key: json.loads(r.value) for r in rest.look_up(df, "u", fetch).collect()}
    assert got["sid:1"] == {"ok": 1} and "404" in got["sid:2"]["_error"]


def test_captured_pages(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"search-results": {"entry": ENTRIES[3 * k : 3 * k + 3] if k == 0 else [{"error": "end"}]}}))
    got = rest.captured(spark, f"file://{tmp_path}").orderBy("ord").collect()
    assert [json.loads(r.payload)["n"] for r in got] == [0, 1, 2]


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, ["a", "b"])], "eid int, xs array<string>")
    tables.save_tables({"papers": df}, path)
    assert tables.load_tables(spark, path, ("papers",))["papers"].first().xs == ["a", "b"]
    assert tables.save_csv({"one": df, "none": df.limit(0)}, path, "trend") == ["one"]
    assert spark.read.csv(f"{path}/trend_one.csv", header=True).first().xs == '["a","b"]'
    tables.save_json(df, f"{path}/j")
    assert spark.read.json(f"{path}/j").count() == 1
    facts = spark.createDataFrame([('{"a": 1}',)], "facts string")
    tables.save_facts(facts, f"{path}/report", "# text")
    assert json.loads(tables.load_facts(spark, f"{path}/report")) == {"a": 1}


def test_embeddings_by_corpus(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    for corpus in ("x", "y"):
        tables.save_embeddings(spark.createDataFrame([("e", [1.0])], "eid string, vector array<float>").withColumn("corpus", F.lit(corpus)), path)
    df = tables.load_embeddings(spark, path, "x")
    assert df.count() == 1 and "PartitionFilters: [isnotnull(corpus" in df._jdf.queryExecution().toString()


def test_incremental_ingest(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    c = CacheTable(spark, f"file://{tmp_path}/cache")
    line = lambda i, v: json.dumps({"eid": i, "payload": {"v": v}})
    (incoming / "a.jsonl").write_text("\n".join([line("1", 1), line("2", 1), "broken", line("1", 1)]))
    for _ in range(2):
        ingest_new(spark, f"file://{incoming}", c, f"file://{tmp_path}/cp").awaitTermination()
    (incoming / "b.jsonl").write_text("\n".join([line("2", 2), line("3", 2)]))
    ingest_new(spark, f"file://{incoming}", c, f"file://{tmp_path}/cp").awaitTermination()
    assert {r.key: json.loads(r.value)["v"] for r in c.read().collect()} == {"sid:1": 1, "sid:2": 1, "sid:3": 2}
