import json

import numpy as np
import pytest

from papertide.operators import embed, vectors
from papertide.sources.model_server import ModelServer, json_schema


def answering(*answers):
    asked, left = [], list(answers)

    def post(url, body):
        asked.append((url, body))
        a = left.pop(0)
        return (200, json.dumps({"choices": [{"message": {"content": a}}]})) if isinstance(a, str) else a

    return asked, post


def test_chat_refits_once():
    said = "maximum context length is 1000 tokens. your prompt contains at least 500 input tokens"
    asked, post = answering((400, said), "fine")
    assert ModelServer("u/", "m", post).chat([{"role": "user", "content": "x"}]) == "fine"
    assert [b["max_tokens"] for _, b in asked] == [1536, 372] and asked[0][0] == "u/chat/completions"
    with pytest.raises(RuntimeError):
        ModelServer("u", "m", answering((400, said), (400, said))[1]).chat([])
    with pytest.raises(RuntimeError):
        ModelServer("u", "m", answering((400, "other"))[1]).chat([])


def test_annotator_keeps_order():
    server = ModelServer("u", "m", lambda url, body: (200, json.dumps({"choices": [{"message": {"content": body["messages"][1]["content"].split("\n")[0]}}]})))
    assert server.annotate([{"title": f"t{i}"} for i in range(20)]) == [f"TITLE: t{i}" for i in range(20)]


def test_schema_and_health():
    s = json_schema()
    assert len(s["properties"]) == 15 and len(s["required"]) == 14 and s["properties"]["sample_size"]["type"] == ["integer", "null"]
    assert ModelServer("u", "m", lambda url, body: (200, "{}")).health()

    def down(url, body):
        raise OSError

    assert not ModelServer("u", "m", down).health()
    assert ModelServer("u", "m", answering('so: {"label": "L", "summary": "S"}')[1]).name_topic(["a"], ["b"]) == {"label": "L", "summary": "S"}
    assert ModelServer("u", "m", answering("# Report")[1]).narrate("{}") == "# Report"


def test_embed(spark):
    df = spark.createDataFrame([("a", "Deep nets", "of the brain"), ("b", None, None), ("c", "Deep nets", "of the brain")], "eid string, title string, abstract string").repartition(2)
    got = {r.eid: np.array(r.vector) for r in embed.embed(df, embed.HashingEncoder()).collect()}
    assert np.allclose(got["a"], got["c"]) and np.isclose(np.linalg.norm(got["a"]), 1) and not got["b"].any()
    assert embed.corpus_key(df, "m") == embed.corpus_key(df.repartition(3), "m") != embed.corpus_key(df, "n")
    assert embed.corpus_key(df.limit(2), "m") != embed.corpus_key(df, "m")

    class Broken:
        name = "broken"

        def encode(self, texts):
            raise ImportError

    assert len(embed.Fallback(Broken(), embed.HashingEncoder(8)).encode(["x"])[0]) == 8


def test_relabelled(spark):
    summary = spark.createDataFrame([(-1, "Outliers", "", 9), (0, "Topic 0", "a", 5)], "topic int, label string, summary string, n_papers int")
    names = spark.createDataFrame([(-1, "no", "no"), (0, "Nets", "About nets")], "topic int, label string, summary string")
    assert [tuple(r) for r in vectors.relabelled(summary, names).collect()] == [(-1, "Outliers", "", 9), (0, "Nets", "About nets", 5)]
