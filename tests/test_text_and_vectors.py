import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertide.operators import cells, text, vectors


def plain_ctfidf(docs, stop=()):
    import re
    from collections import Counter, defaultdict

    words = defaultdict(list)
    for c, _, t in sorted(docs, key=lambda d: d[1]):
        words[c] += [w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop]
    tf = {c: Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:])) for c, w in words.items() if w}
    df = Counter(t for c in tf.values() for t in c)
    return {(c, t): n / sum(x.values()) * math.log(1 + len(tf) / df[t]) for c, x in tf.items() for t, n in x.items()}


def test_ctfidf(spark):
    rng = np.random.default_rng(2)
    docs = [(int(rng.integers(-1, 3)), i, " ".join(rng.choice(["Brain", "über", "the", "x", "scan_2", "of"], int(rng.integers(0, 6))))) for i in range(60)]
    df = spark.createDataFrame(docs, "cluster int, ord int, doc string").repartition(5)
    got = {(r.cluster, r.term): r.score for r in text.ctfidf(df, "cluster", "ord", "doc", None, ["the", "of"]).collect()}
    assert got == pytest.approx(plain_ctfidf(docs, ("the", "of")))
    ranked = text.ctfidf(df, "cluster", "ord", "doc", 2, []).collect()
    assert {r["rank"] for r in ranked} == {1, 2}


def test_order_by_text_ids(spark):
    """Text ids sort as text; a cluster that most rows have lies in several buckets, of which only ends cross over."""
    rng = np.random.default_rng(4)
    docs = [("hot" if i % 5 else f"c{i % 3}", f"2-s2.0-{int(rng.integers(10**6))}x{i}", " ".join(rng.choice(["aa", "bb", "cc", "dd"], int(rng.integers(0, 4))))) for i in range(400)]
    df = spark.createDataFrame(docs, "cluster string, eid string, doc string").repartition(7)
    got = {(r.cluster, r.term): r.score for r in text.ctfidf(df, "cluster", "eid", "doc", None, []).collect()}
    assert got == pytest.approx(plain_ctfidf(docs))
    rows = text.ranged(df, "cluster", "eid")
    ranges = rows.groupBy("bucket").agg(F.min(F.struct("cluster", "eid")).alias("lo"), F.max(F.struct("cluster", "eid")).alias("hi")).orderBy("bucket").collect()
    assert rows.where("cluster = 'hot'").select("bucket").distinct().count() > 1
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(ranges, ranges[1:]))


def test_previous_of_null_and_equal_orders(spark):
    rows = [("k", None, "a"), ("k", 1, "b"), ("k", 1, "c"), ("k", 3, None), ("k", 4, "e"), ("j", 2, "z")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(4)
    got = text.with_previous(text.ranged(df, "k", "o", "v"), "k", "v", "o", "v").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([("k", None, "a", None), ("k", 1, "b", "a"), ("k", 1, "c", "b"), ("k", 3, None, "c"), ("k", 4, "e", None), ("j", 2, "z", None)], key=str)


def test_bigrams_of_short_lists(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],)], "w array<string>")
    assert [r.x for r in df.select(text.with_bigrams(F.col("w")).alias("x")).collect()] == [[], ["a"], ["a", "b", "c", "a b", "b c"]]


def test_tokens_and_stop_words(spark):
    got = spark.createDataFrame([("The Über-brain's CT, a 2D x",)], "t string").select(text.tokens(F.col("t")).alias("x"), text.tokens(F.col("t"), []).alias("y")).first()
    assert got.x == ["über", "brain", "ct", "2d"] and got.y[0] == "the"


def test_l2(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, v array<float>")
    got = {r.i: r.n for r in df.select("i", vectors.l2_normalized(F.col("v")).alias("n")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def blobs(n=40, centres=3, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 6)) * 3
    return np.concatenate([c[k] + rng.normal(size=(n, 6)) * spread for k in range(centres)])


def test_hdbscan_finds_blobs_and_noise():
    x = np.concatenate([blobs(), np.random.default_rng(9).normal(size=(4, 6)) * 40])
    got = vectors.hdbscan(x, 5)
    for k in range(3):
        part = got[40 * k : 40 * k + 40]
        assert np.bincount(part[part >= 0]).max() >= 30
    assert (got[-4:] == -1).all()
    found = sorted(set(got.tolist()) - {-1})
    assert found == list(range(len(found))) and all((got == k).sum() >= 5 for k in found)


def test_hdbscan_small_inputs():
    assert vectors.hdbscan(np.zeros((3, 2)), 5).tolist() == [-1] * 3
    assert len(vectors.hdbscan(np.zeros((12, 2)), 5)) == 12


def test_spanning_tree_is_least():
    x = np.random.default_rng(4).normal(size=(30, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, 3]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    joined, total = {0}, 0.0
    while len(joined) < 30:
        a, b = min(((i, j) for i in joined for j in range(30) if j not in joined), key=lambda e: reach[e])
        joined.add(b)
        total += reach[a, b]
    assert vectors.spanning_tree(x, 4)[:, 2].sum() == pytest.approx(total)


def test_topics(spark):
    x = blobs(20)
    rows = [(i, f"title {i}", i, f"word{i // 20} shared", [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "eid int, title string, citedby_count int, doc string, vector array<float>")
    topics, summary = vectors.discover_topics(df.select("eid", "title", "citedby_count", "doc"), df.select("eid", "vector"))
    got = topics.collect()
    assert len(got) == 60 and all(r.topic_label.startswith(("Topic", "Outliers")) for r in got)
    s = summary.collect()
    assert sum(r.n_papers for r in s) == 60 and sum(r.total_citations for r in s) == sum(range(60))
    assert any("word0" in r.top_terms for r in s)
    centres = vectors.topic_centres(df.select("eid", "vector"), topics.select("eid", "topic"), "eid", "vector")
    near = {r.eid: r.topic for r in vectors.nearest_topic(df, centres, "eid", "vector").collect()}
    agree = [near[r.eid] == r.topic for r in got if r.topic >= 0]
    assert sum(agree) >= 0.8 * len(agree)
    with pytest.raises(ValueError):
        vectors.density_clusters(df.selectExpr("eid", "vector AS low"), "eid", most_points=10)


def test_density_clusters_by_blocks(spark):
    """Cut into blocks, clusters are those of all points in one place."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.1 + c for c in ((0, 0, 0), (2, 0, 0), (0, 3, 1))] + [rng.normal(size=(25, 3)) * 3])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(1000 - i), x[i].tolist()) for i in order], "eid long, low array<double>").repartition(5)
    expected = vectors.hdbscan(x[::-1])
    assert len(set(expected.tolist())) >= 4
    for block in (1000, 60, 25):
        got = {r.eid: r.topic for r in vectors.density_clusters(df, "eid", block=block).collect()}
        assert [got[i] for i in sorted(got)] == expected.tolist()


def scattered():
    """Far groups with cells of their own, points on a grid with equal distances, copies, and some that are far from all."""
    rng = np.random.default_rng(9)
    grid = np.stack(np.meshgrid(*[np.arange(4.0)] * 3), -1).reshape(-1, 3)
    groups = [rng.normal(size=(90, 3)) * 0.2 + c for c in ((40, 0, 0), (0, 60, 0))]
    x = np.concatenate([grid, *groups, np.repeat(grid[:3] + 0.25, 9, 0), np.repeat(groups[0][:5], 3, 0), rng.normal(size=(20, 3)) * 30])
    return x[rng.permutation(len(x))]


def test_spanning_tree_in_cells(spark):
    """Cells give the one tree that all points in one place have, an edge fewer than points, equal distances and copies included."""
    x = scattered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>").repartition(3)
    expected = sorted((int(a), int(b), d) for a, b, d, _ in vectors.spanning_tree(x, 5))
    got = sorted((r.a, r.b, r.d) for r in vectors.spanning_edges(df, 5, cell=30).collect())
    assert got == expected and len(got) == len(x) - 1


def test_density_clusters_of_equal_distances_and_copies(spark):
    """Where many distances are equal, clusters depend on the points, not on how these are dealt out."""
    x = scattered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "eid long, low array<double>").repartition(3)
    expected = vectors.hdbscan(x).tolist()
    assert len(set(expected)) >= 4
    got = {r.eid: r.topic for r in vectors.density_clusters(df, "eid", block=40).collect()}
    assert [got[i] for i in sorted(got)] == expected


def test_a_point_asks_a_bounded_number_of_cells():
    """Eight times the points are eight times the work: a point meets about as many others as before."""
    rng = np.random.default_rng(3)
    met = []
    for n in (8_000, 64_000):
        x = rng.normal(size=(n, 5))
        tree = cells.cuts(x, int(np.log2(n // 500)))
        cell = cells.cell_of(tree, x)
        low, high = np.full((len(tree.axis), 5), np.inf), np.full((len(tree.axis), 5), -np.inf)
        np.minimum.at(low, cell, x)
        np.maximum.at(high, cell, x)
        tree = tree._replace(low=cells.upward(low, np.minimum), high=cells.upward(high, np.maximum))
        some = x[:200]
        asked = cells.reached(tree, some, vectors.nearest(some, x, 5).max(1))
        assert set(zip(range(200), cell[:200])) <= set(zip(*(a.tolist() for a in asked)))
        met.append(np.bincount(cell)[asked[1]].sum() / 200)
    assert met[1] < 2 * met[0] and met[1] < 64_000 / 8


def test_nearest_of_very_many_centres(spark, monkeypatch):
    """20,000 centres in blocks: as by comparing all; ids that repeat or are null are rows of their own."""
    rng = np.random.default_rng(12)
    c = rng.normal(size=(20_000, 4)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[150] = c[19_000]
    x = np.concatenate([rng.normal(size=(298, 4)), c[[150, 7]]]).astype(np.float32)
    ids = [None, 5, 5, *range(10, 307)]
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "topic int, centre array<float>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "eid long, vector array<float>")
    monkeypatch.setattr(vectors, "VECTORS", 120)
    got = vectors.nearest_topic(df, centres, "eid", "vector").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ c.T
    assert len(got) == len(x) and got[0].__fields__ == ["eid", "topic", "similarity"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [r[:2] for r in sorted(map(tuple, got), key=key)] == sorted(zip(ids, s.argmax(1).tolist()), key=key)
    assert sorted(r.similarity for r in got) == pytest.approx(sorted(s.max(1).tolist()), rel=1e-6)
    assert {r.topic for r in got if r.eid == 305} == {150}
    small = vectors.nearest_topic(df, centres, "eid", "vector", block=30_000).collect()
    assert sorted(((r.eid or -1, r.topic) for r in small)) == sorted(((r.eid or -1, r.topic) for r in got))


def test_best_terms_of_many_texts(spark, monkeypatch):
    """Rare terms that no cluster shares outscore frequent ones that all share; more terms are more partitions, of the same counts."""
    monkeypatch.setattr(text, "TERMS_IN_TASK", 40)
    docs = [(c, i, " ".join(["all"] * 9 + [f"own{c}"] * 3 + [f"x{c}{i}{k}" for k in range(5)])) for c in range(6) for i in range(5)]
    df = spark.createDataFrame(docs, "cluster int, ord int, doc string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(((c, -s, t) for (c, t), s in plain_ctfidf(docs).items()))
    for top in (1, 3, 12, 1000):
        got = sorted((r.cluster, r.rank, r.term) for r in text.ctfidf(df, "cluster", "ord", "doc", top, []).collect())
        each = {c: [t for x, _, t in want if x == c][:top] for c in range(6)}
        assert {c: {t for x, _, t in got if x == c} for c in range(6)} == {c: set(v) for c, v in each.items()}
    tf = text.cluster_terms(df, "cluster", "ord", "doc", [])
    assert len(tf.inputFiles()) > 5 * int(before) and spark.conf.get("spark.sql.shuffle.partitions") == before
