"""Near-duplicates by true shingle similarity, against all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from papertide.llm import quality, similar, simhash
from papertide.llm.shared import row_digest

from . import brute
from .test_pipeline import fixture_rows

COLUMNS = "doc_id long, text string, source string"


def grams(t, n=5):
    w = brute.words(brute.fold(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def survivors(rows):
    """The smallest ids of the parts that similarity 0.8 connects, by comparing all pairs."""
    sets, root = {i: grams(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted({find(i) for i in root})


def varied():
    """Texts with some words changed, chains of such texts, and a long passage that most have."""
    r = random.Random(11)
    shared = [f"s{k}" for k in range(60)]
    out = []
    for k in range(12):
        base = [f"d{k}w{j}" for j in range(r.randrange(20, 160))] + (shared if k % 3 else [])
        out.append(base)
        for _ in range(6):
            base = list(base)
            for _ in range(r.randrange(0, 4)):
                base[r.randrange(len(base))] = f"x{r.randrange(10**9)}"
            out.append(base)
    rows = [(i, " ".join(w), "s") for i, w in enumerate(out)] + [(900, "a b", "s"), (901, "A  b", "s"), (902, "", "s"), (903, None, "s")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("common", [0, 50, similar.COMMON])
def test_all_pairs_are_found(spark, common):
    rows = varied()
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = similar.similar_components(df, common=common).select("label.id").distinct().collect()
    assert sorted(r.id for r in got) == survivors(rows)


@pytest.mark.parametrize("size", [1, 3])
def test_long_lists_go_by_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(similar, "BLOCK", size)
    rows = varied()
    got = similar.similar_components(spark.createDataFrame(rows, COLUMNS)).select("label.id").distinct().collect()
    assert sorted(r.id for r in got) == survivors(rows)


def test_sketches_refuse_no_similar_pair():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 600, dtype=np.uint64)
    sets = [base[: r.integers(100, 600)] for _ in range(40)] + [np.unique(np.concatenate([base[20:], r.integers(0, 2**63, k, dtype=np.uint64)])) for k in (1, 40, 90, 300)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    words, edges = similar.sketches(np.concatenate(sets), bounds)
    n = np.diff(bounds)
    for side in (np.zeros(len(n), bool), np.arange(len(n)) % 2 == 0):
        a, b, apart = similar.likely_pairs(n, words, edges, 0.8, side)
        found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        assert all(d <= len(set(sets[x]) ^ set(sets[y])) for x, y, d in zip(a.tolist(), b.tolist(), apart.tolist(), strict=True))
        for x, y in itertools.combinations(range(len(sets)), 2):
            one, two = set(sets[x].tolist()), set(sets[y].tolist())
            if 5 * len(one & two) >= 4 * len(one | two) and (not side.any() or side[x] != side[y]):
                assert (x, y) in found


def test_forest_connects_what_the_edges_connect():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 60, 90), r.integers(0, 60, 90)
    kept = similar.spanning_forest(60, a, b, np.arange(90))

    def parts(x, y):
        root = list(range(60))
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            old, new = root[i], root[j]
            root = [new if k == old else k for k in root]
        return [root.index(k) for k in root], 60 - len(set(root))

    assert parts(a, b)[0] == parts(a[kept], b[kept])[0] and parts(a, b)[1] == kept.sum()


def test_stage_finds_near_copies_that_are_many_bits_apart(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    near = [*base[:60], "other", *base[61:]]
    rows = [(1, " ".join(base), "s"), (2, " ".join(near), "s"), (3, " ".join(reversed(base)), "s")]
    assert (brute.fingerprint(rows[0][1]) ^ brute.fingerprint(rows[1][1])).bit_count() > 2
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(x.doc_id for x in out.collect()) == [1, 3]


def test_simhash_proposes_and_similarity_decides(spark, monkeypatch):
    """Copies with a changed word in a long text come from SimHash's index, are verified, and leave the prefix filter nothing to link."""
    r = random.Random(5)
    rows = []
    for k in range(8):
        base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
        rows += [(10 * k, " ".join(base), "s"), (10 * k + 1, " ".join([*base[:1500], "other", *base[1501:]]), "s")]
    # one multiset of three-word shingles, and so one fingerprint, in texts whose five-word shingles differ
    rows += [(90, "a b a b c a b d a b a b", "s"), (91, "a b d a b a b c a b a b", "s")]
    assert brute.fingerprint(rows[-1][1]) == brute.fingerprint(rows[-2][1])
    close = {(rows[i][0], rows[i + 1][0]) for i in range(0, 16, 2) if (brute.fingerprint(rows[i][1]) ^ brute.fingerprint(rows[i + 1][1])).bit_count() <= 2}
    assert len(close) > 2
    asked, similar_pairs = [], similar._similar

    def watched(pairs, *args):
        out = similar_pairs(pairs, *args)
        asked.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(similar, "_similar", watched)
    got = similar.similar_components(spark.createDataFrame(rows, COLUMNS)).select("label.id").distinct().collect()
    assert sorted(x.id for x in got) == survivors(rows) == [*range(0, 80, 10), 90, 91]
    assert asked[0] == (len(close) + 1, len(close))
    assert asked[1] == (8 - len(close), 8 - len(close)) and asked[2] == (0, 0)


def test_links_of_a_forest_are_near(spark):
    fps = [0, 1, 3, 7, 15, 31, 255 << 40, (255 << 40) + 3]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), forest=True).collect()
    assert links and all((x.a ^ x.b).bit_count() <= 2 for x in links)
    root = {f: f for f in fps}
    for x in links:
        old, new = root[x.b], root[x.a]
        root = {f: new if v == old else v for f, v in root.items()}
    assert len(set(root.values())) == 2


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(1, texts[0], "s"), (2, texts[0], "s"), (2, texts[1], "s"), (None, texts[1], "s"), (None, texts[2], "t"), (None, texts[2], "t"), (None, texts[2], "u")]
    df = spark.createDataFrame(rows, COLUMNS)
    out = [sorted(map(tuple, corpus_pipeline.near_duplicate_stage(spark, df.repartition(n), "").collect()), key=str) for n in (1, 2, 5)]
    assert out[0] == out[1] == out[2]
    assert [x[:2] for x in out[0]] == [(1, texts[0]), (2, texts[1]), (None, texts[2])]


def test_empty(spark):
    assert similar.similar_filter(spark.createDataFrame([], COLUMNS)).count() == 0


def test_all_stages(spark, rows, tmp_path):
    """The stages after this one get what it keeps."""
    data = fixture_rows(rows)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    items = [(1, " ".join(f"b{k}" for k in range(10, 30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    ok = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    kept = survivors([r[:3] for r in data if r[0] in ok])
    text = {r[0]: r[1] for r in data}
    assert 0 in kept and 1 not in kept and 2 not in kept
    kept = [x[0] for x in brute.decontaminate([(i, text[i]) for i in kept], items) if not x[-1]]
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in out} <= set(kept) and 50 in kept and 51 not in kept
    sizes = {}
    for i in kept:
        source = next(r[3] for r in data if r[0] == i)
        sizes[source] = sizes.get(source, 0) + len(brute.words(text[i] if i != 50 else text[i].replace("password=hunter2hunter2", "[SECRET]")))
    assert {r.source: r.source_size for r in out} == {s: n for s, n in sizes.items() if n}


def test_rows_of_any_type(spark):
    """Maps, variants and nested columns; equal rows are one row, and rows that differ in such a column alone are two."""
    import corpus_pipeline

    text = " ".join(f"m{k}" for k in range(80))
    other = " ".join(f"n{k}" for k in range(80))
    rows = [(1, text, {"a": 1}, [{"k": "x"}], '{"v": 1}'), (1, text, {"a": 1}, [{"k": "x"}], '{"v": 1}'), (2, text, {"a": 2}, [{"k": None}], None), (3, other, None, None, "[]"), (None, other, {"b": None}, [], "[]")]
    df = spark.createDataFrame(rows, "doc_id long, text string, marks map<string, int>, nested array<map<string, string>>, raw string").selectExpr("doc_id", "text", "marks", "nested", "try_parse_json(raw) AS v", "'s' AS source")
    out = similar.similar_filter(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert sorted(r.doc_id for r in simhash.simhash_filter(df.where("doc_id IS NOT NULL")).collect()) == [1, 3]
    staged = corpus_pipeline.STAGES[1][1](spark, df, "")
    assert {tuple(sorted(r.marks.items())) for r in staged.collect() if r.doc_id == 1} == {(("a", 1),)}


def test_digests_are_wide(spark):
    """Two halves that do not follow from each other; each column and its being null count."""
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN '' END AS t", "map(id % 3, 1) AS m")
    found = [r[0] for r in df.select(row_digest(df)).collect()]
    assert {len(x) for x in found} == {32} and len({x[:16] for x in found}) == len({x[16:] for x in found}) == 2000
    one = spark.sql("SELECT 1 AS a, '' AS b UNION ALL SELECT 1, NULL")
    assert one.select(row_digest(one)).distinct().count() == 2
