"""Operators that judge whole texts, against plain versions."""

import numpy as np
import pytest
import xxhash

from papertide.llm import decontaminate, language, quality, simhash, substrings
from papertide.llm import textkernel as tk

from . import brute

PAIRS = lambda rows: [(r[0], r[1]) for r in rows]


def test_quality_measures(docs, rows, empty, same):
    out = quality.quality_rules(docs).cache()
    same(out, [(i, *brute.quality(t)) for i, t in PAIRS(rows)], "doc_id", *quality.MEASURES, "base_failed")
    same(out, [(i, *(brute.dup_chars(t, n) for n in quality.GRAM_LIMITS)) for i, t in PAIRS(rows)], "doc_id", *(f"dup_chars_{n}" for n in quality.GRAM_LIMITS))
    assert not out.where("base_failed AND kept").count()
    assert quality.quality_rules(empty).count() == 0


def test_quality_verdicts(make):
    clean = " ".join(f"word{k}" for k in range(200))
    phrase = " ".join(f"rep{k}" for k in range(12))
    mixed = " ".join([phrase, *(f"a{k}" for k in range(20)), phrase, *(f"b{k}" for k in range(20))])
    lines = "\n".join(["a b c d e f"] * 10 + [f"x{k} y{k} z{k}" for k in range(20)])
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_rules(make([(1, clean), (2, mixed), (3, lines), (4, "short")])).collect()}
    assert got[1] == (False, True) and got[2] == (False, False) and not got[3][1] and got[4] == (True, False)


def test_quality_filter_keeps_columns(docs, empty):
    kept = quality.quality_filter(docs)
    assert kept.schema == docs.schema
    assert kept.count() == quality.quality_rules(docs).where("kept").count() > 0
    assert quality.quality_filter(empty).count() == 0


def test_word_hashes_tell_words_apart():
    texts = [f"k{i} {'y' * (i % 40)}z" for i in range(2000)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    w = tk.Words(data, np.array([0, len(data)]))
    different = set(" ".join(texts).split(" ")) - {""}
    assert len(set(w.hashes().tolist())) == len(different)


@pytest.mark.parametrize("window,phrase", [(50, 10), (7, 3), (4, 4)])
def test_repeats(docs, rows, empty, same, window, phrase):
    out = substrings.remove_repeats(docs, window=window, phrase=min(phrase, window))
    same(out, brute.repeats(PAIRS(rows), window), "doc_id", "n_words", "n_removed", "kept_sha256")
    if window == 50:
        assert substrings.remove_repeats(empty).count() == 0


def test_repeats_chains_and_partial_passages(make, same):
    w = [f"v{k}" for k in range(200)]
    pairs = [(9, " ".join(w)), (5, " ".join(w[:80])), (7, " ".join(w[60:140])), (3, " ".join(w[100:])), (8, "q " + " ".join(w[30:110]) + " q"), (2, "the " * 120), (4, "the " * 60 + "end"), (6, " ".join(w[:49]))]
    same(substrings.remove_repeats(make(pairs)), brute.repeats(pairs), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_repeats_kept_text(make):
    w = [f"v{k}" for k in range(60)]
    out = substrings.remove_repeats(make([(1, " ".join(w)), (2, "before  " + "\n".join(w) + "\tafter")]), keep_text=True)
    assert {r.doc_id: r.kept_text for r in out.collect()} == {1: " ".join(w), 2: "before after"}


def test_simhash(docs, rows, empty, same):
    out = simhash.simhash_components(docs)
    same(out, brute.components([(i, brute.fingerprint(t)) for i, t in PAIRS(rows)]), "doc_id", "fingerprint", "component_id")
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.simhash_filter(empty).count() == 0


def test_simhash_filter(docs, rows):
    kept = simhash.simhash_filter(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = {c for i, _, c in brute.components([(i, brute.fingerprint(t)) for i, t in PAIRS(rows)]) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(named)
    assert ids.count(None) == 2


def test_votes_count_past_a_byte():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    bounds = np.array([0, 0, 600, 601, 1000])
    for r, got in enumerate(simhash.votes(hashes, bounds).tolist()):
        h = hashes[bounds[r] : bounds[r + 1]].tolist()
        assert got == sum((2 * sum((x >> b) & 1 for x in h) > len(h)) << b for b in range(64))


def test_links_of_dense_fingerprints(spark, same):
    """Chains, balls and far points: connected as by comparing all pairs."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = {centre}
    for _ in range(150):
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    chain = int(rng.integers(0, 2**63))
    for b in range(0, 60, 2):
        chain ^= 3 << b
        fps.add(chain)
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    signed = [(i, f - 2**64 if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(signed, "id long, fp long")
    links = simhash.fingerprint_links(df.select("fp"))
    from papertide.llm.components import connected_components

    labels = connected_components(df.selectExpr("fp AS node", "id AS label"), links)
    expected = brute.components([(i, f) for i, f in enumerate(sorted(fps))])
    same(labels.join(df, df.fp == labels.node).selectExpr("id", "label"), [(i, c) for i, _, c in expected], "id", "label")


def test_shingle_hash_is_that_of_spark(spark):
    assert spark.sql("SELECT xxhash64('the quick fox') AS h").first().h & (2**64 - 1) == xxhash.xxh64_intdigest(b"the quick fox", 42)


def bench_rows(rows):
    long = next(t for _, t in PAIRS(rows) if t and len(t) > 500)
    w = long.split()
    return [(1, " ".join(w[20:45])), (2, " ".join(w[40:52]).upper()), (2, "two words"), (10, "absent phrase of words that no document has at all here"), (None, "one"), (5, None), (6, ""), (7, "--- !!"), (8, " ".join(w[20:45]))]


def test_decontaminate(spark, docs, rows, empty, same):
    items = bench_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(decontaminate.decontaminate(docs, bench), brute.decontaminate(PAIRS(rows), items), *columns)
    same(decontaminate.decontaminate(docs, bench.limit(0)), brute.decontaminate(PAIRS(rows), []), *columns)
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_decontaminate_in_many_blocks(spark, docs, rows, same, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    items = bench_rows(rows)
    out = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    same(out, brute.decontaminate(PAIRS(rows), items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_proximity(spark, make):
    phrase = [f"t{k}" for k in range(10)]
    swapped = [*phrase[:3], phrase[4], phrase[3], *phrase[5:]]
    missing = [*phrase[:5], "other", *phrase[6:]]
    apart = [x for w in phrase for x in (w, "pad", "pad", "pad")]
    out = decontaminate.decontaminate(make([(1, " ".join(phrase)), (2, " ".join(swapped)), (3, " ".join(missing)), (4, " ".join(apart))]), spark.createDataFrame([(1, " ".join(phrase))], "item_id long, text string"))
    assert {r.doc_id: (r.n_items, r.n_near) for r in out.collect()} == {1: (1, 1), 2: (0, 1), 3: (0, 1), 4: (0, 0)}


def test_decontaminate_filter(spark, docs, rows):
    items = bench_rows(rows)[:2]
    kept = decontaminate.decontaminate_filter(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x[-1] for x in brute.decontaminate(PAIRS(rows), items))


LANGS = {"en": "the and that with this there nd th ing", "de": "der die und nicht eine sch ung keit ch", "fr": "le la que les des eau tion aux ou", "es": "el los que las ción ado una para de"}


def spoken(lang, n, seed):
    r = np.random.default_rng(seed)
    parts = LANGS[lang].split()
    return " ".join("".join(r.choice(parts, int(r.integers(1, 3)))) for _ in range(n))


def test_language(spark, make):
    train = spark.createDataFrame([(i, spoken(lang, 40, 100 * k + i), lang) for k, lang in enumerate(LANGS) for i in range(40)], "doc_id long, text string, lang string")
    model = language.train(train, "doc_id", "text", "lang")
    assert model.families == [["de", "en"], ["es", "fr"]] and model.pairs == [("de", "en"), ("es", "fr")]
    test = [(i, spoken(lang, 30, 9000 + 10 * k + i), lang) for k, lang in enumerate(LANGS) for i in range(10)]
    got = language.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()
    truth = [t[2] for t in test]
    assert sum(g.lang_pred == t for g, t in zip(got, truth, strict=True)) >= 38
    odd = language.identify(make([(1, None), (2, ""), (3, "123 !?"), (4, "你好"), (5, "le")]), model)
    got = {r.doc_id: (r.lang_pred, r.score) for r in odd.collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] in LANGS and got[5][0] in LANGS and all(0 <= s <= 1 for _, s in got.values())


def test_language_sums_match_frequencies():
    texts = [b"Hello there, 123", b"", b"a", b"\xc3\xa9t\xc3\xa9 et hiver"]
    data, cuts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    weights = np.random.default_rng(1).normal(size=(language.DIMS, 3)).astype(np.float32)
    assert np.allclose(language.decisions(data, cuts, weights), language.frequencies(data, cuts) @ weights, atol=1e-4)


def test_language_without_training_rows(docs, empty):
    assert language.train(empty, "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(empty, None).count() == 0
