"""The methods' own columns against plain versions, and what long texts and odd tables cost."""

import math
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from papertide.llm import decontaminate, language, mixing, pii, quality, quotations, secrets, simhash, similar
from papertide.llm.shared import stored

from . import brute
from .test_native_operators import check_mix
from .test_similar import grams

DOCS = "doc_id long, text string, lang string, source string"
KINDS = ["email", "ip", "card", "phone", "term"]


# operator 9


def apart(text, base):
    """Whole terms that are not in or next to an entity."""
    taken = {k for a, _, b, _ in base for k in range(a, b)}
    for m in re.finditer(r"[^\W_]+", text):
        if len(m[0]) >= 4 and not any(k in taken for k in range(m.start() - 1, m.end() + 1)):
            yield m.start(), m.end(), m[0].lower()


def value(text, a, b, kind):
    v = text[a:b]
    return kind, re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower()


def plain_pii(rows, bits=1.0, support=2, near=64):
    base = [brute.pii_spans(t) for _, t in rows]
    terms = [list(apart(t or "", x)) for (_, t), x in zip(rows, base, strict=True)]
    corpus = Counter(w for x in terms for _, _, w in x)
    met = defaultdict(set)
    for r, (_, t) in enumerate(rows):
        for a, _, b, kind in base[r]:
            for i, j, w in terms[r]:
                if (max(0, a - near) <= i and j <= a) or (b <= i and j <= b + near):
                    met[value(t, a, b, kind), w].add((r, i))
    of_entity = Counter()
    for (e, _), places in met.items():
        of_entity[e] += len(places)
    telling = set()
    for (e, w), places in met.items():
        if len({r for r, _ in places}) >= support:
            p, prior = len(places) / corpus[w], of_entity[e] / sum(corpus.values())
            if math.log2(p) >= -bits and math.log2(p / prior) >= 0:
                telling.add(w)
    out = []
    for (i, t), x, y in zip(rows, base, terms, strict=True):
        own = [(a, 4, b, "term") for a, b, w in y if w in telling]
        out.append((i, len(own), brute.written(sorted(x + own))))
    return out


def people(seed, n):
    r = random.Random(seed)
    names = ["Quintessa", "Bartholomew", "Ixchel", "José", "Zoë", "Мария"]
    out = []
    for i in range(n):
        k = r.randrange(len(names))
        mention = r.choice([f"{names[k]} writes from u{k}@corp.example and u{k}@corp.example", f"call {names[k]} at +1 555 010 {1000 + k}", f"{names[k]} was here", "no one", f"host 10.0.0.{k} of {names[k].upper()}"][: 1 if k == 0 else 2 if k < 3 else 5])
        out.append((i, " ".join(r.choice("some plain filler words that many texts have in common".split()) for _ in range(r.randrange(30))) + " " + mention + " " + "tail words " * r.randrange(3)))
    return out


def test_pii_spans_and_terms(spark, rows, same):
    data = [*people(1, 150), *((500 + k, r[1]) for k, r in enumerate(rows)), (900, "x9" * 3000 + " a@b.co"), (901, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    expected = plain_pii(data)
    assert any(n for _, n, _ in expected)
    same(pii.sanitise(df), expected, "doc_id", "n_term", "spans")


def test_pii_counts_an_occurrence_once(spark):
    """A term between two mentions of one entity is one occurrence of six."""
    rows = [(1, "q@corp.example Quintessa q@corp.example"), (2, "q@corp.example Quintessa q@corp.example"), *((k, "Quintessa " + "other words here " * 9) for k in range(3, 7))]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_term == 0 for r in out)


# operator 10


def plain_secrets(rows):
    run = r"[A-Za-z0-9+/_=-]{20,}"
    found = []
    for _, t, lang, source in rows:
        base = brute.secret_spans(t)
        taken = {k for a, _, b, _ in base for k in range(a, b)}
        spans = [(a, k, b, kind, re.match(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)""", t[a:b], re.S)[1] if kind == "assign" else t[a:b]) for a, k, b, kind in base]
        for m in re.finditer(run, t or ""):
            if not any(k in taken for k in range(m.start() - 1, m.end() + 1)) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 12:
                spans.append((m.start(), 3, m.end(), "owned", m[0]))
        found.append((source or "", (source or "", lang or ""), spans))
    owners, repos = defaultdict(set), defaultdict(set)
    for owner, repo, spans in found:
        for *_, v in spans:
            owners[v].add(owner)
            repos[v].add(repo)
    example = {v for v in owners if len(owners[v]) >= 3 or (len(owners[v]) > 1 and len(repos[v]) >= 5)}
    out = []
    for (i, *_), (_, _, spans) in zip(rows, found, strict=True):
        kept = [s for s in spans if s[3] != "owned" or s[4] not in example]
        copied = sum(s[4] in example for s in kept)
        out.append((i, len(kept) - copied, copied, max((len(owners[s[4]]) for s in kept), default=0), max((len(repos[s[4]]) for s in kept), default=0), brute.written(sorted(s[:4] for s in kept))))
    return out


def test_secrets_spans_and_ownership(spark, rows, same):
    r = random.Random(4)
    keys = [f"k{j}AbCdEfGhIjKlMnOpQrS{j}" for j in range(8)]
    data = [(r0[0], r0[1], r0[2], r0[3]) for r0 in rows]
    for i in range(120):
        k = r.randrange(8)
        text = r.choice([f"use {keys[k]} now", f"password={keys[k]}", f"pre{keys[k]}_token: {keys[k]} post", f"AKIA{'Z' * 12}{k}", f"{'ab' * 16}{k} x", f"{keys[k]}+{'ab' * 16}", "nothing"])
        data.append((100 + i, text, r.choice(["en", "de", "fr", None]), f"s{r.randrange(k + 1)}" if k else None))
    same(secrets.scan(spark.createDataFrame(data, DOCS).repartition(3)), plain_secrets(data), "doc_id", "n_live", "n_copied", "most_owners", "most_repos", "spans")


def test_repositories_decide_where_owners_are_few(spark):
    key = "zz8QwErTyUiOpAsDfGhJ77"
    spread = [(i, f"the {key} key", lang, f"o{i % 2}") for i, lang in enumerate(["a", "b", "c", "d", "e", "f"])]
    one = [(i, f"the {key} key", lang, "o") for i, lang in enumerate("abcdefgh")]
    for data, n in ((spread, 0), (one, len(one)), (spread[:4], 4)):
        assert sum(r.n_live for r in secrets.scan(spark.createDataFrame(data, DOCS)).collect()) == n


# operator 5


def mails(seed, n_conv):
    """Conversations with known links: whole, partial, single-line, wrapped and nested quotes, some announced."""
    r = random.Random(seed)
    rows, links = [], {}
    for c in range(n_conv):
        bodies = []
        for t in range(r.randrange(2, 8)):
            said = [" ".join(f"c{c}t{t}w{r.randrange(10**6)}" for _ in range(r.randrange(4, 9))) for _ in range(r.randrange(1, 6))]
            text, target = list(said), None
            if t and r.random() < 0.8:
                target = r.randrange(t)
                from_ = bodies[target]
                kind = r.choice(["whole", "part", "line", "wrapped", "words"])
                a = r.randrange(len(from_))
                b = r.randrange(a, len(from_)) + 1
                words = " ".join(from_).split()
                quote = {"whole": from_, "part": from_[a:b], "line": from_[a : a + 1]}.get(kind)
                if kind == "wrapped":
                    quote = [" ".join(words[k : k + 3]) for k in range(0, len(words), 3)]
                if kind == "words":
                    k = r.randrange(max(1, len(words) - 5))
                    quote = [" ".join(words[k : k + 6])] if len(words) > 5 else from_
                quote = [f"> {x.upper() if r.random() < 0.3 else x}" for x in quote]
                text = ([r.choice(["On Monday, Bob wrote:", "Am Montag schrieb Eva :"])] if r.random() < 0.5 else []) + quote + said
            links[c, t] = target
            bodies.append(said)
            rows.append((c, t, r.choice(["user", "assistant"]), "\n".join(text)))
    return rows, links


def test_quotes_are_linked(spark):
    rows, links = mails(3, 60)
    out = quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    got = {(r.conv_id, r.turn): r.reply_to for r in out}
    assert got == links
    assert not any(re.search(r"^>|wrote:|schrieb", r.formatted, re.M) for r in out)
    ordered = quotations.in_reply_order(quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.conv_id, r.thread, r.turn) for r in ordered] == sorted((r.conv_id, r.thread, r.turn) for r in out)


# operator 2


def test_predictions_follow_from_plain_features(spark):
    texts = [("en", "the cat and that dog with this house there "), ("de", "der hund und die katze nicht eine sache "), ("fr", "le chat que les chiens des eaux tout "), ("es", "el gato que los perros las casas una ")]
    r = random.Random(8)
    data = [(i, " ".join(r.choice(t.split()) for _ in range(30)), lang) for i, (lang, t) in enumerate(texts * 12)]
    model = language.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), "doc_id", "text", "lang")

    def features(t):
        raw = [x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 48 if 48 <= x <= 57 else 32 for x in t.encode()]
        out = np.zeros(language.DIMS)
        for n in (1, 2, 3):
            for k in range(len(raw) - n + 1):
                code = n
                for x in raw[k : k + n]:
                    code = (code << 8 | x) % 2**32
                out[code * 2654435761 % 2**32 >> 20] += 1 / (len(raw) - n + 1)
        return out

    for i, t, pred in [(x.doc_id, data[x.doc_id][1], x.lang_pred) for x in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), model).collect()]:
        d = features(t) @ model.weights + model.bias
        family = model.families[int(np.argmax(d[: len(model.families)]))]
        a, b = next(p for p in model.pairs if set(p) == set(family))
        assert pred == (a if d[len(model.families) + model.pairs.index((a, b))] > 0 else b), i


def test_every_language_is_learned(spark):
    r = random.Random(2)
    data = [(i, " ".join(f"l{i % 90}x{r.randrange(4)}" for _ in range(20)), f"lang{i % 90}") for i in range(360)]
    model = language.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert sum(len(f) for f in model.families) == 90


# odd tables


def test_simhash_filter_keeps_unlike_rows_of_one_id(spark):
    texts = ["alpha beta gamma delta", "completely other words stand here"]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (2, texts[0], "c"), (1, texts[0], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 3):
        assert sorted(map(tuple, simhash.simhash_filter(df.repartition(n)).collect())) == [(1, texts[0], "a"), (1, texts[1], "b")]


def test_columns_may_have_any_names(spark):
    text = " ".join(f"w{k}" for k in range(60))
    names = ["doc_id", "text", "lang", "source", "n_chars", "found", "row", "__id", "bad_id", "a.b", "KEY", "digest", "label"]
    rows = [(1, text + " password=hunter2hunter2", "en", "s", 1, *range(8)), (2, text, "en", "s", 1, *range(8)), (None, text, None, None, None, *range(8))]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, ["long", "string", "string", "string", "long", *["int"] * 8], strict=True)))
    bench = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    for out in (secrets.redact(df), decontaminate.decontaminate_filter(df, bench), simhash.simhash_filter(df), similar.similar_filter(df), quality.quality_filter(df)):
        assert out.columns == names and out.count() > 0
    assert {x.text for x in secrets.redact(df).collect()} == {text, text + " [SECRET]"}


def test_rows_without_id(spark):
    data = [(None, f"word{i} other", "en", "s") for i in range(40)] + [(i, "some words", "en", "t") for i in range(80)]
    out = mixing.mix(spark.createDataFrame(data, DOCS), weights=(1, 3)).where("source = 's'").collect()
    assert sum(r.taken for r in out) == 90 and sum(r.taken > r.size for r in out) == 5


# long texts

LONG = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from papertide.llm import decontaminate, language, quality, simhash, similar, substrings
from papertide.llm import textkernel as tk
words = [("w%d" % i) + "abcdef"[: i % 6] for i in range(500)]
r = np.random.default_rng(1)
text = "".join(" ".join(words[i] for i in r.integers(0, 500, 80_000)) + chr(10) for _ in range(100))
column = pa.array([text, "short"], pa.large_string())
del text
data, cuts = tk.column_bytes(column)
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert cuts[1] > 50_000_000
total = sum(int(m["n_words"].sum()) for _, _, m in quality._measured(column, quality.GRAM_LIMITS, 50))
assert total == 8_000_001
assert len(simhash.fingerprints(data, cuts)) == 2
assert len(similar.shingle_sets(data, cuts, 5, np.zeros(0, np.uint64))[1]) == 3
assert decontaminate._token_hashes(data, cuts)[0].sum() == total
assert sum(w.counts.sum() for _, _, w in substrings._slices(column)) == total
assert language.decisions(data, cuts, np.ones((language.DIMS, 4), np.float32)).shape == (2, 4)
print("PEAK", resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_text_of_50_mb():
    done = subprocess.run([sys.executable, "-c", LONG.format(root=str(Path(__file__).resolve().parents[2]))], capture_output=True, text=True, timeout=400)
    assert "PEAK" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < 1200


def test_very_many_matches_in_one_text(spark):
    n = 20_000
    text = " ".join(f"password=secret{i}value m{i}@corp.example" for i in range(n))
    df = spark.createDataFrame([(1, text, "en", "s")], DOCS)
    assert secrets.scan(df).first().n_assign == n and pii.sanitise(df).first().n_email == n
    assert secrets.redact(df).first().text == " ".join(f"[SECRET] m{i}@corp.example" for i in range(n))
    lines = "\n".join(f"> line number {i} of it\nanswer {i}" for i in range(n // 4))
    mail = spark.createDataFrame([(1, 0, "u", lines.replace("> ", "")), (1, 1, "u", lines)], "conv_id long, turn long, role string, text string")
    assert {r.turn: (r.n_quotes, r.n_linked) for r in quotations.link(mail).collect()} == {0: (0, 0), 1: (n // 4, n // 4)}


@pytest.mark.parametrize("texts", [[], [None], [""], [" ", None, ""]])
def test_texts_without_words(spark, texts):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    assert secrets.redact(df).count() == len(texts) and pii.sanitise(df).count() == len(texts)
    assert similar.similar_filter(df).count() == min(1, len(texts))


# the pipeline on rows of every kind


def plain_kept(text):
    n_words, chars, _, _, _, failed = brute.quality(text)
    if failed or any(brute.dup_chars(text, n) > limit * chars for n, limit in quality.GRAM_LIMITS.items()):
        return False
    lines = [x for x in text.split("\n") if brute.words(x)]
    again = sum(len(x) for k, x in enumerate(lines) if x in lines[:k])
    return again <= 0.3 * sum(map(len, lines))


def test_pipeline_with_null_and_repeated_ids(spark, rows, tmp_path):
    leaked = " ".join(f"b{k}" for k in range(100))
    data = [r[:5] for r in rows] + [(3, leaked, "en", "a", 1), (None, "tail " + leaked, None, None, None), (None, " ".join(f"n{k}" for k in range(70)) + " password=hunter2hunter2", None, None, 5)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    items = [(1, " ".join(f"b{k}" for k in range(10, 30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    d = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{d}/documents.parquet")

    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        steps.append(stored(stage(spark, steps[-1], d)))
        assert steps[-1].columns == docs.columns
    key = lambda x: tuple((v is not None, v) for v in x)
    now = [sorted((tuple(r) for r in s.collect()), key=key) for s in steps]
    assert now[1] == sorted((r for r in data if plain_kept(r[1] or "")), key=key)
    # of each group of linked texts the row with the smallest id, one without an id last
    sets = [grams(r[1]) for r in now[1]]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for g, r in zip(group, now[1], strict=True):
        best[g] = min(best.get(g, (2,)), (r[0] is None, r[0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in now[2]) == sorted(best.values())
    assert all(r in now[1] for r in now[2])
    assert now[3] == [r for r, x in zip(now[2], brute.decontaminate([r[:2] for r in now[2]], items), strict=True) if not x[-1]]
    assert [(r[0], r[1].replace("password=hunter2hunter2", "[SECRET]")) for r in now[3]] == [r[:2] for r in sorted(now[4], key=lambda x: key((*x[:1], x[1].replace("[SECRET]", "password=hunter2hunter2"))))]
    mixed = corpus_pipeline.run(spark, d).collect()
    check_mix([r[:4] for r in now[4]], [*mixed, *(x for x in mixing.mix(steps[4]).where("taken = 0").collect())])
