import hashlib
from itertools import permutations

import pytest

from papertide.llm import audit

from . import brute


def fails(rows):
    """The letters that each row fails."""
    out = []
    for r in rows:
        text = r[1] or ""
        ws = brute.words(text)
        smaller = [x for x in rows if x[0] is not None and r[0] is not None and x[0] < r[0] and (x[1] or "") == text]
        found = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": bool(smaller)}
        out.append({k for k, bad in found.items() if bad})
    return out


def plain(rows, labels, letters="ABCDE"):
    """Each order applied to each document in turn."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, parts = fails(rows), sorted({r[3] or "" for r in rows})
    out, totals = {}, {}
    for part in parts:
        here = [(r[0], f) for r, f in zip(rows, failed) if (r[3] or "") == part]
        for order in map("".join, permutations(letters)):
            left = here
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = sum(x in f for _, f in here)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in here), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                totals[part, x] = totals.get((part, x), 0) + len(gone)
    return {(*k, *v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, (i % 3 == 0) + 0, (i % 4 == 0) + 0) for i in range(0, 18, 2)] + [(0, 0, 1), (5, None, 1), (None, 1, 1), (99, 1, 1)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def test_every_order(docs, rows, labels, same):
    got = audit.filter_audit(docs, labels[1])
    same(got, plain(rows, labels[0]), *COLUMNS)


def test_measures(docs, rows, same):
    def of(t):
        t = t or ""
        ws = brute.words(t)
        return len(ws), len(set(ws)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in "#$%&*|" for c in t), hashlib.sha256(t.encode()).digest()

    same(audit.measures(docs), [(r[0], r[3] or "", *of(r[1])) for r in rows], "id", "part", *audit.MEASURES, "digest")


def test_copies_of_one_text_over_many_parts(spark, same):
    rows = [(i if i % 7 else None, "Hot TEXT" if i % 3 else f"text {i % 5}", "en", f"s{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same(audit.filter_audit(df, none), plain(rows, []), *COLUMNS)


def test_orders_and_filters_of_ones_own(spark, docs, labels):
    got = audit.filter_audit(docs, labels[1], filters={"X": "n_words = 0", "Y": "n_points > 10"}, orders=["XY"])
    assert {(r.filter_order, r.step) for r in got.collect()} == {("XY", 1), ("XY", 2)}
    with pytest.raises(ValueError, match="name those wanted"):
        audit.mask_steps(spark, "ABCDEFG")


def test_empty(empty, labels):
    assert audit.filter_audit(empty, labels[1]).collect() == []


def test_running_failures(spark):
    steps = {(r.mask, r.filter_order, r.step): (r.fails, r.earlier) for r in audit.mask_steps(spark, "ABC").collect()}
    assert len(steps) == 8 * 6 * 3
    assert steps[0b101, "CBA", 1] == (4, 0) and steps[0b101, "CBA", 2] == (0, 4) and steps[0b101, "CBA", 3] == (1, 4)
