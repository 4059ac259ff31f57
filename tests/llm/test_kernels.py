"""Numpy kernels against plain versions on generated texts, without Spark."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from papertide.llm import decontaminate, quality, simhash, substrings
from papertide.llm import textkernel as tk

from . import brute

ALPHABET = ["a", "b", "ab", "A", " ", " ", "  ", "\n", "\t", "\x0b", "\xa0", "é", "\U0001f600", "#", ".", "\x00", "1"]
TEXTS = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join)), max_size=6)
KERNEL = settings(max_examples=120, deadline=None)


def buffers(texts, kind=pa.string()):
    return tk.column_bytes(pa.array(texts, kind))


@KERNEL
@given(TEXTS)
def test_words(texts):
    data, cuts = buffers(texts)
    w = tk.Words(data, cuts)
    raw = data.tobytes()
    for r, t in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(w.starts[w.bounds[r] : w.bounds[r + 1]], w.ends[w.bounds[r] : w.bounds[r + 1]], strict=True)] == brute.words(t)


@KERNEL
@given(TEXTS, st.sampled_from([1, 10, 1000]))
def test_quality(texts, most):
    data, cuts = buffers(texts, pa.large_string())
    for lo, hi in tk.chunks(cuts, most):
        m = quality.measure(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo], {5: 0.3})
        for r in range(lo, hi):
            assert tuple(int(m[k][r - lo]) for k in quality.MEASURES) == brute.quality(texts[r])[:5]
            assert m["dup_chars_5"][r - lo] == brute.dup_chars(texts[r], 5)


@KERNEL
@given(TEXTS)
def test_fingerprints(texts):
    assert simhash.fingerprints(*buffers(texts)).tolist() == [brute.fingerprint(t) for t in texts]


def test_sliced_columns_keep_their_rows():
    column = pa.array(["a b", None, "c", "dd ee ff", ""])
    for lo in range(5):
        data, cuts = tk.column_bytes(column.slice(lo, 2))
        assert [data[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [x or "" for x in column.slice(lo, 2).to_pylist()]
    assert tk.column_bytes(pa.array([], pa.string()))[1].tolist() == [0]


@KERNEL
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=40), min_size=1, max_size=6), st.integers(2, 6))
def test_automata_find_all_windows(docs, window):
    """Every recurring window's passage in one automaton: words removed as by comparing all windows."""
    texts = [" ".join(d) for d in docs]
    hashes = []
    for t in texts:
        w = tk.Words(*buffers([t]))
        hashes.append(w.hashes())
    machine = substrings.Automaton(window, 2)
    for i, d in enumerate(docs):
        if len(d) >= window:
            machine.add(i, hashes[i])
    expected = brute.repeats(list(enumerate(texts)), window)
    assert [int(machine.removed(hashes[i], i).sum()) for i in range(len(docs))] == [x[2] for x in expected]


@KERNEL
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abcd"), max_size=14), max_size=4))
def test_phrases_from_posting_lists(docs, items):
    texts = [" ".join(d) for d in docs]
    block = decontaminate.make_block([(str(i), " ".join(w)) for i, w in enumerate(items)], 10)
    counts, hashes = decontaminate._token_hashes(*buffers(texts))
    order = decontaminate._by_term(hashes) if len(hashes) else np.zeros(0, np.int64)
    ranked = hashes[order]
    last = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True)) if len(ranked) else np.zeros(0, np.int64)
    lists = decontaminate.Lists(block, ranked[last], (last + 1).astype(np.uint32), order.astype(np.uint32))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    hit_w, hit_p, near_w, near_r = decontaminate.look_up(block, lists, bounds)
    exact = {(int(np.searchsorted(bounds, p, "right") - 1), name) for w, p in zip(hit_w, hit_p, strict=True) for name in decontaminate._items(block, np.array([w]))}
    near = {(int(r), name) for w, r in zip(near_w, near_r, strict=True) for name in decontaminate._items(block, np.array([w]))}
    want_exact, want_near = set(), set()
    for r, d in enumerate(docs):
        for i, item in enumerate(items):
            n = min(10, len(item))
            for s in range(len(item) - n + 1 if n else 0):
                window = item[s : s + n]
                if any(d[k : k + n] == window for k in range(len(d) - n + 1)):
                    want_exact.add((r, str(i)))
                if n == 10 and any(sum(any(0 <= b + j + x < len(d) and d[b + j + x] == window[j] for x in range(-2, 3)) for j in range(10)) >= 8 for b in range(-11, len(d) + 2)):
                    want_near.add((r, str(i)))
    assert exact == want_exact and near == want_near
