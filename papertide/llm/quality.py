"""Quality rules by repetition coverage (operator 1).

Rolling hashes of several n-gram lengths measure how many of a text's word
characters lie inside n-grams, and how many characters inside lines, that the
text repeats.  One pass over the documents, no shuffle; numpy works on slices
of about a megabyte, so memory does not follow the length of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkernel as tk
from .shared import map_batches, table

#: Largest share of word characters inside duplicated n-grams, by n.
GRAM_LIMITS = {5: 0.30, 7: 0.25, 10: 0.20}
#: Largest share of the characters of non-blank lines that repeat an earlier line.
LINE_CHAR_LIMIT = 0.30
MIN_WORDS = 50
SLICE_BYTES = 1 << 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point.
POINTS = (np.arange(256) & 0xC0) != 0x80


def lines(data: np.ndarray, cuts: np.ndarray, w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines with a word begin and end, and their rows."""
    breaks = np.flatnonzero(data == 0x0A)
    first = np.unique(np.concatenate([cuts[:-1], breaks + 1]))
    first = first[first < len(data)]
    row = np.searchsorted(cuts, first, "right") - 1
    nl = np.searchsorted(breaks, first)
    stop = np.minimum(np.append(breaks, len(data))[nl], cuts[row + 1])
    worded = np.searchsorted(w.starts, stop) > np.searchsorted(w.starts, first)
    return first[worded], stop[worded], row[worded]


def measure(data: np.ndarray, cuts: np.ndarray, gram_limits: dict[int, float]) -> dict[str, np.ndarray]:
    """Every measure of some rows, given as UTF-8 bytes and offsets."""
    w = tk.Words(data, cuts)
    n_rows, total = len(cuts) - 1, len(w.starts)
    rows = w.rows
    first, stop, row = lines(data, cuts, w)
    begin, end, opens, closes = tk.counted(POINTS, data, w.starts, w.ends, first, stop)
    chars, long = end - begin, closes - opens
    out = {"n_words": w.counts.astype(np.int64), "word_chars": tk.row_sums(chars, w.bounds), "n_symbols": np.diff(tk.counted(SYMBOLS, data, cuts)[0])}

    salt = tk.mix(np.arange(1, n_rows + 1, dtype=np.uint64))
    grams = tk.Grams(w.hashes())
    at = tk.gram_starts(w, 3)
    dup = np.zeros(total + 1, bool)
    dup[at] = tk.repeated(grams.at(at, 3) ^ salt[rows[at]])
    out["n_repeat_words"] = tk.row_sums(tk.covered(np.flatnonzero(dup), 3, total), w.bounds)
    for n in gram_limits:
        # an n-gram can repeat only where each of its 3-grams does
        at = tk.gram_starts(w, n)
        at = at[dup[at] & dup[at + n - 3]]
        at = at[tk.repeated(grams.at(at, n) ^ salt[rows[at]])]
        out[f"dup_chars_{n}"] = tk.row_sums(chars * tk.covered(at, n, total), w.bounds)

    keys = w.span_hash(first, stop) ^ salt[row]
    order = np.lexsort((first, keys))
    again = np.zeros(len(first), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    edge = np.searchsorted(row, np.arange(n_rows + 1))
    out["n_dup_lines"] = tk.row_sums(again, edge)
    out["line_chars"], out["dup_line_chars"] = tk.row_sums(long, edge), tk.row_sums(long * again, edge)
    return out


def verdict(m: dict[str, np.ndarray], gram_limits: dict[int, float], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    ok = ~failed
    for n, limit in gram_limits.items():
        ok &= m[f"dup_chars_{n}"] <= limit * m["word_chars"]
    ok &= m["dup_line_chars"] <= LINE_CHAR_LIMIT * m["line_chars"]
    return failed, ok


def _measured(column: pa.Array, gram_limits: dict[int, float], min_words: int) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    data, cuts = tk.column_bytes(column)
    for lo, hi in tk.chunks(cuts, SLICE_BYTES):
        m = measure(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo], gram_limits)
        m["base_failed"], m["kept"] = verdict(m, gram_limits, min_words)
        yield lo, hi, m


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_limits: dict[int, float] = GRAM_LIMITS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, measures, ``base_failed`` and ``kept``.

    A null or empty text has no words, so it fails the word minimum and is not
    kept.  Repeated rows and null ids are judged row by row.  Other columns of
    ``docs`` are not read and may have any names.
    """
    names = [*MEASURES, *(f"dup_chars_{n}" for n in gram_limits), "dup_line_chars"]
    flat = docs.select(docs[id_col], docs[text_col])
    kind = flat.schema[0].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, m in _measured(batch.column(1), gram_limits, min_words):
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(m[n].astype(np.int64)) for n in names[:5]), pa.array(m["base_failed"]), pa.array(m["kept"]), *(pa.array(m[n].astype(np.int64)) for n in names[5:])]
                yield pa.RecordBatch.from_arrays(columns, names=out_names)

    out_names = [id_col, *names[:5], "base_failed", "kept", *names[5:]]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'bigint'}" for n in out_names[1:])
    return map_batches(flat, judge, schema)


def quality_filter(docs: DataFrame, text_col: str = "text", gram_limits: dict[int, float] = GRAM_LIMITS, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [m["kept"] for _, _, m in _measured(batch.column(at), gram_limits, min_words)]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    # names with dots cannot be read by the mapping
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return map_batches(plain, keep, plain.schema).toDF(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
