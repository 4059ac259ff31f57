"""Language identification by hierarchical discrimination (operator 2).

One-versus-rest linear SVMs first tell language families apart; within the
family, one-versus-one linear SVMs separate its closely related languages and
vote.  Features are the frequencies of hashed byte 1- to 3-grams of the whole
text.  The classifier is fitted on the driver to a bounded sample of labelled
documents, whose features are computed on the executors; prediction is one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import map_batches, sent, table

#: Which languages are closely related; any other value is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
#: Labelled documents that the fit may use: of each language, and in all, shared evenly where there are many languages, but two of each at least.
SAMPLE, SAMPLE_IN_ALL = 400, 4_000
DIMS, GRAMS = 4096, (1, 2, 3)
SLICE_BYTES = 1 << 19
COST, EPOCHS = 1.0, 30
UNKNOWN = "und"

#: A-Z folded, digits alike, other ASCII alike: blank.
SYMBOL = np.full(256, 0x20, np.uint8)
SYMBOL[0x30:0x3A] = 0x30
SYMBOL[0x41:0x5B] = SYMBOL[0x61:0x7B] = np.arange(0x61, 0x7B)
SYMBOL[0x80:] = np.arange(0x80, 0x100)
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
BEYOND = np.arange(256) >= 0x80


def gram_numbers(data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """The feature numbers of the n-grams beginning at each byte, as (n, first byte, numbers), a piece of the text at a time."""
    for first in range(0, len(data), tk.LONG):
        s = SYMBOL[data[first : first + tk.LONG + max(GRAMS) - 1]].astype(np.uint32)
        for n in GRAMS:
            size = min(tk.LONG, len(s) - n + 1)
            if size < 1:
                continue
            code = np.full(size, n, np.uint32)
            for k in range(n):
                code = (code << np.uint32(8)) | s[k : k + size]
            yield n, first, (code * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)


def frequencies(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A row of n-gram frequencies for each text; each n sums to one."""
    out = np.zeros((len(cuts) - 1, DIMS), np.float32)
    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        counts = {n: np.zeros(DIMS, np.int64) for n in GRAMS}
        for n, _, numbers in gram_numbers(data[a:b]):
            counts[n] += np.bincount(numbers, minlength=DIMS)
        for n in GRAMS:
            out[r] += (counts[n] / max(1, b - a - n + 1)).astype(np.float32)
    return out


def decisions(data: np.ndarray, cuts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Frequencies times weights, without building the frequencies."""
    out = np.zeros((len(cuts) - 1, weights.shape[1]))
    many = {n: np.maximum(cuts[1:] - cuts[:-1] - n + 1, 0) for n in GRAMS}
    for n, first, numbers in gram_numbers(data):
        lo = np.clip(cuts[:-1] - first, 0, len(numbers))
        hi = np.clip(cuts[:-1] + many[n] - first, 0, len(numbers))
        for j in range(weights.shape[1]):
            total = np.zeros(len(numbers) + 1)
            np.cumsum(weights[:, j][numbers], dtype=np.float64, out=total[1:])
            out[:, j] += (total[hi] - total[lo]) / np.maximum(many[n], 1)
    return out


def has_letter(column: pa.Array, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    found = np.diff(tk.counted(LETTER, data, cuts)[0]) > 0
    maybe = ~found & (np.diff(tk.counted(BEYOND, data, cuts)[0]) > 0)
    for r in np.flatnonzero(maybe):
        found[r] = any(c.isalpha() for c in column[int(r)].as_py())
    return found


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge SVM by dual coordinate descent; the last column of x is the bias."""
    rng = np.random.default_rng(7)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = 1 / (2 * cost)
    norms = (x * x).sum(1) + diagonal
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + diagonal * alpha[i]
            new = max(0.0, alpha[i] - g / norms[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Classifier:
    families: list[list[str]]
    pairs: list[tuple[str, str]]
    #: Columns: one for each family, then one for each pair; positive means the family, or the pair's first language.
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, d: np.ndarray) -> tuple[list[str], np.ndarray]:
        d = d + self.bias
        n = len(self.families)
        fam = d[:, :n]
        best = fam.argmax(1)
        margin = np.full(len(d), 8.0)
        if n > 1:
            ranked = np.sort(fam, 1)
            margin = (ranked[:, -1] - ranked[:, -2]) / 2
        languages = sorted({x for f in self.families for x in f})
        number = {x: k for k, x in enumerate(languages)}
        votes, sums = np.zeros((len(d), len(languages))), np.zeros((len(d), len(languages)))
        for j, (a, b) in enumerate(self.pairs):
            m = d[:, n + j]
            votes[:, number[a]] += m > 0
            votes[:, number[b]] += m <= 0
            sums[:, number[a]] += m
            sums[:, number[b]] -= m
        score = votes + np.tanh(sums / 10) / 4  # more votes win, then the larger margins
        inside = np.array([[x in f for x in languages] for f in self.families])[best]
        score[~inside] = -np.inf
        pick = score.argmax(1)
        for j, (a, b) in enumerate(self.pairs):
            used = (pick == number[a]) | (pick == number[b])
            margin = np.where(used, np.minimum(margin, np.abs(d[:, n + j])), margin)
        return [languages[k] for k in pick], 1 / (1 + np.exp(-4 * np.maximum(margin, 0)))


def fit(x: np.ndarray, labels: list[str]) -> Classifier | None:
    """Families and pairs are those of the labels seen."""
    present = sorted(set(labels))
    if not present:
        return None
    home = {x: f for f, members in FAMILIES.items() for x in members}
    grouped: dict[str, list[str]] = {}
    for lang in present:
        grouped.setdefault(home.get(lang, lang), []).append(lang)
    families = [grouped[k] for k in sorted(grouped)]
    pairs = [p for f in families for p in combinations(f, 2)]
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    rows = np.hstack([x * scale, np.ones((len(x), 1))])
    label = np.array(labels)
    columns = []
    for f in families:
        y = np.where(np.isin(label, f), 1.0, -1.0)
        columns.append(linear_svm(rows, y) if len(families) > 1 else np.append(np.zeros(DIMS), 1.0))
    for a, b in pairs:
        use = (label == a) | (label == b)
        columns.append(linear_svm(rows[use], np.where(label[use] == a, 1.0, -1.0)))
    w = np.stack(columns, 1)
    return Classifier(families, pairs, (w[:-1] * scale[:, None]).astype(np.float32), w[-1])


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Classifier | None:
    """Fit to at most ``sample`` documents of each language, fewer where languages are many: those with the smallest hashes of their ids."""
    labelled = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()
    if not counts:
        return None
    sample = max(2, min(sample, SAMPLE_IN_ALL // len(counts)))
    draw = (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)).alias("draw")
    # the hash picks somewhat more than the sample; the exact cut is made by order
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.3 * sample + 20) / r["count"])) for r in counts], "lang string, share double")
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw).join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("share")).select("lang", "text", "draw")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cuts = tk.column_bytes(batch.column(1))
            for lo, hi in tk.chunks(cuts, SLICE_BYTES):
                x = frequencies(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "draw", "x"])

    found = sorted(map_batches(rows, features, "lang string, draw double, x binary").collect(), key=lambda r: (r["lang"], r["draw"], bytes(r["x"])))
    taken: dict[str, int] = {}
    x, labels = [], []
    for r in found:
        if taken.setdefault(r["lang"], 0) < sample:
            taken[r["lang"]] += 1
            x.append(np.frombuffer(r["x"], np.float32))
            labels.append(r["lang"])
    return fit(np.stack(x).astype(np.float64), labels) if x else None


def identify(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred`` and ``score``.

    A null text or one without a letter is ``und`` with score 0; so is every
    text if there was nothing to learn from.  Rows are judged one by one.
    """
    flat = docs.select(docs[id_col], docs[text_col])
    received = sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received()
        for batch in batches:
            data, cuts = tk.column_bytes(batch.column(1))
            for lo, hi in tk.chunks(cuts, SLICE_BYTES):
                part, ends = data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo]
                known = has_letter(batch.column(1).slice(lo, hi - lo), part, ends) if m else np.zeros(hi - lo, bool)
                langs, score = m.predict(decisions(part, ends, m.weights)) if m else ([UNKNOWN] * (hi - lo), np.zeros(hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x if k else UNKNOWN for x, k in zip(langs, known, strict=True)]), pa.array(np.where(known, score, 0.0))], names=[id_col, "lang_pred", "score"])

    return map_batches(flat, run, f"`{id_col}` {flat.schema[0].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(fold != 2), "doc_id", "text", "lang")
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
