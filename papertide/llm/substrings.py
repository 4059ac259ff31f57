"""Removal of repeated passages by sharded phrase automata (operator 4).

1. Anchors.  Every window of 50 words picks one of its 10-word phrases, that
   with the smallest hash, so equal windows pick equal phrases, one in about
   twenty.  Phrases met in two documents are counted by hash.
2. Confirmation.  Where a window's phrase recurs, the window itself is hashed.
   Neighbouring windows that pick the same phrase form a span; equal spans are
   merged before their windows are compared, so copies cost no more than one.
   A window in two documents recurs, and its first document is known.
3. Passages.  In its first document a recurring window lies in a run of such
   windows: these runs, each kept once, hold every recurring window.
4. Automata.  Documents are dealt into shards of bounded size.  A shard gets the passages whose
   windows its documents hold and cuts them into blocks of 25 words, of which
   any window of 50 words contains one.  Each block's opening phrase goes into
   the shard's Aho-Corasick automaton, spelt in three letters a word.
5. All documents stream through their shard's automaton; the windows around
   each occurrence are looked up among the passages' windows, and words of those
   that began in a document with a smaller id are removed.

Equality of words, phrases and windows is that of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import discard, map_batches, stored, table

WINDOW, PHRASE = 50, 10
SLICE_BYTES = 1 << 19
#: A word is spelt in so many letters of four bits of its hash: nodes with few branches are walked fast.
LETTERS = 3
#: A shard holds the documents of about so many anchors, some 80 MB of text, and with them no more passages than these can share.
SHARD_ANCHORS = 500_000


def block_words(window: int) -> int:
    """Blocks of so many words, end to end: one lies whole in any window."""
    return (window + 1) // 2


def picked(words: tk.Words, grams: tk.Grams, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of some rows, and each one's phrase hash."""
    starts = tk.gram_starts(words, window)
    at = tk.gram_starts(words, phrase)
    n = len(words.starts)
    hashes = np.full(n, ~np.uint64(0))
    hashes[at] = grams.at(at, phrase)
    bits = np.uint64(max(1, n.bit_length()))
    # the smallest hash, the leftmost of equal ones, over every so many phrases: by doubling
    least = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    span, want = 1, window - phrase + 1
    while span < want:
        step = min(span, want - span)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        span += step
    which = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return starts, hashes[which]


def _joined(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a space after each, and where each begins and ends there."""
    long = words.ends - words.starts + 1
    last = np.cumsum(long)
    out = np.full(int(last[-1]) if len(last) else 0, 0x20, np.uint8)
    if len(long):
        inside = np.ones(len(out), bool)
        inside[last - 1] = False
        out[inside] = words.data[tk.SPACE_SPLIT[words.data]]
    return out, last - long, last - 1


def _slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, tk.Words]]:
    data, cuts = tk.column_bytes(column)
    for lo, hi in tk.chunks(cuts, most):
        yield lo, hi, tk.Words(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])


def find_anchors(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(anchor, id)``, once for each row of ``docs(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, _, w in _slices(batch.column(1)):
                starts, anchors = picked(w, tk.Grams(w.hashes()), window, phrase)
                row = w.rows[starts]
                # runs of windows pick the same phrase
                new = np.append(True, (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1]))[: len(row)]
                yield pa.RecordBatch.from_arrays([pa.array(anchors[new].view(np.int64)), ids.take(pa.array(lo + row[new]))], names=["anchor", "id"])

    return map_batches(docs, run, "anchor bigint, id bigint")


def find_segments(marked: DataFrame, window: int, phrase: int) -> DataFrame:
    """``marked(id, text, anchors)`` to ``(id, text, windows, cuts, keys)``.

    A row for each run of windows whose phrase is among the anchors; spans
    begin at ``cuts`` and are equal where their ``keys`` are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            known = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo, hi, w in _slices(batch.column(1)):
                grams = tk.Grams(w.hashes())
                starts, anchors = picked(w, grams, window, phrase)
                row = w.rows[starts]
                salt = tk.mix(np.arange(1, hi - lo + 1, dtype=np.uint64))
                first = ends[lo] - sizes[lo]
                mine = known[first : ends[hi - 1]] ^ np.repeat(salt, sizes[lo:hi])
                hit = np.isin(anchors ^ salt[row], mine)
                starts, row, anchors = starts[hit], row[hit], anchors[hit]
                if not len(starts):
                    continue
                new = np.append(True, (np.diff(starts) != 1) | (np.diff(row) != 0))
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(starts)) - 1
                buffer, left, right = _joined(w)
                texts = [buffer[a:b].tobytes() for a, b in zip(left[starts[begin]], right[starts[end] + window - 1], strict=True)]
                windows = pa.ListArray.from_arrays(pa.array(np.append(begin, len(starts)), pa.int32()), pa.array(grams.at(starts, window).view(np.int64)))
                # a span ends where its run does or the next window picks another phrase
                cut = np.flatnonzero(new | np.append(True, anchors[1:] != anchors[:-1]))
                size = np.diff(np.append(cut, len(starts)))
                keys = grams.at(starts[cut], size + window - 1) ^ tk.mix(size.astype(np.uint64))
                which = np.searchsorted(begin, cut, "right") - 1
                edges = pa.array(np.searchsorted(which, np.arange(len(begin) + 1)), pa.int32())
                columns = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in ((cut - begin[which]).astype(np.int32), keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + row[begin])), pa.array(texts, pa.binary()).cast(pa.string()), windows, *columns], names=["id", "text", "windows", "cuts", "keys"])

    return map_batches(marked, run, "id bigint, text string, windows array<bigint>, cuts array<int>, keys array<bigint>")


def find_passages(owned: DataFrame, window: int) -> DataFrame:
    """``owned(id, text, bits)`` to ``(id, text)``: runs of windows marked in bits, as pairs (first window, 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_ids, out_texts = [], []
            for i, text, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split(" ")
                mine = np.zeros(64 + max(b["at"] for b in bits), bool)
                for b in bits:
                    mine[b["at"] : b["at"] + 64] |= np.unpackbits(np.array([b["mask"]], "<i8").view(np.uint8), bitorder="little").astype(bool)
                edge = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    out_ids.append(i)
                    out_texts.append(" ".join(words[a : b - 1 + window]))
            if out_ids:
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out_texts, pa.string())], names=["id", "text"])

    return map_batches(owned, run, "id bigint, text string")


def spelt(hashes: np.ndarray) -> str:
    """A text for the automaton: LETTERS letters for each word."""
    nibbles = np.stack([(hashes >> np.uint64(20 + 4 * k)) & np.uint64(15) for k in range(LETTERS)], 1)
    return (nibbles + np.uint64(0x40)).astype(np.uint8).tobytes().decode("ascii")


class Automaton:
    """The passages of a shard: an automaton over their phrases, and their windows with the first document of each."""

    def __init__(self, window: int, phrase: int):
        self.window, self.block = window, block_words(window)
        self.phrase = min(phrase, self.block)
        self.phrases: set[str] = set()
        self.parts: list[tuple[np.ndarray, int]] = []
        self.machine: ahocorasick.Automaton | None = None

    def add(self, first: int, hashes: np.ndarray) -> None:
        text, long = spelt(hashes), LETTERS * self.phrase
        self.phrases.update(text[LETTERS * at : LETTERS * at + long] for at in range(0, len(hashes) - self.block + 1, self.block))
        self.parts.append((tk.Grams(hashes).at(np.arange(len(hashes) - self.window + 1), self.window), first))

    def compile(self) -> None:
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for text in self.phrases:
            self.machine.add_word(text)
        self.machine.make_automaton()
        self.phrases = set()
        keys = np.concatenate([k for k, _ in self.parts])
        firsts = np.repeat(np.array([f for _, f in self.parts], np.int64), [len(k) for k, _ in self.parts])
        order = np.lexsort((firsts, keys))
        keys, firsts = keys[order], firsts[order]
        new = np.append(True, keys[1:] != keys[:-1])
        self.keys, self.firsts, self.parts = keys[new], firsts[new], []

    def removed(self, hashes: np.ndarray, doc: int | None) -> np.ndarray:
        """Marks the words of a document that lie in a window from a document with a smaller id."""
        n = len(hashes)
        if doc is None or n < self.window or not (self.parts or self.machine):
            return np.zeros(n, bool)
        if self.machine is None:
            self.compile()
        ends = np.fromiter((e for e, _ in self.machine.iter(spelt(hashes))), np.int64)
        begin = ends[ends % LETTERS == LETTERS - 1] // LETTERS - self.phrase + 1
        # windows that hold the whole block beginning there
        low, high = np.maximum(begin + self.block - self.window, 0), np.minimum(begin, n - self.window)
        ok = low <= high
        if not ok.any():
            return np.zeros(n, bool)
        change = np.bincount(low[ok], minlength=n + 2) - np.bincount(high[ok] + 1, minlength=n + 2)
        starts = np.flatnonzero(np.cumsum(change[:n]) > 0)
        keys = tk.Grams(hashes).at(starts, self.window)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == keys) & (self.firsts[at] < doc)
        return tk.covered(starts[hit], self.window, n)


def stream(dealt: DataFrame, window: int, phrase: int, id_col: str) -> DataFrame:
    """Rows ``(shard, kind, id, text)``, sorted: each shard's passages (kind 0), then its documents (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, machine = None, None
        for batch in batches:
            shards, kinds, ids = (batch.column(c).to_pylist() for c in range(3))
            for lo, hi, w in _slices(batch.column(3)):
                hashes = w.hashes()
                buffer, left, right = _joined(w)
                out = []
                for r in range(lo, hi):
                    if shards[r] != shard:
                        shard, machine = shards[r], Automaton(window, phrase)
                    a, b = w.bounds[r - lo], w.bounds[r - lo + 1]
                    if kinds[r] == 0:
                        machine.add(ids[r], hashes[a:b])
                        continue
                    gone = machine.removed(hashes[a:b], ids[r])
                    n_gone = int(gone.sum())
                    if n_gone == 0:
                        kept = buffer[left[a] : right[b - 1]].tobytes() if b > a else b""
                    else:
                        stay = np.repeat(~gone, right[a:b] - left[a:b] + 1)
                        kept = buffer[left[a] : right[b - 1] + 1][stay].tobytes()[:-1]
                    out.append((ids[r], int(b - a), n_gone, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    keep_text = "kept_text" in dealt.columns
    names = [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return map_batches(dealt, run, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``, and ``kept_text`` if asked for.

    Ids are integers.  Null and empty texts have no words.  A row with a null
    id loses nothing and is no other's first document; rows that share an id
    are no repeats of each other.
    """
    spark = docs.sparkSession
    flat = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    named = flat.where("id IS NOT NULL AND text IS NOT NULL")
    anchors = stored(find_anchors(named, window, phrase))
    n_anchors = anchors.count()
    recurring = stored(anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"))
    lists = stored(anchors.join(recurring, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("anchors")))
    discard(anchors, recurring)
    # lists are a small part of their texts: hashed, so that no text is sorted
    marked = named.join(lists.hint("shuffle_hash"), "id").select("id", "text", "anchors")
    segments = stored(find_segments(marked, window, phrase).withColumn("segment", F.monotonically_increasing_id()))
    discard(lists)
    last = F.coalesce(F.try_element_at("cuts", F.col("nth") + 2), F.size("windows"))
    spans = segments.select("segment", "id", "windows", "cuts", "keys", F.posexplode("cuts").alias("nth", "cut"))
    spans = spans.select("segment", "id", "cut", F.element_at("keys", F.col("nth") + 1).alias("span"), F.slice("windows", F.col("cut") + 1, last - F.col("cut")).alias("windows"))
    # equal spans once, with their first and last documents
    merged = stored(spans.groupBy("span").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.any_value("windows").alias("windows")))
    firsts = merged.select("a", "b", F.explode("windows").alias("key")).groupBy("key").agg(F.min("a").alias("first"), F.max("b").alias("last")).where("first < last").select("key", "first")
    firsts = stored(firsts)
    each = merged.select("span", "a", F.posexplode("windows").alias("at", "key")).join(firsts, "key")
    found = stored(each.groupBy("span", "a", "first", (F.col("at") / 64).cast("int").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("mask")))
    discard(firsts, merged)
    # a window is kept from its first document, in whose spans it lies
    where = spans.select("segment", "id", "cut", "span")
    own = where.join(found.where("a = first").select("span", F.col("a").alias("id"), "block", "mask"), ["span", "id"])
    own = own.groupBy("segment").agg(F.collect_list(F.struct((F.col("cut") + 64 * F.col("block")).alias("at"), "mask")).alias("bits"))
    passages = stored(find_passages(segments.join(own, "segment").select("id", "text", "bits"), window))
    shards = F.lit(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_anchors // SHARD_ANCHORS)))
    shard = F.pmod(F.xxhash64("id"), shards).cast("int").alias("shard")
    # hashes pass over nulls: a row without an id goes by its text
    own_shard = F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), shards).cast("int").alias("shard")
    needed = stored(where.join(found.select("span", "first").distinct(), "span").where("first < id").select("first", shard).distinct())
    discard(segments, found)

    sent = passages.join(needed, passages["id"] == needed["first"]).select("shard", F.lit(0).alias("kind"), passages["id"], "text")
    dealt = sent.unionByName(flat.select(own_shard, F.lit(1).alias("kind"), "id", "text"))
    if keep_text:
        dealt = dealt.withColumn("kept_text", F.lit(None).cast("string"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "kind")
    out = stream(dealt, window, phrase, id_col)
    return out if keep_text else out.drop("kept_text")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
