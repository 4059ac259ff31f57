"""Benchmark decontamination by a positional inverted index (operator 8).

One pass writes the training tokens' postings to the shared folder: a row for
each shard of some megabytes of text, with its terms' hashes, the lists' ends
and the positions of every token.  Shards hold whole documents, so phrases are
looked up shard by shard and nothing has to be gathered by term.  The benchmark
is the stated query set.  It is read in blocks of bounded size; each block is
broadcast and looked up in every shard: a window's lists are taken from the
rarest term of that shard on, each shifted by the term's place in the window,
and intersected.  Proximity matches allow some terms of a window to be missing
or moved by a few places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import discard, fresh, map_batches, sent, stored, table

WINDOW = 10
SHARD_BYTES, SLICE_BYTES = 2 << 20, 1 << 19
#: A block of the query set: UTF-8 bytes of item text at most, or one longer item.
BLOCK_BYTES = 2 << 20
CANDIDATES = 1 << 17
#: Proximity: so many words of a full window, each at most NEAR_SLOP places off.
NEAR_WORDS, NEAR_SLOP = 8, 2


def words_of(data: np.ndarray, cuts: np.ndarray) -> tk.Words:
    return tk.Words(data, cuts, tk.ALNUM_SPLIT, fold=True)


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(shard, ids, counts, terms, ends, postings)``, stored; positions count words from the shard's first."""
    flat = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = flat.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, cuts = tk.column_bytes(batch.column(1))
            for lo, hi in tk.chunks(cuts, SHARD_BYTES):
                counts, hashes = _token_hashes(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
                order = np.lexsort((np.arange(len(hashes)), hashes)) if len(hashes) < 2 else _by_term(hashes)
                ranked = hashes[order]
                last = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True)) if len(ranked) else np.zeros(0, np.int64)
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int64()),
                        ids,
                        pa.array([counts.tolist()], pa.list_(pa.int32())),
                        pa.array([ranked[last].tobytes()], pa.binary()),
                        pa.array([(last + 1).astype(np.uint32).tobytes()], pa.binary()),
                        # byte planes, as the high bytes of positions hardly vary
                        pa.array([order.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()),
                    ],
                    names=["shard", "ids", "counts", "terms", "ends", "postings"],
                )
                shard += 1

    return stored(map_batches(flat, run, f"shard bigint, ids array<{kind}>, counts array<int>, terms binary, ends binary, postings binary"))


def _token_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row and all their hashes, by slices."""
    counts, hashes = [], []
    for lo, hi in tk.chunks(cuts, SLICE_BYTES):
        w = words_of(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
        counts.append(w.counts)
        hashes.append(w.hashes())
    return np.concatenate(counts), np.concatenate(hashes)


def _by_term(hashes: np.ndarray) -> np.ndarray:
    """Positions sorted by term, then by position."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    run = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))
    return (np.sort((run.astype(np.uint64) << np.uint64(32)) | order.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Block:
    """Part of the query set: its words' terms, its different windows, and the items of each."""

    terms: np.ndarray  # sorted hashes
    words: np.ndarray  # the words of all items, as numbers of terms
    start: np.ndarray  # of each window, in words
    long: np.ndarray
    item_ends: np.ndarray  # for each window, the end of its items in items
    items: np.ndarray
    names: list[str]


def make_block(rows: list[tuple[str, str]], window: int) -> Block:
    texts = pa.array([t for _, t in rows], pa.large_string())
    w = words_of(*tk.column_bytes(texts))
    hashes = w.hashes()
    terms, words = np.unique(hashes, return_inverse=True)
    start, long, item = [], [], []
    for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:], strict=True)):
        n = min(window, int(b - a))
        at = np.arange(a, b - n + 1) if n else np.zeros(0, np.int64)
        start.append(at)
        long.append(np.full(len(at), n))
        item.append(np.full(len(at), i))
    start, long, item = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (start, long, item))
    grams, keys = tk.Grams(hashes), np.zeros(len(start), np.uint64)
    for n in np.unique(long):
        keys[long == n] = grams.at(start[long == n], int(n)) ^ np.uint64(n)
    names = sorted({name for name, _ in rows})
    number = {name: k for k, name in enumerate(names)}
    named = np.array([number[name] for name, _ in rows], np.int64)[item]
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([which, named], 1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
    return Block(terms, words.astype(np.int64), start[first], long[first], np.searchsorted(pairs[:, 0], np.arange(len(first)), "right"), pairs[:, 1], names)


def blocks(bench: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Block]:
    rows, size = [], 0
    for row in bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        if rows and size + len(row[1].encode()) > BLOCK_BYTES:
            yield make_block(rows, window)
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += len(row[1].encode())
    yield make_block(rows, window)


class Lists:
    """The posting lists of a shard that a block asks for."""

    def __init__(self, block: Block, terms: np.ndarray, ends: np.ndarray, postings: np.ndarray):
        at = np.searchsorted(terms, block.terms)
        at[at == len(terms)] = 0
        there = terms[at] == block.terms if len(terms) else np.zeros(len(block.terms), bool)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.size = np.where(there, ends[at].astype(np.int64) - begins[at], 0) if len(terms) else np.zeros(len(block.terms), np.int64)
        self.end = np.cumsum(self.size)
        self.first = self.end - self.size
        take = np.repeat(begins[at] - self.first, self.size) + np.arange(self.end[-1] if len(self.end) else 0) if len(terms) else np.zeros(0, np.int64)
        self.positions = postings[take].astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.size)), self.size) << 32) | self.positions

    def has(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a position from low to high."""
        at = np.searchsorted(self.keys, (terms << 32) | np.maximum(low, 0))
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= ((terms << 32) | high)) & (high >= 0)


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Ranges of windows with some CANDIDATES postings each, or one longer list."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, "right")))
        yield slice(lo, hi)
        lo = hi


def _expand(lists: Lists, term: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window every posting of its term, shifted to where the window would start."""
    n = lists.size[term]
    which = np.repeat(np.arange(len(term)), n)
    at = np.repeat(lists.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return which, lists.positions[at] - shift[which]


def look_up(block: Block, lists: Lists, bounds: np.ndarray, slop: int = NEAR_SLOP, near_words: int = NEAR_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact matches (window, position) and proximity matches (window, row)."""
    empty = np.zeros(0, np.int64)
    if not len(block.start) or not len(lists.keys):
        return empty, empty, empty, empty
    width = int(block.long.max())
    place = np.arange(width)
    inside = place < block.long[:, None]
    terms = block.words[np.minimum(block.start[:, None] + place, len(block.words) - 1)]
    df = np.where(inside, lists.size[terms], np.iinfo(np.int64).max)
    order = np.argsort(df, 1, kind="stable")
    row_of = lambda p: np.searchsorted(bounds, p, "right") - 1
    hit_w, hit_p, near_w, near_r = [empty], [empty], [empty], [empty]

    full = np.flatnonzero(np.take_along_axis(df, order[:, :1], 1)[:, 0] > 0)
    for part in _slices(lists.size[terms[full, order[full, 0]]]):
        w = full[part]
        which, begin = _expand(lists, terms[w, order[w, 0]], order[w, 0])
        which = w[which]
        for k in range(1, width):
            live = (begin >= 0) & (begin + block.long[which] <= bounds[-1]) if k == 1 else np.ones(len(which), bool)
            off = order[which, k]
            check = live & (k < block.long[which])
            c = np.flatnonzero(check)
            at = begin[c] + off[c]
            live[c] = lists.has(terms[which[c], off[c]], at, at)
            which, begin = which[live], begin[live]
        same = (begin >= 0) & (row_of(begin) == row_of(begin + block.long[which] - 1))
        hit_w.append(which[same])
        hit_p.append(begin[same])

    # where at most `window - near_words` terms are missing, one of that many and one more rarest is there, up to `slop` off
    whole = np.flatnonzero(block.long == window)
    for k in range(window - near_words + 1):
        rank = order[whole, k] if width == window else empty
        w = whole[lists.size[terms[whole, rank]] > 0] if len(rank) else empty
        for part in _slices((2 * slop + 1) * lists.size[terms[w, order[w, k]]]) if len(w) else ():
            v = w[part]
            own = order[v, k]
            which, begin = _expand(lists, terms[v, own], own)
            row = row_of(begin + own[which])
            which, row = np.repeat(v[which], 2 * slop + 1), np.repeat(row, 2 * slop + 1)
            begin = (begin[:, None] + np.arange(-slop, slop + 1)).ravel()
            count, left = np.ones(len(which), np.int64), window - 1
            for j in (j for j in range(window) if j != k):
                left -= 1
                off = order[which, j]
                at = begin + off
                count += lists.has(terms[which, off], np.maximum(at - slop, bounds[row]), np.minimum(at + slop, bounds[row + 1] - 1))
                live = count + left >= near_words
                which, begin, row, count = which[live], begin[live], row[live], count[live]
            near_w.append(which)
            near_r.append(row)
    return tuple(np.concatenate(x) for x in (hit_w, hit_p, near_w, near_r))


def _block_hits(index: DataFrame, block: Block, window: int) -> DataFrame:
    """``(shard, row, spans, items, near)`` for rows with a match; spans are pairs of first word and end."""
    received = sent(index.sparkSession, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = received()
        for batch in batches:
            for i in range(batch.num_rows):
                shard, counts, terms, ends, postings = (batch.column(c)[i] for c in ("shard", "counts", "terms", "ends", "postings"))
                bounds = np.concatenate([[0], np.cumsum(np.asarray(counts.values, np.int64))])
                planes = np.frombuffer(postings.as_buffer(), np.uint8)
                lists = Lists(b, np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(ends.as_buffer(), np.uint32), np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel())
                hit_w, hit_p, near_w, near_r = look_up(b, lists, bounds, window=window)
                hit_r = np.searchsorted(bounds, hit_p, "right") - 1
                out = []
                for row in np.unique(np.concatenate([hit_r, near_r])).tolist():
                    mine = hit_r == row
                    p = hit_p[mine] - bounds[row]
                    spans = np.unique(np.stack([p, p + b.long[hit_w[mine]]], 1), axis=0).astype(np.int32)
                    out.append((shard.as_py(), row, spans.ravel().tolist(), _items(b, hit_w[mine]), _items(b, near_w[near_r == row])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "row", "spans", "items", "near"])

    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
    return map_batches(index.select("shard", "counts", "terms", "ends", "postings"), run, "shard bigint, row int, spans array<int>, items array<string>, near array<string>")


def _items(b: Block, windows: np.ndarray) -> list[str]:
    begins = np.concatenate([[0], b.item_ends[:-1]]) if len(b.item_ends) else b.item_ends
    found = {k for w in np.unique(windows).tolist() for k in b.items[begins[w] : b.item_ends[w]].tolist()}
    return [b.names[k] for k in sorted(found)]


def _n_covered(spans_lists: pa.Array) -> np.ndarray:
    out = np.zeros(len(spans_lists), np.int64)
    for i, spans in enumerate(spans_lists):
        pairs = np.asarray(spans.values, np.int64).reshape(-1, 2) if spans.is_valid else np.zeros((0, 2), np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        reach = np.concatenate([[0], np.maximum.accumulate(pairs[:, 1])])[:-1] if len(pairs) else pairs[:, 0]
        out[i] = np.maximum(0, pairs[:, 1] - np.maximum(pairs[:, 0], reach)).sum()
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``items`` and ``n_near``.

    Null and empty texts have no words and no hits; so have all documents if
    the benchmark is empty.  Items that share an id count once.  An item
    without an id is listed as ``null``.  Repeated rows and null ids are judged
    row by row.  ``n_near`` counts the items with a proximity match.
    """
    index = build_index(docs, id_col, text_col)
    hits = None
    for block in blocks(bench, item_col, item_text_col, window):
        found = stored(_block_hits(index, block, window))
        hits = found if hits is None else hits.unionByName(found)
    # a row of a document for each block at most
    hits = hits.groupBy("shard", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.size(F.array_distinct(F.flatten(F.collect_list("near")))).alias("n_near"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(2, "spans", pa.array(_n_covered(batch.column(2)), pa.int64()))

    hits = map_batches(hits.select("shard", "row", "spans", "items", "n_near"), count, "shard bigint, row int, spans bigint, items array<string>, n_near int")
    base = index.select("shard", F.posexplode(F.arrays_zip(F.col("ids"), F.col("counts"))).alias("row", "d")).select("shard", "row", F.col("d.ids").alias(id_col), F.col("d.counts").cast("bigint").alias("n_words"))
    base = stored(base)
    discard(index)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(hits, ["shard", "row"], "left").select(
        id_col,
        "n_words",
        F.coalesce("spans", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("spans", F.lit(0)) > 0).alias("contaminated"),
        items.alias("items"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )


def decontaminate_filter(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns.

    Rows are told apart by id and text, so null and repeated ids are safe.
    """
    id_, digest = fresh(docs, "bad_id"), fresh(docs, "bad_digest")
    old = F.col(f"`{text_col}`")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(old).alias("digest"))
    found = decontaminate(docs.select(key.alias("key"), old.alias("text")), bench, "key", "text")
    bad = found.where("contaminated").select(F.col("key.id").alias(id_), F.col("key.digest").alias(digest)).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.xxhash64(old) == F.col(digest)), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")
