"""SimHash near-duplicates (operator 7).

Fingerprints are bit-majority votes over the XXH64 hashes of word shingles.
They are linked through an inverted index on positional bytes: two of 64 bits
can spoil at most two of the eight bytes, so a linked pair agrees in at least
six byte positions.  The index is therefore kept at the guaranteed count: one
posting list for each choice of six positions and their values.  A pair that
shares m bytes meets in C(m, 6) lists, and the pairs that meet are exactly
those that reach the minimum, so the tally needs no list of all pairs.  Inside
a list only the two free bytes differ; pairs are verified there by probing the
16 + 120 values at one or two bits' distance.  A list holds at most 65,536
different fingerprints, however many documents carry them, and gives at most
one link for each member that it joins to a smaller one, so no group is ever
written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import connected_components
from .shared import discard, fresh, map_batches, row_digest, stored, table

SHINGLE, BITS, SEED = 3, 2, 42
SLICE_BYTES = 1 << 20
#: Shingles whose places are Python numbers at once.
LISTED = 1 << 18
#: Byte b to eight counters of one byte each, one for each of its bits, lowest bit first.
SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def votes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row, the bits set in over half of its hashes, as one uint64 each."""
    n_rows = len(bounds) - 1
    count = np.diff(bounds)
    # blocks of at most 255 hashes, each within one row, so that byte counters cannot run over
    per_row = -(-count // 255)
    row = np.repeat(np.arange(n_rows), per_row)
    first = np.cumsum(per_row) - per_row
    block = bounds[row] + 255 * (np.arange(len(row)) - first[row])
    out = np.zeros(n_rows, np.uint64)
    if not len(block):
        return out
    raw = hashes.view(np.uint8).reshape(-1, 8)
    edges = np.searchsorted(row, np.arange(n_rows + 1))
    for byte in range(8):
        sums = np.add.reduceat(SPREAD[raw[:, byte]], block)
        bits = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        for i in range(8):
            over = 2 * tk.row_sums(bits[:, i], edges) > count
            out |= over.astype(np.uint64) << np.uint64(8 * byte + i)
    return out


def fingerprints(data: np.ndarray, cuts: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of some rows, given as UTF-8 bytes and offsets; no words: zero."""
    w = tk.Words(data, cuts, fold=True)
    # words with one space after each, so that a shingle is a range of bytes
    long = w.ends - w.starts + 1
    last = np.cumsum(long)
    first = last - long
    joined = np.full(int(last[-1]) if len(last) else 0, 0x20, np.uint8)
    if len(long):
        inside = np.ones(len(joined), bool)
        inside[last - 1] = False
        joined[inside] = w.data[tk.SPACE_SPLIT[w.data]]
    # a row of n words has max(1, n - shingle + 1) shingles, none if it has no word
    n_shingles = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(n_shingles)])
    row = np.repeat(np.arange(len(n_shingles)), n_shingles)
    begin = w.bounds[:-1][row] + np.arange(bounds[-1]) - bounds[row]
    end = np.minimum(begin + shingle, w.bounds[1:][row]) - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.empty(len(begin), np.uint64)
    for lo in range(0, len(begin), LISTED):
        part = slice(lo, lo + LISTED)
        spans = zip(first[begin[part]].tolist(), (last[end[part]] - 1).tolist(), strict=True)
        hashes[part] = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(begin[part]))
    return votes(hashes, bounds)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)``: fp is the fingerprint as a signed long."""
    flat = docs.select(docs[id_col], docs[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cuts = tk.column_bytes(batch.column(1))
            for lo, hi in tk.chunks(cuts, SLICE_BYTES):
                fp = fingerprints(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return map_batches(flat, run, f"id {flat.schema[0].dataType.simpleString()}, fp bigint")


def position_sets(bits: int) -> list[int]:
    """Masks that blank out each choice of ``bits`` of the eight bytes, signed."""
    out = []
    for free in combinations(range(8), bits):
        mask = (1 << 64) - 1
        for byte in free:
            mask &= ~(0xFF << (8 * byte))
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _flips(bits: int) -> list[tuple[int, ...]]:
    return [c for k in range(1, bits + 1) for c in combinations(range(8 * bits), k)]


def list_links(fps: np.ndarray, lists: np.ndarray, bits: int, free: np.ndarray, forest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside posting lists, as a star for each connected part.

    ``fps`` are the members, ``lists`` the number of each one's list, and
    ``free`` has a row for each list: the byte positions that may differ.
    Members of a list agree in all other bytes, so whatever differs from one in
    ``bits`` bits or fewer is found by probing those bits.  A connected part of
    n members gives n - 1 links, to its smallest fingerprint, or, with
    ``forest``, a tree of links that were found themselves, the closest first.
    """
    order = np.lexsort((fps, lists))
    fps, lists = fps[order], lists[order]
    # the list and the free bytes, packed in one sortable key
    residue = np.zeros(len(fps), np.uint64)
    for k in range(bits):
        residue |= ((fps >> (free[lists, k].astype(np.uint64) * np.uint64(8))) & np.uint64(0xFF)) << np.uint64(8 * k)
    keys = (lists.astype(np.uint64) << np.uint64(8 * bits)) | residue
    ranked = np.argsort(keys)
    sorted_keys = keys[ranked]
    found_a, found_b = [], []
    for flip in _flips(bits):
        delta = np.uint64(sum(1 << i for i in flip))
        probe = keys ^ delta
        at = np.searchsorted(sorted_keys, probe)
        at[at == len(sorted_keys)] = 0
        hit = sorted_keys[at] == probe
        hit &= probe > keys  # each pair once
        if hit.any():
            found_a.append(np.flatnonzero(hit))
            found_b.append(ranked[at[hit]])
    if not found_a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if forest:
        # one bit's difference is probed before two
        kept = spanning_forest(len(fps), a, b, np.arange(len(a)))
        return fps[a[kept]], fps[b[kept]]
    root = _least(len(fps), a, b, fps)
    joined = root != np.arange(len(fps))
    return fps[joined], fps[root[joined]]


def _least(n: int, a: np.ndarray, b: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Which member stands for each one's connected part of its list."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) are in the forest of least ranks; ranks differ."""
    root, taken = np.arange(n), np.zeros(len(a), bool)
    while True:
        x, y = root[a], root[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return taken
        best = np.full(n, len(rank), np.int64)
        np.minimum.at(best, x[open_], rank[open_])
        np.minimum.at(best, y[open_], rank[open_])
        chosen = open_[(best[x[open_]] == rank[open_]) | (best[y[open_]] == rank[open_])]
        taken[chosen] = True
        u, v = x[chosen], y[chosen]
        link = np.arange(n)
        while True:
            low = np.minimum(link[u], link[v])
            new = link.copy()
            np.minimum.at(new, link[u], low)
            np.minimum.at(new, link[v], low)
            new = new[new]
            if (new == link).all():
                break
            link = new
        root = link[root]


def fingerprint_links(fps: DataFrame, bits: int = BITS, forest: bool = False) -> DataFrame:
    """``fps(fp)``, distinct, to links ``(a, b)`` that connect whatever is at most ``bits`` bits apart.

    With ``forest`` the two of each link are at most that far apart themselves.
    """
    masks = position_sets(bits)
    free = np.array(list(combinations(range(8), bits)), np.uint64)
    spread = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("held")) for i, m in enumerate(masks)))).alias("k"))
    lists = spread.groupBy("k.choice", "k.held").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("fps")
            sizes = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = members.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            which = np.repeat(np.arange(len(sizes)), sizes)
            choice = batch.column("choice").to_numpy(zero_copy_only=False).astype(np.int64)
            a, b = list_links(flat, which, bits, free[choice], forest)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return map_batches(lists, link, "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and empty texts have the fingerprint zero and are linked like others.
    Rows that share an id are judged each by its own text; a null id never
    names a component, and where a component has null ids only its
    ``component_id`` is null.  Other columns are not read.
    """
    prints = stored(fingerprint_table(docs, id_col, text_col, shingle))
    owners = stored(prints.groupBy("fp").agg(F.min("id").alias("id")))
    # labels must be unique to fingerprints even where ids repeat or are null
    nodes = owners.select(F.col("fp").alias("node"), F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("fp").alias("fp")).alias("label"))
    # few bytes make many list entries: dealt out first, so that a handful of files is not a handful of tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = fingerprint_links(owners.select("fp").repartition(parts, "fp"), bits)
    comps = stored(connected_components(nodes, links).select(F.col("node").alias("fp"), F.col("label.id").alias("component_id")))
    discard(owners)
    return prints.join(comps, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: the first by id, then by the digest of the row.

    Rows with a null id are kept.  Rows that share an id are judged each by its
    own text; rows that are equal throughout are one row.
    """
    mark = fresh(docs, "row")
    marked = docs.withColumn(mark, row_digest(docs))
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(mark).alias("digest"))
    found = simhash_components(marked.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), "key", "text", shingle, bits)
    stay = found.where(F.col("key") == F.col("component_id")).where("NOT key.none").select(F.col("key.digest").alias(mark)).distinct()
    named = marked.where(F.col(f"`{id_col}`").isNotNull()).join(stay, mark, "left_semi").dropDuplicates([mark])
    return named.unionByName(marked.where(F.col(f"`{id_col}`").isNull())).drop(mark)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
