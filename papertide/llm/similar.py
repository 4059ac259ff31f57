"""Near-duplicates by SimHash, held to the true similarity of their word shingles (the pipeline's second stage).

Two documents are linked where the Jaccard similarity of their sets of five-word
shingles is ``SIMILARITY`` or more.  SimHash comes first: fingerprints of
operator 7 that are equal or at most ``BITS`` bits apart are candidates, found
by its inverted index, and links are those of them whose whole sets are similar
enough.  No radius of bits holds all such pairs, so a prefix filter, which does,
then looks for what joins the groups that SimHash has made: under one order of
all shingles, two such sets share one of the first n - ceil(0.8 n) + 1 of each.
The order puts shingles that many documents have last, so that license lines
and other boilerplate make no long lists; whatever it is, no pair is lost.

A list is never gathered as one row.  Lists are told apart by their counts and
two digests of their members, equal ones are kept once, and a long one is cut
into blocks whose pairs are looked at one by one; blocks whose members are one
group already are left out.  Inside a block sketches refuse whatever differs in
too many shingles for sure.  What is left is not written out as pairs: a block
gives the edges of a minimum spanning forest of its groups, the closest first.
These are verified by whole sets.  A second look at the lists then gives every
pair that the sketches leave in question and that is not yet connected, so a
link that hides behind an edge that proved false is not lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import connected_components
from .shared import discard, fresh, map_batches, row_digest, sent, stored
from .simhash import fingerprint_links, fingerprints, spanning_forest

SHINGLE, SIMILARITY = 5, 0.8
SLICE_BYTES = 1 << 20
#: So many of the most common shingles come last in the order, the rest by their hashes.
COMMON = 200_000
#: Bits of a sketch, powers of two: at least twice the shingles, within these bounds.  Each tells whether an odd number of shingles falls on it.
LEAST_BITS, MOST_BITS = 512, 16384
#: A list is looked at in pairs of blocks of about so many members.
BLOCK = 1024
#: Rows of a block whose distances are held at once, in words of 64 bits.
HELD = 1 << 21
#: Less than any difference between quotients of numbers of shingles, more than their rounding.
EPS = 1e-9


def shingle_sets(data: np.ndarray, cuts: np.ndarray, shingle: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some rows, in order row by row, and the n + 1 bounds of the rows.

    ``common`` are the hashes that come last, sorted as they shall come.  A row
    of fewer words than a shingle has all its words as one, a row without words none.
    """
    w = tk.Words(data, cuts, fold=True)
    n_shingles = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(n_shingles)), n_shingles)
    begin = w.bounds[:-1][row] + np.arange(len(row)) - (np.cumsum(n_shingles) - n_shingles)[row]
    hashes = tk.Grams(w.hashes()).at(begin, np.minimum(shingle, w.counts[row]))
    place = np.zeros(len(hashes), np.int64)
    if len(common):
        ranked = np.argsort(common)
        at = np.minimum(np.searchsorted(common[ranked], hashes), len(common) - 1)
        place = np.where(common[ranked][at] == hashes, ranked[at] + 1, 0)
    order = np.lexsort((hashes, place, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n_shingles)))])


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, cuts = tk.column_bytes(column)
    for lo, hi in tk.chunks(cuts, SLICE_BYTES):
        yield lo, hi, data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo]


def _lists(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))


def sketch_words(n: np.ndarray) -> np.ndarray:
    """How many words of 64 bits the sketches of sets of these sizes have."""
    bits = 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64)
    return np.clip(bits, LEAST_BITS, MOST_BITS) // 64


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches one after the other, as words, and their bounds: two rows' sketches, folded to one size, differ in no more bits than their sets in shingles."""
    n = np.diff(bounds)
    words = sketch_words(n)
    edges = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(edges[-1], np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    bit = (hashes & (64 * words[row] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, edges[row] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out, edges


def common_shingles(texts: DataFrame, shingle: int, most: int = COMMON) -> np.ndarray:
    """Up to ``most`` shingles that recur in texts close to each other, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for _, _, data, cuts in _slices(batch.column(0)):
                found, n = np.unique(shingle_sets(data, cuts, shingle, none)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

    rows = map_batches(texts, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most)
    return np.array([r["h"] for r in rows.collect()][::-1], np.int64).view(np.uint64)


def likely_pairs(n: np.ndarray, words: np.ndarray, edges: np.ndarray, similarity: float, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) that may be similar by their sizes and sketches, and in how many bits they differ.

    Where both values of ``side`` occur, only pairs of one of each are looked at.
    """
    size = np.diff(edges)
    across = bool(side.any() and not side.all())
    most = (1 - similarity) / (1 + similarity)
    left, right, apart = [], [], []
    for m in np.unique(size).tolist():
        own, double = np.flatnonzero(size == m), np.flatnonzero(size == 2 * m)
        sketch = words[edges[own][:, None] + np.arange(m)]
        if len(double):
            both = words[edges[double][:, None] + np.arange(2 * m)]
            sketch = np.concatenate([sketch, both[:, :m] ^ both[:, m:]])
        every = np.concatenate([own, double])
        step = max(1, HELD // (m * len(every)))
        for lo in range(0, len(own), step):
            mine = own[lo : lo + step]
            near = np.minimum(n[mine, None], n[every]) >= similarity * np.maximum(n[mine, None], n[every]) - EPS
            near &= np.arange(len(every)) > np.arange(lo, lo + len(mine))[:, None]
            if across:
                near &= side[mine, None] != side[every]
            i, j = np.nonzero(near)
            differ = np.zeros(len(i), np.int64)
            for a in range(0, len(i), max(1, HELD // m)):
                part = slice(a, a + max(1, HELD // m))
                differ[part] = np.bitwise_count(sketch[lo + i[part]] ^ sketch[j[part]]).sum(1)
            ok = differ <= most * (n[mine[i]] + n[every[j]]) + EPS
            left.append(mine[i[ok]])
            right.append(every[j[ok]])
            apart.append(differ[ok])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (left, right, apart))


def _blocks(postings: DataFrame, heads: DataFrame, nodes: DataFrame, labels: DataFrame, others: bool) -> DataFrame:
    """``(members)``: a row for each pair of blocks of each list, with the members' keys, sizes, sketches, sides and labels.

    Nodes without a label are groups of their own, or left out unless ``others``.
    """
    labelled = nodes.select("key", "n", "sketch").join(labels, "key", "left" if others else "inner").withColumn("label", F.coalesce("label", "key"))
    member = postings.join(heads, "h").select("h", "c", "key").join(labelled, "key")
    cut = F.ceil(F.col("c") / BLOCK).cast("int")
    member = member.withColumn("block", F.pmod(F.xxhash64("key"), cut).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    # where both are one block there is no other side
    one = F.struct("key", "n", "sketch", (F.col("block") > F.col("other")).alias("side"), "label")
    pairs = member.select("h", low.alias("p"), high.alias("q"), one.alias("x")).groupBy("h", "p", "q").agg(F.collect_list("x").alias("m"))
    return pairs.where(F.exists("m", lambda x: x["label"] != F.col("m")[0]["label"])).select("m")


def _edges(blocks: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Likely pairs ``(a, b)`` of different labels, a < b; with ``forest`` only a block's spanning forest of its labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            for i in range(len(lists)):
                m = lists[i].values
                key, n, side, label = (np.asarray(m.field(f).to_numpy(zero_copy_only=False)) for f in ("key", "n", "side", "label"))
                order = np.argsort(key)
                data, cuts = tk.column_bytes(m.field("sketch").take(pa.array(order)))
                key, n, side, label = key[order], n[order].astype(np.int64), side[order].astype(bool), label[order]
                a, b, apart = likely_pairs(n, np.frombuffer(data.tobytes(), np.uint64), cuts // 8, similarity, side)
                new = label[a] != label[b]
                a, b, apart = np.minimum(a, b)[new], np.maximum(a, b)[new], apart[new]
                kept = np.ones(len(a), bool)
                if forest:
                    ranked = np.lexsort((b, a, apart))
                    a, b = a[ranked], b[ranked]
                    group = np.unique(label, return_inverse=True)[1]
                    kept = spanning_forest(len(key), group[a], group[b], np.arange(len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(key[a[kept]]), pa.array(key[b[kept]])], names=["a", "b"])

    return map_batches(blocks, run, "a bigint, b bigint").distinct()


def _similar(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the stored ``pairs(a, b)`` whose sets are similar enough; only texts that are asked for are read again."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for lo, hi, data, cuts in _slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(*shingle_sets(data, cuts, shingle, none))], names=["key", "grams"])

    asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    owners = nodes.join(asked, "key", "left_semi").select("key", F.col("label.digest").alias("digest"))
    found = keyed.select("digest", "text").join(owners, "digest").dropDuplicates(["digest"]).select("key", "text")
    sets = stored(map_batches(found, whole, "key bigint, grams array<bigint>"))
    both = pairs
    for name in ("a", "b"):
        both = both.join(sets.select(F.col("key").alias(name), F.col("grams").alias(f"grams_{name}")), name)
    sized = both.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).alias("both"), (F.size("grams_a") + F.size("grams_b")).alias("total"))
    out = stored(sized.where(F.col("both") >= similarity * (F.col("total") - F.col("both")) - EPS).select("a", "b"))
    discard(sets)
    return out


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs of keys ``(a, b)``, a < b, that SimHash proposes for ``nodes(key, fp)``.

    Keys of one fingerprint meet the least of them, and the least of two
    fingerprints each other where the index joins these.
    """
    owners = stored(nodes.groupBy("fp").agg(F.min("key").alias("key")))
    same = nodes.join(owners.withColumnRenamed("key", "other"), "fp").where("key != other").select(F.col("other").alias("a"), F.col("key").alias("b"))
    # few bytes make many list entries: dealt out first
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = fingerprint_links(owners.select("fp").repartition(parts, "fp"), forest=True)
    for side in "ab":
        links = links.join(owners.select(F.col("fp").alias(side), F.col("key").alias(f"key_{side}")), side)
    near = links.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
    out = stored(same.union(near).distinct())
    discard(owners)
    return out


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, common: int = COMMON) -> DataFrame:
    """``(key, label)``: each different shingle set, and the row that stands for its component, as ``label.id`` and ``label.digest``.

    That row is the first by id, nulls last, then by a digest of the whole row.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), row_digest(docs).alias("digest"), F.col(f"`{text_col}`").alias("text"))
    last = sent(docs.sparkSession, common_shingles(keyed.select("text"), shingle, common))
    kind = docs.schema[id_col].dataType.simpleString()

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = last()
        for batch in batches:
            for lo, hi, data, cuts in _slices(batch.column(2)):
                prints = fingerprints(data, cuts)
                grams, bounds = shingle_sets(data, cuts, shingle, order)
                n = np.diff(bounds)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(grams))])
                first = np.where(n > 0, n - np.ceil(similarity * n - EPS).astype(np.int64) + 1, 0)
                kept = np.arange(len(grams)) - np.repeat(bounds[:-1], n) < np.repeat(first, n)
                sketch, edges = sketches(grams, bounds)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((8 * edges).astype(np.int32)), pa.py_buffer(sketch)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)), pa.array(n.astype(np.int32)), _lists(grams[kept], np.concatenate([[0], np.cumsum(first)])), packed, pa.array(prints.view(np.int64))],
                    names=["id", "digest", "key", "n", "prefix", "sketch", "fp"],
                )

    short = map_batches(keyed, shorten, f"id {kind}, digest string, key bigint, n int, prefix array<bigint>, sketch binary, fp bigint")
    label = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("digest").alias("digest"), F.col("key").alias("key"))
    nodes = stored(short.groupBy("key").agg(F.min(label).alias("label"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp")))

    proposed = simhash_candidates(nodes.select("key", "fp"))
    links = _similar(proposed, nodes, keyed, shingle, similarity)
    discard(proposed)
    joined = stored(_grouped(links, links))

    postings = nodes.select("key", F.explode("prefix").alias("h"))
    # near copies share most of their prefix: lists of the same members are kept once
    lists = postings.groupBy("h").agg(F.count("*").alias("c"), F.min("key").alias("least"), F.bit_xor(F.xxhash64("key")).alias("mark")).where("c > 1")
    heads = stored(lists.groupBy("c", "least", "mark").agg(F.min("h").alias("h")).select("h", "c"))

    tried = stored(_edges(_blocks(postings, heads, nodes, joined, others=True), similarity, forest=True))
    found = _similar(tried, nodes, keyed, shingle, similarity)
    so_far = stored(_grouped(tried.union(links), links.union(found)))
    # members without any likely partner in another group have none in another look either
    rest = _edges(_blocks(postings, heads, nodes, so_far, others=False), similarity, forest=False)
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"))
    discard(joined, so_far, heads, tried)
    others = _similar(rest, nodes, keyed, shingle, similarity)
    discard(rest)
    every = links.union(found).union(others)
    out = stored(connected_components(nodes.select(F.col("key").alias("node"), "label"), every).select(F.col("node").alias("key"), "label"))
    discard(nodes, links, found, others)
    return out


def _grouped(met: DataFrame, links: DataFrame) -> DataFrame:
    """``(key, label)`` of the nodes of ``met(a, b)`` as ``links(a, b)`` join them."""
    nodes = met.select(F.col("a").alias("node")).union(met.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("label"))
    return connected_components(nodes, links).select(F.col("node").alias("key"), "label")


def similar_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: the first by id, nulls last, then by the digest of the row.

    Texts without words are copies of each other.  Rows that are equal
    throughout are one row.  Columns may have any names.
    """
    mark = fresh(docs, "row")
    stay = similar_components(docs, id_col, text_col, shingle, similarity).select(F.col("label.digest").alias(mark)).distinct()
    kept = docs.withColumn(mark, row_digest(docs)).join(stay, mark, "left_semi")
    # rows that are equal throughout have one digest
    return kept.dropDuplicates([mark]).drop(mark)
