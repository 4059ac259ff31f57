"""Vectors: normalisation, projection, density clusters and topics.

The reference projects with a stochastic method from a library; here vectors
are projected on their principal components, which is deterministic.  Clusters
are HDBSCAN* as published (mutual reachability, minimum spanning tree, condensed
tree, excess of mass).  Results agree in kind, not in labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ClusterSettings
from ..storage import stored
from .cells import CELL, distances, spanning_edges
from .text import ctfidf

#: Fixed value: what noise is called.
OUTLIERS = "Outliers / unclustered"
#: Points that are compared each with each in one task.
BLOCK = 5_000
#: Centres and vectors that one task compares.
CENTRES, VECTORS = 10_000, 50_000


def l2_normalized(v: Column) -> Column:
    """Unit length in single precision; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # handed over in an array: in the inner function it would be computed for each element
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: (x / F.greatest(n, F.lit(1e-8))).cast("float")))[0]


def project(vectors: DataFrame, id_col: str, vector_col: str, components: int) -> DataFrame:
    """``(id, low)``: normalised vectors on their first principal components, computed from the distributed covariance."""
    rows = vectors.select(id_col, array_to_vector(l2_normalized(F.col(vector_col)).cast("array<double>")).alias("v"))
    model = PCA(k=components, inputCol="v", outputCol="p").fit(rows)
    return model.transform(rows).select(id_col, vector_to_array("p").alias("low"))


def spanning_tree(x: np.ndarray, min_samples: int, core: np.ndarray | None = None) -> np.ndarray:
    """Edges (a, b, distance, later) of the minimum spanning tree under mutual reachability; memory grows with the points alone.

    ``core`` are the distances to the nearest points where there are more than
    these; ``later`` is 0 between copies.  Of equal distances that of a copy
    comes first, then that of the smaller numbers.
    """
    n = len(x)
    core = nearest(x, x, min_samples).max(1) if core is None else core
    outside = np.ones(n, bool)
    near, later, via = np.full(n, np.inf), np.ones(n, bool), np.zeros(n, np.int64)
    edges = np.empty((max(n - 1, 0), 4))
    at = 0
    for e in range(n - 1):
        outside[at] = False
        d = distances(x[at : at + 1], x)[0]
        apart = d > 0
        d = np.maximum(d, np.maximum(core, core[at]))
        same = d == near
        closer = outside & ((d < near) | same & ((apart < later) | (apart == later) & (at < via)))
        near[closer], later[closer], via[closer] = d[closer], apart[closer], at
        left = np.where(outside, near, np.inf)
        first = np.flatnonzero(left == left.min())
        if len(first) > 1:
            first = first[np.lexsort((np.maximum(first, via[first]), np.minimum(first, via[first]), later[first]))]
        at = int(first[0])
        edges[e] = min(via[at], at), max(via[at], at), near[at], later[at]
    return edges[np.argsort(edges[:, 2], kind="stable")]


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances, or as many as there are, from each of x to the points y."""
    k = min(k, len(y))
    out = np.empty((len(x), k))
    step = max(1, (1 << 20) // max(1, len(y)))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.partition(distances(x[lo : lo + step], y), k - 1, axis=1)[:, :k]
    return out


def hdbscan(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None) -> np.ndarray:
    """Labels 0, 1, ... by each cluster's first point, -1 for noise."""
    x = np.asarray(x, float)
    if len(x) < max(2, min_cluster_size):
        return np.full(len(x), -1)
    return clusters_of(spanning_tree(x, min_samples or min_cluster_size), len(x), min_cluster_size)


def clusters_of(edges: np.ndarray, n: int, min_cluster_size: int) -> np.ndarray:
    """The labels of n points from edges (a, b, distance, later) that hold their minimum spanning tree."""
    # single linkage: node n + e joins two nodes at an edge's distance
    left, right, size = np.empty(n - 1, int), np.empty(n - 1, int), np.ones(2 * n - 1, int)
    top = np.arange(n)
    group = np.arange(n)
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 3], edges[:, 2]))]
    length, done = np.empty(n - 1), 0

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b, d in edges[:, :3]:
        ra, rb = find(int(a)), find(int(b))
        if ra == rb:
            continue
        left[done], right[done], length[done] = group[ra], group[rb], d
        size[n + done] = size[left[done]] + size[right[done]]
        top[rb] = ra
        group[ra] = n + done
        done += 1
    density = 1 / np.maximum(length, 1e-12)

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += [left[v - n], right[v - n]]
        return out

    # the condensed tree: each cluster with its birth, stability, child clusters and members
    clusters = [{"node": 2 * n - 2, "birth": 0.0, "stability": 0.0, "children": [], "root": True}]
    todo = [0]
    while todo:
        c = todo.pop()
        node = clusters[c]["node"]
        while node >= n:
            e = node - n
            a, b, lam = left[e], right[e], density[e]
            big = [v for v in (a, b) if size[v] >= min_cluster_size]
            lost = size[node] if len(big) == 2 else size[node] - sum(size[v] for v in big)
            clusters[c]["stability"] += lost * (lam - clusters[c]["birth"])
            if len(big) == 2:
                for v in big:
                    clusters[c]["children"].append(len(clusters))
                    todo.append(len(clusters))
                    clusters.append({"node": v, "birth": lam, "stability": 0.0, "children": [], "root": False})
                break
            if not big:
                break
            node = big[0]
    chosen: set[int] = set()
    best = [0.0] * len(clusters)
    for c in reversed(range(len(clusters))):
        below = sum(best[k] for k in clusters[c]["children"])
        if not clusters[c]["root"] and clusters[c]["stability"] >= below:
            best[c] = clusters[c]["stability"]
            chosen.add(c)
        else:
            best[c] = below
    labels = np.full(n, -1)
    keep, stack = [], [0]
    while stack:
        c = stack.pop()
        if c in chosen:
            keep.append(sorted(points(clusters[c]["node"])))
        else:
            stack += clusters[c]["children"]
    for k, members in enumerate(sorted(keep)):
        labels[members] = k
    return labels


def density_clusters(low: DataFrame, id_col: str, vector_col: str = "low", min_cluster_size: int = 5, most_points: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(id, topic)``: density clusters of all points; exact at any size, -1 for noise.

    Up to ``block`` points are one task's.  More are cut into cells of space
    (see ``cells``), where distances to the nearest points and the minimum
    spanning tree are found without comparing all pairs; the work grows about
    as the points do, if they have few dimensions.  Only the points' numbers and
    the tree's edges, one fewer than points, meet at the end, in one task, where
    clusters are cut from the tree.  Ids must be different; ``most_points``
    refuses more than are meant.
    """
    n = low.count()
    if most_points is not None and n > most_points:
        raise ValueError(f"more than {most_points} points; cluster a sample and use nearest_topic for the rest")
    kind = low.schema[id_col].dataType.simpleString()
    if n < max(2, min_cluster_size):
        return low.select(id_col, F.lit(-1).alias("topic"))
    # numbers in the order of the ids
    points = stored(low.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).repartitionByRange("id").sortWithinPartitions("id"))
    rows = points.select("id", "x", F.row_number().over(W.orderBy("id")).alias("i")) if n <= block else _numbered(points)
    rows = stored(rows.select("id", "x", (F.col("i") - 1).cast("bigint").alias("i")))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame(spanning_tree(np.stack(pdf["x"].to_numpy()), min_cluster_size), columns=["a", "b", "d", "later"]).astype({"a": int, "b": int, "later": int})

    if n <= block:
        edges = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(tree, "a bigint, b bigint, d double, later int")
    else:
        edges = spanning_edges(rows.select("i", "x"), min_cluster_size, min(block, CELL))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = clusters_of(pdf[["a", "b", "d", "later"]].to_numpy(float), n, min_cluster_size)
        return pd.DataFrame({"i": np.arange(n), "topic": labels.astype("int32")})

    found = edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(cut, "i bigint, topic int")
    return rows.join(found, "i").select(F.col("id").cast(kind).alias(id_col), "topic")


def _numbered(points: DataFrame) -> DataFrame:
    """``i``, from 1 on in the order of the stored, sorted ids: each partition's rows are numbered after those before."""
    rows = points.withColumn("part", F.spark_partition_id())
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("least").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("id"))).join(F.broadcast(before), "part").select("id", "x", (F.col("r") + F.col("before")).alias("i"))


def topic_centres(vectors: DataFrame, topics: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(topic, centre)``: normalised mean vectors, noise left out."""
    each = vectors.join(topics.where("topic >= 0"), id_col).select("topic", F.posexplode(l2_normalized(F.col(vector_col))).alias("i", "x"))
    mean = each.groupBy("topic", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("c")).select("topic", l2_normalized(F.col("c")).alias("centre"))


def nearest_topic(vectors: DataFrame, centres: DataFrame, id_col: str, vector_col: str, block: int = CENTRES) -> DataFrame:
    """``(id, topic, similarity)`` for any number of vectors and centres; of equal similarities the smallest topic.

    Up to ``block`` centres are sent to all executors.  More are dealt into
    blocks, which blocks of vectors meet one by one: a task holds one of each
    and gives the best of its centres, and the best of those is taken.  Without
    centres the topic is -1 and the similarity null.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    unit = vectors.select(F.col(f"`{id_col}`").alias("id"), l2_normalized(F.col(vector_col)).alias("v"))
    few = centres.orderBy("topic").limit(block + 1).collect()
    if not few:
        return vectors.select(id_col, F.lit(-1).alias("topic"), F.lit(None).cast("double").alias("similarity"))
    if len(few) > block:
        return _nearest_by_blocks(unit, centres, block).select(F.col("id").alias(id_col), "topic", "similarity")
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r["topic"] for r in few]), np.array([r["centre"] for r in few], np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                topic, similarity = _best(b["v"], *sent.value)
                yield pd.DataFrame({"id": b["id"], "topic": topic, "similarity": similarity})

    return unit.mapInPandas(run, f"id {kind}, topic int, similarity double").withColumnRenamed("id", id_col)


def _best(vectors: pd.Series, topics: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of some centres, in order of their topics, to each vector, some MB of products at a time."""
    x = np.stack(vectors.to_numpy()).astype(np.float32)
    at, similarity = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, (1 << 22) // len(centres))
    for lo in range(0, len(x), step):
        s = x[lo : lo + step] @ centres.T
        at[lo : lo + step], similarity[lo : lo + step] = s.argmax(1), s.max(1)
    return topics[at].astype("int32"), similarity


def _nearest_by_blocks(unit: DataFrame, centres: DataFrame, block: int) -> DataFrame:
    n, k = unit.count(), centres.count()
    mine, theirs = max(1, -(-n // VECTORS)), -(-k // block)
    # rows are numbered, not keyed by their ids, which may be repeated or null
    rows = stored(unit.withColumn("row", F.monotonically_increasing_id()))
    left = rows.withColumn("p", F.pmod(F.xxhash64("row"), F.lit(mine))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    right = centres.select("topic", "centre", F.pmod(F.xxhash64("topic"), F.lit(theirs)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(mine - 1).cast("bigint"))).alias("p"))

    def meet(v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(c):
            return pd.DataFrame({"row": [], "topic": [], "similarity": []})
        c = c.sort_values("topic")
        topic, similarity = _best(v["v"], c["topic"].to_numpy(), np.stack(c["centre"].to_numpy()).astype(np.float32))
        return pd.DataFrame({"row": v["row"].to_numpy(), "topic": topic, "similarity": similarity})

    met = left.select("p", "q", "row", "v").groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, "row bigint, topic int, similarity double")
    best = met.groupBy("row").agg(F.max(F.struct("similarity", (-F.col("topic")).alias("least"))).alias("best"))
    return rows.select("id", "row").join(best, "row").select("id", (-F.col("best.least")).alias("topic"), "best.similarity")


def discover_topics(papers: DataFrame, vectors: DataFrame, settings: ClusterSettings = ClusterSettings()) -> tuple[DataFrame, DataFrame]:
    """Papers with ``topic, umap_x, umap_y, topic_label``, and the topics' summary.

    Takes ``papers(eid, title, citedby_count, doc)`` and ``vectors(eid, vector)``.
    A topic is called after its number and described by its first five terms;
    ``relabelled`` puts a model's names in their place.  Too few papers for a
    cluster are all noise, at 0.
    """
    n = vectors.limit(settings.components + 3).count()
    if n < 4:
        placed = vectors.select("eid", F.lit(-1).alias("topic"), F.lit(0.0).alias("umap_x"), F.lit(0.0).alias("umap_y"))
    else:
        low = stored(project(vectors, "eid", "vector", max(2, min(settings.components, n - 2))))
        topics = density_clusters(low, "eid", "low", settings.min_cluster_size)
        placed = topics.join(low, "eid").select("eid", "topic", F.element_at("low", 1).alias("umap_x"), F.element_at("low", 2).alias("umap_y"))
    label = F.when(F.col("topic") < 0, OUTLIERS).otherwise(F.concat(F.lit("Topic "), F.col("topic")))
    out = stored(papers.join(placed, "eid").withColumn("topic_label", label))
    return out, topic_summary(out, settings.top_terms)


def topic_sums(topics: DataFrame, top_titles: int = 5) -> DataFrame:
    """Papers, citations and most cited titles of each topic."""
    sums = topics.groupBy("topic").agg(F.first("topic_label").alias("label"), F.count("*").alias("n_papers"), F.sum("citedby_count").alias("total_citations"))
    order = W.partitionBy("topic").orderBy(F.desc("citedby_count"), "eid")
    titles = topics.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_titles).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda s: s["title"]).alias("titles"))
    return sums.join(titles, "topic", "left").select("topic", "label", "n_papers", "total_citations", F.array_join("titles", " | ").alias("rep_titles"))


def topic_summary(topics: DataFrame, top_terms: int = 12, top_titles: int = 5, stop_words: list[str] | None = None) -> DataFrame:
    """Papers, citations, leading terms and most cited titles of each topic; without other stop words, English ones are left out."""
    terms = ctfidf(topics, "topic", "eid", "doc", top_terms, stop_words).groupBy(F.col("cluster").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("terms"))
    out = topic_sums(topics, top_titles).join(terms, "topic", "left")
    return out.select("topic", "label", F.when(F.col("topic") < 0, "").otherwise(F.array_join(F.slice("terms", 1, 5), ", ")).alias("summary"), "n_papers", "total_citations", F.array_join("terms", ", ").alias("top_terms"), "rep_titles").orderBy(F.desc("n_papers"), "topic")


def relabelled(summary: DataFrame, names: DataFrame) -> DataFrame:
    """Topic summaries with the labels and summaries of ``names(topic, label, summary)``; noise keeps its own."""
    new = names.where("topic >= 0").select("topic", F.col("label").alias("__label"), F.col("summary").alias("__summary"))
    out = summary.join(new, "topic", "left").withColumn("label", F.coalesce("__label", "label")).withColumn("summary", F.coalesce("__summary", "summary"))
    return out.select(summary.columns).orderBy(F.desc("n_papers"), "topic")
