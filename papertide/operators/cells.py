"""The minimum spanning tree, under mutual reachability, of points too many to be compared each with each.

Space is cut into cells at medians of a sample; the sample decides where, and
nothing else.  A cell's points are compared with one another, and each point
with those cells only that its best distance so far leaves open, so that the
work grows with the points where they have few dimensions (a ball reaches more
cells the more dimensions there are).  Both results are exact: distances to the
nearest points, and the tree, which grows by Boruvka's rounds.  Of equal
distances that of a copy comes first, then that of the smaller numbers, so that
there is one tree, however cells are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored

#: Points of a cell, and asking points that meet it in one group.
CELL, ASKING = 1_500, 50_000
#: Points on which the cuts are decided: some for each cell, and at most.
SAMPLED, MOST_SAMPLED = 40, 200_000
#: Distances that are held at once.
HELD = 1 << 17
#: The first edge found out of each component.
FOUND = "comp bigint, w double, a bigint, b bigint, other bigint"
NONE = pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between two sets of points, added up dimension by dimension."""
    d = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        g = x[:, j, None] - y[:, j]
        g *= g
        d += g
    return np.sqrt(d, out=d)


class Tree(NamedTuple):
    """Cuts as a heap from 1 on, the halves of node v being 2 v and 2 v + 1; ``axis`` is -1 at cells.

    ``low`` and ``high`` are the boxes of a node's points, ``least`` their least
    core distance, ``only`` the component that all of them are of, or -1.
    """

    axis: np.ndarray
    value: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    least: np.ndarray | None = None
    only: np.ndarray | None = None


def cuts(sample: np.ndarray, depth: int) -> Tree:
    axis, value = np.full(2 << depth, -1), np.zeros(2 << depth)
    parts = {1: sample}
    for v in range(1, 1 << depth):
        x = parts.pop(v, sample[:0])
        wide = np.ptp(x, axis=0) if len(x) else np.zeros(1)
        if wide.max() <= 0:
            continue
        j = int(wide.argmax())
        c = np.sort(x[:, j])
        at = c[(len(c) - 1) // 2]
        axis[v], value[v] = j, at if at < c[-1] else c[c < c[-1]][-1]
        right = x[:, j] > value[v]
        parts[2 * v], parts[2 * v + 1] = x[~right], x[right]
    return Tree(axis, value)


def cell_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    node, all_ = np.ones(len(x), np.int64), np.arange(len(x))
    while (tree.axis[node] >= 0).any():
        j = tree.axis[node]
        node = np.where(j < 0, node, 2 * node + (x[all_, j] > tree.value[node]))
    return node


def upward(leaf: np.ndarray, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Values of all nodes from those of the cells; what is under no cell keeps its own."""
    out = leaf.copy()
    for v in range(len(leaf) // 2 - 1, 0, -1):
        out[v] = join(out[v], join(out[2 * v], out[2 * v + 1]))
    return out


def reached(tree: Tree, x: np.ndarray, within: np.ndarray, comp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a point and a cell no farther than the point asks for, which may hold points of other components."""
    p, node, out = np.arange(len(x)), np.ones(len(x), np.int64), []
    while len(p):
        gap = np.zeros(len(p))
        for j in range(x.shape[1]):
            g = np.maximum(np.maximum(tree.low[node, j] - x[p, j], x[p, j] - tree.high[node, j]), 0)
            gap += g * g
        ok = np.sqrt(gap) <= within[p]
        if comp is not None:
            ok &= (tree.least[node] <= within[p]) & (tree.only[node] != comp[p])
        p, node = p[ok], node[ok]
        cell = tree.axis[node] < 0
        out.append((p[cell], node[cell]))
        p, node = np.repeat(p[~cell], 2), (2 * node[~cell, None] + np.arange(2)).ravel()
    return np.concatenate([a for a, _ in out] or [p]), np.concatenate([b for _, b in out] or [node])


def points_of(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def closest(x: np.ndarray, y: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distances from each of x to its nearest k of y, in order, and how many copies each of those has."""
    k = min(k, len(y))
    d, c = np.empty((len(x), k)), np.empty((len(x), k), np.int64)
    step = max(1, HELD // len(y))
    for lo in range(0, len(x), step):
        far = distances(x[lo : lo + step], y)
        at = np.argpartition(far, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(far, at, 1)
        order = near.argsort(1, kind="stable")
        d[lo : lo + step], c[lo : lo + step] = np.take_along_axis(near, order, 1), copies[np.take_along_axis(at, order, 1)]
    return d, c


def crossing(x: np.ndarray, core: np.ndarray, comp: np.ndarray, i: np.ndarray, y: pd.DataFrame, within: np.ndarray | None = None) -> pd.DataFrame:
    """For each component among some points, its first edge to points of other components."""
    y = y.sort_values("i")
    to, their_core, their_comp, number = points_of(y["x"]), y["core"].to_numpy(), y["comp"].to_numpy(), y["i"].to_numpy()
    at, w = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, HELD // len(y))
    for lo in range(0, len(x), step):
        d = distances(x[lo : lo + step], to)
        np.maximum(d, their_core, out=d)
        np.maximum(d, core[lo : lo + step, None], out=d)
        d[comp[lo : lo + step, None] == their_comp] = np.inf
        # of equal distances the first, so that of the smallest number
        at[lo : lo + step] = d.argmin(1)
        w[lo : lo + step] = np.take_along_axis(d, at[lo : lo + step, None], 1)[:, 0]
    ok = np.isfinite(w) if within is None else w <= within
    out = pd.DataFrame({"comp": comp[ok], "w": w[ok], "a": np.minimum(i, number[at])[ok], "b": np.maximum(i, number[at])[ok], "other": their_comp[at][ok]})
    return out.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")


def met(asking: DataFrame, points: DataFrame, tasks: int, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Asking points with the points of the cells that they ask; where very many ask one cell, in several groups."""
    asking = stored(asking)
    parts = F.broadcast(asking.groupBy("cell").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("parts")))
    left = asking.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int")).drop("parts")
    right = points.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = (df.repartition(tasks, "cell", "part").groupBy("cell", "part") for df in (left, right))
    out = stored(next(both).cogroup(next(both)).applyInPandas(work, schema))
    discard(asking)
    return out


def spanning_edges(rows: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """``(a, b, d, later)``: the tree's edges between the numbers of ``rows(i, x)``; ``later`` is 0 between copies."""
    spark = rows.sparkSession
    # copies are one point: they meet at its core distance
    single = stored(rows.groupBy("x").agg(F.min("i").alias("i"), F.count("*").alias("copies")))
    n = single.count()
    depth = max(0, int(np.ceil(np.log2(n / cell))))
    every = max(1, n // min(SAMPLED << depth, MOST_SAMPLED))
    sample = single.where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0).select("x").toPandas()
    tree = cuts(points_of(sample["x"]), depth) if len(sample) else Tree(np.full(2, -1), np.zeros(2))
    tasks = max(2 * spark.sparkContext.defaultParallelism, (1 << depth) // 16)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=cell_of(tree, points_of(b["x"])))

    placed = stored(single.mapInPandas(place, "x array<double>, i bigint, copies bigint, cell bigint").repartition(tasks, "cell"))
    dims = len(placed.select("x").first()[0])
    ends = [f(F.col("x")[j]) for f in (F.min, F.max) for j in range(dims)]
    boxes = np.array(placed.groupBy("cell").agg(*ends).collect(), float)
    low, high = np.full((len(tree.axis), dims), np.inf), np.full((len(tree.axis), dims), -np.inf)
    low[boxes[:, 0].astype(int)], high[boxes[:, 0].astype(int)] = boxes[:, 1 : 1 + dims], boxes[:, 1 + dims :]
    tree = tree._replace(low=upward(low, np.minimum), high=upward(high, np.maximum))

    known = _with_core(placed, tree, k, tasks)
    copied = rows.join(known.where("copies > 1").select("x", "core", F.col("i").alias("a")), "x").where("i <> a")
    copied = copied.select("a", F.col("i").alias("b"), F.col("core").alias("d"), F.lit(0).alias("later"))

    least = np.full(len(tree.axis), np.inf)
    for r in known.groupBy("cell").agg(F.min("core").alias("least")).collect():
        least[r["cell"]] = r["least"]
    tree = tree._replace(least=upward(least, np.minimum))
    state = stored(known.select("i", "x", "core", "cell", F.col("i").alias("comp")).repartition(tasks, "cell"))
    discard(placed)
    edges: list[DataFrame] = []
    while (merged := _round(state, tree, tasks)) is not None:
        discard(state)
        edges.append(merged[0])
        state = merged[1]
    discard(state)
    grown = [e.select("a", "b", F.col("w").alias("d"), F.lit(1).alias("later")).distinct() for e in edges]
    return reduce(DataFrame.union, grown, copied)


def _with_core(placed: DataFrame, tree: Tree, k: int, tasks: int) -> DataFrame:
    """Cells' points with ``core``, the distance to the k-th nearest of all, itself and copies counted."""

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        x = points_of(pdf["x"])
        d, c = closest(x, x, pdf["copies"].to_numpy(), k)
        enough = c.cumsum(1) >= k
        bound = np.where(enough.any(1), np.take_along_axis(d, enough.argmax(1)[:, None], 1)[:, 0], np.inf)
        return pdf.assign(bound=bound, d=list(d), c=list(c))

    nested = "d array<double>, c array<bigint>"
    first = stored(placed.repartition(tasks, "cell").groupBy("cell").applyInPandas(within, f"x array<double>, i bigint, copies bigint, cell bigint, bound double, {nested}"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p, there = reached(tree, points_of(b["x"]), b["bound"].to_numpy())
                out = b.iloc[p].assign(cell=there)
                yield out[there != b["cell"].to_numpy()[p]]

    def beyond(asking: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(points):
            return pd.DataFrame({"i": [], "d": [], "c": []})
        d, c = closest(points_of(asking["x"]), points_of(points["x"]), points["copies"].to_numpy(), k)
        keep = d < asking["bound"].to_numpy()[:, None]
        some = keep.any(1)
        size = keep[some].sum(1)
        return pd.DataFrame({"i": asking["i"].to_numpy()[some], "d": [v[:s] for v, s in zip(d[some], size)], "c": [v[:s] for v, s in zip(c[some], size)]})

    asking = first.select("i", "x", "cell", "bound").mapInPandas(ask, "i bigint, x array<double>, cell bigint, bound double")
    more = met(asking, placed.select("cell", "x", "copies"), tasks, beyond, f"i bigint, {nested}")
    more_of = more.groupBy("i").agg(F.flatten(F.collect_list("d")).alias("d2"), F.flatten(F.collect_list("c")).alias("c2"))
    every = [F.concat(c, F.coalesce(c + "2", F.array().cast(kind))).alias(c) for c, kind in (("d", "array<double>"), ("c", "array<bigint>"))]
    near = first.join(more_of, "i", "left").select("i", "x", "copies", "cell", *every).withColumn("near", F.array_sort(F.arrays_zip("d", "c")))
    core = F.aggregate("near", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("core")), lambda s, e: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + e["c"]).alias("n"), e["d"].alias("core"))))["core"]
    out = stored(near.select("i", "x", "copies", "cell", core.alias("core")))
    discard(first, more)
    return out


def _round(state: DataFrame, tree: Tree, tasks: int) -> tuple[DataFrame, DataFrame] | None:
    """The first edge out of every component but the largest, and the points with what they are of then; None if they are of one."""
    largest = state.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(2).collect()
    if len(largest) < 2:
        return None
    idle = largest[0]["comp"]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["comp"] != idle]
        return crossing(points_of(mine["x"]), mine["core"].to_numpy(), mine["comp"].to_numpy(), mine["i"].to_numpy(), pdf) if len(mine) else NONE

    near = stored(state.repartition(tasks, "cell").groupBy("cell").applyInPandas(inside, FOUND))
    tree, bounds = _components(state, tree)
    bound = near.select("comp", "w")
    if bounds:
        bound = bound.union(state.sparkSession.createDataFrame(bounds, "comp bigint, w double"))
    asks = state.join(bound.groupBy("comp").agg(F.min("w").alias("within")), "comp").where((F.col("comp") != idle) & (F.col("core") <= F.col("within")))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p, there = reached(tree, points_of(b["x"]), b["within"].to_numpy(), b["comp"].to_numpy())
                yield b.iloc[p].assign(cell=there)[there != b["cell"].to_numpy()[p]]

    def beyond(asking: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(points):
            return NONE
        return crossing(points_of(asking["x"]), asking["core"].to_numpy(), asking["comp"].to_numpy(), asking["i"].to_numpy(), points, asking["within"].to_numpy())

    asking = asks.select("i", "x", "core", "cell", "comp", "within").mapInPandas(ask, "i bigint, x array<double>, core double, cell bigint, comp bigint, within double")
    far = met(asking, state, tasks, beyond, FOUND)
    best = near.union(far).groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e"))
    chosen = stored(best.select("comp", "e.*"))
    if chosen.isEmpty():
        raise ValueError("no component has a nearest other one: coordinates must be numbers")
    discard(near, far)
    leads = _leads(chosen)
    after = stored(state.join(leads, "comp", "left").select("i", "x", "core", "cell", F.coalesce("to", "comp").alias("comp")).repartition(tasks, "cell"))
    discard(leads)
    return chosen, after


def _components(state: DataFrame, tree: Tree) -> tuple[Tree, list[tuple[int, float]]]:
    """The tree with the one component of a node, and for components with cells of their own a distance to another.

    Such components may find none in their cells; a cell's point of least core
    distance, and that of least among its other components, stand for it.
    """
    each = state.groupBy("cell", "comp").agg(F.min(F.struct("core", "i", "x")).alias("r"))
    two = each.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("r.core", "r.i", "r.x", "comp"))), 1, 2).alias("two")).collect()
    only = np.full(len(tree.axis), -2)
    for r in two:
        only[r["cell"]] = r["two"][0]["comp"] if len(r["two"]) == 1 else -1
    tree = tree._replace(only=upward(only, lambda a, b: a if a == b or b == -2 else b if a == -2 else -1))
    points = [p for r in two for p in r["two"]]
    x, core, comp = np.array([p["x"] for p in points]), np.array([p["core"] for p in points]), np.array([p["comp"] for p in points])
    bounds: dict[int, float] = {}
    for p in (r["two"][0] for r in two if len(r["two"]) == 1):
        w = np.maximum(np.maximum(distances(np.array([p["x"]]), x)[0], core), p["core"])[comp != p["comp"]]
        if len(w):
            bounds[p["comp"]] = min(bounds.get(p["comp"], np.inf), float(w.min()))
    return tree, list(bounds.items())


def _leads(chosen: DataFrame) -> DataFrame:
    """``(comp, to)``: where the chosen edges lead in the end; two that chose one edge meet at the smaller."""
    back = chosen.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    to = F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other"))
    out = stored(chosen.join(back, "other", "left").select("comp", to.alias("to")))
    while True:
        onward = out.select(F.col("comp").alias("to"), F.col("to").alias("next"))
        step = stored(out.join(onward, "to", "left").select("comp", F.coalesce("next", "to").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        discard(out)
        out = step
        if out.where("moved").isEmpty():
            return out
