"""Filter interaction audit (operator 11): what filters remove in every order, and how they overlap.

Documents come down to mask cells, counts by part and set of failed filters,
before anything is set against orders.  In the space of masks, which the number
of filters bounds, each mask is unpivoted against the steps of all orders, and
a running bit-or along an order tells what has failed before.  Cells meet those
rows by their mask; conditional sums give the metrics of a step, and a window
over a filter's steps its total over all orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import discard, map_batches, stored, table

#: Failure conditions over the measures of a document.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * n_points",
    "D": "n_marks > 0",
    "E": "coalesce(id > first_id, false)",
}
#: All orders of so many filters: 276,480 rows of masks and steps at most.
MOST_FILTERS = 6
SLICE_BYTES = 1 << 20
#: Rows without an id are spread over so many keys.
SPREAD = 1024

UPPER, MARKS, POINTS = np.zeros(256, bool), np.zeros(256, bool), (np.arange(256) & 0xC0) != 0x80
UPPER[0x41:0x5B] = True
MARKS[list(b"#$%&*|")] = True

MEASURES = ("n_words", "n_distinct", "n_upper", "n_points", "n_marks")


def _measure(data: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of some rows, given as UTF-8 bytes and offsets."""
    w = tk.Words(data, cuts)
    n, rows = len(cuts) - 1, w.rows
    salt = tk.mix(np.arange(1, n + 1, dtype=np.uint64))
    first = np.unique(w.hashes() ^ salt[rows], return_index=True)[1]
    out = {"n_words": w.counts, "n_distinct": np.bincount(rows[first], minlength=n)}
    for name, which in (("n_upper", UPPER), ("n_points", POINTS), ("n_marks", MARKS)):
        out[name] = np.diff(tk.counted(which, data, cuts)[0])
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``part``, what the filters ask of the whole text, and its SHA-256 ``digest``.

    A null text is empty, a null part the empty string.  Words are told apart
    by 64-bit hashes.  Of a very long text some bytes are held for each of its words.
    """
    flat = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].alias("text"))
    kind = flat.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cuts = tk.column_bytes(batch.column(2))
            for lo, hi in tk.chunks(cuts, SLICE_BYTES):
                m = _measure(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
                shas = [hashlib.sha256(data[a:b]).digest() for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1])]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(shas, pa.binary())], names=["id", "part", *MEASURES, "digest"])

    return map_batches(flat, work, f"id {kind}, part string, {', '.join(f'{k} bigint' for k in MEASURES)}, digest binary")


def failures(measured: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """``id``, ``part`` and ``mask``: bit k is set if the row fails the k-th filter.

    ``measured`` is read twice.  ``first_id`` is the smallest id among rows with
    the same text; rows without an id are never smaller and never larger than
    others.  Texts that occur once meet no row; a text that very many share is
    one row on its side of the join, whose other side adaptive execution splits.
    """
    firsts = measured.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(0) for k, condition in enumerate(filters.values())]
    return measured.join(firsts, "digest", "left").select("id", "part", sum(bits[1:], bits[0]).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: str = "quality = 1", toxic: str = "toxic = 1") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: counts of rows, and of those labelled so.

    An id that is labelled more than once counts as good or toxic if any of its
    labels says so.  Rows without an id or a label are neither.
    """
    marks = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("marked")).agg(F.max(F.expr(good)).alias("is_good"), F.max(F.expr(toxic)).alias("is_toxic"))
    # rows without an id meet no label; they do not all go to one task
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("part", F.monotonically_increasing_id()), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("bigint"))
    rows = failed.withColumn("spread", spread)
    met = rows.join(marks.withColumn("none", F.lit(0).cast("bigint")), (F.col("id") == F.col("marked")) & (F.col("spread") == F.col("none")), "left")
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("is_good")).alias("good"), F.count_if(F.col("is_toxic")).alias("toxic"))


def mask_steps(spark: SparkSession, letters: str, orders: list[str] | None = None) -> DataFrame:
    """Every mask at every step of the orders: ``mask``, ``filter_order``, ``step``, ``letter``, ``bit``, ``fails`` and ``earlier``, the filters of earlier steps that the mask fails."""
    if orders is None:
        if len(letters) > MOST_FILTERS:
            raise ValueError(f"all orders of more than {MOST_FILTERS} filters are too many; name those wanted")
        orders = ["".join(o) for o in permutations(letters)]
    steps = spark.createDataFrame([(o,) for o in orders], "filter_order string").select("filter_order", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)")
    rows = steps.select("filter_order", (F.col("at") + 1).alias("step"), "letter", bit.alias("bit"), F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))).alias("mask"))
    before = W.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    return rows.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))


def audit(found: DataFrame, letters: str, orders: list[str] | None = None) -> DataFrame:
    """The metrics of each step of each order in each part, from the cells of ``cells``.

    One row, zeros included, for each part, ``filter_order`` and ``step``:
    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost`` and ``shapley``.  No cells, no rows.
    """
    gone = (F.col("fails") != 0) & (F.col("earlier") == 0)
    count = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")
    # bounded by the number of filters, not by the data
    steps = F.broadcast(mask_steps(found.sparkSession, letters, orders))
    per_step = (
        found.repartition("part")
        .join(steps, "mask")
        .groupBy("part", "filter_order", "step", "letter")
        .agg(
            count(F.col("fails").bitwiseOR(F.col("earlier")) == 0, "n").alias("kept"),
            count(gone, "n").alias("removed"),
            count((F.col("fails") != 0) & (F.col("earlier") != 0), "n").alias("redundant"),
            count(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
            count(gone, "good").alias("good_lost"),
            count(gone, "toxic").alias("toxic_lost"),
        )
    )
    return per_step.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict[str, str] = FILTERS, orders: list[str] | None = None) -> DataFrame:
    """``audit`` of whole texts; ``filters`` are named by one letter each.

    Repeated rows are judged row by row: rows with the smallest id of a text are
    all firsts.  Other columns of ``docs`` may have any names.  Very long texts
    are taken whole.
    """
    measured = stored(measures(docs, id_col, text_col, part_col))
    found = stored(cells(failures(measured, filters), labels, id_col))
    discard(measured)
    return audit(found, "".join(filters), orders)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step::INT AS step, letter, bit, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE x WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 WHEN 'E' THEN 16 ELSE 0 END))::INT AS done
  FROM orders, range(1, 6) r(step), letters WHERE letter = filter_order[step]
), docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), masked AS (
  SELECT doc_id, part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * list_unique(ws) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask FROM docs
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM masked LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), audited AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN mask & (done | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & done = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & done <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & done = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & done = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM audited
"""
