"""From raw documents to a training mix: quality, near-duplicates, benchmarks, secrets, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; ``docs`` has the columns of ``documents``, and so have all results but the
last, which is the mix's manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papertide.llm import decontaminate, mixing, quality, secrets, similar
from papertide.llm.shared import discard, stored, table

#: No SQL has XXH64, which the SimHash stage votes with.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.  Null and empty texts have no words and go; repeated rows and null ids are judged row by row."""
    return quality.quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one document stays.

    SimHash proposes pairs, their true similarity decides, and a prefix filter finds what SimHash misses.

    That is the row with the smallest id, null ids last, then that with the
    smallest digest.  Rows that share an id are judged each by its text, and
    texts without words are one group.
    """
    return similar.similar_filter(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.  Null and empty texts stay, and so does all if the benchmark is empty."""
    return decontaminate.decontaminate_filter(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts; no document goes.  Null owners count as one owner; null texts stay null."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each, repeats counted.  A null source is a source of its own; texts without words are not taken."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and reread by the next."""
    docs = stored(STAGES[0][1](spark, table(spark, sf_dir, "documents"), sf_dir))
    for _, stage in STAGES[1:]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return docs
