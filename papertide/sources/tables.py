"""Tables on disk: Parquet, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIDY = ("papers", "paper_authors", "paper_affils", "paper_keywords")


def load_tables(spark: SparkSession, path: str, names: tuple[str, ...] = TIDY) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested columns: they are written as JSON."""
    return df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema))


def save_csv(tables: dict[str, DataFrame], path: str, prefix: str) -> list[str]:
    """Every table that has a row, as ``{prefix}_{name}.csv``; returns the names written."""
    written = []
    for name, df in tables.items():
        if not df.isEmpty():
            _flat(df).write.mode("overwrite").csv(f"{path}/{prefix}_{name}.csv", header=True)
            written.append(name)
    return written


def save_parquet_and_csv(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    _flat(df).write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)


def save_json(df: DataFrame, path: str, array: bool = False) -> None:
    """One object a line; as one ``array``, a single file written from one task, for tables that a reader takes whole."""
    if not array:
        df.write.mode("overwrite").json(path)
        return
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    ends = F.array_join(F.array_sort(F.collect_list("value")), ",\n")
    rows.agg(F.concat(F.lit("[\n"), ends, F.lit("\n]")).alias("value")).write.mode("overwrite").text(path)


def save_facts(facts: DataFrame, path: str, report: str | None = None) -> None:
    """The frozen facts, one JSON document, and the narrative if there is one."""
    facts.select(F.col("facts").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}_facts.json")
    if report is not None:
        save_text(facts.sparkSession, f"{path}.md", report)


def save_text(spark: SparkSession, path: str, text: str) -> None:
    spark.range(1, numPartitions=1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def load_facts(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}_facts.json", wholetext=True).first()[0].rstrip("\n")


def save_embeddings(vectors: DataFrame, path: str) -> None:
    """Vectors with the hash of the corpus and model they are for, a folder for each."""
    vectors.write.mode("append").partitionBy("corpus").parquet(path)


def load_embeddings(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """The vectors of one corpus; the filter prunes all other folders."""
    return spark.read.parquet(path).where(F.col("corpus") == corpus)
