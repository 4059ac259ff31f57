"""Keeps a labelled corpus current: new files of texts are labelled by the taxonomy and counted.

``python -m jobs.label_corpus DOCUMENTS OUTPUT [--config FILE]``

A file stream takes the files that no earlier run has taken.  Under ``OUTPUT``:

* ``documents``: a row for each text, by batch and language;
* ``counts``: for each batch and language, texts and words of each label.  Sums
  over batches are the corpus's (``label_counts``), so that no run reads what an
  earlier one has written;
* ``checkpoint``: what has been taken.  It belongs to the output: delete both or none.

A batch overwrites its own partitions, so a batch that failed half-way is
repeated without a trace, and a run that finds nothing new changes nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from papertide.config import TAXONOMY
from papertide.operators import taxonomy

log = logging.getLogger("jobs.label_corpus")

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"
DOCUMENTS = "doc_id long, source string, n_words long, text_hash string, labels array<string>, batch long, lang string"
COUNTS = "label string, n_docs long, n_words long, batch long, lang string"
WORD = r"[^\x20\x09-\x0D]+"
#: The label of texts that have none.
UNLABELLED = "(none)"


def settings(path: str | None = None) -> dict:
    return json.loads((Path(path) if path else Path(__file__).with_suffix(".json")).read_text())


def labelled(texts: DataFrame, config: dict) -> DataFrame:
    """Words, hash and labels of each text; a null text is empty, with a null hash."""
    seeds = {label: tuple(words) for label, words in config["taxonomy"].items()} or TAXONOMY
    text = F.coalesce("text", F.lit(""))
    # a column of its own: inside the conditions it would be lower-cased anew for each seed
    texts = texts.withColumn("lowered", F.lower(text))
    labels = taxonomy.rule_labels(F.col("lowered"), seeds, config["whole_words"])
    return texts.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.sha2("text", 256).alias("text_hash"), taxonomy.label_union(labels, F.lit(None).cast("array<string>")).alias("labels"), "lang")


def counted(documents: DataFrame) -> DataFrame:
    """Texts and words by language and label; a text counts for each of its labels."""
    label = F.explode(F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit(UNLABELLED))))
    return documents.select("lang", "n_words", label.alias("label")).groupBy("lang", "label").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def _replace(df: DataFrame, path: str) -> int:
    """Writes the partitions that ``df`` has, in place of what they held; returns the rows written."""
    seen = Observation()
    # files of a sound size whatever share of the rows a language has
    rows = df.hint("rebalance", "lang").observe(seen, F.count("*").alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(path)
    return seen.get["n"]


def run(spark: SparkSession, documents: str, output: str, config: dict | None = None) -> None:
    """Takes what is new under ``documents`` and returns when it is written."""
    config = config or settings()
    taken: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        part = F.lit(number).cast("long").alias("batch")
        n = _replace(labelled(batch, config).select("*", part), f"{output}/documents")
        written = spark.read.schema(DOCUMENTS).parquet(f"{output}/documents").where(F.col("batch") == number)
        k = _replace(counted(written).select("*", part), f"{output}/counts")
        taken.append(n)
        log.info("batch %d: wrote %d documents and %d counts under %s", number, n, k, output)

    files = spark.readStream.schema(TEXTS).option("maxBytesPerTrigger", config["bytes_per_batch"]).parquet(documents)
    stream = files.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %d new documents from %s", sum(taken), documents)


def label_counts(spark: SparkSession, output: str) -> DataFrame:
    """``(lang, label, n_docs, n_words)`` of the corpus so far."""
    return spark.read.schema(COUNTS).parquet(f"{output}/counts").groupBy("lang", "label").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))


def read_documents(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{output}/documents").drop("batch")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("documents", help="folder of Parquet files, also a remote one")
    args.add_argument("output")
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("label_corpus").getOrCreate()
    try:
        run(spark, given.documents, given.output, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
