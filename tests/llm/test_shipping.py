"""Executors that cannot import the package still run its Python functions."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from papertide.llm import decontaminate, language
docs = spark.createDataFrame([(i, "some words of a text " * 5, "en" if i % 2 else "de") for i in range(8)], "doc_id long, text string, lang string")
print("ROWS", language.identify(docs, language.train(docs, "doc_id", "text", "lang")).count(), decontaminate.decontaminate(docs, docs.selectExpr("doc_id AS item_id", "text")).where("contaminated").count())
"""


def test_functions_and_broadcasts_travel_by_value(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 8 8" in done.stdout, done.stderr[-2000:]
