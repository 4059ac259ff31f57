"""Document vectors by an encoder behind an interface; the offline one hashes words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_text
from ..sources import tables
from ..storage import stored
from .vectors import l2_normalized

BATCH = 32


class Encoder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""


class HashingEncoder:
    """Signed word hashing: deterministic, without a model."""

    def __init__(self, dims: int = 64):
        self.dims, self.name = dims, f"hashing-{dims}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dims] += 1 if h >> 63 else -1
        return out


class PooledEncoder:
    """A token model as encoder: texts are cut after ``most_tokens`` tokens and token vectors pooled over each text's own.

    ``load`` gives the two halves, in the worker that uses them: from texts to
    a list of token numbers for each, and from numbers and mask (texts x
    tokens) to vectors (texts x tokens x dims).  ``pooling`` is ``mean`` or
    ``first``, the vector of the first token.
    """

    def __init__(self, name: str, load: Callable[[], tuple[Callable, Callable]], most_tokens: int = 512, pooling: str = "mean"):
        self.load, self.most_tokens, self.pooling = load, most_tokens, pooling
        self.name = f"{name}-{most_tokens}-{pooling}"
        self.halves: tuple[Callable, Callable] | None = None

    def encode(self, texts: list[str]) -> np.ndarray:
        if self.halves is None:
            self.halves = self.load()
        tokenize, forward = self.halves
        numbers = [list(x)[: self.most_tokens] for x in tokenize(texts)]
        long = max(1, *map(len, numbers))
        ids, mask = np.zeros((len(texts), long), np.int64), np.zeros((len(texts), long), np.int64)
        for r, x in enumerate(numbers):
            ids[r, : len(x)], mask[r, : len(x)] = x, 1
        out = np.asarray(forward(ids, mask), np.float32)
        if self.pooling == "first":
            return out[:, 0] * mask[:, :1]
        return (out * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]


class Fallback:
    """An encoder, and another for when the first cannot be used."""

    def __init__(self, first: Encoder, second: Encoder):
        self.first, self.second, self.name = first, second, first.name

    def encode(self, texts: list[str]) -> np.ndarray:
        try:
            return self.first.encode(texts)
        except (ImportError, OSError, RuntimeError):
            return self.second.encode(texts)


def embed(papers: DataFrame, encoder: Encoder, batch: int = BATCH) -> DataFrame:
    """``(eid, vector)``: unit vectors of title and abstract, keyed by the paper, never by position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                yield pd.DataFrame({"eid": part["eid"].to_numpy(), "vector": list(np.asarray(encoder.encode(part["doc"].tolist()), np.float32))})

    kind = papers.schema["eid"].dataType.simpleString()
    docs = papers.select("eid", document_text(F.col("title"), F.col("abstract")).alias("doc"))
    return docs.mapInPandas(run, f"eid {kind}, vector array<float>").withColumn("vector", l2_normalized(F.col("vector")))


def embed_once(papers: DataFrame, encoder: Encoder, path: str | None = None) -> DataFrame:
    """``(eid, vector, corpus)``: read from ``path`` where this corpus and model have been there, else encoded, and saved there."""
    key = corpus_key(papers, encoder.name)
    if path is None:
        return stored(embed(papers, encoder).withColumn("corpus", F.lit(key)))
    spark = papers.sparkSession
    known = vectors_at(spark, path, key)
    if known is None:
        tables.save_embeddings(embed(papers, encoder).withColumn("corpus", F.lit(key)), path)
        known = vectors_at(spark, path, key)
    return known


def vectors_at(spark: SparkSession, path: str, corpus: str) -> DataFrame | None:
    try:
        found = tables.load_embeddings(spark, path, corpus)
    except Exception as e:  # the folder begins with the first corpus
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return found if not found.isEmpty() else None


def corpus_key(papers: DataFrame, model: str) -> str:
    """Names the vectors of a model for a corpus: a hash over the papers' own hashes in order of their ids.

    Hashes are summed by prefix first, so no more than 4096 of them meet in one place.
    """
    doc = F.concat_ws("\u0001", F.col("eid").cast("string"), document_text(F.col("title"), F.col("abstract")))
    each = papers.select(F.sha2(doc, 256).alias("h")).groupBy(F.left("h", F.lit(3)).alias("p")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("s"))
    parts = sorted((r["p"], r["n"], str(r["s"])) for r in each.collect())
    return hashlib.sha256(repr((model, parts)).encode()).hexdigest()[:16]
