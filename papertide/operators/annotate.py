"""Annotations of papers by a model behind an interface; the offline annotator is rules and deterministic.

Real endpoints implement ``Annotator.annotate`` over a batch; answers are
cached by the hash of what was asked, so a rerun asks only for what is new.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TAXONOMY
from ..functions.variant import coerced, salvaged
from ..schemas import ANNOTATION
from .cache import CacheTable, missing

# Fixed value: what servers say when a prompt and the wanted answer exceed the context.
CONTEXT = re.compile(r"(?is)maximum context length is (\d+).*?contains at least (\d+) input tokens")
MARGIN = 128


class Annotator(Protocol):
    name: str

    def annotate(self, papers: list[dict]) -> list[str]:
        """A JSON answer, or text around one, for each paper."""


class RuleAnnotator:
    """Marks what a paper's own words say; no model, no network."""

    name = "rules-1"
    modalities = ("mri", "ct", "angiography", "ultrasound", "pet")
    families = {"cnn": ("convolutional", "cnn", "u-net"), "transformer_llm": ("large language model", "llm", "gpt"), "vision_transformer": ("vision transformer",), "gan": ("generative adversarial",), "diffusion": ("diffusion model",), "radiomics": ("radiomic",), "foundation_model": ("foundation model",)}

    def annotate(self, papers: list[dict]) -> list[str]:
        return [json.dumps(self.one(p)) for p in papers]

    def one(self, p: dict) -> dict:
        text = " ".join(str(p.get(k) or "") for k in ("title", "abstract")).lower()
        hits = lambda words: any(re.search(rf"(?<!\w){re.escape(w)}", text) for w in words)
        return {
            "is_ai_relevant": hits([s for seeds in TAXONOMY.values() for s in seeds] + ["machine learning", "deep learning", "neural network"]),
            "clinical_task": "segmentation" if "segment" in text else "detection" if "detect" in text else "not_applicable",
            "ai_methods": [w for w in ("deep learning", "machine learning", "random forest") if w in text],
            "model_family": [f for f, words in self.families.items() if hits(words)],
            "imaging_modality": [m for m in self.modalities if hits([m])],
            "anatomy": [],
            "disease": [],
            "data_regime": "multi_center" if hits(["multicenter", "multi-center"]) else "unknown",
            "sample_size": next((int(m) for m in re.findall(r"(\d+) patients", text)), None),
            "external_validation": "external validation" in text,
            "benchmarks_datasets": [w for w in ("brats", "adni", "isles") if w in text],
            "code_available": "code is available" in text or "github" in text,
            "data_available": "data are available" in text,
            "novelty_keywords": [],
            "one_sentence_summary": str(p.get("title") or ""),
        }


def asked_as(annotator: Annotator | str) -> str:
    """What decides an answer besides the paper: the model's name or, where it tells more of itself, its signature."""
    return annotator if isinstance(annotator, str) else getattr(annotator, "signature", annotator.name)


def keywords_of(papers: DataFrame) -> Column:
    return F.col("author_keywords") if "author_keywords" in papers.columns else F.lit(None).cast("array<string>")


def prompt_key(annotator: Annotator | str, papers: DataFrame, kind: str = "annotation") -> Column:
    """The cache key: a hash of the kind of question, the model, and all of the paper that the prompt is made of."""
    return F.sha2(F.to_json(F.struct(F.lit(asked_as(annotator)).alias("model"), F.lit(kind).alias("kind"), F.col("abstract"), F.col("title"), keywords_of(papers).alias("keywords"))), 256)


def room_left(error: str) -> int | None:
    """Tokens that still fit when a server refuses a prompt as too long; None if the text is about something else or nothing fits."""
    m = CONTEXT.search(error)
    if not m:
        return None
    left = int(m[1]) - int(m[2]) - MARGIN
    return left if left > 0 else None


def questions(papers: DataFrame, annotator: Annotator | str, kind: str = "annotation") -> DataFrame:
    """``(key, title, abstract, author_keywords)``, each different prompt once."""
    return papers.select(prompt_key(annotator, papers, kind).alias("key"), "title", "abstract", keywords_of(papers).alias("author_keywords")).dropDuplicates(["key"])


def ask(asked: DataFrame, call: Callable[[list[dict]], list[str]], store: CacheTable | None = None) -> DataFrame:
    """``(key, value)``: what ``call`` answers to the other columns, a batch at a time.

    With a cache only what it lacks is asked for, and the answers go to it;
    without one they are written down, so that nothing is asked twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.drop(columns="key").to_dict("records")
            rows = [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows]
            yield pd.DataFrame({"key": b["key"], "value": call(rows)})

    wanted = asked if store is None else missing(asked, store.read())
    got = wanted.mapInPandas(run, "key string, value string")
    if store is None:
        return got
    store.append(got)
    return store.read().select("key", "value")


def annotate(papers: DataFrame, annotator: Annotator, partitions: int | None = None) -> DataFrame:
    """``(key, value)``: raw answers for ``papers(eid, title, abstract)`` and keywords if there are any, each different prompt asked once."""
    asked = questions(papers, annotator)
    return ask(asked.repartition(partitions) if partitions else asked, annotator.annotate)


def answers(papers: DataFrame, annotator: Annotator, cache: DataFrame) -> DataFrame:
    """Answers that the cache lacks; append them to it."""
    return ask(missing(questions(papers, annotator), cache), annotator.annotate)


def extractions(papers: DataFrame, answered: DataFrame, annotator: Annotator | str) -> DataFrame:
    """``answered(key, value)`` to one typed row per paper; answers that no JSON can be salvaged from give null fields."""
    keyed = papers.select("eid", prompt_key(annotator, papers).alias("key")).join(answered.select("key", salvaged(F.col("value")).alias("v")), "key")
    return keyed.select("eid", *coerced(F.col("v"), ANNOTATION))


def joined(papers: DataFrame, extracted: DataFrame, suffix: str = "_llm") -> DataFrame:
    """Left join on the id; columns of both keep the paper's name and get the suffix on the other side."""
    renamed = extracted.select("eid", *(F.col(c).alias(c + suffix if c in papers.columns else c) for c in extracted.columns if c != "eid"))
    return papers.join(renamed, "eid", "left")
