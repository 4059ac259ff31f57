"""Rule labels, label sets, relevance, and the long table of labels."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TAXONOMY
from ..functions.variant import at, one_or_many, salvaged, text_of
from . import annotate
from .cache import CacheTable

TEXT_PARTS = ("title", "abstract")
LIST_PARTS = ("author_keywords", "ai_methods", "novelty_keywords")
NO_LABELS = "array<string>"


def _joined(c: Column) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast(NO_LABELS)), " ", "")


def classification_text(df: DataFrame) -> Column:
    """All parts in lower case, joined by spaces; missing ones are empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in TEXT_PARTS]
    parts += [_joined(F.col(c)) if c in df.columns else F.lit("") for c in LIST_PARTS]
    return F.lower(F.concat_ws(" ", *parts))


def rule_labels(text: Column, taxonomy: dict[str, tuple[str, ...]] = TAXONOMY, whole_words: bool = False) -> Column:
    """Every label of which a seed is in the text, also inside words; ``whole_words`` is stricter than the reference."""

    def hit(seed: str) -> Column:
        return text.rlike(r"(?U)(?<!\w)\Q" + seed + r"\E(?!\w)") if whole_words else F.contains(text, F.lit(seed))

    def any_of(seeds: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for seed in seeds:
            out = out | hit(seed)
        return out

    flags = [F.when(any_of(seeds), F.lit(label)) for label, seeds in taxonomy.items()]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast(NO_LABELS)


def label_union(rules: Column, annotated: Column, mode: str = "union") -> Column:
    """Distinct labels in code point order: of both, or of the annotation (``llm``) or the rules alone."""
    rules, annotated = (F.coalesce(c, F.array().cast(NO_LABELS)) for c in (rules, annotated))
    chosen = {"union": F.array_union(rules, annotated), "llm": annotated, "rules": rules}[mode]
    return F.array_sort(F.array_distinct(chosen))


def canonical(labels: Column, taxonomy: dict[str, tuple[str, ...]] = TAXONOMY) -> Column:
    """Beyond the reference: annotated labels to the taxonomy's spelling; others are dropped."""
    known = F.create_map(*(F.lit(x) for label in taxonomy for x in (label.lower(), label)))
    return F.array_compact(F.transform(labels, lambda x: F.try_element_at(known, F.lower(x))))


class Labeller(Protocol):
    name: str

    def label(self, papers: list[dict]) -> list[str]:
        """A JSON object with the list ``subfields``, or text around one, for each paper."""


def annotated_labels(papers: DataFrame, labeller: Labeller, store: CacheTable | None = None) -> DataFrame:
    """``(eid, subfields_llm)``: a model's labels; what is no list of texts in an answer is left out."""
    answered = annotate.ask(annotate.questions(papers, labeller, "labels"), labeller.label, store)
    said = at(salvaged(F.col("value")), "subfields")
    labels = F.filter(F.transform(one_or_many(said), text_of), lambda x: x.isNotNull() & (x != ""))
    keyed = papers.select("eid", annotate.prompt_key(labeller, papers, "labels").alias("key"))
    return keyed.join(answered.select("key", F.coalesce(labels, F.array().cast(NO_LABELS)).alias("subfields_llm")), "key").select("eid", "subfields_llm")


def assign_subfields(papers: DataFrame, annotated: DataFrame | None = None, taxonomy: dict[str, tuple[str, ...]] = TAXONOMY, mode: str = "union") -> DataFrame:
    """``papers`` with ``subfields_rule``, ``subfields_llm`` and ``subfields``; ``annotated(eid, subfields_llm)`` joins on the id."""
    out = papers.withColumn("subfields_rule", rule_labels(classification_text(papers), taxonomy))
    out = out.join(annotated.select("eid", "subfields_llm"), "eid", "left") if annotated is not None else out.withColumn("subfields_llm", F.array().cast(NO_LABELS))
    return out.withColumn("subfields_llm", F.coalesce("subfields_llm", F.array().cast(NO_LABELS))).withColumn("subfields", label_union(F.col("subfields_rule"), F.col("subfields_llm"), mode))


def relevant(papers: DataFrame) -> DataFrame:
    """Papers not marked as irrelevant; without a mark they stay."""
    return papers.where(F.coalesce("is_ai_relevant", F.lit(True))) if "is_ai_relevant" in papers.columns else papers


def subfields_long(labeled: DataFrame) -> DataFrame:
    return labeled.select("eid", "year", "citedby_count", "citations_per_year", F.explode("subfields").alias("subfield")).where("subfield IS NOT NULL")
