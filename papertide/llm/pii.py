"""Information-theoretic sanitisation of personal data (operator 9), in DataFrame operations only.

Patterns find the protected entities: addresses, IPs, cards and phones.  Words
close to an entity may reveal it too.  Every occurrence of a term in the corpus,
entities left out, is an event; with p(entity) the share of all occurrences that
stand near the entity, and p(entity | term) that share among the term's own,
PMI(term; entity) = log2 p(entity | term) / p(entity) bits of the entity's
information -log2 p(entity) are disclosed by the term.  A term is telling where
it leaves no more than ``DISCLOSED_BITS`` of that open and discloses
``LEAST_BITS`` or more: a term that only stands where the entity is met anyway,
or less often, tells nothing.  Telling terms are generalised wherever they stand in
the corpus, near an entity or not.  Terms seen near an entity in one document
only are no evidence and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, stored, table
from .spans import BLOT, NONE, blocks, blotted, bound, in_order, labelled, matches, n_of, written

KINDS = ["email", "ip", "card", "phone", "term"]
#: The search starts at the first character of a run, or where the last match ended: no other start can match.
#: Possessive loops match the same here and need no stack, however long the run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Whole words of four letters or digits at least, none of them in or next to an entity that is blotted out.
TERM = rf"(?<![\p{{L}}\p{{N}}{BLOT}])[\p{{L}}\p{{N}}]{{4,}}+(?!{BLOT})"
#: Code points on either side of an entity in which terms count as near.
NEAR = 64
DISCLOSED_BITS, LEAST_BITS = 1.0, 0.0
#: Near an entity in so many different documents.
SUPPORT = 2


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second one from the right doubled, is a multiple of ten."""
    back = F.split(F.reverse(digits), "")
    each = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(v: Column) -> Column:
    n = F.length(_digits(v))
    return F.when((n >= 14) & (n <= 19), _luhn(_digits(v))).otherwise(False)


def _ip(v: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(v, r"\."), small)


def _phone(v: Column) -> Column:
    return F.length(_digits(v)).between(10, 15)


def entities(text: Column) -> Column:
    email = matches(text, "email", EMAIL, lambda v: F.lit(True), F.contains(text, F.lit("@")))
    ip = matches(text, "ip", IP, _ip, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))
    card = matches(text, "card", CARD, _card, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    phone = matches(text, "phone", PHONE, _phone, text.rlike(r"\+[0-9]"))
    return F.concat(email, ip, card, phone)


def entity_value(span: Column) -> Column:
    """Spellings of one entity compare equal: digits alone for cards and phones, lower case for addresses."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _near_terms(text: Column, lead: Column, span: Column) -> Column:
    """Terms in the windows before and after an entity, whole; ``text`` begins at ``lead`` of the document, entities blotted out."""

    def in_window(first: Column, last: Column) -> Column:
        # one character more on either side tells whether a term is cut off
        early = F.greatest(first - 1, F.lit(0))
        piece = F.substring(text, early - lead + 1, F.greatest(last - early + 1, F.lit(0)))
        found = matches(piece, "term", TERM, lambda v: F.lit(True), F.lit(True))
        moved = F.transform(found, lambda s: F.struct((s["start"] + early).alias("start"), (s["end"] + early).alias("end"), F.lower(s["value"]).alias("term")))
        return F.filter(moved, lambda s: (s["start"] >= first) & (s["end"] <= last))

    return F.concat(in_window(F.greatest(span["start"] - NEAR, F.lit(0)), span["start"]), in_window(span["end"], span["end"] + NEAR))


def near_entities(text: Column, base: Column) -> Column:
    """For each entity (sorted by start) its digest and the terms near it; a long text is cut up once for each block of entities."""

    def block(part: Column) -> Column:
        lead = F.greatest(part[0]["start"] - NEAR - 1, F.lit(0))
        last = F.array_max(F.transform(part, lambda s: s["end"])) + NEAR + 1
        piece = F.struct(lead.alias("lead"), F.substring(text, lead + 1, last - lead).alias("text"))
        return bound(piece, lambda w: F.transform(part, lambda s: F.struct(F.sha2(entity_value(s), 256).alias("entity"), _near_terms(w["text"], w["lead"], s).alias("terms"))))

    return F.flatten(F.transform(blocks(base), block))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = DISCLOSED_BITS, support: int = SUPPORT, least_bits: float = LEAST_BITS) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_sha256``, ``spans``, ``n_term`` and ``found``.

    ``found`` is the array of all spans.  Null and empty texts have none, and
    texts without an entity have their telling terms found all the same.  Repeated rows and null ids are
    judged row by row; copies of a document are documents of their own.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), in_order(entities(text), KINDS).alias("base"))
    rows = rows.select("row", "id", "base", blotted(F.col("text"), F.col("base")).alias("text"))
    rows = stored(rows.select("row", "id", "base", "text", near_entities(F.col("text"), F.col("base")).alias("near")))
    met = rows.where(F.size("base") > 0).select("row", F.explode("near").alias("n")).select("row", "n.entity", F.explode("n.terms").alias("t"))
    # a term near two mentions of one entity is one occurrence
    met = stored(met.select("entity", "t.term", "row", F.col("t.start").alias("start")).distinct())
    # one row of each document, then one of each term and entity
    pairs = met.groupBy("entity", "term", "row").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_near"))
    pairs = stored(pairs)
    corpus = rows.select(F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    corpus = stored(corpus.groupBy(F.lower("word").alias("term")).agg(F.sum("n").alias("n_corpus")))
    total = float(corpus.agg(F.sum("n_corpus")).first()[0] or 1)
    by_entity = pairs.groupBy("entity").agg(F.sum("n_near").alias("n_entity"))
    told = pairs.where(F.col("n_docs") >= support).join(by_entity, "entity").join(corpus, "term")
    share, prior = F.col("n_near") / F.col("n_corpus"), F.col("n_entity") / F.lit(total)
    telling = stored(told.where((F.log2(share) >= -bits) & (F.log2(share / prior) >= least_bits)).select("term").distinct())
    discard(pairs, met, corpus)
    # which rows have which telling terms, then where they stand there
    words = rows.select("row", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    told = stored(words.join(telling, "term").groupBy("row").agg(F.collect_list("term").alias("told")))
    spans = matches(F.col("text"), "term", TERM, lambda v: F.array_contains("told", F.lower(v)), F.lit(True))
    terms = rows.select("row", "text").join(told, "row").select("row", spans.alias("terms"))
    every = in_order(F.concat("base", F.coalesce("terms", F.array().cast(NONE))), KINDS)
    return (
        rows.select("row", "id", "base")
        .join(terms, "row", "left")
        .select(F.col("id").alias(id_col), *(n_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size(F.coalesce("terms", F.array().cast(NONE))).cast("bigint").alias("n_term"), every.alias("found"))
    )


def sanitised_text(text: Column, found: Column) -> Column:
    """The text with entities removed to their kind, and telling terms generalised."""
    return labelled(text, found, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents")).drop("found")
