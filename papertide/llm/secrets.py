"""Secret scans by corpus-wide ownership frequency (operator 10), in DataFrame operations only.

Patterns find candidates in every text: assignments, access keys, long hex
strings, and other long strings of mixed letters and digits.  Their hashes are
counted over the corpus by distinct owners and repositories.  A value that
``COPIED_OWNERS`` owners have, or that two owners have spread over
``COPIED_REPOS`` repositories, is a copied example; however often one owner's
repositories repeat a value, it is that owner's and looks like a live
credential.  Pattern matches are always reported; of the other strings those
that look live are added as spans of kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, stored, table
from .spans import BLOT, NONE, blotted, in_order, labelled, matches, n_of, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GUARD = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: Whole runs of at least so many characters, none of them in or next to a base span that is blotted out.
LONG = rf"(?<![A-Za-z0-9+/_={BLOT}-])[A-Za-z0-9+/_=-]{{20,}}+(?!{BLOT})"
KINDS = ["assign", "access", "hex", "owned"]
#: A value with at least so many distinct owners is a copied example; so is one of two owners in at least so many repositories.
COPIED_OWNERS, COPIED_REPOS = 3, 5
#: A long string looks random with so many different characters, digits among them.
MIXED = 12


def base_spans(text: Column) -> Column:
    """The three kinds' matches; a greedy run of 32 or 16 characters at least is the accepted match of that run."""
    assign = matches(text, "assign", ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8, text.rlike(ASSIGN_GUARD))
    access = matches(text, "access", ACCESS, lambda v: F.lit(True), F.contains(text, F.lit("AKIA")))
    hexes = matches(text, "hex", HEX, lambda v: F.lit(True), text.rlike(HEX))
    return F.concat(assign, access, hexes)


def long_spans(text: Column) -> Column:
    def random(v: Column) -> Column:
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIXED)

    return matches(text, "owned", LONG, random, text.rlike(LONG))


def secret_value(span: Column) -> Column:
    """What is compared between documents: an assignment's right side, else the match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_sha256``, ``spans``, ``n_live``, ``n_copied``, ``most_owners``, ``most_repos`` and ``found``.

    ``found`` is the array of all spans; ``most_owners`` and ``most_repos`` are
    those of its most widely spread value.  Null and empty texts have none.
    Null owners count together as one owner.  Repeated rows and null ids are
    judged row by row; copies in one repository count it once.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    owner = F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit(""))
    repo = F.concat_ws("\u0001", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repo_cols))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), owner.alias("owner"), repo.alias("repo"), text.alias("text"), in_order(base_spans(text), KINDS).alias("base"))
    # long strings inside or across a base span belong to it
    rows = stored(rows.select("row", "id", "owner", "repo", "base", long_spans(blotted(F.col("text"), F.col("base"))).alias("long")))
    each = rows.where((F.size("base") > 0) | (F.size("long") > 0)).select("row", "owner", "repo", F.explode(F.concat("base", "long")).alias("span"))
    each = stored(each.withColumn("digest", F.sha2(secret_value(F.col("span")), 256)))
    owned = each.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    counts = stored(owned.groupBy("digest", "owner").agg(F.count("*").alias("repos")).groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")))
    copied = (F.col("owners") >= copied_owners) | ((F.col("owners") > 1) & (F.col("repos") >= copied_repos))
    judged = each.select("row", "span", "digest").join(counts, "digest").select("row", "span", copied.alias("copied"), "owners", "repos")
    judged = judged.where((F.col("span.kind") != "owned") | ~F.col("copied"))
    # a document's own spans
    by_row = judged.groupBy("row").agg(F.collect_list("span").alias("all"), F.sum(F.when(F.col("copied"), 1).otherwise(0)).alias("n_copied"), F.count("*").alias("n"), F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"))
    every = in_order(F.coalesce(F.col("all"), F.array().cast(NONE)), KINDS)
    out = rows.select("row", "id", "base").join(by_row, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        *(n_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(every).alias("spans"),
        F.coalesce(F.col("n") - F.col("n_copied"), F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"),
        F.coalesce("most_repos", F.lit(0)).alias("most_repos"),
        every.alias("found"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``docs`` with every reported secret replaced by ``[SECRET]``, all columns and rows kept.

    Rows are told apart by id and text, so null and repeated ids are safe, and
    columns may have any names.
    """
    id_, digest, found, text, changed = (fresh(docs, n) for n in ("found_id", "found_digest", "found", "redacted", "changed"))
    old = F.col(f"`{text_col}`")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(old).alias("digest"))
    owner, repo = F.col(f"`{owner_col}`").alias("owner"), F.struct(*(f"`{c}`" for c in repo_cols)).cast("string").alias("repo")
    secret = scan(docs.select(key.alias("key"), old.alias("text"), owner, repo), "key", "text", "owner", ("repo",), copied_owners)
    secret = secret.where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias(found)).select(F.col("key.id").alias(id_), F.col("key.digest").alias(digest), found)
    joined = docs.join(secret, F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.xxhash64(old) == F.col(digest)), "left")
    blotted_out = labelled(old, F.coalesce(F.col(found), F.array().cast(NONE)), lambda s: F.lit("[SECRET]"))
    # under another name first: inside a lambda the old text's name would mean the new one
    done = joined.select(*(F.col(f"`{c}`") for c in docs.columns), blotted_out.alias(text), F.col(found).isNotNull().alias(changed))
    new = {text_col: F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(changed), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*((new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")
