"""Chat formatting by quotation linking (operator 5), in DataFrame operations only.

Lines that begin with ``>`` marks are quotes; the number of marks is the level.
Runs of lines of one level are passages.  A passage, normalised and hashed, is
looked up among the messages of its conversation: whole bodies without quotes,
any of their lines that follow each other, and, for passages of ``LEAST_WORDS``
words, any words that follow each other, so that quotes of half a line and
quotes that a mail program has wrapped anew are found too.  Of each message only
runs of the lengths that its conversation quotes are hashed.  The first message
that has a passage is the original.  A message replies to the latest original of
its outermost quotes; messages without a linked quote open a thread.
Conversations come out message by message, without quotes and the lines that
announce them, with the keys of their reply order: threads by their first
message, and in a thread every reply after what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table
from .spans import bound

QUOTE = r"^\s*((?:>\s*)++)"
#: Passages of so many words are found wherever they stand in a message, shorter ones as whole lines.
LEAST_WORDS = 5
#: A line before a quote that tells who wrote it.
ANNOUNCED = r"(?i)\b(wrote|schrieb|a écrit|escribió)\b[^:]{0,80}:\s*$"


def parsed_lines(text: Column) -> Column:
    """Each line's quote level, 0 for none, and what it says."""

    def line(s: Column) -> Column:
        marks = F.regexp_extract(s, QUOTE, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.cast("int").alias("level"), F.when(level > 0, F.regexp_replace(s, QUOTE, "")).otherwise(s).alias("body"))

    return F.transform(F.split(text, "\n"), line)


def normal(text: Column) -> Column:
    """Lower case, with single spaces for everything that is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(lines: Column) -> Column:
    """Runs of lines of one level above 0, as (level, body)."""

    def runs(x: Column) -> Column:
        # where a run begins, and after the last line; places count from 1
        first = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | (F.element_at(x, i)["level"] != F.element_at(x, F.greatest(i - 1, F.lit(1)))["level"]))
        return bound(F.concat(first, F.array(F.size(x) + 1)), lambda f: F.transform(F.sequence(F.lit(1), F.size(f) - 1), lambda k: run(x, F.element_at(f, k), F.element_at(f, k + 1))))

    def run(x: Column, start: Column, stop: Column) -> Column:
        level = F.element_at(x, start)["level"]
        said = F.when(level > 0, F.array_join(F.transform(F.slice(x, start, stop - start), lambda y: y["body"]), "\n"))
        return F.struct(level.alias("level"), said.alias("body"))

    return F.filter(bound(lines, runs), lambda p: p["level"] > 0)


def _own_lines(lines: Column) -> Column:
    """What a message says itself: its lines of level 0, but for those that announce the quote after them."""
    announces = lambda x, i: F.coalesce(F.try_element_at(F.col("lines"), i + 2)["level"] > 0, F.lit(False)) & F.rlike(x["body"], F.lit(ANNOUNCED))
    return F.transform(F.filter(lines, lambda x, i: (x["level"] == 0) & ~announces(x, i)), lambda x: x["body"])


def _parts(body: Column) -> Column:
    """A passage as its whole, as lines that have words, and as words, all normalised."""
    whole = normal(body)
    said = F.filter(F.transform(F.split(body, "\n"), normal), lambda s: s != "")
    as_one = F.when(whole != "", F.array(whole)).otherwise(F.slice(F.array(whole), 1, 0))
    words = F.when(whole != "", F.split(whole, " ")).otherwise(F.slice(F.array(whole), 1, 0))
    return F.array(*(F.struct(F.lit(kind).alias("kind"), x.alias("parts")) for kind, x in (("whole", as_one), ("lines", said), ("words", words))))


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "\n"), 256)


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, ``reply_to``, ``thread``, ``n_quotes``, ``n_linked`` and ``formatted``.

    Sorting a conversation by ``thread``, then turn, gives its reply order.  Null
    texts are empty.  Null conversations or turns cannot be linked: such
    messages are threads of their own.  A repeated (conversation, turn) is one
    message to those that quote it, and each row keeps its own quotes.  Empty
    passages count as quotes but are not looked up.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    quoted = text.rlike(r"(?m)^\s*>")
    lines = F.when(quoted, parsed_lines(text)).otherwise(F.array(F.struct(F.lit(0).alias("level"), text.alias("body"))))
    rows = messages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), lines.alias("lines"))
    own = F.regexp_replace(F.array_join(_own_lines(F.col("lines")), "\n"), r"^\s+|\s+$", "")
    rows = stored(rows.select("row", "conv", "turn", "role", own.alias("body"), passages(F.col("lines")).alias("quotes")))

    asked = rows.where(F.size("quotes") > 0).select("row", "conv", "turn", F.posexplode("quotes").alias("nth", "quote"))
    asked = stored(asked.select("row", "conv", "turn", "quote.level", "nth", F.filter(_parts(F.col("quote.body")), lambda x: (x["kind"] != "words") | (F.size(x["parts"]) >= LEAST_WORDS)).alias("as")))
    wanted = asked.select("row", "nth", "conv", "turn", F.inline("as")).where(F.size("parts") > 0)
    wanted = stored(wanted.select("row", "nth", "conv", "turn", "kind", F.size("parts").alias("long"), _digest(F.col("parts")).alias("digest")))
    # only conversations with a quote are indexed, and only by runs as long as their quotes; each passage once, under its first turn
    lengths = wanted.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "kind", "long").distinct()
    said = rows.where(F.col("turn").isNotNull()).select("conv", F.col("turn").alias("original"), F.inline(_parts(F.col("body"))))
    said = said.join(lengths, ["conv", "kind"]).where(F.size("parts") >= F.col("long"))
    runs = F.transform(F.sequence(F.lit(1), F.size("parts") - F.col("long") + 1), lambda i: _digest(F.slice("parts", i, F.col("long"))))
    told = said.select("conv", "kind", "original", F.explode(F.array_distinct(runs)).alias("digest"))
    first = stored(told.groupBy("conv", "kind", "digest").agg(F.min("original").alias("original")))
    found = wanted.join(first, ["conv", "kind", "digest"]).where("original < turn").select("row", "nth", "original")
    linked = asked.select("row", "nth", "level").join(found.groupBy("row", "nth").agg(F.min("original").alias("original")), ["row", "nth"])
    by_row = linked.groupBy("row").agg(F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("original"))).alias("outer"), F.max("original").alias("any"))
    out = stored(rows.join(by_row, "row", "left").select("row", "conv", "turn", "role", "body", F.size("quotes").cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.coalesce("outer", "any").alias("reply_to")))

    # follow replies to the threads' first messages, doubling the distance each round
    up = stored(out.where("reply_to IS NOT NULL").groupBy("conv", "turn").agg(F.max("reply_to").alias("up")))
    while True:
        far = up.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"))
        step = stored(up.join(far, ["conv", "up"], "left").select("conv", "turn", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        if not step.where("moved").limit(1).count():
            break
        up = step.drop("moved")
    roots = up.select("conv", "turn", F.col("up").alias("root"))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"))
    done = out.join(roots, ["conv", "turn"], "left")
    return done.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "reply_to", F.coalesce("root", "turn").alias("thread"), "n_quotes", "n_linked", formatted.alias("formatted"))


def in_reply_order(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The messages of ``link``, conversation by conversation, each in reply order; a long conversation may lie in several partitions."""
    return linked.orderBy(conv_col, "thread", turn_col)


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
