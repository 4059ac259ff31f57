"""Regular-expression matches with their positions, in DataFrame operations only.

Spark returns what a pattern matches but not where.  Cutting the text at the
same pattern gives the pieces between matches, and the lengths of pieces and
matches add up to positions in code points.  Both follow the same leftmost,
non-overlapping search.  Arrays of spans are built block by block, so that time
and memory follow the number of matches also where a text has very many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string>"
NONE = f"array<{SPAN}>"
#: Spans that are put together at once.
BLOCK = 256
#: Stands for each code point of a span that is blotted out; Unicode keeps it out of texts.
BLOT = "\uffff"


def no_spans() -> Column:
    return F.array().cast(NONE)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(items: Column) -> Column:
    """The array's items in arrays of at most BLOCK."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))
    return bound(items, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.slice(F.array(x), 1, 0)))


def matches(text: Column, kind: str, pattern: str, accept: Callable[[Column], Column], guard: Column) -> Column:
    """Matches that ``accept`` lets through, as an array of SPAN; ends are exclusive.

    ``guard`` must hold wherever the pattern matches; other texts are not searched.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(accept(pair["value"]), F.concat(acc["out"], F.array(span).cast(NONE))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, pairs: Column) -> Column:
        done = F.aggregate(pairs, F.struct(acc["at"].alias("at"), no_spans().alias("out")), step)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    # one piece more than matches; zipped, the last pair has no match
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda p: p["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NONE}>").alias("out"))
    walked = F.aggregate(blocks(pairs), start, block, lambda acc: F.flatten(acc["out"]))
    return F.when(F.coalesce(guard, F.lit(False)), walked).otherwise(no_spans())


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Sorted by start, then by the kind's place in ``kinds``, then by end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*(F.lit(k) for k in kinds)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``text`` with spans (sorted by start) replaced.

    ``by`` gets a span and the place up to which the spans before it reach; it
    writes what stands for the span, or for the rest of it, there.
    """
    strings = "array<string>"

    def step(acc: Column, s: Column, piece: Column, lead: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.substring(piece, acc["at"] - lead + 1, s["start"] - acc["at"])).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap, by(s, acc["at"]))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        # of a long text only the part that the block covers is searched for each of its spans
        far = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        piece = F.substring(text, acc["at"] + 1, far - acc["at"])
        done = bound(piece, lambda w: F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(strings).alias("out")), lambda a, s: step(a, s, w, acc["at"])))
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(strings).alias("out"))
    done = F.aggregate(blocks(spans), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def blotted(text: Column, spans: Column) -> Column:
    """``text`` with a BLOT for each code point of its spans (sorted by start), so that places stay."""
    return replaced(text, spans, lambda s, at: F.repeat(F.lit(BLOT), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"]))))


def labelled(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with a label for each of its spans (sorted by start); a span that begins inside an earlier one goes with that."""
    return replaced(text, spans, lambda s, at: F.when(s["start"] >= at, label(s)).otherwise(""))
