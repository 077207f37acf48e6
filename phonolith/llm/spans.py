"""Regular-expression matches with their places, as Column expressions only; linear in a text's length and matches."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"
#: Elements of an array that are handled together. An array that grows is copied at each step, so it grows in blocks.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of match: its pattern, a test that each match must pass, and a cheap test of the whole text."""

    name: str
    pattern: str
    passes: Callable[[Column], Column] | None = None
    hint: Callable[[Column], Column] | None = None


def none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: inside a lambda an outer expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(items: Column) -> Column:
    """items, a lambda's variable, as an array of arrays of at most BLOCK elements."""
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of values what op makes of all those before it, beginning with 0."""

    def grow(first: Column, items: Column) -> Column:
        zero = F.struct(first.alias("now"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda acc, x: F.struct(op(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(items, zero, step, lambda acc: acc["out"])

    def whole(parts: Column) -> Column:
        begins = grow(F.lit(0), F.transform(parts, lambda p: F.aggregate(p, F.lit(0), op)))
        return F.flatten(F.zip_with(parts, begins, lambda p, first: grow(first, p)))

    return let(values, lambda v: let(blocks(v), whole))


def places(text: Column, pattern: str, around: bool = False) -> Column:
    """start, end and value of the leftmost non-overlapping matches; places are code points, the end is exclusive.

    split() and regexp_extract_all() walk the same matches, so the lengths of the pieces between matches and of
    the matches themselves add up to the places. With around: also `left` and `right`, the pieces of the text before
    and after the match, up to the next ones.
    """

    def located(m: Column) -> Column:
        lengths = F.zip_with(m["gaps"], m["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        after = F.slice(m["gaps"], F.lit(2), F.greatest(F.lit(0), F.size(m["gaps"]) - 1))
        rows = F.arrays_zip(m["gaps"].alias("gap"), m["hits"].alias("hit"), before(lengths, lambda a, b: a + b).alias("at"), *([after.alias("after")] if around else []))

        def place(p: Column) -> Column:
            begin = p["at"] + F.length(p["gap"])
            context = [p["gap"].alias("left"), p["after"].alias("right")] if around else []
            return F.struct(begin.alias("start"), (begin + F.length(p["hit"])).alias("end"), p["hit"].alias("value"), *context)

        return F.transform(F.filter(rows, lambda p: p["hit"].isNotNull()), place)

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(both, located)


def find(text: Column, kind: Kind, order: int) -> Column:
    """The matches of kind that pass its test, as SPAN."""
    found = places(text, kind.pattern)
    if kind.passes:
        found = F.filter(found, lambda p: kind.passes(p["value"]))
    spans = F.transform(found, lambda p: F.struct(p["start"], F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), p["end"], p["value"]))
    seen = text.rlike(kind.pattern)
    seen = kind.hint(text) & seen if kind.hint else seen
    return F.when(seen, spans).otherwise(none())


def replaced(text: Column, spans: Column) -> Column:
    """text with each of spans, which come by start, replaced by its kind in brackets.

    Of overlapping spans the first is named, and all they cover goes.
    """

    def built(m: Column) -> Column:
        ends = F.transform(m["spans"], lambda s: s["end"])
        rows = F.arrays_zip(m["spans"].alias("span"), before(ends, lambda a, b: F.greatest(a, b)).alias("at"))
        marks = F.filter(rows, lambda r: r["span"]["start"] >= r["at"])

        def block(b: Column) -> Column:
            first = F.get(b, F.lit(0))["at"]
            piece = F.substring(m["text"], first + 1, F.element_at(b, -1)["span"]["start"] - first)
            shown = lambda x, p: F.concat(F.substring(p["text"], x["at"] - p["first"] + 1, x["span"]["start"] - x["at"]), F.lit("["), F.upper(x["span"]["kind"]), F.lit("]"))
            return let(F.struct(piece.alias("text"), first.alias("first")), lambda p: F.array_join(F.transform(b, lambda x: shown(x, p)), ""))

        tail = F.substring(m["text"], F.array_max(ends) + 1, F.length(m["text"]))
        return F.concat(let(marks, lambda v: F.array_join(F.transform(blocks(v), block), "")), tail)

    return let(F.struct(text.alias("text"), spans.alias("spans")), built)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column, kinds: list[str]) -> Column:
    return F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(kinds))), 256)
