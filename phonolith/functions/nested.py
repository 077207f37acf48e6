"""Nested JSON as variants, walked as deep as a column's deepest value: the first URL in it, and its canonical text.

A Column can't recurse, so a walk is written out level by level. deepest() reads how many levels a column needs, in
one pass over its brackets; each level handles arrays and objects by one transform(), so a plan grows by one lambda a
level. A value deeper than the levels written out is an error, never a wrong answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .text import let

#: Levels that a plan may have.
MOST = 32


class TooDeep(ValueError):
    """Values nest deeper than a plan can follow."""


def depth(json: Column) -> Column:
    """How deep arrays and objects nest in a JSON text, by its brackets outside strings; 0 for scalars."""
    bare = F.regexp_replace(json, r'"(?:\\.|[^"\\])*+"', "")
    marks = F.split(F.translate(F.regexp_replace(bare, r"[^\[\]{}]", ""), "{}", "[]"), "")
    step = lambda acc, c: let(acc["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(acc["most"], n).alias("most")))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def deepest(df: DataFrame, json: Column) -> int:
    """The levels that a walk over this column needs."""
    levels = df.agg(F.max(depth(json))).first()[0] or 0
    if levels > MOST:
        raise TooDeep(f"values nest {levels} levels deep, more than {MOST}")
    return levels


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _walk(v: Column, levels: int, scalar: Callable[[Column], Column], nested: Callable[[Column, Column, Callable], Column]) -> Column:
    """scalar(v), or nested(v, kind, walk of the next level) for an array or an object."""

    def of(x: Column) -> Column:
        if levels:
            inner = nested(x["v"], x["kind"], lambda y: _walk(y, levels - 1, scalar, nested))
        else:
            inner = F.raise_error(F.lit("values nest deeper than the levels of this plan")).cast("string")
        return F.when(x["kind"].isin("ARRAY", "OBJECT"), inner).otherwise(scalar(x["v"]))

    return let(F.struct(v.alias("v"), _kind(v).alias("kind")), of)


def audio_url(json: Column, levels: int) -> Column:
    """The first usable URL: a text itself, an array's first hit at any depth, an object's first of src, url and path.

    Text that isn't JSON is a URL itself; malformed JSON, other values and empty texts have none. What an object's
    field holds is walked like any value.
    """
    field = lambda v, name: F.nullif(F.to_json(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("null"))

    def nested(v: Column, kind: Column, walk: Callable[[Column], Column]) -> Column:
        own = F.parse_json(F.coalesce(*[field(v, n) for n in ("src", "url", "path")], F.lit("null")))
        items = F.when(kind == "ARRAY", v.cast("array<variant>")).otherwise(F.array(own))
        return F.get(F.filter(F.transform(items, walk), lambda u: u.isNotNull()), F.lit(0))

    text = lambda v: F.nullif(F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))
    found = _walk(F.try_parse_json(json), levels, text, nested)
    return F.when(json.rlike(r'^\s*["\[{]'), found).otherwise(F.nullif(json, F.lit("")))


def number_text(v: Column) -> Column:
    """A double as the shortest text, with an exponent from 1e21 on and below 1e-6."""
    s = v.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"[-.]", ""), "0+$", "")
    sign, e = F.when(v < 0, "-").otherwise(""), F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    size = F.length(digits)
    wide = F.concat(F.substring(digits, 1, 1), F.when(size > 1, ".").otherwise(""), F.substring(digits, F.lit(2), size), F.lit("e"), F.when(e > 0, "+").otherwise("-"), F.abs(e).cast("string"))
    whole = F.concat(F.substring(F.rpad(digits, F.greatest(size, e + 1), "0"), F.lit(1), e + 1), F.when(size > e + 1, F.concat(F.lit("."), F.substring(digits, e + 2, size))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    shown = F.when((e >= 21) | (e < -6), wide).when(e >= 0, whole).otherwise(small)
    return F.when(v == 0, "0").when(e.isNull(), F.regexp_replace(s, r"\.0$", "")).otherwise(F.concat(sign, shown))


def canonical(json: Column, levels: int) -> Column:
    """JSON with the keys of all objects sorted, at any depth, and numbers in their shortest form; null if it doesn't begin with JSON.

    Keys come by UTF-16 units, those that are array indices first and by number, as objects keep them.
    """
    index = lambda k: F.when(k.rlike("^(?:0|[1-9][0-9]{0,9})$") & (k.try_cast("long") < (1 << 32) - 1), k.try_cast("long"))

    def nested(v: Column, kind: Column, walk: Callable[[Column], Column]) -> Column:
        keyed = F.transform(F.map_keys(v.cast("map<string,variant>")), lambda k: F.struct(F.coalesce(index(k), F.lit(1 << 32)).alias("at"), F.encode(k, "UTF-16BE").alias("units"), k.alias("k")))
        object_ = F.transform(F.array_sort(keyed), lambda e: F.struct(F.concat(F.regexp_extract(F.to_json(F.array(e["k"])), r"(?s)^\[(.*)\]$", 1), F.lit(":")).alias("mark"), F.element_at(v.cast("map<string,variant>"), e["k"]).alias("v")))
        items = F.when(kind == "ARRAY", F.transform(v.cast("array<variant>"), lambda x: F.struct(F.lit("").alias("mark"), x.alias("v")))).otherwise(object_)
        inner = F.array_join(F.transform(items, lambda e: F.concat(e["mark"], walk(e["v"]))), ",")
        around = [F.when(kind == "ARRAY", a).otherwise(o) for a, o in ("[{", "]}")]
        return F.concat(around[0], inner, around[1])  # inner once: a plan grows by one walk a level

    def scalar(v: Column) -> Column:
        return F.when(_kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), number_text(F.try_variant_get(v, "$", "double"))).when(_kind(v) == "VOID", "null").otherwise(F.to_json(v))

    v = F.try_parse_json(json)
    return F.when(v.isNotNull(), _walk(v, levels, scalar, nested))
