"""Exact order statistics of groups of any size: no task holds a group.

A mergeable sketch brackets each rank: percentile_approx() errs by at most n / accuracy ranks, so the values at
twice that error to both sides enclose the one that is asked for. A second pass counts the values below a bracket and
groups the distinct values inside it, a few ten-thousandths of a group; a window over those finds the value whose
running count reaches the rank. Both passes are pre-aggregated; what is shuffled are sketches, counts and the values
inside brackets. Keys are coarse: their brackets, a row a key, are broadcast, for a join by shuffle would bring a group to
one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000


@dataclass(frozen=True)
class Rank:
    """A value by its rank among n sorted ones, from 1, near the quantile q."""

    name: str
    q: float
    rank: Callable[[Column], Column]


def nearest(name: str, q: float) -> Rank:
    """The nearest-rank percentile."""
    return Rank(name, q, lambda n: F.greatest(F.lit(1), F.ceil(F.round(n * q, 6))).cast("long"))


#: The two middle values, the same one in a group of odd size.
MIDDLE = [Rank("_low", 0.5, lambda n: F.floor((n + 1) / 2)), Rank("_high", 0.5, lambda n: F.floor(n / 2) + 1)]


def select(df: DataFrame, keys: list[str], column: str, ranks: list[Rank], accuracy: int = ACCURACY) -> DataFrame:
    """A row for each key with the value of each rank; nulls don't count, keys may be null. Null where a group has no value."""
    parts = [F.col(k) for k in keys] or [F.lit(0)]  # without keys all rows are one group
    own = [f"_k{i}" for i in range(len(parts))]
    rows = df.select(*[k.alias(o) for k, o in zip(parts, own)], F.col(column).cast("double").alias("_v"))
    slack = 2.0 / accuracy
    asks = [x for r in ranks for x in (max(0.0, r.q - slack), min(1.0, r.q + slack))]
    ends = F.percentile_approx("_v", [0.0, *asks, 1.0], accuracy)
    brackets = rows.groupBy(*own).agg(ends.alias("_e"), F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    of = lambda i, r: F.struct(
        F.when(F.lit(r.q <= slack), F.col("_least")).otherwise(F.get("_e", F.lit(2 * i + 1))).alias("low"),
        F.when(F.lit(r.q >= 1 - slack), F.col("_most")).otherwise(F.get("_e", F.lit(2 * i + 2))).alias("high"),
        r.rank(F.col("_n")).cast("long").alias("rank"),
    )
    brackets = brackets.select(*own, F.array(*[of(i, r) for i, r in enumerate(ranks)]).alias("_b"))
    same = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in own]
    met = rows.join(F.broadcast(brackets.select(*[F.col(k).alias(f"_of{k}") for k in own], "_b")), same)
    v = F.col("_v")
    marks = F.transform("_b", lambda b, i: F.struct(i.alias("i"), F.when(v >= b["low"], v).alias("value"), (v <= b["high"]).alias("inside"), b["rank"].alias("rank")))
    each = met.select(*own, F.explode(F.filter(marks, lambda m: m["inside"])).alias("m"))  # value null: below the bracket
    counts = each.groupBy(*own, "m.i", "m.value", "m.rank").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*own, "i")
    upto = F.sum("n").over(w.orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    hit = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")) & F.col("value").isNotNull())
    found = hit.groupBy(*own).agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(r.name) for i, r in enumerate(ranks)])
    named = brackets.select(*[F.col(k).alias(f"_of{k}") for k in own]).join(found, same, "left")
    return named.select(*[F.col(f"_of{o}").alias(k) for o, k in zip(own, keys)], *[r.name for r in ranks])
