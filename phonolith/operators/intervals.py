"""Joins and aggregates of half-open intervals, by bucket so that each is an equi-join or a plain aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def overlaps(s: Column, e: Column, start: Column, end: Column) -> Column:
    return (e > start) & (s < end)


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (start >= outer_start) & (end <= outer_end)


def cut(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """A row for each bucket that an interval touches, with bucket_start and the overlap as weight."""
    first, last = F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size)
    d = df.filter(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(first, last)))
    begin = F.col("_b") * size
    weight = F.least(F.col(end), begin + size) - F.greatest(F.col(start), begin)
    return d.withColumns({"bucket_start": begin, "weight": weight}).drop("_b")


def timeline(df: DataFrame, keys: list[str], start: str, end: str, prob: str, size: int, threshold: float = 0.5) -> DataFrame:
    """Each bucket's overlap-weighted probability and share of speech."""
    w = F.col("weight")
    spoken = F.sum(F.when(F.col(prob) >= threshold, w).otherwise(0))
    out = cut(df, start, end, size).groupBy(*keys, "bucket_start").agg((F.sum(F.col(prob) * w) / F.sum(w)).alias("prob"), (spoken / F.sum(w)).alias("speech_ratio"))
    return out.withColumn("speaking", F.col("speech_ratio") >= 0.5)


def retain(df: DataFrame, keys: list[str], start: str, end: str, span: int) -> DataFrame:
    """Intervals that reach into the last span, clipped at its edge."""
    d = df.withColumn("_base", F.max(end).over(Window.partitionBy(*keys)) - span)
    return d.filter(F.col(end) > F.col("_base")).withColumn(start, F.greatest(start, "_base")).drop("_base")


def near(left: DataFrame, right: DataFrame, keys: list[str], time: str, tolerance: int, also: Callable) -> DataFrame:
    """left's rows with a row of right of equal keys less than tolerance away for which also(left's, right's column) holds."""
    slot = F.floor(F.col(time) / tolerance)
    a = left.withColumn("_slot", slot).alias("a")
    b = right.select("*", F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot")).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_slot"]]
    on.append(F.abs(F.col(f"a.{time}") - F.col(f"b.{time}")) < tolerance)
    on.append(also(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return a.join(b, condition, "left_semi").drop("_slot")
