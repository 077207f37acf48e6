"""Runs of equal or speaking rows in ordered groups: one window pass to number runs, one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_runs(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "run") -> DataFrame:
    """df with the number of each row's run of equal values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.when(F.row_number().over(w) == 1, 1).otherwise((~value.eqNullSafe(F.lag(value).over(w))).cast("int"))
    df = df.withColumn("_new", first)
    return df.withColumn(name, F.sum("_new").over(w)).drop("_new")


def hysteresis(df: DataFrame, keys: list[str], order: list[str], p: Column, threshold: float = 0.5, offset: float = 0.15, enter: int = 2, leave: int = 4) -> DataFrame:
    """df with `speaking`: on from the enter-th hop of a run at the threshold, off from the leave-th of one below it by offset.

    Hops in between end both runs. Null and NaN are silence. The same as streaming.folds.Hysteresis, by windows alone.
    """
    kind = F.when(p.isNull() | F.isnan(p) | (p < threshold - offset), -1).when(p >= threshold, 1).otherwise(0)
    d = with_runs(df.withColumn("_kind", kind), keys, order, F.col("_kind"), "_run")
    d = d.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)))
    turn = F.when((F.col("_kind") == 1) & (F.col("_at") >= enter), True).when((F.col("_kind") == -1) & (F.col("_at") >= leave), False)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("speaking", F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False))).drop("_kind", "_run", "_at")


def runs(df: DataFrame, keys: list[str], order: list[str], value: Column, *more: Column) -> DataFrame:
    """One row a run: keys, run, value, length, first and last place (from 0), and aggregates of more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = with_runs(df.withColumn("_value", value).withColumn("_at", F.row_number().over(w) - 1), keys, order, F.col("_value"))
    return numbered.groupBy(*keys, "run").agg(F.first("_value").alias("value"), F.count("*").alias("length"), F.min("_at").cast("long").alias("start"), F.max("_at").cast("long").alias("end"), *more)
