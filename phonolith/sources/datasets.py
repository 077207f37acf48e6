"""Data sets: pages, ranges, splits and seeded samples of ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PAGE = 100
#: Ranges of an order by which sample() numbers rows.
RANGES = 64


def page(df: DataFrame, order: str, offset: int, length: int) -> DataFrame:
    """One page: from offset, 1 to 100 rows."""
    return df.orderBy(order).offset(max(0, offset)).limit(max(1, min(PAGE, length)))


def rows(df: DataFrame, order: str, start: int, limit: int) -> DataFrame:
    """limit rows from start, at least one."""
    return df.orderBy(order).offset(max(0, start)).limit(max(1, limit))


def configs(splits: DataFrame) -> DataFrame:
    """Distinct splits of each config(config, split, pos) in first-seen order; blank configs are left out."""
    first = splits.filter((F.trim("config") != "") & (F.trim("split") != "")).groupBy("config", "split").agg(F.min("pos").alias("pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "split"))), lambda x: x["split"])
    return first.groupBy("config").agg(ordered.alias("splits"))


def seed_number(seed: str | None) -> int | None:
    """FNV-1a of a seed's UTF-16 units; none of an empty seed."""
    if not seed:
        return None
    h = 2166136261
    units = seed.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) % (1 << 32)
    return h


def random_numbers(seed: int):
    """The 32-bit Mulberry generator: numbers from 0 to below 1."""
    low = (1 << 32) - 1
    state = seed & low
    while True:
        state = (state + 0x6D2B79F5) & low
        t = (state ^ state >> 15) * (state | 1) & low
        t ^= (t + ((t ^ t >> 7) * (t | 61) & low)) & low
        yield ((t ^ t >> 14) & low) / (1 << 32)


def offsets(total: int, wanted: int, seed: str | None) -> list[int]:
    """Distinct offsets in the order drawn; a bounded number of draws."""
    import random

    number = seed_number(seed)
    draw = random_numbers(number) if number is not None else iter(random.random, None)
    seen: dict[int, None] = {}
    for _ in range(min(3 * total, total + 20 * wanted)):
        if len(seen) >= min(wanted, total):
            break
        seen.setdefault(int(next(draw) * total))
    return list(seen)


def sample(df: DataFrame, order: str, wanted: int, seed: str | None) -> DataFrame:
    """wanted rows without replacement, with `ord`: by page, then as drawn.

    Offsets become keys by ranges of the order and their row counts, so no task sees all rows. The ranges' bounds
    are drawn first, so both passes over the rows number them alike, however Spark plans or repeats them.
    """
    spark = df.sparkSession
    spread = df.select(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("b")).first()["b"] or []
    bounds = sorted({b for b in spread if b is not None})
    part = F.lit(0)
    for b in bounds:
        part = part + F.when(F.col(order) > F.lit(b), 1).otherwise(0)
    parts = df.withColumn("_part", part.cast("int"))
    begins, total = [], 0
    for p, n in sorted(parts.groupBy("_part").count().collect()):  # at most RANGES numbers
        begins.append((p, total, n))
        total += n
    drawn = offsets(total, wanted, seed)
    places = sorted(range(len(drawn)), key=lambda i: (drawn[i] // PAGE, i))
    wish = [(p, drawn[i] - begin + 1, n) for n, i in enumerate(places) for p, begin, size in begins if begin <= drawn[i] < begin + size]
    wish = spark.createDataFrame(wish, "_part int, _at int, ord int")
    hit = parts.join(F.broadcast(wish.select("_part").distinct()), "_part", "left_semi")  # ranges without a drawn offset end here
    numbered = hit.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return numbered.join(F.broadcast(wish), ["_part", "_at"]).select("ord", *df.columns)
