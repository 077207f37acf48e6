"""Exact dedup by two-pass Bloom filtering (operator 11). DataFrame operations only.

Texts are equal when their normalised forms are: each run of white space is one space. A text stands for its SHA-256.

The first pass counts, over all rows, how often each bit of a Bloom filter is set. A hash owns `probes` bits of one
64-bit word, and words are as many as give each row `bits` bits. The bits set twice or more make the second filter:
a hash that occurs twice has all its bits there. The second pass tests every row against it in place. A row that
fails has no equal and goes straight to the result; the others, the equal ones and a few per cent that share bits by
chance, are grouped by their hash. Groups are pre-aggregated before they are shuffled, and rows meet the heaviest
groups by a broadcast of a fixed size, so a group may hold most rows.

What moves is small: a word and a bit for each probe of a row, pre-aggregated, and the hashes of possible repeats. The
filter holds only words with a repeated bit. It is broadcast if they are at most `most` words (their count is
checked); beyond that every row counts as a possible repeat, which moves a hash a row and changes no result.

Defined results: a null text is empty, and equal to an empty one; of rows without a key and rows with one, the latter
stay; of rows that share the smallest key the first one read stays, so exactly one row of a group is kept; further
columns are ignored by mark() and pass through keep(), whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import Tables, heavy_join


@dataclass(frozen=True)
class Settings:
    bits: int = 16  # of the filter, for each row
    probes: int = 2
    most: int = 1 << 21  # words with a repeated bit that are broadcast; about 100 MB


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as binary."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def _word(sha: str, words: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(words))


def _bits(sha: str, s: Settings) -> Column:
    """The bits of a hash within its word, each once."""
    other = F.xxhash64(sha, F.lit(1))
    return F.array_distinct(F.array(*[F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(s.probes)]))


def repeated_bits(hashes: DataFrame, sha: str, words: int, s: Settings, tables: Tables) -> DataFrame | None:
    """First pass over hashes: the second filter as rows (word, mask) that can be broadcast, or None if they are too many."""
    cells = hashes.select(_word(sha, words).alias("word"), F.explode(_bits(sha, s)).alias("bit"))
    twice = cells.groupBy("word", "bit").agg(F.count("*").alias("n")).filter("n > 1")
    found = tables.keep(twice.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    return found if found.count() <= s.most else None


def possible(rows: DataFrame, sha: str, words: int, found: DataFrame | None, s: Settings) -> DataFrame:
    """Second pass: rows with _again, false only where no other row has the same hash. Nothing is shuffled."""
    if found is None:
        return rows.withColumn("_again", F.lit(True))
    own = F.aggregate(_bits(sha, s), F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    probed = rows.withColumn("_word", _word(sha, words)).withColumn("_own", own)
    met = probed.join(F.broadcast(found.withColumnRenamed("word", "_word")), "_word", "left")
    again = F.coalesce(F.col("mask").bitwiseAND(F.col("_own")) == F.col("_own"), F.lit(False))
    return met.select(*[F.col(c) for c in rows.columns], again.alias("_again"))


def words_for(n: int, s: Settings) -> int:
    return max(1, math.ceil(n * s.bits / 64))


def mark(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row; keep_id is the key of the row of its group that stays."""
    tables = Tables(docs.sparkSession, "exact")
    rows = tables.keep(docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_id"), digest(F.col(text)).alias("_sha")))
    words = words_for(rows.count(), s)
    tested = possible(rows, "_sha", words, repeated_bits(rows, "_sha", words, s, tables), s)
    some = tested.filter("_again").drop("_again")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_rid")).alias("first")
    groups = tables.keep(some.groupBy("_sha").agg(F.count("*").alias("n"), first))
    met = heavy_join(some, groups, "_sha", "n")
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    grouped = met.select(F.col("_id").alias(key), F.col("first._id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_rid") == F.col("first._rid")).alias("kept"), sha)
    alone = tested.filter("not _again").select(F.col("_id").alias(key), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.union(grouped)


def keep(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows that stay, whole. Rows without an equal don't move; of possible repeats each task sends one of a group."""
    tables = Tables(docs.sparkSession, "exact")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row")).withColumn("_sha", digest(F.col(f"_row.`{text}`")))
    words = words_for(docs.count(), s)
    tested = possible(rows, "_sha", words, repeated_bits(rows, "_sha", words, s, tables), s)
    own = F.col(f"_row.`{key}`")
    order = F.struct(own.isNull().alias("none"), own.alias("id"), F.xxhash64("_row").alias("tie"))
    best = tested.filter("_again").groupBy("_sha").agg(F.min_by("_row", order).alias("_row")).select("_row")
    return tested.filter("not _again").select("_row").union(best).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
