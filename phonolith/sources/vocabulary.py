"""Vocabularies: lines to pieces, several put together, ids to pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def parse(lines: DataFrame) -> DataFrame:
    """(pos, id, piece) of lines(pos, line): an id stands after the last space, or the place is the id."""
    numbered = F.col("line").rlike(r"\s[0-9]+$")
    number = F.regexp_extract("line", r"\s([0-9]+)$", 1)
    piece = F.when(numbered, F.regexp_replace("line", r"\s[0-9]+$", "")).otherwise(F.col("line"))
    return lines.select("pos", F.when(numbered, number.cast("long")).otherwise(F.col("pos")).alias("id"), piece.alias("piece"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file; places are those of its lines. It is one file, as large as a vocabulary."""
    lines = spark.read.text(path).coalesce(1).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    return parse(lines.filter("line <> ''"))


def aggregate(pieces: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """(id, piece, part) of pieces(part, id, piece), each part's ids moved by its offset."""
    offset = F.coalesce(*[F.when(F.col("part") == k, v) for k, v in offsets.items()])
    return pieces.select((F.col("id") + offset).alias("id"), "piece", "part")


def lookup(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """ids with their pieces in place of `id`; empty where there is none."""
    return ids.join(vocabulary, "id", "left").select(*[c for c in ids.columns if c != "id"], F.coalesce("piece", F.lit("")).alias("piece"))
