"""Transcripts as nested rows: words, segments, levels of detail, joining of parts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from phonolith.functions.text import words

#: Levels of detail, each with all that those before it have.
LEVELS = ("text", "segments", "words", "detailed")
KEPT = {"segments": LEVELS[1:], "words": LEVELS[2:], "tokens": LEVELS[3:]}


def timed_words(df: DataFrame, keys: list[str], text: str, step: float, length: float) -> DataFrame:
    """A text's words at even times; stands in for a recogniser."""
    d = df.select(*keys, F.posexplode(words(F.col(text))).alias("pos", "word"))
    return d.withColumns({"start_s": F.col("pos") * step, "end_s": F.col("pos") * step + length})


def _in_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda x: x[column])


def default_segment(w: DataFrame, keys: list[str]) -> DataFrame:
    """All words of a key as one segment; its confidence is their mean if all are known."""
    known = F.bool_and(F.col("confidence").isNotNull())
    return w.groupBy(*keys).agg(F.array_join(_in_order("word"), " ").alias("text"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.when(known, F.avg("confidence")).alias("confidence"))


def canonical(w: DataFrame, keys: list[str]) -> DataFrame:
    """One nested transcript a key, of words(pos, word, start_s, end_s, confidence)."""
    word = F.struct("pos", F.col("word").alias("text"), "start_s", "end_s", "confidence")
    ordered = F.array_sort(F.collect_list(word))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), " ")
    d = w.groupBy(*keys).agg(ordered.alias("words"), text.alias("text"), F.min("start_s").alias("s"), F.max("end_s").alias("e"), F.avg("confidence").alias("c"))
    segment = F.struct(F.lit(0).alias("index"), "text", F.col("s").alias("start_s"), F.col("e").alias("end_s"), F.col("c").alias("confidence"))
    return d.select(*keys, F.struct("text", F.array(segment).alias("segments"), "words").alias("transcript"))


def shift(items: Column, seconds: Column) -> Column:
    """Times of an array of structs moved; missing ones stay missing."""
    return F.transform(items, lambda w: w.withField("start_s", w["start_s"] + seconds).withField("end_s", w["end_s"] + seconds))


def detail(level: Column, arrays: dict[str, Column]) -> Column:
    """A struct of those arrays that a level keeps; empty ones are null."""
    return F.struct(*[F.when(level.isin(*KEPT[n]) & (F.size(a) > 0), a).alias(n) for n, a in arrays.items()])


def concat(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Parts of a key joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return df.groupBy(*keys).agg(F.array_join(parts, " ").alias(text), F.count("*").alias("parts"))


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"(?<!^)(?=[A-Z])", "_", c).lower() for c in df.columns])


def prefix_lengths(pieces: DataFrame, keys: list[str], order: str, piece: str) -> DataFrame:
    """pieces' rows with `n`, the length of the decoded text of all pieces up to each; linear in the pieces of a text.

    Decoded as text.decode_pieces() does. A character that isn't white space counts, and a space before it if white
    space stands between it and an earlier such character and it is no punctuation mark. What a piece adds depends on
    the pieces before it only by whether they have a character and end in white space, so running sums suffice.
    """
    own = F.when((F.col(piece) == "<blank>") | F.col(piece).rlike("^<.*>$"), "").otherwise(F.replace(F.col(piece), F.lit("▁"), F.lit(" ")))
    inside = F.size(F.regexp_extract_all("_t", F.lit(r"\S\s+(?=[^\s.,!?;:])"), F.lit(0)))
    solid = F.length(F.regexp_replace("_t", r"\s+", ""))
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("_t", own).withColumns({"_solid": solid, "_ends": F.when(F.col("_t") != "", F.col("_t").rlike(r"\s$"))})
    space = F.coalesce(F.last("_ends", ignorenulls=True).over(before), F.lit(False)) | F.col("_t").rlike(r"^\s")
    after = F.coalesce(F.sum("_solid").over(before), F.lit(0)) > 0
    led = F.when(space & after & F.col("_t").rlike(r"^\s*[^\s.,!?;:]"), 1).otherwise(0)
    rows = rows.withColumn("_adds", F.col("_solid") + inside + led)
    return rows.withColumn("n", F.sum("_adds").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t", "_solid", "_ends", "_adds")


def boundaries(sentences: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sentence, boundary): how many words there are up to the end of each sentence.

    Both come as (keys, i, size), sizes without white space. Running sums place both on one line; of the words that
    reach a sentence's end the first is the least place among those after it, by one more window.
    """
    sums = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda d, word: d.select(*keys, F.sum("size").over(sums).alias("upto"), F.lit(word).alias("word"), "i")
    line = upto(sentences, False).union(upto(words, True))
    reach = Window.partitionBy(*keys).orderBy(F.col("upto").desc(), F.col("word").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = line.withColumn("boundary", F.min(F.when(F.col("word"), F.col("i"))).over(reach) + 1)
    return placed.filter(~F.col("word") & F.col("boundary").isNotNull()).select(*keys, F.col("i").alias("sentence"), "boundary")


def joined_pieces(parts: DataFrame, keys: list[str], order: list[str], text: str, separator: str, size: int = 1 << 16) -> DataFrame:
    """(keys, piece, begin, parts, text): a key's texts in order, joined, as pieces of about `size` characters.

    Where each text begins in the whole is a running sum, so a piece holds the texts that begin in its stretch and
    begins itself where the first of them does: put together by `piece`, pieces are the joined text. No array holds a
    key's texts, only those of a piece, and a text of its own length at most beyond.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    own = F.coalesce(F.col(text), F.lit(""))
    step = F.length(own) + len(separator)
    at = F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select(*keys, at.alias("_at"), F.row_number().over(w).alias("_n"), own.alias("_text"))
    placed = placed.withColumns({"piece": F.floor(F.col("_at") / size), "_text": F.concat(F.when(F.col("_n") > 1, separator).otherwise(""), "_text")})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))), lambda x: x["_text"])
    begin = F.min(F.when(F.col("_n") > 1, F.col("_at") - len(separator)).otherwise(0))
    return placed.groupBy(*keys, "piece").agg(begin.alias("begin"), F.count("*").alias("parts"), F.array_join(ordered, "").alias("text"))
