"""Native transcripts of recogniser families as canonical ones: nested rows at a level of detail.

A family differs in where segments and words come from and in what its counts count; those are a Family's fields.
All arrays are built by aggregations on the transcript's keys, and tokens meet words by a bucketed equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .transcript import KEPT

SEGMENT = "array<struct<index:int,text:string,start_s:double,end_s:double,confidence:double>>"


@dataclass(frozen=True)
class Family:
    """segments: `words` (one of all words), `span` (the text over its words, else tokens) or `native`."""

    name: str
    segments: str
    whole: bool = False  # a text without words is one segment of the whole recording
    counts_native: bool = True  # counts are those of the native transcript, not of what a level keeps


FAMILIES = {
    "transducer": Family("transducer", "words", counts_native=False),
    "attention": Family("attention", "words", whole=True, counts_native=False),
    "ctc": Family("ctc", "span"),
    "seq2seq": Family("seq2seq", "native"),
}


def linked(words: DataFrame, tokens: DataFrame, keys: list[str], bucket_s: float = 1.0) -> DataFrame:
    """words(keys, pos, start_s, end_s, ...) with `tokens`, the places of the tokens that lie inside each."""
    slot = lambda c: F.floor(F.col(c) / bucket_s)
    spans = words.filter("start_s <= end_s").select(*keys, F.col("pos").alias("_word"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.explode(F.sequence(slot("start_s"), slot("end_s"))).alias("_slot"))
    placed = tokens.select(*keys, F.col("pos").alias("_token"), "start_s", "end_s", slot("start_s").alias("_slot"))
    inside = spans.join(placed, [*keys, "_slot"]).filter("start_s >= _s and end_s <= _e")
    found = inside.groupBy(*keys, F.col("_word").alias("pos")).agg(F.sort_array(F.collect_list("_token")).alias("tokens"))
    none = F.expr("cast(array() as array<int>)")
    return words.join(found, [*keys, "pos"], "left").withColumn("tokens", F.coalesce("tokens", none))


def _nested(df: DataFrame, keys: list[str], name: str, *columns: str) -> DataFrame:
    item = F.struct(F.col("pos").alias("index"), *columns)
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name))


def _one(items: str, text: Column, confidence: Column) -> Column:
    """A segment from the first of items to the last."""
    first, last = F.get(items, F.lit(0)), F.element_at(items, -1)
    return F.array(F.struct(F.lit(0).alias("index"), text.alias("text"), first["start_s"].alias("start_s"), last["end_s"].alias("end_s"), confidence.alias("confidence")))


def _segments(family: Family) -> Column:
    has = lambda c: F.size(c) > 0
    if family.segments == "native":
        return F.col("_segments")
    if family.segments == "span":
        over = lambda c: _one(c, F.col("text"), F.col("utterance"))
        return F.when(has("_words"), over("_words")).when(has("_tokens"), over("_tokens"))
    sure = F.transform("_words", lambda w: w["confidence"])
    mean = F.when(F.forall(sure, lambda c: c.isNotNull()), F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure))
    text = F.trim(F.array_join(F.transform("_words", lambda w: w["text"]), " "))
    found = F.when(has("_words"), _one("_words", text, mean))
    if family.whole:
        whole = F.struct(F.lit(0).alias("index"), F.col("text"), F.lit(0.0).alias("start_s"), F.coalesce("duration_s", F.lit(0.0)).alias("end_s"), F.col("utterance").alias("confidence"))
        found = found.when(F.length("text") > 0, F.array(whole))
    return found


def to_canonical(native: DataFrame, words: DataFrame, tokens: DataFrame, segments: DataFrame, keys: list[str], family: Family, detail: str = "detail") -> DataFrame:
    """(keys, transcript) of native(keys, text, utterance, duration_s, detail), its words, tokens and segments.

    words, tokens and segments have keys, pos, text, start_s, end_s and confidence. Arrays that a level doesn't keep,
    and empty ones, are null, as are the counts of what isn't there. For `native` segments the words are the segments.
    """
    parts = ["text", "start_s", "end_s", "confidence"]
    spoken = segments if family.segments == "native" else linked(words, tokens, keys)
    d = native
    for df, name, more in ((spoken, "_words", [c for c in ("tokens",) if c in spoken.columns]), (tokens, "_tokens", []), (segments, "_segments", [])):
        d = d.join(_nested(df, keys, name, *parts, *more), keys, "left")
    level = F.col(detail)
    arrays = {"segments": _segments(family).cast(SEGMENT), "words": F.col("_words"), "tokens": F.col("_tokens")}
    kept = {n: F.when(level.isin(*KEPT[n]) & (F.size(a) > 0), a) for n, a in arrays.items()}
    counts = [F.when(F.size(a) > 0, F.size(a)).alias(f"{n}_count") for n, a in (arrays if family.counts_native else kept).items()]
    return d.select(*keys, F.struct("text", F.lit(family.name).alias("family"), *[a.alias(n) for n, a in kept.items()], *counts).alias("transcript"))
