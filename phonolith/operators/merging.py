"""Merging of overlapping windows in batch, exact however far back a repeat lies.

The folds of streaming.mergers keep a bounded tail. In batch the rows of a sentence meet instead: what a window settles
depends on the windows before it only through sentences of the same normalised text, so those are dealt to one task,
in order, and a fold keeps the ends of the settled ones. A stream of any length is spread over its sentences.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from phonolith.streaming.mergers import cut_sentences
from phonolith.streaming.runner import SLICE, fold_batch

SENTENCES = ArrayType(StructType([StructField("text", StringType()), StructField("end", DoubleType()), StructField("words", IntegerType())]))


@dataclass
class Repeats:
    """Of one text, in order: a row repeats a settled one if their ends are near, or if either has none."""

    tolerance: float
    settled: list = field(default_factory=list)  # ends, in order
    untimed: bool = False

    def step(self, row: dict) -> list[dict]:
        end = row["end"]
        timed = end is not None and end == end
        at = bisect_left(self.settled, end) if timed else 0
        near = timed and any(abs(e - end) <= self.tolerance for e in self.settled[max(0, at - 1) : at + 1])
        if self.untimed or near or not timed and self.settled:
            return []
        if timed:
            insort(self.settled, end)
        else:
            self.untimed = True
        return [row]


@F.arrow_udf(SENTENCES)
def _cut(words: pa.Array, ends: pa.Array) -> pa.Array:
    """The sentences of windows' words, each with the end of its last word. Few rows of a batch are Python objects at once."""

    def of(texts, times) -> list[dict]:
        texts = texts or []
        times = [None] * len(texts) if times is None else [None if t is None or t != t else t for t in times]
        return [{"text": " ".join(w[0] for w in s), "end": s[-1][1], "words": len(s)} for s in cut_sentences(list(zip(texts, times)))]

    kind = pa.list_(pa.struct([("text", pa.string()), ("end", pa.float64()), ("words", pa.int32())]))
    parts = ((words.slice(at, SLICE).to_pylist(), ends.slice(at, SLICE).to_pylist()) for at in range(0, len(words), SLICE))
    return pa.concat_arrays([pa.array([], kind), *[pa.array([of(w, t) for w, t in zip(*p)], kind) for p in parts]])


def settled(windows: DataFrame, key: str, order: str, words: str, ends: str | None, final: str, tolerance: float = 0.15, least_words: int = 1) -> DataFrame:
    """(key, order, place, text, end) of each sentence that windows settle: all but a window's last, and that too if final.

    words: a window's words; ends: when each ends, or None for words without times. Sentences that were settled before
    with about the same end, or of unknown end, are dropped; so are those of fewer than least_words.
    """
    times = F.col(ends).cast("array<double>") if ends else F.lit(None).cast("array<double>")
    cut = windows.select(F.col(key).alias("_stream"), F.col(order).alias("_at"), F.col(final).alias("_final"), _cut(F.col(words), times).alias("_s"))
    each = cut.select("_stream", "_at", "_final", F.size("_s").alias("_n"), F.posexplode("_s").alias("place", "s"))
    done = each.filter((F.col("_final") | (F.col("place") < F.col("_n") - 1)) & (F.col("s.words") >= least_words))
    same = F.trim(F.regexp_replace(F.lower("s.text"), r"\s+", " "))
    rows = done.select(F.sha2(F.to_json(F.struct("_stream", same.alias("t"))), 256).alias("_text"), "_stream", "_at", "place", F.col("s.text").alias("text"), F.col("s.end").alias("end"))
    kinds = dict(rows.dtypes)
    schema = f"_stream {kinds['_stream']}, _at {kinds['_at']}, place int, text string, end double"
    kept = fold_batch(rows, "_text", ["_at", "place"], partial(Repeats, tolerance), schema)
    return kept.select(F.col("_stream").alias(key), F.col("_at").alias(order), "place", "text", "end")
