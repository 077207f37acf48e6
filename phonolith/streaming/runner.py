"""One fold, two ways to run it: over complete groups in batch, over a stream with state kept by key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from phonolith.session import ship


#: Rows of an Arrow batch that are Python objects at once.
SLICE = 512


def _rows(pdf: pd.DataFrame) -> list[dict]:
    return [{k: v.tolist() if hasattr(v, "tolist") else v for k, v in r.items()} for r in pdf.to_dict("records")]


def fold_batch(df: DataFrame, key: str, order: list[str], make: Callable[[], Any], schema: str) -> DataFrame:
    """Rows out of a fold over each key's rows in order; schema is that of the fold's rows.

    Keys are dealt by a shuffle and rows come sorted to a streaming task, which holds one fold, not a group.
    Rows with a null key are one stream.
    """
    ship(df.sparkSession)
    columns = [c for c in df.columns if c != key]
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for pdf in (b.iloc[at : at + SLICE] for b in batches for at in range(0, max(1, len(b)), SLICE)):
            out = []
            for k, row in zip(pdf[key], _rows(pdf[columns])):
                if fold is None or not (k == now or pd.isna(k) and pd.isna(now)):
                    now, fold = k, make()
                out += [{key: k, **r} for r in fold.step(row)]
            yield pd.DataFrame(out, columns=[key, *names])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {schema}")


class _Kept(StatefulProcessor):
    """A fold in one value of state."""

    def __init__(self, key: str, order: list[str], make: Callable[[], Any], names: list[str]):
        self.key, self.order, self.make, self.names = key, order, make, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "fold binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # a micro-batch isn't ordered within a key
        out = [{self.key: key[0], **r} for row in _rows(pdf.drop(columns=[self.key])) for r in fold.step(row)]
        self.state.update((pickle.dumps(fold),))
        if out:
            yield pd.DataFrame(out, columns=[self.key, *self.names])

    def close(self) -> None:
        return None


def fold_stream(df: DataFrame, key: str, order: list[str], make: Callable[[], Any], schema: str) -> DataFrame:
    """As fold_batch() over a stream whose rows of a key come in order across micro-batches.

    The session needs RocksDB as its state store.
    """
    ship(df.sparkSession)
    names = StructType.fromDDL(schema).names
    full = f"{key} {dict(df.dtypes)[key]}, {schema}"
    return df.groupBy(key).transformWithStateInPandas(_Kept(key, order, make, names), full, "append", "none")


def windowed(events: DataFrame, time: str, late: str, size: str, slide: str | None, keys: list[str], *aggregates) -> DataFrame:
    """Event-time windows with a watermark for late rows."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(*keys, F.window(time, size, slide)).agg(*aggregates)


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: list[str], *aggregates) -> DataFrame:
    """Sessions that a gap ends, with a watermark for late rows."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)).agg(*aggregates)


def coalesced(events: DataFrame, time: str, late: str, slot: str, key: str, kind: str, metric: str, order: list[str]) -> DataFrame:
    """Rows (key, kind, time, last): of events of kind `metric` the last of each slot of event time, other events all.

    `last` has the event's other columns; of equal times the last by order. In batch, or over a stream in update mode:
    a slot's row comes again when it changes, and its state goes once the watermark, `late` behind, has passed it.
    """
    from pyspark.sql import functions as F

    rest = F.struct(*[c for c in events.columns if c not in (key, kind, time)])
    seen = events.withWatermark(time, late) if events.isStreaming else events
    slots = seen.filter(F.col(kind) == metric).groupBy(key, F.window(time, slot).alias("_slot"))
    last = slots.agg(F.max(F.struct(F.col(time).alias("t"), *order, rest.alias("r"))).alias("_last"))
    metrics = last.select(key, F.lit(metric).alias(kind), F.col("_last.t").alias(time), F.col("_last.r").alias("last"))
    others = seen.filter(~F.col(kind).eqNullSafe(metric)).select(key, kind, time, rest.alias("last"))
    return metrics.union(others)
