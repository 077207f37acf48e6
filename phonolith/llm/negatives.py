"""Hard-negative mining by bit-sliced integer products (operator 12).

Vectors are made whole numbers, floor(scale * x), and a score is the inner product of two of them. Components are cut
into bit-planes in two's complement. The product of an anchor with a vector grows plane by plane, most significant
first; what the planes that are left can add lies between known bounds for each anchor, the sums of its negative and
of its positive components times the largest remainder. So each pair has an interval that halves with each plane, and
it is dropped once the interval can't reach what is asked: the anchor's last top score so far, or the bands of its
positives. While many pairs are left a plane is one matrix product; once few are, only those pairs are worked on.
Sums are exact: single precision holds them where they stay below 2 ** 24, double below 2 ** 53, else integers do.

Two rounds of that, over all rows. The first gives each anchor its positives, the best rows of its label; their
scores give bands of scores for negatives, and the second gives each positive the best rows of other labels in its
band. Rows are dealt into a grid of blocks, `anchors` anchors by a bounded number of rows; a task holds the anchors of
a block and streams its rows past them, with a bounded number of best rows for each anchor and band. A vector moves
once for each block of anchors, and what leaves a task is best rows only, which a window ranks.

Defined results: rows with a null key, label or vector, or with a null or non-finite component, take no part, nor
do those with a component so large that a product could leave 2 ** 56. Vectors of different lengths don't meet.
Rows that share a key are rows of their own: each is an anchor, a positive or a negative by itself; of equal rows all
count. A positive without a row in its band has no row in the result; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Tables, ship


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5  # for each anchor
    negatives: int = 10  # for each positive
    low: int = 30  # per cent of the positive's score
    high: int = 90
    anchors: int = 4096  # in a block
    rows: int = 262144  # in a block, at most
    blocks: int = 24  # of rows, where there are enough of them
    pairs: int = 1 << 21  # handled at once
    sparse: int = 32  # pairs are worked on one by one if at most one in so many is left


#: Beyond every score and sum of scores.
FAR = 1 << 61


def _dtype(most: int) -> type:
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def within(a: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) with low[i] <= score <= high[i], and their scores; a, v: whole numbers, a row each."""
    none = np.zeros(0, np.int64)
    if not len(a) or not len(v):
        return none, none, none
    if not a.shape[1]:
        i, j = np.nonzero(np.broadcast_to(((low <= 0) & (high >= 0))[:, None], (len(a), len(v))))
        return i, j, np.zeros(len(i), np.int64)
    bits = int(max(v.max(), ~v.min())).bit_length() + 1
    gain, loss = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    kind = _dtype(int((gain - loss).max()) << bits)
    score, pairs = np.zeros((len(a), len(v)), kind), None
    for p in range(bits - 1, -1, -1):
        weight, rest = -(1 << p) if p == bits - 1 else 1 << p, (1 << p) - 1
        plane, floor, ceiling = (v >> p) & 1, low - rest * gain, high - rest * loss
        if pairs is None:
            score += (a * weight).astype(kind) @ plane.astype(kind).T
            open_ = (score >= floor.astype(kind)[:, None]) & (score <= ceiling.astype(kind)[:, None])
            if p and np.count_nonzero(open_) * s.sparse > open_.size:
                continue
            i, j = np.nonzero(open_)
            pairs = i, j, score[i, j].astype(np.int64)
        else:
            i, j, part = pairs
            for at in range(0, len(i), 1 << 16):
                x = slice(at, at + (1 << 16))
                part[x] += weight * np.einsum("nd,nd->n", a[i[x]], plane[j[x]])
            ok = (part >= floor[i]) & (part <= ceiling[i])
            pairs = i[ok], j[ok], part[ok]
    return pairs


def best(i: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each i: higher scores first, ties by smaller id, then by row."""
    order = np.lexsort((rids, ids, -score, i))
    i = i[order]
    new = np.ones(len(i), bool)
    new[1:] = i[1:] != i[:-1]
    begins = np.flatnonzero(new)
    rank = np.arange(len(i)) - np.repeat(begins, np.diff([*begins, len(i)]))
    return order[rank < k]


class _Top:
    """The best rows so far of each anchor, and the score that another one must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.least = k, [np.zeros(0, np.int64)] * 4, np.full(n, -FAR)

    def add(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        if not len(i):
            return
        rows = [np.concatenate(x) for x in zip(self.rows, (i, score, ids, rids))]
        kept = best(*rows, self.k)
        self.rows = [x[kept] for x in rows]
        count = np.bincount(self.rows[0], minlength=len(self.least))
        last = np.cumsum(count) - 1
        full = count == self.k
        self.least[full] = self.rows[1][last[full]]


def _vectors(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a batch, for each length of vectors."""
    column = batch.column("vec")
    sizes = np.diff(column.offsets.to_numpy())
    flat, begin = column.values.to_numpy(), column.offsets[0].as_py()
    flat, out = flat[begin:].astype(np.int64), []
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out.append((at, flat[begins[at][:, None] + np.arange(size)]))
    return out


class _Anchors:
    """Anchors of one length of vectors in a block."""

    def __init__(self, rid: np.ndarray, label: np.ndarray, vec: np.ndarray, bands: list[list[int]] | None, s: Settings):
        self.rid, self.label, self.vec, self.s = rid, label, vec, s
        k = s.positives if bands is not None else 1
        self.tops = [_Top(len(rid), s.negatives if bands is not None else s.positives) for _ in range(k)]
        self.low, self.high = np.full((len(rid), k), FAR), np.full((len(rid), k), -FAR)
        if bands is None:
            self.low[:], self.high[:] = -FAR, FAR
        for n, scores in enumerate(bands or []):
            x = np.array(scores, np.int64)
            self.low[n, : len(x)], self.high[n, : len(x)] = -(-s.low * x // 100), s.high * x // 100
        self.same = bands is None

    def meet(self, rid: np.ndarray, ids: np.ndarray, label: np.ndarray, vec: np.ndarray) -> None:
        step = max(1, self.s.pairs // max(1, len(self.rid)))
        for own, mine in [(np.flatnonzero(self.label == x), np.flatnonzero(label == x)) for x in np.unique(label)] if self.same else [(np.arange(len(self.rid)), np.arange(len(rid)))]:
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                low = np.stack([np.maximum(self.low[own, k], t.least[own]) for k, t in enumerate(self.tops)], 1)
                high = self.high[own]
                real = low <= high
                least = np.where(real, low, FAR).min(1, initial=FAR)
                most = np.where(real, high, -FAR).max(1, initial=-FAR)
                i, j, score = within(self.vec[own], vec[some], least, most, self.s)
                ok = self.rid[own][i] != rid[some][j] if self.same else self.label[own][i] != label[some][j]
                i, j, score = i[ok], some[j[ok]], score[ok]
                for k, top in enumerate(self.tops):
                    ok = (score >= low[i, k]) & (score <= high[i, k])
                    top.add(own[i[ok]], score[ok], ids[j[ok]], rid[j[ok]])

    def found(self) -> list[np.ndarray]:
        """anchor's rid, row's id, score, row's rid, and the bands (bits) in which it is among the best."""
        rows = [np.concatenate(x) for x in zip(*[(*t.rows, np.full(len(t.rows[0]), 1 << k)) for k, t in enumerate(self.tops)])]
        order = np.lexsort((rows[3], rows[0]))
        i, score, ids, rids, bit = (x[order] for x in rows)
        if not len(i):
            return [i, ids, score, rids, bit]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (rids[1:] != rids[:-1])
        at = np.flatnonzero(new)
        return [self.rid[i[at]], ids[at], score[at], rids[at], np.bitwise_or.reduceat(bit, at)]


FOUND = "rid long, other long, score long, other_rid long, bands long"


def _blocks(s: Settings, banded: bool):
    """Rows come by block, anchors first."""

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, groups = None, [], {}

        def settled() -> dict[int, _Anchors]:
            by: dict[int, list] = {}
            for batch in waiting:
                rid, label = numbers(batch, "rid"), numbers(batch, "label")
                bands = batch.column("scores").to_pylist()
                for at, vec in _vectors(batch):
                    by.setdefault(vec.shape[1], []).append((rid[at], label[at], vec, [bands[x] for x in at]))
            return {size: _Anchors(*[np.concatenate(x) for x in list(zip(*parts))[:3]], sum((p[3] for p in parts), []) if banded else None, s) for size, parts in by.items()}

        def result() -> Iterator[pa.RecordBatch]:
            for g in groups.values():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in g.found()], [x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = numbers(batch, "a") << 32 | numbers(batch, "c")
            sort = place << 1 | ~batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(sort[1:] != sort[:-1]) + 1).tolist(), len(sort)]
            for begin, end in zip(cuts, cuts[1:]):
                part = batch.slice(begin, end - begin)
                if place[begin] != now:
                    yield from result()
                    now, waiting, groups = place[begin], [], {}
                if part.column("anchor")[0].as_py():
                    waiting.append(part)
                    continue
                if waiting:
                    groups, waiting = settled(), []
                rid, ids, label = (numbers(part, x) for x in ("rid", "id", "label"))
                for at, vec in _vectors(part):
                    if vec.shape[1] in groups:
                        groups[vec.shape[1]].meet(rid[at], ids[at], label[at], vec)
        yield from result()

    return run


def _scan(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, s: Settings, banded: bool) -> DataFrame:
    """Best rows of each block for its anchors(rid, id, label, vec, scores)."""
    a = -(-n_anchors // s.anchors)
    c = -(-n // min(max(n // s.blocks, 512), s.rows))
    block = lambda by, count: F.pmod(F.xxhash64(by), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    mine = anchors.withColumns({"a": block("rid", a), "c": every(c), "anchor": F.lit(True)})
    theirs = rows.select("rid", "id", "label", "vec", F.lit(None).cast("array<long>").alias("scores")).withColumns({"a": every(a), "c": block("rid", c), "anchor": F.lit(False)})
    dealt = mine.unionByName(theirs).repartition("a", "c").sortWithinPartitions("a", "c", F.col("anchor").desc(), "rid")
    return dealt.mapInArrow(_blocks(s, banded), FOUND)


def integers(vectors: DataFrame, anchor: Column, s: Settings = Settings(), key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(rid, id, label, vec, anchor) of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") * s.scale)
    bound = F.least(F.sqrt(F.lit(2.0**56) / F.greatest(F.size(vector), F.lit(1))), F.lit(2.0**31 - 1))
    sound = F.col(key).isNotNull() & F.col(label).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound))
    read = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.when(sound, F.transform(x, lambda c: F.floor(c).cast("int"))).alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return read.filter("vec is not null").withColumn("rid", F.monotonically_increasing_id())


def mine(vectors: DataFrame, anchor: Column, s: Settings = Settings(), key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where anchor holds."""
    spark = ship(vectors.sparkSession)
    tables = Tables(spark, "negatives")
    rows = tables.keep(integers(vectors, anchor, s, key, label, vector))
    anchors = rows.filter("anchor").select("rid", "id", "label", "vec")
    n, n_anchors = rows.count(), anchors.count()

    first = _scan(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), n, n_anchors, s, False) if n_anchors else spark.createDataFrame([], FOUND)
    by_score = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other", "other_rid")
    ranked = first.withColumn("k", F.row_number().over(by_score("rid")) - 1).filter(F.col("k") < s.positives)
    positives = tables.keep(ranked.select("rid", "k", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))

    scores = positives.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "positive_score"))).alias("p"))  # as many as an anchor has positives
    banded = anchors.join(scores, "rid").select("rid", "id", "label", "vec", F.transform("p", lambda x: x["positive_score"]).alias("scores"))
    second = _scan(rows, banded, n, n_anchors, s, True) if n_anchors else spark.createDataFrame([], FOUND)
    bands = F.filter(F.sequence(F.lit(0), F.lit(s.positives - 1)), lambda k: F.call_function("shiftright", F.col("bands"), k).bitwiseAND(F.lit(1)) == 1)
    each = second.withColumn("k", F.explode(bands))
    ranked = each.withColumn("rank", F.row_number().over(by_score("rid", "k"))).filter(F.col("rank") <= s.negatives)
    named = positives.join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    out = ranked.select("rid", "k", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["rid", "k"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
