"""Embedding near-dedup by sorted projection passes (operator 7).

Equal vectors are folded into one representative first. In each pass the representatives are ordered
lexicographically by concatenated random hashes (signs of projections, most significant first); each is compared
with the `window` that follow it, by cosine in double precision, and the verified pairs of all passes are united.

The passes find links by chance. Among n vectors a window holds about those that share their first log2(n / window)
+ 1 hashes, which a pair at the threshold does with probability p = (1 - angle / pi) ** (log2(n / window) + 1); so
passes() takes as many as find such a pair with probability `recall`. Their number grows with n to the power 0.23.

A window that ends in a link may be too short for a vector. The links of such vectors in their component are counted
exactly: by the triangle inequality, angles to the component's centre tell of most pairs whether they link, and these
are counted by weights of rings around it; the pairs that angles leave open are compared, block against block, and
only counts leave a task. So a tight group of near copies, of mutual cosine about 0.95 and more, costs a row for each
member, no partner is capped, and for every vector n_links is the number of true links, found with at least the stated
recall. Vectors whose windows suffice cost nothing there, however large their component.

A pass moves each vector once, by a range shuffle; the neighbours on both sides of a partition's border, a bounded
number, meet afterwards. Nothing but links and these border rows is written.

Components are taken in single precision, as embeddings are stored, and cosines computed from them in double.

Defined results: null, empty or zero vectors and those with null or non-finite components link with nothing;
vectors of different lengths don't link; repeated vec_ids give a row each; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Tables, components, heavy_join, ship


#: Angles are computed to within this, in radians.
SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    recall: float = 0.95  # of pairs at the threshold; nearer ones are found more often
    least: int = 8  # passes
    hashes: int = 48
    window: int = 64
    block: int = 1024
    sample: int = 64  # members that make a component's centre, about
    step: float = 0.005  # of the rings around it, in radians
    zone: int = 8  # rings
    seed: int = 7

    @property
    def sure(self) -> int:
        """Members whose rings sum to at most this are linked: their angles sum to less than the threshold's."""
        return math.floor((math.acos(self.cosine) - SLACK) / self.step) - 2

    @property
    def far(self) -> int:
        """Members whose rings differ by more than this aren't linked."""
        return math.floor((math.acos(self.cosine) + SLACK) / self.step) + 1


def passes(n: int, s: Settings) -> int:
    """How many passes find a pair at the threshold among n vectors with probability s.recall."""
    same = 1 - math.acos(s.cosine) / math.pi
    p = same ** max(1.0, math.log2(max(n, 2) / s.window) + 1)
    return max(s.least, math.ceil(math.log(1 - s.recall) / math.log(1 - p)))


def unit(rows: list[bytes]) -> np.ndarray:
    """Rows of equal length, as unit vectors in double precision."""
    v = np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _keys(s: Settings, n: int):
    weights = 1 << np.arange(s.hashes - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = [np.array(x, "<f4") for x in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in flat])
            for dim in np.unique(sizes).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([s.seed, dim]).standard_normal((dim, n * s.hashes))
                at = np.flatnonzero(sizes == dim)
                rows = [flat[i].tobytes() for i in at]
                v, vecs = unit(rows), pa.array(rows, pa.binary())
                rids, w = (batch.column(i).take(pa.array(at)) for i in (0, 1))
                for p in range(n):
                    key = (v @ planes[dim][:, p * s.hashes : (p + 1) * s.hashes] > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(key), rids, w, vecs], ["pass", "dim", "key", "rid", "w", "vec"])

    return run


def _near(v: np.ndarray, s: Settings, since: int = 0, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j <= i + window, j >= since, whose cosine reaches the threshold; v: unit rows in order."""
    first, second = [], []
    for at in range(max(0, since - s.window), len(v), step):
        cos = v[at : at + step] @ v[at : at + step + s.window].T
        i, j = np.nonzero(cos >= s.cosine)
        ok = (j > i) & (j - i <= s.window) & (j + at >= since)
        first.append(i[ok] + at)
        second.append(j[ok] + at)
    return np.concatenate(first), np.concatenate(second)


def _needed(i: np.ndarray, j: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j) in order, those that are kept, and whether each marks a vector whose window may be too short.

    Vectors in a pair that ends a window are marked and counted exactly later, so a pair of two of them only has to
    keep them connected. It is left out if i's first partner k makes a pair with j too, as (i, k) is kept and (k, j),
    a shorter pair, is kept or left out for the same reason.
    """
    if not ends.any():
        return i, j, ends
    n = int(j.max()) + 1
    marked = np.zeros(n, bool)
    marked[i[ends]] = marked[j[ends]] = True
    begin = np.r_[True, i[1:] != i[:-1]]
    first = j[begin][np.cumsum(begin) - 1]
    implied = (j != first) & marked[i] & marked[j] & np.isin(first * n + j, i * n + j)
    i, j = i[~implied], j[~implied]
    return i, j, marked[i] | marked[j]


#: Links (part null) and border rows (b null) of the passes.
OUT = "a long, b long, wa long, wb long, full boolean, part int, at long, place long, vec binary"
NAMES = [x.split()[0] for x in OUT.split(", ")]
TYPES = [pa.int64()] * 4 + [pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def _links(rid: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
    low = rid[i] < rid[j]
    a, b = np.where(low, i, j), np.where(low, j, i)
    columns = [pa.array(rid[a]), pa.array(rid[b]), pa.array(w[a]), pa.array(w[b]), pa.array(full)]
    return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(i), t) for t in TYPES[5:]]], NAMES)


def _windows(s: Settings):
    """Rows come by pass, dimension and key; the last `window` rows of a batch are carried to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), 0, None

        def border(place, rid, w, vec, begin: int) -> pa.RecordBatch:
            n = len(rid)
            columns = [pa.array(rid), pa.nulls(n, pa.int64()), pa.array(w), *[pa.nulls(n, t) for t in TYPES[3:5]], pa.array(np.full(n, part, np.int32)), pa.array(np.arange(begin, begin + n)), pa.array(place), pa.array(vec, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            rid, w, vec = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_pylist()
            if seen < s.window:
                n = s.window - seen
                yield border(place[:n], rid[:n], w[:n], vec[:n], seen)
            old = 0
            if held:
                old = len(held[1])
                place, rid, w, vec = np.concatenate([held[0], place]), np.concatenate([held[1], rid]), np.concatenate([held[2], w]), held[3] + vec
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for begin, end in zip(cuts, cuts[1:]):
                if end > old:
                    i, j = _near(unit(vec[begin:end]), s, max(0, old - begin))
                    yield _links(rid[begin:end], w[begin:end], *_needed(i, j, j - i == s.window))
            seen += len(rid) - old
            held = place[-s.window :], rid[-s.window :], w[-s.window :], vec[-s.window :]
        if seen > s.window:
            n = min(s.window, seen - s.window)
            yield border(*[x[-n:] for x in held], seen - n)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows that come ordered by column, one table for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and held[-1].column(column)[0].as_py() != batch.column(column)[a].as_py():
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _across(s: Settings):
    """Pairs of border rows of different partitions; rows come by block and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, "block"):
            rank, part, place, rid, w = (t[c].to_numpy() for c in ("rank", "part", "place", "rid", "w"))
            vec, own = t["vec"].to_pylist(), rank // s.block == t["block"][0].as_py()
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for begin, end in zip(cuts, cuts[1:]):
                i, j = (x + begin for x in _near(unit(vec[begin:end]), s))
                ok = own[i] & (part[i] != part[j]) & (rank[j] - rank[i] <= s.window)
                i, j = i[ok], j[ok]
                yield _links(rid, w, *_needed(i, j, rank[j] - rank[i] == s.window))

    return run


def _counted(s: Settings):
    """Exact counts of the links between two blocks of a component, but for those that the angles settle; rows come by pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, "pair"):
            rid, w, ring, asks, size = (t[c].to_numpy() for c in ("rid", "w", "ring", "asks", "size"))
            vec = [np.array(x, "<f4").tobytes() for x in t["vec"].to_pylist()]
            for n in np.unique(size):
                one, two = np.flatnonzero((size == n) & asks), np.flatnonzero((size == n) & ~asks)
                if len(one) and len(two):
                    hit = unit([vec[i] for i in one]) @ unit([vec[i] for i in two]).T >= s.cosine
                    hit &= (rid[one][:, None] != rid[two]) & (ring[one][:, None] + ring[two] > s.sure)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[one]), pa.array((hit @ w[two]).astype(np.int64))], ["rid", "n"])

    return run


def _ringed(members: DataFrame, tables: Tables, s: Settings) -> DataFrame:
    """members with the ring each lies in: its angle to its component's centre, in steps of s.step.

    A centre is the mean of some members' directions; any would do, as the bounds hold for each. Beside
    a centre of length zero all members are in one ring, which settles nothing.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, x: n + x.cast("double") * x))
    some = members.filter((F.col("rid") == F.col("root")) | (F.pmod(F.xxhash64("rid"), F.col("size")) < s.sample))
    parts = some.select("root", "size", norm(F.col("vec")).alias("norm"), F.posexplode("vec").alias("pos", "x"))
    means = parts.groupBy("root", "pos").agg(F.max("size").alias("size"), F.avg(F.col("x") / F.col("norm")).alias("x"))
    centres = means.groupBy("root").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "x"))).getField("x").alias("centre"))
    beside = heavy_join(members.drop("size"), tables.keep(centres), "root", "size")
    dot = F.aggregate(F.zip_with("vec", "centre", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda n, x: n + x)
    cos = F.try_divide(dot, norm(F.col("vec")) * norm(F.col("centre")))
    ring = F.floor(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))) / s.step)
    return tables.keep(beside.withColumn("ring", F.coalesce(ring, F.lit(s.sure + 1).cast("long"))).drop("centre"))


def _exact(members: DataFrame, tables: Tables, s: Settings) -> DataFrame:
    """(rid, exact) of the full ones of members(root, rid, w, full, vec, size): the weight of their links in the component.

    Angles to a centre bound those between members: two whose rings sum to at most `sure` are linked, two whose
    rings differ by more than `far` aren't. The first are counted from the rings' weights. Only what neither
    settles is compared, zone by zone of rings, in blocks.
    """
    ringed = _ringed(members, tables, s)
    zone = F.when(F.col("size") > s.block, F.expr(f"ring div {s.zone}")).otherwise(0).cast("long")
    placed = ringed.withColumn("zone", zone)
    rings = placed.groupBy("root", "size", "zone", "ring").agg(F.sum("w").alias("w"), F.count("*").alias("m"), F.count_if("full").alias("f"))
    zones = rings.groupBy("root", "size", "zone").agg(F.min("ring").alias("low"), F.max("ring").alias("high"), F.sum("m").alias("m"), F.sum("f").alias("f"), F.collect_list(F.struct("ring", "w")).alias("rings"))
    zones = tables.keep(zones.groupBy("root", "size").agg(F.collect_list(F.struct("zone", "low", "high", "m", "f", "rings")).alias("zones")))
    placed = tables.keep(heavy_join(placed.drop("size"), zones, "root", "size"))

    near = lambda z: F.filter(z["rings"], lambda r: r["ring"] + F.col("ring") <= s.sure)
    weight = F.aggregate("zones", F.lit(0).cast("long"), lambda n, z: n + F.aggregate(near(z), F.lit(0).cast("long"), lambda k, r: k + r["w"]))
    itself = F.when(2 * F.col("ring") <= s.sure, F.col("w")).otherwise(0)
    settled = placed.filter("full").select("rid", (weight - itself).alias("n"))

    ring, blocks = F.col("ring"), lambda n: F.ceil(n / s.block).cast("long")
    open_ = lambda z: (ring + z["high"] > s.sure) & (z["low"] - ring <= s.far) & (ring - z["high"] <= s.far)
    own = F.element_at(F.filter("zones", lambda z: z["zone"] == F.col("zone")), 1)

    def dealt(rows: DataFrame, asks: bool) -> DataFrame:
        """rows once for each block of members they are to meet; a block is (zone, number)."""
        mine, other = ("f", "m") if asks else ("m", "f")
        met = rows.withColumn("z", F.explode(F.filter("zones", lambda z: (z[other] > 0) & open_(z))))
        met = met.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col(f"z.{other}")) - 1)))
        me, they = F.concat_ws(":", "zone", F.pmod(F.xxhash64("rid"), blocks(own[mine]))), F.concat_ws(":", "z.zone", "theirs")
        pair = F.concat_ws("/", F.col("root").cast("string"), *((me, they) if asks else (they, me)))
        return met.select(pair.alias("pair"), "rid", "w", "ring", "vec", F.lit(asks).alias("asks"), F.size("vec").alias("size"))

    both = dealt(placed.filter("full"), True).union(dealt(placed, False))
    compared = both.repartition("pair").sortWithinPartitions("pair", "rid").mapInArrow(_counted(s), "rid long, n long")
    return settled.union(compared).groupBy("rid").agg(F.sum("n").alias("exact"))


def links(reps: DataFrame, tables: Tables, s: Settings) -> DataFrame:
    """Distinct links (a, b, wa, wb, full) of reps(rid, w, _v); full: the window of an end may be too short.

    Of links between two such ends only those that connect them are sure to be here.
    """
    spark = reps.sparkSession
    keyed = reps.select("rid", "w", "_v").mapInArrow(_keys(s, passes(reps.count(), s)), "pass int, dim int, key long, rid long, w long, vec binary")
    order = ["pass", "dim", "key", "rid"]
    passed = tables.keep(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_windows(s), OUT))
    borders, begins, total = passed.filter("b is null"), [], 0
    for part, n in sorted(borders.groupBy("part").agg(F.max("at") + 1).collect()):  # a number for each partition
        begins.append((part, total))
        total += n
    begins = spark.createDataFrame(begins, "part int, begin long")
    rank = F.col("begin") + F.col("at")
    block = F.expr(f"rank div {s.block}")
    halo = (F.col("rank") % s.block < s.window) & (block > 0)
    ranked = borders.join(F.broadcast(begins), "part").select("part", "place", F.col("a").alias("rid"), F.col("wa").alias("w"), "vec", rank.alias("rank"))
    dealt = ranked.withColumn("block", F.explode(F.when(halo, F.array(block, block - 1)).otherwise(F.array(block))))
    across = dealt.repartition("block").sortWithinPartitions("block", "rank").mapInArrow(_across(s), OUT)
    every = passed.filter("b is not null").union(across)
    return tables.keep(every.groupBy("a", "b", "wa", "wb").agg(F.max("full").alias("full")))


def dedup(vectors: DataFrame, s: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row of vectors."""
    spark = ship(vectors.sparkSession)
    tables = Tables(spark, "vectors")
    v = F.col(vector).cast("array<float>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.when(sound, v).alias("_v"))
    reps = rows.filter("_v is not null").groupBy("_v").agg(F.min("_id").alias("first"), F.count("*").alias("w"))
    reps = tables.keep(reps.withColumn("rid", F.monotonically_increasing_id()))
    found = links(reps, tables, s)

    roots = tables.keep(components(spark, found, tables))
    ends = found.select(F.col("a").alias("rid"), F.col("wb").alias("n"), "full").union(found.select("b", "wa", "full"))
    counts = tables.keep(ends.groupBy("rid").agg(F.sum("n").alias("n"), F.max("full").alias("full")))
    linked = roots.withColumnRenamed("id", "rid").join(counts, "rid").join(reps.select("rid", "first", "w"), "rid")
    linked = tables.keep(linked)
    whole = linked.groupBy("root").agg(F.count("*").alias("size"), F.count_if("full").alias("fulls"), F.min("first").alias("low"))
    linked = tables.keep(heavy_join(linked, tables.keep(whole), "root", "size"))
    counts = linked.select("rid", "n", "low")
    if not linked.filter("full").isEmpty():
        members = linked.filter("fulls > 0").join(reps.select("rid", F.col("_v").alias("vec")), "rid")
        exact = _exact(tables.keep(members.select("root", "rid", "w", "full", "vec", "size")), tables, s)
        counts = linked.join(exact, "rid", "left").select("rid", F.coalesce("exact", "n").alias("n"), "low")
    reps = reps.join(counts, "rid", "left")
    reps = tables.keep(reps.select("_v", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("low", "first").alias("component_id")))
    out = heavy_join(rows.filter("_v is not null"), reps, "_v", "w").select("_id", "n_links", "component_id")
    alone = rows.filter("_v is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    kept = F.col("_id").eqNullSafe(F.col("component_id"))
    return out.union(alone).select(F.col("_id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", kept.alias("kept"))
