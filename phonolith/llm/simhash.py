"""SimHash near-dedup by a Gray-order hierarchical index (operator 10).

Fingerprints are made in Arrow batches. Exact repeats of a fingerprint are folded into one row first, so copies
cost nothing later. Two fingerprints that differ in at most d bits agree wholly on one of d + 1 bit segments:
the top nodes of the index are these shared masked patterns (segment, value), and Spark deals the fingerprints
to them. A top node with more than `leafy` fingerprints is split again by the segments of its free bits, until
it is small or so few bits are free that it must be; so no node is unbounded, and no link is lost. Inside a top
node the fingerprints are sorted by Gray rank; runs of neighbours form nodes that hold the bits all members
share, level by level. A search descends from the root adding up the differences on each node's newly shared
bits and drops a whole node once they exceed d. A top node emits a link from each fingerprint to its local
component, not all pairs.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated doc_ids give a
row each; a null doc_id is never a component's smallest unless all are null; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Tables, components, heavy_join, ship

SHINGLE, SEED, BITS = 3, 42, 2
LEAF, FANOUT, LEAFY = 32, 8, 4096
#: Shingles counted at once, and texts turned into Python objects at once: bounds of a task's memory.
STEP, ROWS = 65536, 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 of word shingles, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest as hashed

    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    sizes = [min(STEP, n - at) for at in range(0, n, STEP)]
    return majority((np.fromiter((hashed(next(shingles), SEED) for _ in range(size)), np.uint64, size) for size in sizes), n)


def majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The bits that more than half of n hashes, which come in arrays, have set, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for h in hashes:
        for at in range(0, len(h), STEP):
            counts += np.unpackbits(h[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                prints = [fingerprint(t or b"", shingle) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return run


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, as a long that sorts so."""
    rank = fp
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(fixed: int, bits: int = BITS) -> list[int]:
    """The free bits of a mask, cut into bits + 1 runs, each joined to the fixed bits."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cuts = [len(free) * k // (bits + 1) for k in range(bits + 2)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _tree(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the root down: where each node's children begin, the bits they share, and their pattern."""
    ones, zeros, starts, levels = fps, ~fps, np.arange(0, len(fps), LEAF), []
    while True:
        ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
        levels.append((starts, ones | zeros, ones))
        if len(starts) == 1:
            return levels[::-1]
        starts = np.arange(0, len(starts), FANOUT)


def _children(nodes: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node its place in nodes, repeated, and its children."""
    ends = np.append(starts[1:], total)
    sizes = ends[nodes] - starts[nodes]
    owner = np.repeat(np.arange(len(nodes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[nodes], sizes)


def linked(fps: np.ndarray, bits: int, step: int = 256) -> np.ndarray:
    """Index of the smallest fingerprint that each reaches by links of at most bits differing bits.

    fps: distinct uint64 in Gray order. step: searches that run at once.
    """
    levels, label = _tree(fps), np.arange(len(fps))
    below = [(shared, pattern) for _, shared, pattern in levels[1:]] + [(np.full(len(fps), ~np.uint64(0)), fps)]
    found_a, found_b = [], []
    for at in range(0, len(fps), step):
        query = np.arange(at, min(at + step, len(fps)))
        node = np.zeros(len(query), np.int64)
        diff = np.bitwise_count((fps[query] ^ levels[0][2][0]) & levels[0][1][0]).astype(np.int64)
        query, node, diff = query[diff <= bits], node[diff <= bits], diff[diff <= bits]
        for (starts, shared, _), (shared_below, pattern) in zip(levels, below):
            owner, child = _children(node, starts, len(pattern))
            new = shared_below[child] & ~shared[node[owner]]
            query, diff = query[owner], diff[owner] + np.bitwise_count((fps[query[owner]] ^ pattern[child]) & new)
            keep = diff <= bits
            query, node, diff = query[keep], child[keep], diff[keep]
        later = node > query
        found_a.append(query[later])
        found_b.append(node[later])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _search(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by top node and Gray rank; a node that a batch cuts is carried to the next one."""
        carry = None

        def links(node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((node[1:] != node[:-1]).any(1)) + 1
            begins, ends = np.append(0, cut), np.append(cut, len(fps))
            a, b = [], []
            for i in np.flatnonzero(ends - begins > 1):
                own = fps[begins[i] : ends[i]]
                label = linked(own.view(np.uint64), bits)
                moved = label != np.arange(len(own))
                a.append(own[moved])
                b.append(own[label[moved]])
            whole = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([whole(a), whole(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, value, fps = (batch.column(i).to_numpy() for i in range(3))
            node = np.stack([mask, value], 1)
            if carry is not None:
                node, fps = np.concatenate([carry[0], node]), np.concatenate([carry[1], fps])
            last = np.flatnonzero((node != node[-1]).any(1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links(node[:cut], fps[:cut])
            carry = node[cut:], fps[cut:]
        if carry is not None and len(carry[1]):
            yield links(*carry)

    return run


def links(prints: DataFrame, tables: Tables, bits: int = BITS, leafy: int = LEAFY) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` of prints whenever they differ in at most bits."""
    level, masks, out = prints.select(F.lit(0).cast("long").alias("mask"), "fp"), [0], None
    while True:
        cut = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in segments(m, bits)]))])
        routed = level.select(F.explode(cut[F.col("mask")]).alias("mask"), "fp")
        routed = routed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        big = tables.keep(routed.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > leafy).select("mask", "value"))
        full = {r["mask"] for r in big.select("mask").distinct().collect()}  # at most 3 ** depth masks
        # With few free bits a node can't hold more than leafy fingerprints, whatever they are.
        masks = sorted({s for m in masks for s in segments(m, bits) if _signed(s) in full and 64 - s.bit_count() >= leafy.bit_length()})
        if not masks:
            out = routed if out is None else out.union(routed)
            break
        hot = big.filter(F.col("mask").isin([_signed(m) for m in masks]))
        rest = routed.join(hot, ["mask", "value"], "left_anti")
        out = rest if out is None else out.union(rest)
        level = tables.keep(routed.join(hot, ["mask", "value"], "left_semi").select("mask", "fp"))
    ordered = out.withColumn("rank", gray_rank(F.col("fp"))).repartition("mask", "value").sortWithinPartitions("mask", "value", "rank")
    return ordered.select("mask", "value", "fp").mapInArrow(_search(bits), "a long, b long")


def dedup(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, leafy: int = LEAFY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    spark = ship(docs.sparkSession)
    tables = Tables(spark, "simhash")
    marked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")
    marked = tables.keep(marked)
    prints = tables.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("w")))
    found = tables.keep(links(prints, tables, bits, leafy).distinct())
    roots = components(spark, found, tables)
    firsts = roots.join(prints.select(F.col("fp").alias("id"), "first"), "id").groupBy("root").agg(F.min("first").alias("component"))
    moved = roots.join(firsts, "root").select(F.col("id").alias("fp"), "component")
    prints = tables.keep(prints.join(moved, "fp", "left").select("fp", "w", F.coalesce("component", "first").alias("component_id")))
    return heavy_join(marked, prints, "fp", "w").select(F.col("doc_id").alias(key), "fp", "component_id")


def firsts(rows: DataFrame, group: DataFrame, key: str, text: str) -> DataFrame:
    """Of rows(_row, _rid) one of each component of group(_rid, component_id), as its own columns.

    Hashing the kept numbers, some bytes each and an even share of them a task, lets the texts stream by; a
    sort-merge join would sort the texts.
    """
    order = rows.select("_rid", F.struct(F.col(f"_row.{key}").isNull(), F.col(f"_row.{key}"), F.xxhash64(f"_row.{text}"), F.col("_rid").alias("rid")).alias("_order"))
    first = group.select("_rid", "component_id").join(order, "_rid").groupBy("component_id").agg(F.min("_order").alias("f"))
    return rows.join(first.select(F.col("f.rid").alias("_rid")).hint("shuffle_hash"), "_rid", "left_semi").select("_row.*")


def keep_one(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest key, nulls last; of rows that share it, one by a hash.

    Rows get a number of their own, so repeated keys don't mix. Only numbers, keys and hashes are grouped; a text
    moves once, to meet the verdict on its row.
    """
    tables = Tables(docs.sparkSession, "simhash-rows")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
    rows = tables.keep(rows)
    group = dedup(rows.select("_rid", F.col(f"_row.{text}").alias("_text")), bits, shingle, key="_rid", text="_text")
    return firsts(rows, group, key, text)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
