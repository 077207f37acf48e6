"""Near-dedup by the Jaccard similarity of word shingles (the pipeline's near_dedup stage).

Texts with the same set of shingles are folded first, so exact copies cost nothing later. Operator 10's Gray-order
index then links what its fingerprints, here of these shingles, show to be close; this connects most copies at
little cost. Its radius is too small for all pairs of similarity 0.8, whose fingerprints differ in about ten bits, so
MinHash bands find the rest: two texts meet in a bucket when one of `bands` groups of `rows` minima agrees, which at
similarity J has probability 1 - (1 - J ** rows) ** bands: 0.9996 at 0.8 and more above. A pair that meets is a
candidate if sketches of two bits for each of `minima` minima differ in no more places than pairs at the threshold do
(3.2 standard deviations above their mean: 0.9993 of them). Every link, the index's too, is verified on the whole
shingle sets, so nothing below the threshold is linked.

In a bucket each text is compared with one hub first, and again with other hubs while the bucket holds several
components; what then still lies in different components is compared pair by pair, block against block, so a bucket
of any size is many small groups. So a large group of copies costs a link each, and no pair of a bucket is left out.

Defined results: null and blank texts are copies of each other; a text shorter than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import simhash
from .common import Tables, components, heavy_join, ship


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    jaccard: float = 0.8
    bands: int = 20
    rows: int = 5
    minima: int = 512
    hubs: int = 2
    block: int = 512  # texts of a bucket that meet in a task at last
    seed: int = 42


#: Shingles whose minima are taken at once, texts turned into Python objects at once, and shingle sets remembered.
STEP, ROWS, HELD = 1024, 256, 64
#: Counts are whole numbers; products of them with the threshold are not.
SLACK = 1e-6
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of the columns, in order."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = (out ^ c) * MIX
        out ^= out >> np.uint64(29)
    return out


def shingles(text: bytes, size: int) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted."""
    from xxhash import xxh64_intdigest as hashed

    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h, size = np.fromiter(map(hashed, words), np.uint64, len(words)), min(size, len(words))
    return np.unique(mixed([h[i : len(h) - size + 1 + i] for i in range(size)]))


def _minima(found: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mul), ~np.uint64(0))
    for at in range(0, len(found), STEP):
        np.minimum(low, (found[at : at + STEP, None] * mul + add).min(0), out=low)
    return low


def _bands(low: np.ndarray, s: Settings) -> np.ndarray:
    grid = low[: s.bands * s.rows].reshape(s.bands, s.rows)
    return mixed([np.arange(s.bands, dtype=np.uint64), *grid.T]).view(np.int64)


def _sketch(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 minima a word."""
    bits = (low * MIX >> np.uint64(62)).reshape(-1, 32)
    return (bits << np.arange(0, 64, 2, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def alike(a: Column, b: Column, s: Settings) -> Column:
    """Whether two sketches differ in no more places than those of pairs at the threshold."""
    p = 0.75 * (1 - s.jaccard)
    most = int(s.minima * p + 3.2 * (s.minima * p * (1 - p)) ** 0.5)
    other = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    places = F.transform(other, lambda x: F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))))
    return F.aggregate(places, F.lit(0), lambda n, x: n + x) <= most


def _signatures(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        rng = np.random.default_rng(s.seed)
        mul, plus = rng.integers(0, 1 << 64, (2, s.minima), np.uint64)
        mul |= np.uint64(1)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = []
                for t in batch.column(1).cast(pa.binary()).to_pylist():
                    found = shingles(t or b"", s.shingle)
                    low = _minima(found, mul, plus)
                    rows.append((xxh3_128_digest(found.tobytes()), len(found), simhash.majority([found], len(found)), *([_bands(low, s), _sketch(low)] if len(found) else [[], []])))
                types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], ["rid", "whole", "n", "fp", "bands", "sketch"])

    return run


def _verified(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def sets(rid: int, text: bytes) -> np.ndarray:
            if rid not in held:
                if len(held) >= HELD:
                    del held[next(iter(held))]
                held[rid] = shingles(text, s.shingle)
            return held[rid]

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                a, b, one, two = (whole.slice(at, ROWS).column(i) for i in range(4))
                hit = []
                for i, t, j, u in zip(a.to_pylist(), one.cast(pa.binary()).to_pylist(), b.to_pylist(), two.cast(pa.binary()).to_pylist()):
                    x, y = shingles(t, s.shingle), sets(j, u)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    hit.append(both >= s.jaccard * (len(x) + len(y) - both) - SLACK)
                keep = pa.array(hit, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def _close(reps: DataFrame, tables: Tables) -> DataFrame:
    """Pairs (a, b) of reps(rid, fp) that operator 10's index links, a star for each fingerprint and component."""
    prints = tables.keep(reps.groupBy("fp").agg(F.min("rid").alias("rid")))
    same = reps.join(prints.withColumnRenamed("rid", "b"), "fp").select(F.col("rid").alias("a"), "b")
    one, two = (prints.select(F.col("fp").alias(c), F.col("rid").alias(f"r{c}")) for c in "ab")
    near = simhash.links(prints, tables).distinct().join(one, "a").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return same.union(near).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _met_hubs(bucketed: DataFrame, turn: int) -> DataFrame:
    """bucketed(value, rid, n, c, sketch, bands, m) with one hub of each bucket; hubs of the largest buckets are broadcast."""
    order = F.struct(F.xxhash64("rid", F.lit(turn)), "rid", "n", "c", "sketch", "bands")
    hubs = bucketed.groupBy("value").agg(F.min(order).alias("h"), F.count("*").alias("size"))
    names = {"rid": "o", "n": "on", "c": "oc", "sketch": "os", "bands": "ob"}
    return heavy_join(bucketed, hubs.select("value", "size", *[F.col(f"h.{c}").alias(o) for c, o in names.items()]), "value", "size")


def _met_all(bucketed: DataFrame, s: Settings) -> DataFrame:
    """Pairs (rid > o) of each bucket of m texts, each in the first bucket that both share.

    Texts of a bucket are dealt to blocks, and each pair of blocks is a group of its own.
    """
    blocks = F.ceil(F.col("m") / s.block).cast("long")
    own = bucketed.withColumn("own", F.pmod(F.xxhash64("rid"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    own = own.withColumns({"x": F.least("own", "with"), "y": F.greatest("own", "with")}).drop("m", "with")
    names = {"rid": "o", "n": "on", "c": "oc", "sketch": "os", "bands": "ob", "own": "oown"}
    others = own.select("value", "x", "y", *[F.col(c).alias(o) for c, o in names.items()])
    shares = F.zip_with("bands", "ob", lambda x, y: x == y)
    once = (F.col("rid") > F.col("o")) & (F.get("bands", F.array_position(shares, True).cast("int") - 1) == F.col("value"))
    here = (F.col("x") == F.col("y")) | (F.col("own") != F.col("oown"))
    return own.join(others, ["value", "x", "y"]).filter(here & once)


def links(texts: DataFrame, reps: DataFrame, tables: Tables, s: Settings) -> DataFrame:
    """Links (a, b) that connect the numbers of reps(rid, n, fp, bands, sketch) that are similar; texts(rid, text)."""
    spark = texts.sparkSession
    buckets = reps.select("rid", F.explode("bands").alias("value"))
    shared = buckets.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1")
    mixed_up = tables.keep(buckets.join(shared, "value"))
    close = tables.keep(_close(reps, tables))
    met = tables.keep(mixed_up.select("rid").union(close.select("a")).union(close.select("b")).distinct())
    # Only texts that meet another one are read again.
    texts = tables.keep(texts.join(met.hint("shuffle_hash"), "rid", "left_semi"))
    mixed_up = tables.keep(mixed_up.join(reps.select("rid", "n", "sketch", "bands"), "rid").withColumn("c", F.col("rid")))
    tried, found = None, None
    for turn in range(s.hubs + 1):
        last = turn == s.hubs
        near = F.least("n", "on") >= F.lit(s.jaccard) * F.greatest("n", "on") - F.lit(SLACK)  # or it can't be similar
        pairs = _met_all(mixed_up, s) if last else _met_hubs(mixed_up, turn)
        pairs = pairs.filter((F.col("c") != F.col("oc")) & near & alike(F.col("sketch"), F.col("os"), s))
        pairs = pairs.select(F.greatest("rid", "o").alias("a"), F.least("rid", "o").alias("b"))
        pairs = tables.keep(pairs.union(close).distinct() if tried is None else pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        one, two = (texts.select(F.col("rid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = one.join(pairs.hint("shuffle_hash"), "a").join(two, "b").select("a", "b", "text_a", "text_b")
        new = tables.keep(both.mapInArrow(_verified(s), "a long, b long"))
        found = new if found is None else found.union(new)
        if last:
            return found
        roots = tables.keep(components(spark, found, tables))
        now = mixed_up.drop("c", "m").join(roots.select(F.col("id").alias("rid"), "root"), "rid", "left")
        now = now.select("value", "rid", "n", "sketch", "bands", F.coalesce("root", "rid").alias("c"))
        several = now.groupBy("value").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m")).filter("x <> y").select("value", "m")
        mixed_up = tables.keep(now.join(several, "value"))
        tables.free()
        if mixed_up.isEmpty():
            return found


def keep_one(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of similar texts: that of the smallest key, nulls last; of rows that share it, one by a hash."""
    spark = ship(docs.sparkSession)
    tables = Tables(spark, "jaccard")
    rows = tables.keep(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_rid")))
    texts = rows.select(F.col("_rid").alias("rid"), F.col(f"_row.{text}").alias("text"))
    signed = tables.keep(texts.mapInArrow(_signatures(s), "rid long, whole binary, n long, fp long, bands array<long>, sketch array<long>"))
    wholes = tables.keep(signed.groupBy("whole").agg(F.min("rid").alias("rid"), F.count("*").alias("w")))
    reps = tables.keep(signed.join(wholes.select("rid"), "rid", "left_semi").drop("whole"))
    roots = components(spark, links(texts, reps, tables, s), tables)
    grouped = wholes.join(roots.withColumnRenamed("id", "rid"), "rid", "left")
    grouped = tables.keep(grouped.select("whole", "w", F.coalesce("root", "rid").alias("component_id")))
    group = heavy_join(signed.select(F.col("rid").alias("_rid"), "whole"), grouped, "whole", "w")
    return simhash.firsts(rows, group, key, text)
