"""Shared helpers: table reading, tables that outlive an executor, joins and components that stand skew."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from phonolith.session import ship, table  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own on a single machine where it is unset (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="phonolith-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Intermediate results as Parquet in the shared folder. They cut lineage and survive lost executors.

    Those that a later step replaces are dropped by drop(); the others go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)
        self.free()

    def free(self) -> None:
        """Spark drops shuffle files when the driver's garbage, their last references, is collected; an operator of many steps asks for that."""
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        try:
            drop(self.spark, self.root)
        except Exception:  # the JVM may have ended before; the folder is the cluster's to clean then
            return

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        self.last = f"{self.root}/{self.n}"
        df.write.parquet(self.last)
        return self.spark.read.schema(df.schema).parquet(self.last)

    def drop(self, path: str) -> None:
        drop(self.spark, path)


#: Keys that heavy_join() treats as heavy; bounds what it broadcasts.
HEAVY_KEYS = 512


def heavy_join(left: DataFrame, right: DataFrame, key: str, weight: str, heavy: int = HEAVY_KEYS) -> DataFrame:
    """left LEFT JOIN right on key (null matches null), where few keys may hold most of left's rows.

    right has one row per key, with the number of left's rows in weight. Its `heavy` heaviest keys, a fixed
    number, are broadcast; the rows of all other keys, none of which is heavier, are joined by a shuffle.
    """
    rest = [c for c in right.columns if c != key]
    top = right.orderBy(F.col(weight).desc(), F.col(key)).limit(heavy)
    top = F.broadcast(top.select(F.col(key).alias("_k"), F.struct(*rest).alias("_top")))
    tagged = left.join(top, left[key].eqNullSafe(F.col("_k")), "left").drop("_k")
    found = tagged.filter("_top is not null").select(*left.columns, *[F.col(f"_top.{c}").alias(c) for c in rest])
    others = right.select(F.col(key).alias("_k"), *rest)
    missed = tagged.filter("_top is null").drop("_top")
    missed = missed.join(others, missed[key].eqNullSafe(others["_k"]), "left").select(*left.columns, *rest)
    return found.unionByName(missed)


def components(spark: SparkSession, edges: DataFrame, tables: Tables, rounds: int = 60) -> DataFrame:
    """(id, root) for each id of edges(a, b): root is the smallest id reachable. Ids are comparable, not null.

    Alternates large-star and small-star rounds: each node's neighbours are linked to its smallest
    neighbour, until nothing changes. A node's smallest neighbour is a min() with partial aggregation; its
    neighbours are never gathered, so a hub of any degree costs no task more than its joined rows, which
    adaptive execution splits. Each round's links are a written table.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = tables.keep(links)
    path, before = tables.last, None
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        after = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        links = tables.keep(after.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        tables.drop(path)
        path, now = tables.last, seen.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())
