"""Merkle fixity audit of WARC replicas (operator 1).

Each record is hashed. Records of a file are gathered by ordered ranges of offsets, the leaves of the file's tree:
a leaf's digest covers the offset, length and digest of its records in order. Each node above covers `fanout`
children, and the replica's root covers its files' roots, in a tree of their own. Two replicas are compared at the
root; only the children of nodes that differ are compared next, so sound branches are never opened, down to the
records of differing leaves.

All levels are DataFrames of (file, node, digest), a group of at most `fanout` children a node; the digests are
written once, and the descent joins levels that shrink by the fan-out.

Defined results: a null content is an empty record; a record in one replica only is missing or extra; records that
share file and offset are compared as a sorted list, so repeated rows match repeated rows; a null file name is a
file of its own; further columns are ignored; two empty replicas are equal and give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Tables, heavy_join, ship

#: A WARC response record without dates, so that it is a function of its page; the last two lines end the record.
HEADER = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/html\r\nContent-Length: {length}\r\n\r\n"
TAIL = "\r\n\r\n"
#: Levels of a tree over 64-bit positions can't exceed this.
MOST_LEVELS = 16


@dataclass(frozen=True)
class Shape:
    range_bytes: int = 1 << 18
    fanout: int = 16
    pages_per_file: int = 512
    most: int = 4096  # different records of a file, about


def record(uri: Column, content: Column) -> Column:
    content = F.coalesce(content, F.lit(""))
    a, rest = HEADER.split("{uri}")
    b, c = rest.split("{length}")
    return F.concat(F.lit(a), F.coalesce(uri, F.lit("")), F.lit(b), F.octet_length(content).cast("string"), F.lit(c), content, F.lit(TAIL))


def write_records(pages: DataFrame, shape: Shape = Shape(), key: str = "page_id", url: str = "url", content: str = "html", replica: str | None = None) -> DataFrame:
    """pages as WARC records (key, file, offset, length, sha256): files by ranges of the key, offsets by key.

    A column replica of contents that have the same lengths gives a further digest, `replica`, of the record at the
    same place. Offsets are running sums inside a file; only lengths and digests are sorted, not contents. Equal
    records are folded before and unfolded after, so a page that repeats without bound costs the window one row;
    pages without a key are dealt to files by their URLs. A range of keys with more than `most` different records, as
    a key with many contents makes, is dealt to numbered files by digests.
    """
    tables = Tables(pages.sparkSession, "records")
    bodies = {"sha256": record(F.col(url), F.col(content))} | ({"replica": record(F.col(url), F.col(replica))} if replica else {})
    number = F.lpad(F.expr(f"`{key}` div {shape.pages_per_file}").cast("string"), 8, "0")
    name = F.when(F.col(key).isNull(), F.concat(F.lit("null-"), F.substring(F.sha2(F.coalesce(F.col(url), F.lit("")), 256), 1, 3))).otherwise(number)
    rows = pages.select(F.col(key).cast("long").alias(key), F.concat(F.lit("part-"), name).alias("file"), F.octet_length(bodies["sha256"]).cast("long").alias("length"), *[F.sha2(c, 256).alias(n) for n, c in bodies.items()])
    order = [key, "length", *bodies]
    folded = tables.keep(rows.groupBy("file", *order).agg(F.count("*").alias("m")))
    large = tables.keep(folded.groupBy("file").agg(F.count("*").alias("size")).filter(F.col("size") > shape.most))
    dealt = heavy_join(folded, large, "file", "size")
    piece = F.pmod(F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long"), F.ceil(F.col("size") / shape.most))
    dealt = dealt.withColumn("file", F.concat("file", F.coalesce(F.concat(F.lit("-"), piece.cast("string")), F.lit("")), F.lit(".warc")))
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begun = dealt.withColumn("begin", F.coalesce(F.sum(F.col("length") * F.col("m")).over(before), F.lit(0)))
    each = begun.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return each.select(key, "file", "length", *bodies, (F.col("begin") + F.col("nth") * F.col("length")).cast("long").alias("offset"))


def split(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of a WARC file, plain or with a gzip member a record (bytes then unpacked)."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            unpack, out, end = zlib.decompressobj(31), [], at
            while not unpack.eof and end < len(data):
                out.append(unpack.decompress(view[end : end + 65536]))
                end = min(len(data), end + 65536)
            whole, end = b"".join(out), end - len(unpack.unused_data)
        else:
            head = data.index(b"\r\n\r\n", at)
            size = re.search(rb"(?im)^content-length:\s*(\d+)", data[at:head])
            end = head + 4 + (int(size[1]) if size else 0) + len(TAIL)
            whole = data[at:end]
        yield at, whole
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, sha256, record) of every record of the WARC files under path; a file is a task's work."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, whole in split(data.as_py()):
                    row = [name], [at], [len(whole)], [hashlib.sha256(whole).hexdigest()], [whole]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["file", "offset", "length", "sha256", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1), "content").mapInArrow(run, "file string, offset long, length long, sha256 string, record binary")


def _joined(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(items)).getField("d"), "\n"), 256)


def leaves(records: DataFrame, shape: Shape) -> DataFrame:
    """(file, node, digest) of the offset ranges of each file. A range holds few records, each of some bytes."""
    text = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha256")
    item = F.struct(F.col("offset").alias("o"), text.alias("d"))
    return records.groupBy("file", F.expr(f"offset div {shape.range_bytes}").alias("node")).agg(_joined(item).alias("digest"))


def parents(nodes: DataFrame, shape: Shape) -> DataFrame:
    item = F.struct(F.col("node").alias("o"), F.concat_ws(":", F.col("node").cast("string"), "digest").alias("d"))
    return nodes.groupBy("file", F.expr(f"node div {shape.fanout}").alias("node")).agg(_joined(item).alias("digest"))


def tree(records: DataFrame, shape: Shape, tables: Tables) -> list[DataFrame]:
    """Levels from a file's leaves up to one node a file, then over the files' roots up to one node in all."""
    levels = [tables.keep(leaves(records, shape))]
    while levels[-1].agg(F.max("node")).first()[0] and len(levels) < MOST_LEVELS:
        levels.append(tables.keep(parents(levels[-1], shape)))
    return levels


def file_tree(roots: DataFrame, depth: int, tables: Tables) -> list[DataFrame]:
    """The tree over the files' roots, from the replica's root down: (prefix, digest), each prefix of the names' hashes."""
    name = F.coalesce("file", F.lit(""))
    item = F.struct(F.sha2(name, 256).alias("o"), F.concat_ws(":", name, "digest").alias("d"))
    levels = [tables.keep(roots.groupBy(F.substring(F.sha2(name, 256), 1, depth).alias("prefix")).agg(_joined(item).alias("digest")))]
    for d in range(depth - 1, -1, -1):
        item = F.struct(F.col("prefix").alias("o"), F.concat_ws(":", "prefix", "digest").alias("d"))
        levels.append(tables.keep(levels[-1].groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(_joined(item).alias("digest"))))
    return levels[::-1]


def _differs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    one, two = a.select(*keys, F.col("digest").alias("_a")), b.select(*keys, F.col("digest").alias("_b"))
    on = [one[k].eqNullSafe(two[k]) for k in keys]
    both = one.join(two, on, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*[F.coalesce(one[k], two[k]).alias(k) for k in keys])


def _under(df: DataFrame, bad: DataFrame, node: Column) -> DataFrame:
    """Rows of df whose parent node is in bad."""
    bad = bad.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    return df.join(bad, df["file"].eqNullSafe(bad["_f"]) & (node == bad["_n"]), "left_semi")


def audit(primary: DataFrame, replica: DataFrame, shape: Shape = Shape(), key: str = "page_id") -> DataFrame:
    """(key, file, offset, length, sha256, status) of every record: ok, corrupt, missing (in replica) or extra."""
    spark = primary.sparkSession
    tables = Tables(spark, "warc")
    columns = [key, "file", "offset", "length", "sha256"]
    a, b = tables.keep(primary.select(columns)), tables.keep(replica.select(columns))
    up_a, up_b = tree(a, shape, tables), tree(b, shape, tables)
    while len(up_a) < len(up_b):
        up_a.append(tables.keep(parents(up_a[-1], shape)))
    while len(up_b) < len(up_a):
        up_b.append(tables.keep(parents(up_b[-1], shape)))
    # From the replicas' roots down to files, 16 branches a node, then down each differing file's levels.
    files = max(1, up_a[-1].count(), up_b[-1].count())
    depth = math.ceil(math.log(files, 16)) if files > 16 else 1
    bad = None
    for d, (x, y) in enumerate(zip(file_tree(up_a[-1], depth, tables), file_tree(up_b[-1], depth, tables))):
        if bad is not None:
            x, y = (g.join(bad.select(F.col("prefix").alias("_p")), F.substring("prefix", 1, d - 1) == F.col("_p"), "left_semi") for g in (x, y))
        bad = tables.keep(_differs(x, y, ["prefix"]))
        if bad.isEmpty():
            return a.withColumn("status", F.lit("ok"))
    name = F.substring(F.sha2(F.coalesce("file", F.lit("")), 256), 1, depth)
    x, y = (t.join(bad, name == F.col("prefix"), "left_semi") for t in (up_a[-1], up_b[-1]))
    bad = tables.keep(_differs(x, y, ["file", "node"]))
    for x, y in list(zip(up_a, up_b))[-2::-1]:
        parent = F.expr(f"node div {shape.fanout}")
        bad = tables.keep(_differs(_under(x, bad, parent), _under(y, bad, parent), ["file", "node"]))
    leaf = F.expr(f"offset div {shape.range_bytes}")

    def opened(df: DataFrame) -> DataFrame:
        """Records of differing leaves; those that share a place are numbered in order."""
        place = Window.partitionBy("file", "offset").orderBy("sha256", "length", key)
        return _under(df, bad, leaf).withColumn("nth", F.row_number().over(place))

    one, two = opened(a), opened(b)
    one, two = one.select(*[F.col(c).alias(f"a_{c}") for c in [*columns, "nth"]]), two.select(*[F.col(c).alias(f"b_{c}") for c in [*columns, "nth"]])
    on = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in ("file", "offset", "nth")]
    same = F.col("a_sha256").eqNullSafe(F.col("b_sha256")) & F.col("a_length").eqNullSafe(F.col("b_length"))
    status = F.when(F.col("b_nth").isNull(), "missing").when(F.col("a_nth").isNull(), "extra").when(same, "ok").otherwise("corrupt")
    found = one.join(two, on, "full_outer").select(*[F.when(F.col("a_nth").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in columns], status.alias("status"))
    shut = bad.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    sound = a.join(shut, a["file"].eqNullSafe(shut["_f"]) & (leaf == shut["_n"]), "left_anti").withColumn("status", F.lit("ok"))
    return sound.unionByName(found)
