"""Session helpers: a tuned builder for local runs and shipping this package to executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for any deployment: adaptive plans decide partition counts and split skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session on this machine. On a cluster pass SETTINGS to your own builder."""
    conf = SETTINGS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions or cpus)}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("phonolith").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, so that its Python functions import there."""
    sc = spark.sparkContext
    if getattr(sc, "_phonolith", None) is None:
        root = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="phonolith-")) / "phonolith.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(str(path))
        sc._phonolith = str(path)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own on a single machine where it is unset (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="phonolith-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def end() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have ended before; the folder is the cluster's to clean then
            return

    atexit.register(end)
    return path
