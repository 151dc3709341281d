"""The folder that driver and executors share, where tables between steps lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_MADE: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset: a temporary folder of a local session, an error on a cluster, whose
    executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="anchorcurve-"))
    return _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of it, which goes when the driver ends."""
    own = f"{shared_root(spark)}/anchorcurve-{spark.sparkContext.applicationId}"
    if own not in _MADE:
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _MADE.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._anchorcurve_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame that cut() made, once nothing needs it."""
    path = getattr(df, "_anchorcurve_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
