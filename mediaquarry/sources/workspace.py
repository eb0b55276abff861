"""Intermediate tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session takes a temporary folder and a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="mq-work-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bounds the Arrow batches that Python workers hold, in bytes, for the rest of the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    size = int(now[:-1]) * {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[now[-1].lower()] if now[-1].isalpha() else int(now)
    if size <= 0 or size > mb << 20:
        spark.conf.set(key, f"{mb}m")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again with its schema. The files go when the session ends, since a
    result may still be read from them."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/mq-work-{label}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(at.toString())
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(at.toString())
