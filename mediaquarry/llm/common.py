"""Shared plumbing: the scratch folder all executors see, checked broadcasts, ASCII text rules."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: White space of every contract: \x20 and \x09-\x0D, as one string.
SPACE = " \t\n\x0b\x0c\r"
#: A word is a maximal run of anything else. Java and RE2 both read this form.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A table of at most so many rows and bytes may be broadcast; beyond that joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary
    one; on a cluster executors would not see each other's files there, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        if "root" not in _OWN:
            _OWN["root"] = tempfile.mkdtemp(prefix="mq-shared-")
            atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
        root = f"file://{_OWN['root']}"
    return root.rstrip("/")


_OWN: dict[str, str] = {}


class Scratch:
    """Tables written under the shared root. They cut lineage and survive lost executors.

    Paths are fresh for each object, so concurrent or repeated calls never meet. drop() deletes a
    table that no later step reads; what a result is still read from goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/mq-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df written as Parquet and read again with the schema it had."""
        self._n += 1
        at = f"{self.path}/{name}-{self._n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._mq_at = at
        return out

    def fresh(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{name}-{self._n}"

    def drop(self, *tables: DataFrame | str | None) -> None:
        for t in tables:
            at = t if isinstance(t, str) else getattr(t, "_mq_at", None)
            if at:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _width(field) -> Column:
    """Bytes that a value takes, roughly; nested values count as their JSON text."""
    c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16 if kind in ("array", "map", "struct") else F.lit(16)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and `size` bytes, else as it is (the join
    then shuffles). The input runs for the count as well: give it a written table, or a cheap plan."""
    widths = [_width(f) for f in df.schema.fields]
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(sum(widths[1:], widths[0]).cast("long"))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def fresh_name(taken, base: str) -> str:
    """`base`, with as many underscores before it as it takes to differ from all taken names."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def lean(spark: SparkSession, mb: int = 8) -> None:
    """Bounds the Arrow batches that Python workers hold, in bytes, for the rest of the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    size = int(now[:-1]) * {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[now[-1].lower()] if now[-1].isalpha() else int(now)
    if size <= 0 or size > mb << 20:
        spark.conf.set(key, f"{mb}m")


def tidied(run):
    """An Arrow batch function that gives its memory back when a task ends: workers live on, and what the
    allocators keep would add up over the stages of a long session."""

    def batches_of(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return batches_of


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(c: Column, seed: int) -> Column:
    """Uniform in (0, 1), the same on every engine: the first 52 bits of md5(seed:value)."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def running(df: DataFrame, order: list, weight: Column, scratch: Scratch, name: str) -> DataFrame:
    """df with `_pos` double: the sum of `weight` over all rows before this one in the given order.

    Range partitions are sorted and summed each in its own task; only one total a partition reaches
    the driver. The sorted table is written first, so that both passes see the same partitions.
    """
    import pyarrow as pa

    cols = df.columns
    ranged = df.withColumn("_w", weight.cast("double")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*ranged.schema.fields, StructField("_pid", IntegerType()), StructField("_run", DoubleType())])

    def add(batches):
        import numpy as np
        from pyspark import TaskContext

        pid, total = TaskContext.get().partitionId(), 0.0
        for b in batches:
            w = b.column("_w").to_numpy(zero_copy_only=False)
            run = total + np.cumsum(w) - w
            total += float(w.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(w), pid, dtype=np.int32)), pa.array(run)], names=[*b.schema.names, "_pid", "_run"])

    kept = scratch.write(ranged.mapInArrow(add, schema), name)
    totals = sorted((r[0], r[1]) for r in kept.groupBy("_pid").agg(F.sum("_w")).collect())
    starts, at = {}, 0.0
    for pid, total in totals:
        starts[pid] = at
        at += total
    if not starts:
        return kept.select(*cols, F.col("_run").alias("_pos"))
    begin = df.sparkSession.createDataFrame(list(starts.items()), "_pid int, _begin double")
    return kept.join(F.broadcast(begin), "_pid").select(*cols, (F.col("_begin") + F.col("_run")).alias("_pos"))


def groups(batches, keys: list[str]):
    """Streams (key, Arrow table) from Arrow batches that are sorted by the keys; a group may span batches."""
    import pyarrow as pa

    kept, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        import numpy as np

        cols = [np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:]):
            if s == e:
                continue
            key = tuple(c[s].item() if hasattr(c[s], "item") else c[s] for c in cols)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(b.slice(s, e - s))
    if kept:
        yield last, pa.Table.from_batches(kept)
