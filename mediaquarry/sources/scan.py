"""Scanning files into assets: extension filter, live photos, signatures, capture dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import guessed_date
from ..functions.media import extension, media_kind
from ..functions.text import stable_id, tag_set, title_from_stem


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, mtime_ns) of all files below root; contents are never read. Times are in milliseconds there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    relative = F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(base), F.lit(""))
    return files.select(relative.alias("path"), F.col("length").alias("size_bytes"), (F.unix_millis("modificationTime") * 1_000_000).alias("mtime_ns"))


def signature(files: Column) -> Column:
    """SHA-1 over path, size and time of the files in path order, without separators. files: array of (path, size, mtime)."""
    return F.sha1(F.array_join(F.transform(F.array_sort(files), lambda f: F.concat(f["path"], f["size_bytes"].cast("string"), f["mtime_ns"].cast("string"))), "").cast("binary"))


def build_assets(files: DataFrame) -> DataFrame:
    """files (path relative to the root, size_bytes, mtime_ns) to one row an asset.

    Files of one folder and stem that hold an image and a video are one live photo, everything else in the
    group included; other files are assets of their own.
    """
    f = files.withColumn("media_kind", media_kind("path")).filter("media_kind is not null")
    f = f.withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))
    file = F.struct("path", "size_bytes", "mtime_ns", "media_kind")
    g = f.groupBy("stem").agg(F.array_sort(F.collect_list(file)).alias("files"))
    has = lambda kind: F.exists("files", lambda x: x["media_kind"] == kind)
    live = has("image") & has("video")
    assets = g.select("stem", live.alias("live"), F.explode(F.when(live, F.array("files")).otherwise(F.transform("files", lambda x: F.array(x)))).alias("files"))
    shown = F.when(F.col("live"), F.filter("files", lambda x: x["media_kind"] == "image")[0]).otherwise(F.col("files")[0])
    a = assets.withColumn("shown", shown).withColumn("relative_key", F.when(F.col("live"), F.col("stem")).otherwise(F.col("shown.path")))
    modified = (F.array_max(F.col("files.mtime_ns")) / F.lit(1e9)).cast("double")
    out = a.select(
        stable_id("relative_key").alias("id"), F.col("shown.path").alias("path"), F.col("files.path").alias("component_paths"), "relative_key",
        title_from_stem(F.regexp_extract("stem", r"([^/]+)$", 1)).alias("title"), F.when(F.col("live"), F.lit("live_photo")).otherwise(F.col("shown.media_kind")).alias("media_kind"),
        extension("shown.path").alias("extension"), signature(F.col("files")).alias("file_signature"), F.aggregate("files", F.lit(0).cast("long"), lambda s, x: s + x["size_bytes"]).alias("size_bytes"), modified.alias("modified_ts"),
    )
    return out.withColumn("captured_at", guessed_date("relative_key", "modified_ts")).withColumn("tags", tag_set("media_kind", F.expr("cast(array() as array<string>)"), "relative_key"))
