"""Incremental ingest: snapshot diffs, the detection change feed, and the same over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.mutations import only_prefix, without_prefix

#: The columns that make a detection what it is; a change in one of them makes it dirty.
IDENTITY = ["kind", "label", "confidence", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "persona_id", "encoding", "signature", "source_frame_token", "captured_at", "pipeline_revision"]


def snapshot_diff(current: DataFrame, known: DataFrame, key: str = "id", signature: str = "file_signature", revision: str | None = None) -> DataFrame:
    """(key, action): added, removed, changed, reanalyse (an older pipeline revision only) or unchanged."""
    cols = [key, signature, *([revision] if revision else [])]
    a = current.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = known.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    both = a.join(b, F.col(f"a_{key}") == F.col(f"b_{key}"), "full_outer")
    same = F.col(f"a_{signature}").eqNullSafe(F.col(f"b_{signature}"))
    action = F.when(F.col(f"b_{key}").isNull(), "added").when(F.col(f"a_{key}").isNull(), "removed").when(~same, "changed")
    if revision:
        action = action.when(~F.col(f"a_{revision}").eqNullSafe(F.col(f"b_{revision}")), "reanalyse")
    return both.select(F.coalesce(f"a_{key}", f"b_{key}").alias(key), action.otherwise("unchanged").alias("action"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """One row: added, updated, removed, unchanged."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return diff.agg(n("added").alias("added"), n("changed", "reanalyse").alias("updated"), n("removed").alias("removed"), n("unchanged").alias("unchanged"))


def reanalysis_mode(recorded: Column, current: str, content_changed: Column) -> Column:
    """full for new content, human_faces_only where only the face pipeline is older, else none."""
    return F.when(content_changed, "full").when(~F.coalesce(recorded, F.lit("")).eqNullSafe(F.lit(current)), "human_faces_only").otherwise("none")


def refresh_faces(old_detections: Column, new_faces: Column, old_tags: Column, new_tags: Column, old_meta: Column, new_meta: Column) -> tuple[Column, Column, Column]:
    """A partial recompute: faces, the tags face and person, and human_face_* metadata are replaced, the rest stays."""
    detections = F.concat(F.filter(old_detections, lambda d: d["kind"] != "face"), F.filter(new_faces, lambda d: d["kind"] == "face"))
    tags = F.array_sort(F.array_distinct(F.concat(F.filter(old_tags, lambda t: ~t.isin("face", "person")), F.filter(new_tags, lambda t: t.isin("face", "person")))))
    return detections, tags, F.map_concat(without_prefix(old_meta, "human_face_"), only_prefix(new_meta, "human_face_"))


def detection_feed(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """new rows with their dirty flags: unchanged ones keep flag and revision, changed and new ones are dirty.
    Rows only in old are gone. A null persona and an empty one are the same."""
    norm = lambda side: F.struct(*[F.coalesce(F.nullif(F.col(f"{side}.{c}"), F.lit("")), F.lit("")) .alias(c) if c == "persona_id" else F.col(f"{side}.{c}").alias(c) for c in IDENTITY])
    j = new.alias("n").join(old.alias("o"), (F.col("n.item_id") == F.col("o.item_id")) & (F.col("n.detection_id") == F.col("o.detection_id")), "left")
    same = F.col("o.item_id").isNotNull() & norm("n").eqNullSafe(norm("o"))
    out = [F.col(f"n.{c}") for c in new.columns if c not in ("cluster_dirty", "cluster_dirty_revision", "updated_at")]
    return j.select(
        *out, F.when(same, F.col("o.cluster_dirty")).otherwise(F.lit(True)).alias("cluster_dirty"), F.when(same, F.col("o.cluster_dirty_revision")).otherwise(F.lit(now)).alias("cluster_dirty_revision"),
        F.when(same, F.col("o.updated_at")).otherwise(F.lit(now)).alias("updated_at"),
    )


def mark_clean(detections: DataFrame, rows: DataFrame, revision: str) -> DataFrame:
    """The given rows' dirty flags cleared at a revision."""
    hit = detections.join(rows.select("item_id", "detection_id").distinct().withColumn("_hit", F.lit(True)), ["item_id", "detection_id"], "left")
    return hit.withColumn("cluster_dirty", F.col("cluster_dirty") & F.col("_hit").isNull()).withColumn("cluster_dirty_revision", F.when(F.col("_hit"), F.lit(revision)).otherwise(F.col("cluster_dirty_revision"))).select(*detections.columns)


def mark_stable(clusters: DataFrame, kind: str, revision: str) -> DataFrame:
    own = F.col("kind") == kind
    return clusters.withColumn("is_partial", F.when(own, F.lit(False)).otherwise(F.col("is_partial"))).withColumn("revision", F.when(own, F.lit(revision)).otherwise(F.col("revision")))


def keep_assignments(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Before a batch of items is saved: personas that users have set in the store meanwhile are united in."""
    now = stored.select("id", F.col("manual_persona_ids").alias("_m"))
    return batch.join(now, "id", "left").withColumn("manual_persona_ids", F.array_union("manual_persona_ids", F.coalesce("_m", F.expr("cast(array() as array<string>)")))).select(*batch.columns)


def batch_size(scan: int = 8, analysis: int = 24) -> int:
    """Items a micro-batch holds."""
    return max(scan, min(analysis, 32))


def upserted_parts(spark, target: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each part of an upsert target, from finished batches (below `before`, if given)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda path: [str(f.getPath().getName()) for f in fs.listStatus(path)]
    versions = sorted(int(n[2:]) for n in (listed(at) if fs.exists(at) else []) if n.startswith("v=") and n[2:].isdigit())
    out: dict[int, str] = {}
    for v in versions:
        names = listed(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}"))
        if "_SUCCESS" in names and (before is None or v < before):
            out |= {int(n[len("_part=") :]): f"{target}/v={v}/{n}" for n in names if n.startswith("_part=")}
    return out


def read_upserts(spark, target: str, schema) -> DataFrame:
    """The rows an upsert target holds now."""
    paths = list(upserted_parts(spark, target).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_upserts(stream: DataFrame, target: str, key: str, order: str, checkpoint: str, parts: int = 16):
    """Structured Streaming twin of upsert: each micro-batch's newest row a key replaces what the target holds.

    The target is in parts by a hash of the key. A batch writes the folder `v=<batch id>` with the parts its keys
    lie in, and these alone are read and written; a batch that is run again writes the same folder, one that
    stops leaves no mark of success and is not read. `read_upserts` gives the rows. Returns the started query
    (available-now trigger).
    """
    from pyspark.sql import Window

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy(key).orderBy(F.col(order).desc())
        new = batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").persist()
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        touched = {r[0] for r in new.select(part).distinct().collect()}  # at most one row a part
        old = [at for k, at in upserted_parts(spark, target, batch_id).items() if k in touched]
        rows = new
        if old:
            rows = spark.read.schema(batch.schema).parquet(*old).join(new.select(key), key, "left_anti").select(*batch.columns).unionByName(new)
        rows.withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(f"{target}/v={batch_id}")
        new.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: counts and sums by event-time window and type, with a watermark; batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
