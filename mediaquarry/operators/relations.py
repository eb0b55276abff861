"""Derived relations: inverted tables, exploded detections, cluster views, pruning, map points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_pet, search_blob
from ..functions.vectors import padded_box

EMPTY = "cast(array() as array<string>)"


def persona_ids(manual="manual_persona_ids", detections="detections") -> Column:
    """Sorted distinct persona ids of an item, set by hand or by a detection."""
    found = F.filter(F.transform(F.coalesce(F.col(detections)["persona_id"], F.expr(EMPTY)), lambda p: F.nullif(p, F.lit(""))), lambda p: p.isNotNull())
    return F.array_sort(F.array_union(F.coalesce(F.col(manual), F.expr(EMPTY)), found))


def item_personas(items: DataFrame) -> DataFrame:
    own = items.select("id", persona_ids().alias("own"))  # on its own, so that files are read for these fields only
    return own.select(F.col("id").alias("item_id"), F.explode("own").alias("persona_id"))


def item_tags(items: DataFrame) -> DataFrame:
    """Distinct lower-case tags without empty ones."""
    tags = F.array_distinct(F.filter(F.transform("tags", F.lower), lambda t: t != ""))
    return items.select(F.col("id").alias("item_id"), F.explode(tags).alias("tag"))


def item_search(items: DataFrame, personas: DataFrame) -> DataFrame:
    """One blob of searchable text an item; persona names in the order of their ids."""
    own = items.select("id", persona_ids().alias("own"))
    names = own.select(F.col("id").alias("item_id"), F.posexplode("own").alias("pos", "persona_id")).join(personas.select(F.col("id").alias("persona_id"), "name"), "persona_id")
    names = names.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("names"))
    out = items.join(names, items.id == names.item_id, "left")
    blob = search_blob("title", "relative_key", "media_kind", "tags", F.coalesce("names", F.expr(EMPTY)), F.coalesce(F.col("detections")["label"], F.expr(EMPTY)), "metadata", "notes")
    return out.select(F.col("id").alias("item_id"), blob.alias("search_blob"))


def pipeline_revision(kind: Column, metadata: Column) -> Column:
    """The models a detection came from: faces, pets (two models joined by |) and objects differ."""
    at = lambda key: F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(""))
    pets = F.concat_ws("|", F.nullif(at("pet_face_model"), F.lit("")), F.nullif(at("pet_embedding_model"), F.lit("")))
    return F.when(kind == "face", at("human_face_pipeline")).when(kind.startswith("pet"), pets).otherwise(at("object_model"))


def detection_rows(items: DataFrame, now: str) -> DataFrame:
    """A row for each detection of each item, all of them dirty."""
    d = items.select("id", "captured_at", "metadata", F.explode("detections").alias("d"))
    box = padded_box("d.bbox")
    return d.select(
        F.col("id").alias("item_id"), F.col("d.id").alias("detection_id"), "d.kind", "d.label", "d.confidence", *[box[i].alias(f"bbox_{c}") for i, c in enumerate("xywh")],
        F.nullif("d.persona_id", F.lit("")).alias("persona_id"), F.coalesce("d.encoding", F.expr("cast(array() as array<double>)")).alias("encoding"), F.coalesce("d.signature", F.lit("")).alias("signature"),
        F.lit("").alias("source_frame_token"), "captured_at", pipeline_revision(F.col("d.kind"), F.col("metadata")).alias("pipeline_revision"),
        F.lit(True).alias("cluster_dirty"), F.lit(now).alias("cluster_dirty_revision"), F.lit(now).alias("updated_at"),
    )


def unassigned() -> Column:
    return F.coalesce("persona_id", F.lit("")) == ""


def cluster_candidates(detections: DataFrame, kind: str) -> DataFrame:
    """Unassigned detections of a kind with a vector or a hash."""
    own = (F.col("kind") == "face") if kind == "person" else is_pet("kind", "label")
    return detections.filter(unassigned() & own & ((F.coalesce(F.size("encoding"), F.lit(0)) > 0) | (F.coalesce("signature", F.lit("")) != "")))


def can_own(persona_kind, detection_kind, label) -> Column:
    """People own faces, pets own pet detections."""
    return F.when(persona_kind == "person", detection_kind == "face").when(persona_kind == "pet", is_pet(detection_kind, label)).otherwise(F.lit(False))


def cluster_members(clusters: DataFrame, members: DataFrame, detections: DataFrame) -> DataFrame:
    """Clusters with their still unassigned detections, joined three ways."""
    free = detections.filter(unassigned()).select("item_id", "detection_id", "label", "confidence", "captured_at", "encoding", "signature")
    return clusters.select("cluster_id", "kind").join(members, "cluster_id").join(free, ["item_id", "detection_id"])


def live_clusters(clusters: DataFrame, members: DataFrame, detections: DataFrame) -> DataFrame:
    """Clusters that still have members, with counts over the survivors, largest first."""
    alive = members.join(detections.filter(unassigned()).select("item_id", "detection_id"), ["item_id", "detection_id"], "left_semi")
    agg = alive.groupBy("cluster_id").agg(
        F.count_distinct("item_id", "detection_id").cast("int").alias("member_count"), F.count_distinct("item_id").cast("int").alias("item_count"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    return clusters.drop("member_count", "item_count").join(agg, "cluster_id").orderBy(F.col("member_count").desc(), F.col("item_count").desc(), F.col("latest_captured_at").desc(), "cluster_id")


def prune(items: DataFrame, detections: DataFrame, clusters: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cascade of deleted items: detections, memberships and clusters left without members go."""
    detections = detections.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    members = members.join(detections.select("item_id", "detection_id"), ["item_id", "detection_id"], "left_semi")
    return detections, members, clusters.join(members.select("cluster_id"), "cluster_id", "left_semi")


def personas_of_items(items: DataFrame, personas: DataFrame) -> DataFrame:
    """(item_id, names): each item's personas by name, any case."""
    j = item_personas(items).join(personas.select(F.col("id").alias("persona_id"), "name"), "persona_id")
    return j.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("l"), "persona_id", "name"))), lambda s: s["name"]).alias("names"))


def map_points(detections: DataFrame, personas: DataFrame, clusters: DataFrame, members: DataFrame, items: DataFrame, limit: int = 12_000) -> DataFrame:
    """The newest faces with vectors, with persona, else cluster, and item; the limit comes before the joins."""
    d = detections.filter((F.col("kind") == "face") & (F.size("encoding") > 0)).orderBy(F.col("captured_at").desc(), "item_id", "detection_id").limit(limit)
    d = d.select("item_id", "detection_id", "confidence", "encoding", "captured_at", F.nullif("persona_id", F.lit("")).alias("persona_id"))
    d = d.join(personas.select(F.col("id").alias("persona_id"), F.col("name").alias("persona_name"), F.col("color").alias("persona_color")), "persona_id", "left")
    c = members.join(clusters.select("cluster_id", F.col("label").alias("cluster_label")), "cluster_id").groupBy("item_id", "detection_id").agg(F.min(F.struct("cluster_id", "cluster_label")).alias("c"))
    d = d.join(c, ["item_id", "detection_id"], "left").join(items.select(F.col("id").alias("item_id"), F.col("title").alias("item_title"), "thumbnail_path"), "item_id", "left")
    no_persona, blank = F.col("persona_name").isNull(), F.lit("")
    return d.select(
        "item_id", "detection_id", "confidence", "encoding", "captured_at", F.coalesce("persona_id", blank).alias("persona_id"), F.coalesce("persona_name", blank).alias("persona_name"),
        F.coalesce("persona_color", F.lit("#A0A0A0")).alias("color"), F.coalesce(F.when(no_persona, F.col("c.cluster_id")), blank).alias("cluster_id"),
        F.coalesce(F.when(no_persona, F.col("c.cluster_label")), blank).alias("cluster_label"), F.coalesce("item_title", blank).alias("item_title"), F.coalesce("thumbnail_path", blank).alias("thumbnail_path"),
    )


def map_groups(points: DataFrame) -> DataFrame:
    """Points by persona, else cluster, else alone; classes in that order, large groups first."""
    rank = F.when(F.col("persona_id") != "", 0).when(F.col("cluster_id") != "", 1).otherwise(2)
    key = F.when(rank == 0, F.col("persona_id")).when(rank == 1, F.col("cluster_id")).otherwise(F.concat_ws(":", "item_id", "detection_id"))
    label = F.when(rank == 0, F.col("persona_name")).when(rank == 1, F.col("cluster_label")).otherwise(F.lit("face"))
    return points.groupBy(rank.alias("class"), key.alias("group_key"), label.alias("label")).agg(F.count(F.lit(1)).alias("size")).orderBy("class", F.col("size").desc(), "label", "group_key")


def subject_summary(detections="detections") -> Column:
    """'label xN' for faces and pets of an item, most frequent first, ties by label from the end; 'None' without."""
    label = lambda d: F.when(d["kind"] == "face", F.lit("human face")).when(is_pet(d["kind"], d["label"]) | (F.lower(d["label"]) == "pet"), F.lower(d["label"]))
    labels = F.filter(F.transform(detections, label), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(labels), lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), x.alias("label")))
    text = F.transform(F.sort_array(counted, asc=False), lambda s: F.when(s["n"] > 1, F.concat(s["label"], F.lit(" x"), s["n"].cast("string"))).otherwise(s["label"]))
    return F.when(F.size(labels) > 0, F.array_join(text, ", ")).otherwise(F.lit("None"))


def item_details(items: DataFrame, personas: DataFrame) -> DataFrame:
    """(id, details): the text shown for an item; at most 24 tags are listed."""
    d = items.join(personas_of_items(items, personas), items.id == F.col("item_id"), "left")
    join = lambda a: F.coalesce(F.nullif(F.array_join(a, ", "), F.lit("")), F.lit("None"))
    meta = lambda title, key: F.when(F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("")) != "", F.concat(F.lit(f"{title}: "), F.try_element_at("metadata", F.lit(key))))
    duration = F.when(F.coalesce("duration_seconds", F.lit(0.0)) != 0, F.concat(F.format_string("%.1f", F.col("duration_seconds").cast("double")), F.lit("s"))).otherwise("n/a")
    lines = [
        F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Type: "), "media_kind"), F.concat(F.lit("Path: "), "path"), F.concat(F.lit("Captured: "), "captured_at"),
        F.concat(F.lit("Size: "), F.coalesce(F.col("width").cast("string"), F.lit("None")), F.lit(" x "), F.coalesce(F.col("height").cast("string"), F.lit("None"))),
        F.concat(F.lit("Duration: "), duration), F.concat(F.lit("Favorite: "), F.when(F.col("favorite"), "yes").otherwise("no")),
        F.concat(F.lit("Assigned People/Pets: "), join(F.coalesce("names", F.expr(EMPTY)))), F.concat(F.lit("Detected Subjects: "), subject_summary()), F.concat(F.lit("Tags: "), join(F.slice("tags", 1, 24))),
        meta("Video AI frames", "video_ai_frames_analyzed"), meta("Human Face Detector", "human_face_detector_model"), meta("Human Face Recognizer", "human_face_recognizer_model"),
        meta("Human Face Device", "human_face_device"), meta("Human Face Detector Device", "human_face_detector_device"), meta("Human Face Recognizer Device", "human_face_recognizer_device"),
        meta("Object Device", "object_device"), meta("Pet Face Device", "pet_face_device"), meta("Pet Embedding Device", "pet_embedding_device"), meta("Human Face Backend Warning", "human_face_backend_error"),
        F.when(F.size("component_paths") > 1, F.concat(F.lit("Components: "), F.size("component_paths").cast("string"))),
    ]
    return d.select("id", F.concat_ws("\n", *lines).alias("details"))


def references_in_order(personas: DataFrame) -> DataFrame:
    """(id, reference): a persona's reference images, newest first."""
    key = F.transform("reference_images", lambda r: F.struct(r["created_at"].alias("created_at"), r.alias("r")))
    return personas.select("id", F.posexplode(F.transform(F.sort_array(key, asc=False), lambda s: s["r"])).alias("pos", "reference"))


def keep_live_ids(owners: DataFrame, items: DataFrame, column: str = "item_ids") -> DataFrame:
    """Albums or memories without ids of items that are gone; the order stays."""
    each = owners.select("id", F.posexplode(column).alias("pos", "item")).join(items.select(F.col("id").alias("item")), "item", "left_semi")
    kept = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("_kept"))
    return owners.join(kept, "id", "left").withColumn(column, F.coalesce("_kept", F.expr(EMPTY))).drop("_kept").select(*owners.columns)


def keep_live_avatars(personas: DataFrame, items: DataFrame) -> DataFrame:
    """Personas without avatars of items that are gone."""
    live = items.select(F.col("id").alias("avatar_item_id"), F.lit(True).alias("_live"))
    out = personas.join(live, "avatar_item_id", "left").withColumn("avatar_item_id", F.when(F.col("_live"), F.col("avatar_item_id")))
    return out.select(*personas.columns)


def detections_of(items: DataFrame) -> DataFrame:
    """(item_id, pos, detection fields): the items' own lists, a row an entry."""
    return items.select(F.col("id").alias("item_id"), F.posexplode("detections").alias("pos", "d")).select("item_id", "pos", "d.*")


def with_detections(items: DataFrame, rows: DataFrame) -> DataFrame:
    """items with the rows (item_id, pos, detection fields) as their lists."""
    fields = [f.name for f in items.schema["detections"].dataType.elementType.fields]
    kept = rows.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("d")))), lambda s: s["d"]).alias("_d"))
    out = items.join(kept, items.id == kept.item_id, "left")
    kind = items.schema["detections"].dataType
    return out.withColumn("detections", F.coalesce(F.col("_d").cast(kind), F.array().cast(kind))).select(*items.columns)
