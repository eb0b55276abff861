"""Changes to a library. Every function takes tables and returns the changed ones: Parquet is written anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_pet, stable_id
from .detect import distinct_references
from .distinct import first_encodings, learned_encodings
from .relations import EMPTY, can_own, detections_of, unassigned

#: Colours of personas in order of creation; they repeat.
COLORS = ("#0D3B66", "#3A7D44", "#A23B72", "#B56576", "#33658A", "#6D597A", "#5E6472")


def upsert(base: DataFrame, delta: DataFrame, key: list[str] | str = "id") -> DataFrame:
    """Rows of delta replace those of base with the same key; new ones are added. Doing it twice changes nothing."""
    keys = [key] if isinstance(key, str) else key
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def remove(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def replace_kind(base: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """All rows of one kind replaced."""
    return base.filter(F.col("kind") != kind).unionByName(new, allowMissingColumns=True)


def replace_clusters(clusters: DataFrame, members: DataFrame, new: DataFrame, new_members: DataFrame, detections: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Clusters of a kind replaced; memberships need an unassigned detection, clusters need members."""
    kept = members.join(clusters.filter(F.col("kind") != kind).select("cluster_id"), "cluster_id", "left_semi")
    live = new_members.join(detections.filter(unassigned()).select("item_id", "detection_id"), ["item_id", "detection_id"], "left_semi")
    out = kept.unionByName(live.select(*kept.columns))
    return replace_kind(clusters, new, kind).join(out.select("cluster_id"), "cluster_id", "left_semi"), out


def create_persona(personas: DataFrame, name: str, kind: str, now: str) -> DataFrame:
    """personas with the new one; a persona of that name (any case) and kind is kept as it is."""
    name = name.strip()
    if not name:
        raise ValueError("a persona needs a name")
    count = personas.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.lower("name") == name.lower()) & (F.col("kind") == kind)).alias("same"))
    new = count.filter("same = 0").select(
        stable_id(F.lit(f"persona:{kind}:{name.lower()}:{now}")).alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(now).alias("created_at"), F.array(*[F.lit(c) for c in COLORS])[(F.col("n") % len(COLORS)).cast("int")].alias("color")
    )
    return personas.unionByName(new, allowMissingColumns=True)


def assign_regions(detections: DataFrame, regions: DataFrame, persona_id: str, persona_kind: str, reassign: bool = False) -> DataFrame:
    """detections with the persona set on the regions (item_id, detection_id) it can own."""
    hit = detections.join(regions.select("item_id", "detection_id").distinct().withColumn("_hit", F.lit(True)), ["item_id", "detection_id"], "left")
    ok = F.coalesce("_hit", F.lit(False)) & can_own(F.lit(persona_kind), F.col("kind"), F.col("label")) & (F.lit(reassign) | unassigned())
    return hit.withColumn("persona_id", F.when(ok, F.lit(persona_id)).otherwise(F.col("persona_id"))).select(*detections.columns)


def with_whole_cluster(regions: DataFrame, members: DataFrame) -> DataFrame:
    """regions and everything in their clusters."""
    own = members.join(regions.select("item_id", "detection_id"), ["item_id", "detection_id"], "left_semi").select("cluster_id").distinct()
    return regions.select("item_id", "detection_id").unionByName(members.join(own, "cluster_id", "left_semi").select("item_id", "detection_id")).distinct()


def assign_region(detections: DataFrame, members: DataFrame, region: DataFrame, persona_id: str, persona_kind: str) -> DataFrame:
    """One region and its whole cluster, others' assignments included."""
    return assign_regions(detections, with_whole_cluster(region, members), persona_id, persona_kind, reassign=True)


def assign_clusters(detections: DataFrame, clusters: DataFrame, members: DataFrame, cluster_ids: list[str], persona_id: str, persona_kind: str) -> DataFrame:
    """Members of clusters of one kind; regions that others own stay."""
    own = clusters.filter(F.col("cluster_id").isin(*cluster_ids))
    kinds = {r[0] for r in own.select("kind").distinct().limit(2).collect()}
    if kinds != {persona_kind}:
        raise ValueError("clusters must be of the persona's kind")
    return assign_regions(detections, members.join(own.select("cluster_id"), "cluster_id", "left_semi"), persona_id, persona_kind)


def _by_item(regions: DataFrame) -> DataFrame:
    return regions.groupBy(F.col("item_id").alias("id")).agg(F.collect_set("detection_id").alias("_own"))


def assign_in_items(items: DataFrame, regions: DataFrame, persona_id: str, persona_kind: str, reassign: bool = False) -> DataFrame:
    """The items among whose detections some regions (item_id, detection_id) take the persona, changed."""
    fits = lambda d: F.array_contains("_own", d["id"]) & can_own(F.lit(persona_kind), d["kind"], d["label"]) & (F.lit(reassign) | F.coalesce(d["persona_id"], F.lit("")).isin("", persona_id))
    hit = items.join(_by_item(regions), "id").filter(F.exists("detections", fits))
    return hit.withColumn("detections", F.transform("detections", lambda d: F.when(fits(d), d.withField("persona_id", F.lit(persona_id))).otherwise(d))).select(*items.columns)


def clear_in_items(items: DataFrame, regions: DataFrame) -> DataFrame:
    """The items of the regions, without personas on these."""
    hit = items.join(_by_item(regions), "id")
    bare = lambda d: F.when(F.array_contains("_own", d["id"]), d.withField("persona_id", F.lit(None).cast("string"))).otherwise(d)
    return hit.withColumn("detections", F.transform("detections", bare)).select(*items.columns)


def learn(personas: DataFrame, persona_id: str, persona_kind: str, taught: DataFrame, by: tuple[str, ...] = ("item_id", "id"), first: bool = False) -> DataFrame:
    """personas after one has been assigned detections (item_id, detection fields as in an item's list).

    Of those it can own, in order of item and detection (`by`), a vector is learnt if its cosine to all references
    is below 0.985, a hash if it is new. The first item becomes the avatar where there is none. With `first` a vector
    must also be that far from those before it that were not learnt.
    """
    own = taught.filter(can_own(F.lit(persona_kind), F.col("kind"), F.col("label")))
    order = Window.partitionBy("persona_id").orderBy(*by)
    new = own.filter(F.coalesce(F.size("encoding"), F.lit(0)) > 0).select(F.lit(persona_id).alias("persona_id"), "item_id", "id", "encoding")
    since = 1 << 40  # below are the places of what is known
    new = new.withColumn("seq", F.row_number().over(order).cast("long") + since)
    me = F.col("id") == persona_id
    known = personas.filter(me).select(F.col("id").alias("persona_id"), F.posexplode("reference_encodings").alias("pos", "encoding"))
    rows = known.select("persona_id", F.col("pos").cast("long").alias("seq"), "encoding").unionByName(new.select("persona_id", "seq", "encoding"))
    fits = first_encodings(rows).filter(F.col("first") | (F.col("seq") < since)) if first else learned_encodings(rows, since=since).filter("kept")
    vectors = rows.join(fits.select("persona_id", "seq"), ["persona_id", "seq"]).groupBy("persona_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "encoding"))), lambda x: x["encoding"]).alias("_v"))
    hashes = own.filter(F.coalesce("signature", F.lit("")) != "").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "id", "signature"))), lambda x: x["signature"])).alias("_h"))
    avatar = taught.agg(F.min("item_id").alias("_a"))
    extra = hashes.crossJoin(avatar).join(vectors, F.lit(True), "left").withColumn("_p", F.lit(persona_id))  # one row
    out = personas.join(extra.select("_p", "_v", "_h", "_a"), F.col("id") == F.col("_p"), "left")
    out = out.withColumns({
        "reference_encodings": F.when(me, F.coalesce("_v", "reference_encodings")).otherwise(F.col("reference_encodings")),
        "reference_signatures": F.when(me, F.array_union("reference_signatures", F.coalesce("_h", F.expr(EMPTY)))).otherwise(F.col("reference_signatures")),
        "avatar_item_id": F.when(me & (F.coalesce("avatar_item_id", F.lit("")) == ""), F.col("_a")).otherwise(F.col("avatar_item_id")),
    })
    return out.select(*personas.columns)


def dedupe_references(personas: DataFrame, items: DataFrame) -> DataFrame:
    """personas whose reference images, oldest first, have a path of their own and stem from detections that
    differ from those of all images kept before; images whose detection is gone stay."""
    each = personas.select(F.col("id").alias("persona_id"), F.explode("reference_images").alias("r")).filter("r.path <> ''")
    each = each.groupBy("persona_id", "r.path").agg(F.min_by("r", "r.created_at").alias("r"))
    each = each.withColumn("seq", F.row_number().over(Window.partitionBy("persona_id").orderBy("r.created_at", "path")))
    source = detections_of(items).select(F.col("item_id").alias("_i"), F.col("id").alias("_d"), "encoding", "signature")
    found = each.join(source, (F.col("r.source_item_id") == F.col("_i")) & (F.col("r.source_region_id") == F.col("_d")), "left")
    kept = distinct_references(found.filter("_d is not null").select("persona_id", "seq", "encoding", "signature")).filter("kept").select("persona_id", "seq")
    kept = kept.unionByName(found.filter("_d is null").select("persona_id", "seq"))
    left = each.join(kept, ["persona_id", "seq"]).groupBy("persona_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "r"))), lambda x: x["r"]).alias("_r"))
    out = personas.join(left, F.col("id") == F.col("persona_id"), "left")
    none = F.array().cast(personas.schema["reference_images"].dataType)
    return out.withColumn("reference_images", F.coalesce("_r", none)).select(*personas.columns)


def clear_regions(detections: DataFrame, regions: DataFrame) -> DataFrame:
    hit = detections.join(regions.select("item_id", "detection_id").distinct().withColumn("_hit", F.lit(True)), ["item_id", "detection_id"], "left")
    return hit.withColumn("persona_id", F.when(F.col("_hit").isNull(), F.col("persona_id"))).select(*detections.columns)


def clear_items(items: DataFrame, detections: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items and their detections without personas."""
    own = F.col("id").isin(*ids)
    bare = F.transform("detections", lambda d: d.withField("persona_id", F.lit(None).cast("string")))
    items = items.withColumn("manual_persona_ids", F.when(own, F.expr(EMPTY)).otherwise(F.col("manual_persona_ids"))).withColumn("detections", F.when(own, bare).otherwise(F.col("detections")))
    return items, detections.withColumn("persona_id", F.when(~F.col("item_id").isin(*ids), F.col("persona_id")))


def assign_item(items: DataFrame, item_id: str, persona_id: str) -> DataFrame:
    """The persona added by hand to an item."""
    return items.withColumn("manual_persona_ids", F.when(F.col("id") == item_id, F.array_union("manual_persona_ids", F.array(F.lit(persona_id)))).otherwise(F.col("manual_persona_ids")))


def learnable_of_item(detections: DataFrame, item_id: str, persona_kind: str) -> DataFrame:
    """Detections an item assignment may teach: the face of an item with exactly one, or all pets."""
    own = detections.filter(F.col("item_id") == item_id)
    if persona_kind == "pet":
        return own.filter(is_pet("kind", "label"))
    faces = own.filter(F.col("kind") == "face")
    one = faces.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("item_id")
    return faces.join(one, "item_id", "left_semi")


def create_album(albums: DataFrame, items: DataFrame, name: str, item_ids: list[str], now: str, description: str = "") -> DataFrame:
    spark = albums.sparkSession
    new = spark.createDataFrame([(name, now, description, "", [])], "name string, created_at string, description string, query string, item_ids array<string>")
    new = new.withColumn("id", stable_id(F.concat(F.lit("album:"), "name", F.lit(":"), "created_at")))
    return add_to_album(albums.unionByName(new.select(*albums.columns)), items, None, item_ids, F.col("id") == new.select("id").first()[0])


def add_to_album(albums: DataFrame, items: DataFrame, album_id: str | None, item_ids: list[str], which: Column | None = None) -> DataFrame:
    """Known ids that are not in the album yet are appended in order; other albums stay."""
    which = which if which is not None else F.col("id") == album_id
    want = list(dict.fromkeys(i for i in item_ids if i))
    known = {r[0] for r in items.filter(F.col("id").isin(*want)).select("id").collect()} if want else set()  # at most the ids asked for
    add = F.array(*[F.lit(i) for i in want if i in known]).cast("array<string>")
    return albums.withColumn("item_ids", F.when(which, F.concat("item_ids", F.array_except(add, "item_ids"))).otherwise(F.col("item_ids")))


def delete_album(albums: DataFrame, album_id: str) -> DataFrame:
    return albums.filter(F.col("id") != album_id)


def toggle_favorite(items: DataFrame, ids: DataFrame) -> DataFrame:
    """All given items become favourites, or none if all were."""
    hit = items.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    every = hit.filter("_hit").agg(F.coalesce(F.bool_and("favorite"), F.lit(False)).alias("_all"))
    out = hit.crossJoin(F.broadcast(every))  # one row
    return out.withColumn("favorite", F.when(F.col("_hit"), ~F.col("_all")).otherwise(F.col("favorite"))).select(*items.columns)


def merge_maps(left: Column, right: Column) -> Column:
    """Two maps as one; the right one's values win."""
    keys = F.map_keys(right)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(keys, k)), right)


def without_prefix(m: Column, prefix: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.startswith(prefix))


def only_prefix(m: Column, prefix: str) -> Column:
    return F.map_filter(m, lambda k, v: k.startswith(prefix))
