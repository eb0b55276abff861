"""The library's application interface: what the routes and commands offered, as methods that return DataFrames.

Reading methods return lazy DataFrames with the names the routes use; changing ones save new snapshots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .operators import clusters, detect, memories, mutations, relations, search, similarity
from .schema import conform
from .sources.headers import extract_metadata
from .sources.workspace import written
from .sources.scan import build_assets
from .sources.store import Library
from .streaming.ingest import diff_counts, keep_assignments, mark_clean, mark_stable, refresh_faces, snapshot_diff


def int_param(value: str | None, default: int) -> int:
    """A whole number of at least 1; anything else is the default."""
    try:
        return max(1, int(value)) if value else default
    except ValueError:
        return default


def _named(*names: str) -> list[Column]:
    """Columns in camel case."""
    camel = lambda n: "".join(w.capitalize() if i else w for i, w in enumerate(n.split("_")))
    return [F.col(n).alias(camel(n)) for n in names]


class LibraryApi:
    def __init__(self, library: Library, settings: Settings | None = None):
        self.library, self.settings = library, settings or Settings()

    def t(self, name: str) -> DataFrame:
        return self.library.table(name)

    # reading ----------------------------------------------------------------

    def status(self) -> DataFrame:
        """(name, n): counts of items, personas, people, pets, albums, memories."""
        p = self.t("personas")
        return search.status_counts({"items": self.t("items"), "personas": p, "people": p.filter("kind = 'person'"), "pets": p.filter("kind = 'pet'"), "albums": self.t("albums"), "memories": self.t("memories")})

    def summaries(self, items: DataFrame) -> DataFrame:
        names = relations.personas_of_items(items, self.t("personas")).withColumnRenamed("item_id", "_id")
        j = items.join(names, items.id == F.col("_id"), "left")
        cols = _named("id", "title", "path", "thumbnail_path", "media_kind", "captured_at", "favorite", "width", "height", "duration_seconds", "tags")
        return j.select(*cols, F.coalesce("names", F.expr(relations.EMPTY)).alias("personaNames"))

    def items(self, query: str = "", type: str = "all", personaKind: str = "all", personaId: str = "", favorites: str = "", limit: str | None = None) -> DataFrame:
        kind = lambda v: None if v in ("", "all") else v
        t = self.library.load()
        found = search.search(t["items"], t["item_tags"], t["item_personas"], t["personas"], t["item_search"], query, media_kind=kind(type), favorites=favorites == "1", persona_id=personaId or None, persona_kind=kind(personaKind), limit=int_param(limit, self.settings.page_size), settings=self.settings, item_grams=self.library.grams())
        return self.summaries(found)

    def item(self, item_id: str) -> DataFrame:
        one = self.library.find("items", item_id)
        details = relations.item_details(one, self.t("personas")).withColumnRenamed("id", "_id")
        shown = F.transform("detections", lambda d: F.struct(d["id"].alias("id"), d["kind"].alias("kind"), d["label"].alias("label"), d["confidence"].alias("confidence"), d["bbox"].alias("bbox"), d["persona_id"].alias("personaId")))
        rest = one.select(F.col("id").alias("_r"), *_named("component_paths", "manual_persona_ids", "notes", "metadata"), shown.alias("detections"))
        out = self.summaries(one).join(rest, F.col("id") == F.col("_r")).join(details, F.col("id") == F.col("_id"))
        return out.drop("_r", "_id")

    def personas(self, kind: str = "") -> DataFrame:
        p = self.t("personas")
        p = search.list_personas(p.filter(F.col("kind") == kind) if kind else p)
        avatar = self.t("items").select(F.col("id").alias("_a"), F.col("thumbnail_path").alias("avatarThumbnailPath"))
        j = p.join(avatar, F.col("avatar_item_id") == F.col("_a"), "left")
        return j.select(*_named("id", "name", "kind", "created_at", "color", "avatar_item_id"), F.coalesce("avatarThumbnailPath", F.lit("")).alias("avatarThumbnailPath"), F.size("reference_images").alias("referenceImageCount"))

    def persona_items(self, persona_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self.summaries(search.query_items(self.t("items"), item_personas=self.t("item_personas"), persona_ids=[persona_id], limit=limit, offset=offset))

    def albums(self) -> DataFrame:
        return search.list_albums(self.t("albums")).select(*_named("id", "name", "created_at", "description"), F.size("item_ids").alias("itemCount"))

    def album_items(self, album_id: str) -> DataFrame:
        return self.summaries(search.members(self.library.find("albums", album_id), self.t("items")))

    def memories(self) -> DataFrame:
        return search.list_memories(self.t("memories")).select(*_named("id", "title", "subtitle", "summary", "created_at", "memory_type", "start_date", "end_date"), F.size("item_ids").alias("itemCount"), F.col("persona_ids").alias("personaIds"))

    def memory_items(self, memory_id: str) -> DataFrame:
        return self.summaries(search.members(self.library.find("memories", memory_id), self.t("items")))

    def unknown_clusters(self, kind: str = "") -> DataFrame:
        live = relations.live_clusters(self.t("unknown_clusters"), self.t("unknown_cluster_members"), self.t("detections"))
        live = live.filter(F.col("kind") == kind) if kind else live
        return live.select(F.col("cluster_id").alias("id"), *_named("kind", "label", "member_count", "item_count", "preview_path", "latest_captured_at", "average_confidence"))

    def cluster_items(self, cluster_ids: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
        own = self.t("unknown_cluster_members").filter(F.col("cluster_id").isin(*cluster_ids)).select(F.col("item_id").alias("id")).distinct()
        return self.summaries(search.by_ids_recent(self.t("items"), own, limit, offset))

    def cluster_suggestions(self, cluster_id: str, limit: int = 6) -> DataFrame:
        own = self.t("unknown_cluster_members").filter(F.col("cluster_id") == cluster_id).join(self.t("detections"), ["item_id", "detection_id"])
        kept = clusters.references_of(own)
        kind = (self.t("unknown_clusters").filter(F.col("cluster_id") == cluster_id).select("kind").first() or ["person"])[0]
        return similarity.suggestions(similarity.cluster_scores(kept, self.t("personas"), kind, self.settings), limit)

    def count_detections(self, kind: str = "all", dirty_only: bool = False) -> int:
        """Detections that clusters of a kind may hold, or only those changed since the last clustering."""
        return search.query_detections(self.t("detections"), kind, True if dirty_only else None).count()

    def embedding_map(self, limit: int = 12_000) -> DataFrame:
        t = self.library.load()
        return relations.map_points(t["detections"], t["personas"], t["unknown_clusters"], t["unknown_cluster_members"], t["items"], limit)

    # changing ---------------------------------------------------------------

    def _save(self, now: str, **tables: DataFrame) -> None:
        self.library.save(tables, now)

    def sync(self, files: DataFrame, now: str, analyse: Callable[[DataFrame], DataFrame] | None = None, face_pipeline: str | None = None, batches: int = 1, headers: DataFrame | None = None) -> DataFrame:
        """Files as listed now against the stored items: new and changed assets are saved, missing ones removed,
        in as many saves as `batches`. Returns the counts.

        headers (see sources.headers) give sizes, dates and durations. analyse takes items and returns (id, detections and any other columns of items) of what its models find;
        without it, changed items keep what was found before. Personas are carried over to detections that go
        on from earlier ones, free detections go to personas they match, and what users have set stays. With
        face_pipeline, items that were analysed by another one only have their faces done anew.
        """
        assets, known = build_assets(files), self.t("items")
        if headers is not None:
            assets = extract_metadata(assets, headers)
        recorded = F.coalesce(F.try_element_at("metadata", F.lit("human_face_pipeline")), F.lit(""))
        pipeline = F.lit(face_pipeline) if face_pipeline is not None else F.lit("")
        left = assets.withColumn("_rev", pipeline)
        diff = snapshot_diff(left, known.withColumn("_rev", recorded if face_pipeline is not None else F.lit("")), revision="_rev").persist()
        rows = diff_counts(diff).collect()
        todo = diff.filter(F.col("action").isin("added", "changed", "reanalyse")).withColumn("_batch", F.pmod(F.xxhash64("id"), F.lit(batches)))
        removed = diff.filter("action = 'removed'").select("id")
        for b in range(batches):
            part = todo.filter(F.col("_batch") == b).select("id", "action")
            changed = self._analysed(assets.join(part, "id"), now, analyse)
            self.library.save_items(changed, removed, now)
        diff.unpersist()
        return known.sparkSession.createDataFrame(rows, diff_counts(diff).schema)

    def _analysed(self, assets: DataFrame, now: str, analyse: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        """Items as a sync saves them. assets has the column `action`."""
        known, personas = self.t("items"), self.t("personas")
        own = [c for c in assets.columns if c not in ("id", "action")]
        stored = known.select("id", *[F.col(c).alias(f"old_{c}") for c in known.columns if c != "id"])
        rows = assets.join(stored, "id", "left")
        kept = {c: F.col(f"old_{c}") for c in known.columns if c not in ("id", *own)}
        kept["discovered_at"] = F.coalesce(F.nullif("old_discovered_at", F.lit("")), F.lit(now))
        if "metadata" in own:
            rows = rows.withColumn("metadata", mutations.merge_maps(F.coalesce("old_metadata", F.expr("cast(map() as map<string,string>)")), F.col("metadata")))
        base = conform(rows.select("id", *own, *[v.alias(c) for c, v in kept.items()]), "items")
        if analyse is None:
            return base
        found = analyse(base)
        extra = [c for c in found.columns if c != "id" and c in base.columns]
        fresh = base.drop(*extra).join(found.select("id", *extra), "id").join(assets.select("id", "action"), "id")
        fresh = conform(fresh, "items").join(assets.select("id", "action"), "id").join(known.select("id", *[F.col(c).alias(f"old_{c}") for c in ("detections", "tags", "metadata")]), "id", "left")
        d, t, m = refresh_faces(F.col("old_detections"), F.col("detections"), F.col("old_tags"), F.col("tags"), F.col("old_metadata"), F.col("metadata"))
        partly = F.col("action") == "reanalyse"
        fresh = fresh.withColumns({"detections": F.when(partly, d).otherwise(F.col("detections")), "tags": F.when(partly, t).otherwise(F.col("tags")), "metadata": F.when(partly, m).otherwise(F.col("metadata"))})
        fresh = fresh.select(*known.columns)
        # written once: what follows looks at these rows several times, and should not find what was done to get them
        fresh = written(fresh, "analysed")
        carried = written(detect.carry_assignments(relations.detections_of(fresh), relations.detections_of(known.join(fresh.select("id"), "id", "left_semi")), personas), "carried")
        carried = similarity.auto_assign(carried.withColumnRenamed("id", "detection_id"), personas, self.settings).withColumnRenamed("detection_id", "id")
        return keep_assignments(relations.with_detections(fresh, carried), known)

    def refresh_clusters(self, kind: str, now: str) -> str:
        """Places new and changed detections into the stored clusters, or clusters anew where there is nothing
        to go on from. Returns which."""
        t = self.library.load()
        how, members = clusters.refresh(t["unknown_clusters"], t["unknown_cluster_members"], t["detections"], kind, self.settings)
        cols = ["item_id", "detection_id", "label", "confidence", "captured_at"]
        full = members.join(t["detections"].select(*cols), ["item_id", "detection_id"]).withColumn("kind", F.lit(kind))
        full = clusters.order_rank(full, ["cluster_id"])
        new, links = mutations.replace_clusters(t["unknown_clusters"], t["unknown_cluster_members"], clusters.finalize(full, revision=now), members, t["detections"], kind)
        self._save(now, unknown_clusters=mark_stable(new, kind, now), unknown_cluster_members=links, detections=mark_clean(t["detections"], members, now))
        return how

    def rebuild_clusters(self, kind: str, now: str) -> None:
        det = self.t("detections")
        members = clusters.cluster_unknown(det, kind, self.settings)
        new, links = mutations.replace_clusters(self.t("unknown_clusters"), self.t("unknown_cluster_members"), clusters.finalize(members, revision=now), members.select("cluster_id", "item_id", "detection_id"), det, kind)
        self._save(now, unknown_clusters=new, unknown_cluster_members=links)

    def regenerate_memories(self, now: str) -> None:
        self._save(now, memories=memories.regenerate(self.t("items"), self.t("item_personas"), self.t("personas"), now, self.settings))

    def create_persona(self, name: str, kind: str, now: str) -> str:
        """Its id, or that of the persona of this name and kind."""
        self._save(now, personas=mutations.create_persona(self.t("personas"), name, kind, now))
        return self.t("personas").filter((F.lower("name") == name.strip().lower()) & (F.col("kind") == kind)).select("id").first()[0]

    def _persona(self, persona_id: str, new_name: str, kind: str, now: str) -> tuple[str, str]:
        """(id, kind) of a persona, created where only a name is given."""
        persona_id = persona_id or self.create_persona(new_name, kind, now)
        found = self.library.find("personas", persona_id).select("kind").first()
        if found is None:
            raise ValueError("there is no such persona")
        return persona_id, found[0]

    def _assign(self, regions: DataFrame, persona_id: str, kind: str, now: str, reassign: bool) -> None:
        """Items, detections, personas (with what they learn) and indexes in one save."""
        changed = mutations.assign_in_items(self.t("items"), regions, persona_id, kind, reassign)
        if changed.isEmpty():
            raise ValueError("there are no detections that this persona can own")
        taught = relations.detections_of(changed).join(regions.select("item_id", F.col("detection_id").alias("id")).distinct(), ["item_id", "id"], "left_semi").filter(F.col("persona_id") == persona_id)
        self.library.save_persona_assignment(mutations.learn(self.t("personas"), persona_id, kind, taught), changed, now)

    def assign_region(self, item_id: str, detection_id: str, persona_id: str, now: str, new_name: str = "", kind: str = "person") -> None:
        """The region and its whole cluster, others' assignments included."""
        persona_id, kind = self._persona(persona_id, new_name, kind, now)
        region = self.library.spark.createDataFrame([(item_id, detection_id)], "item_id string, detection_id string")
        self._assign(mutations.with_whole_cluster(region, self.t("unknown_cluster_members")), persona_id, kind, now, reassign=True)

    def assign_clusters(self, cluster_ids: list[str], persona_id: str, now: str, new_name: str = "", kind: str = "person") -> None:
        """The members of clusters of the persona's kind; regions that others own stay."""
        persona_id, kind = self._persona(persona_id, new_name, kind, now)
        own = self.t("unknown_clusters").filter(F.col("cluster_id").isin(*cluster_ids))
        if {r[0] for r in own.select("kind").distinct().limit(2).collect()} != {kind}:
            raise ValueError("clusters must be of the persona's kind")
        self._assign(self.t("unknown_cluster_members").join(own.select("cluster_id"), "cluster_id", "left_semi"), persona_id, kind, now, reassign=False)

    def clear_region(self, item_id: str, detection_id: str, now: str) -> None:
        region = self.library.spark.createDataFrame([(item_id, detection_id)], "item_id string, detection_id string")
        changed = mutations.clear_in_items(self.t("items"), region)
        self.library.save_persona_assignment(self.t("personas"), changed, now)
        self.regenerate_memories(now)

    def assign_item(self, item_id: str, persona_id: str, now: str, new_name: str = "", kind: str = "person") -> None:
        """The persona by hand; it learns from the item's only face, or from all its pets."""
        persona_id, kind = self._persona(persona_id, new_name, kind, now)
        changed = mutations.assign_item(self.library.find("items", item_id), item_id, persona_id)
        taught = mutations.learnable_of_item(relations.detections_of(changed).withColumnRenamed("id", "detection_id"), item_id, kind).withColumnRenamed("detection_id", "id")
        personas = mutations.learn(self.t("personas"), persona_id, kind, taught)
        personas = personas.withColumn("avatar_item_id", F.when((F.col("id") == persona_id) & (F.coalesce("avatar_item_id", F.lit("")) == ""), F.lit(item_id)).otherwise(F.col("avatar_item_id")))
        self.library.save_persona_assignment(personas, changed, now)
        self.regenerate_memories(now)

    def clear_item(self, item_id: str, now: str) -> None:
        """The item and its detections without personas."""
        one = self.library.find("items", item_id)
        changed, _ = mutations.clear_items(one, self.t("detections").limit(0), [item_id])
        self.library.save_persona_assignment(self.t("personas"), changed, now)
        self.regenerate_memories(now)

    def dedupe_references(self, now: str) -> None:
        self._save(now, personas=mutations.dedupe_references(self.t("personas"), self.t("items")))

    def create_album(self, name: str, item_ids: list[str], now: str) -> None:
        self._save(now, albums=mutations.create_album(self.t("albums"), self.t("items"), name, item_ids, now))

    def add_to_album(self, album_id: str, item_ids: list[str], now: str) -> None:
        self._save(now, albums=mutations.add_to_album(self.t("albums"), self.t("items"), album_id, item_ids))

    def delete_album(self, album_id: str, now: str) -> None:
        self._save(now, albums=mutations.delete_album(self.t("albums"), album_id))

    def toggle_favorite(self, ids: list[str], now: str) -> None:
        own = self.t("items").filter(F.col("id").isin(*ids))
        self.library.save_items(mutations.toggle_favorite(own, own.select("id")), own.limit(0).select("id"), now)
