"""A library on disk: one Parquet folder a table and snapshot, and a small manifest that names the current one.

A save writes new snapshots of the tables it changes and then a manifest with the next number, by renaming a
finished file to a name that must not exist yet. The highest number counts, so readers see the old or the new
state whenever a save stops, no path is overwritten while it is read, and of two saves that start from one
state the later fails instead of undoing the other. That rests on a rename that fails if its target exists, as on HDFS;
stores whose rename overwrites need one writer at a time. Old states stay readable for KEPT_MANIFESTS saves;
`vacuum` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations, textindex
from ..schema import TABLES, conform, empty, schema


KEPT_MANIFESTS = 10
#: Tables in parts by a hash of the item's id: a save of some items leaves the parts of others as they are.
KEYED = {"items": "id", "item_personas": "item_id", "item_tags": "item_id", "item_search": "item_id", "item_grams": "item_id", "detections": "item_id", "unknown_cluster_members": "item_id"}
#: Tables whose files are sorted, so that readers skip the pages of other values.
SORTED = {"item_grams": "gram"}


class Library:
    def __init__(self, spark: SparkSession, root: str, parts: int = 16):
        """parts: how many parts the tables of a new library have; an existing one keeps its own."""
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    # manifest ---------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, str]]:
        """(number, path) of the manifests there are, in order."""
        at, fs = self._fs(self.root)
        names = [str(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n[len("manifest-") : -len(".json")]), f"{self.root}/{n}") for n in names if re.fullmatch(r"manifest-\d+\.json", n))

    def manifest(self) -> dict:
        found = self._manifests()
        if not found:
            return {"number": 0, "tables": {}, "metadata": {"schema_version": "1"}}
        number, at = found[-1]
        return {**self._named(at), "number": number}

    def _named(self, at: str) -> dict:
        path, fs = self._fs(at)
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Makes the manifest, read under number n, the one of number n + 1."""
        number = manifest["number"] + 1
        tmp, fs = self._fs(f"{self.root}/_manifest-{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        at, _ = self._fs(f"{self.root}/manifest-{number}.json")
        if fs.exists(at) or not fs.rename(tmp, at):
            fs.delete(tmp, False)
            raise RuntimeError("the library has been saved by another session; load it again")
        for old, path in self._manifests():
            if old <= number - KEPT_MANIFESTS:
                fs.delete(self._fs(path)[0], False)

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Deletes snapshots and parts that none of the kept manifests names, and staged changes that were left behind,
        if they are older than so many seconds: a save that is under way has younger ones, and readers of a kept
        state lose nothing. Returns how many folders went."""
        import time

        kept = set()
        for _, at in self._manifests():
            for entry in self._named(at)["tables"].values():
                kept |= {entry} if isinstance(entry, str) else set(entry.values())
        before, gone = (time.time() - older_than) * 1000, 0
        for table in [*TABLES, "_changes"]:
            at, fs = self._fs(f"{self.root}/{table}")
            for snapshot in fs.listStatus(at) if fs.exists(at) else []:
                name = f"{table}/{snapshot.getPath().getName()}"
                parts = {k for k in kept if k.startswith(f"{name}/")}
                doomed = [] if name in kept else [f.getPath() for f in fs.listStatus(snapshot.getPath()) if f.isDirectory() and f"{name}/{f.getPath().getName()}" not in kept] if parts else [snapshot.getPath()]
                for path in doomed if snapshot.getModificationTime() < before else []:
                    gone += bool(fs.delete(path, True))
        return gone

    def metadata(self, key: str, default: str | None = None) -> str | None:
        return self.manifest()["metadata"].get(key, default)

    def set_metadata(self, **values: str) -> None:
        m = self.manifest()
        m["metadata"].update(values)
        self._publish(m)

    # tables -----------------------------------------------------------------

    def table(self, name: str, manifest: dict | None = None, parts: set[int] | None = None) -> DataFrame:
        """A table, or those parts of it that the given hashes of item ids lie in."""
        return self._read(name, (manifest or self.manifest())["tables"].get(name), parts)

    def _read(self, name: str, entry: str | dict[str, str] | None, parts: set[int] | None = None) -> DataFrame:
        paths = [entry] if isinstance(entry, str) else [at for k, at in (entry or {}).items() if parts is None or int(k) in parts]
        if not paths:
            return empty(self.spark, name)
        return conform(self._plain(name, paths), name)

    def _plain(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema(name)).parquet(*[f"{self.root}/{at}" for at in paths]) if paths else empty(self.spark, name)

    def load(self) -> dict[str, DataFrame]:
        """All tables of one state."""
        m = self.manifest()
        return {name: self.table(name, m) for name in TABLES if name != "metadata"}

    def _part(self, column: str, manifest: dict):
        return F.pmod(F.xxhash64(column), F.lit(manifest.setdefault("parts", self.parts))).cast("int")

    def _stage(self, name: str, df: DataFrame, manifest: dict, made: dict, parts: set[int] | None = None) -> DataFrame:
        """A new snapshot of a table, or of the given parts of it, not published yet; what is derived from it reads it, by its
        plain columns: what has just been written needs no conforming, and files are read for the fields asked for."""
        at, df = f"{name}/{uuid.uuid4().hex}", conform(df, name)
        if name not in KEYED:
            made[name] = at
            df.write.parquet(f"{self.root}/{at}")
            return self._plain(name, [at])
        df = df.withColumn("_part", self._part(KEYED[name], manifest))
        if name in SORTED:
            df = df.sortWithinPartitions("_part", SORTED[name])  # each task its own rows: a part is not one task's work
        df.write.partitionBy("_part").parquet(f"{self.root}/{at}")
        path, fs = self._fs(f"{self.root}/{at}")
        names = [str(f.getPath().getName()) for f in fs.listStatus(path)]
        new = {n.split("=")[1]: f"{at}/{n}" for n in names if n.startswith("_part=")}
        old = manifest["tables"].get(name) or {}
        if parts is not None and isinstance(old, dict):
            made[name] = {k: v for k, v in old.items() if int(k) not in parts} | new
        else:
            made[name] = new
        return self._plain(name, list(new.values()))

    def _commit(self, manifest: dict, made: dict, now: str) -> None:
        manifest["tables"].update(made)
        if now:
            manifest["metadata"]["updated_at"] = now
        self._publish(manifest)

    def save(self, tables: dict[str, DataFrame], now: str = "") -> None:
        """New snapshots of the given tables, published together."""
        m, made = self.manifest(), {}
        for name, df in tables.items():
            self._stage(name, df, m, made)
        self._commit(m, made, now)

    def save_state(self, items: DataFrame, personas: DataFrame, albums: DataFrame, memories: DataFrame, now: str) -> None:
        """Everything at once: tables replaced, indexes rebuilt, detections diffed, clusters pruned; albums, memories
        and avatars lose items that are gone."""
        m, made = self.manifest(), {}
        items = self._stage("items", items, m, made)
        personas = self._stage("personas", relations.keep_live_avatars(personas, items), m, made)
        self._stage("albums", relations.keep_live_ids(albums, items), m, made)
        self._stage("memories", relations.keep_live_ids(memories, items), m, made)
        self._follow(items, personas, m, made, now)
        self._commit(m, made, now)

    def _follow(self, items: DataFrame, personas: DataFrame, m: dict, made: dict, now: str, parts: set[int] | None = None, changed: DataFrame | None = None, keys: DataFrame | None = None) -> None:
        """What follows from new items, or from those of some parts: indexes, detections, memberships, clusters. Where only
        some items are `changed` (`keys`: their ids and those that are gone), the detections of others stay as they are."""
        from ..streaming.ingest import detection_feed

        named = empty(self.spark, "personas") if personas.isEmpty() else personas  # without names, texts are made where items lie
        for name, df in self.indexes(items, named).items():
            staged = self._stage(name, df, m, made, parts)
            if name == "item_search":
                self._stage("item_grams", textindex.postings(staged), m, made, parts)
        old = self.table("detections", m, parts)
        if changed is None:
            feed = detection_feed(old, relations.detection_rows(items, now), now)
        else:
            own = old.join(changed.select(F.col("id").alias("item_id")).hint("shuffle_hash"), "item_id", "left_semi")
            others = old.join(keys.select(F.col("id").alias("item_id")).hint("shuffle_hash"), "item_id", "left_anti")
            feed = others.unionByName(detection_feed(own, relations.detection_rows(changed, now), now))
        detections = self._stage("detections", feed, m, made, parts)
        free = detections.filter(relations.unassigned() & ~F.col("cluster_dirty")).select("item_id", "detection_id")
        self._stage("unknown_cluster_members", self.table("unknown_cluster_members", m, parts).join(free, ["item_id", "detection_id"], "left_semi"), m, made, parts)
        members = self._read("unknown_cluster_members", made["unknown_cluster_members"])
        self._stage("unknown_clusters", self.table("unknown_clusters", m).join(members.select("cluster_id"), "cluster_id", "left_semi"), m, made)

    def save_items(self, changed: DataFrame, removed: DataFrame, now: str, personas: DataFrame | None = None) -> None:
        """Progress of a sync, or an assignment: removed ids go, changed items are upserted, indexes and detections
        follow. Only the parts that hold such items are read and written anew."""
        m, made, staged = self.manifest(), {}, f"{self.root}/_changes/{uuid.uuid4().hex}"
        conform(changed, "items").write.parquet(f"{staged}/items")
        changed = self.spark.read.schema(schema("items")).parquet(f"{staged}/items")
        changed.select("id", F.lit(False).alias("gone")).unionByName(removed.select("id", F.lit(True).alias("gone"))).write.parquet(f"{staged}/keys")
        keys = self.spark.read.schema("id string, gone boolean").parquet(f"{staged}/keys")
        touched = {r[0]: r[1] for r in keys.groupBy(self._part("id", m).alias("p")).agg(F.max("gone")).collect()}  # at most a row a part
        parts, gone = set(touched), any(touched.values())
        if parts:
            items = self.table("items", m, parts).join(keys.select("id").hint("shuffle_hash"), "id", "left_anti").unionByName(changed)
            items = self._stage("items", items, m, made, parts)
        people = personas if personas is not None else self.table("personas", m)
        if gone:
            every = self._read("items", made["items"])
            people = relations.keep_live_avatars(people, every)
            for name in ("albums", "memories"):
                self._stage(name, relations.keep_live_ids(self.table(name, m), every), m, made)
        if gone or personas is not None:
            people = self._stage("personas", people, m, made)
        if parts:
            self._follow(items, people, m, made, now, parts, changed, keys)
        self._commit(m, made, now)
        at, fs = self._fs(staged)
        fs.delete(at, True)

    def save_persona_assignment(self, personas: DataFrame, changed: DataFrame, now: str) -> None:
        """Personas as learnt and the items they were assigned in: items, detections and indexes in one save."""
        self.save_items(changed, changed.limit(0).select("id"), now, personas)

    @staticmethod
    def indexes(items: DataFrame, personas: DataFrame) -> dict[str, DataFrame]:
        """The indexes that are made from items; the postings follow from item_search as it is staged."""
        return {"item_personas": relations.item_personas(items), "item_tags": relations.item_tags(items), "item_search": relations.item_search(items, personas)}

    def grams(self) -> DataFrame | None:
        """The index of search texts with its plain columns, so that filters reach its files; None before the first save."""
        entry = self.manifest()["tables"].get("item_grams")
        if not entry:
            return None
        return self._plain("item_grams", list(entry.values()))

    def find(self, name: str, key: str, column: str = "id") -> DataFrame:
        """Point lookup."""
        return self.table(name).filter(F.col(column) == key)

    # JSON -------------------------------------------------------------------

    def export_json(self, path: str) -> None:
        """One folder of JSON lines a table, under a new folder that then takes the place of `path`."""
        staged = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        for name, df in self.load().items():
            df.write.json(f"{staged}/{name}")
        new, fs = self._fs(staged)
        at, _ = self._fs(path)
        old, _ = self._fs(f"{staged}-old")
        had = fs.exists(at)
        if had:
            fs.rename(at, old)
        fs.rename(new, at)
        if had:
            fs.delete(old, True)

    def backfill_detections(self, now: str = "") -> bool:
        """Detections from the items' own lists, where there are items and no detection is stored."""
        if self.table("items").isEmpty() or not self.table("detections").isEmpty():
            return False
        self.save({"detections": relations.detection_rows(self.table("items"), now)}, now)
        return True

    def import_json(self, path: str, now: str = "") -> bool:
        """Reads such a folder into an empty library; rebuilds detections from items where they are missing."""
        if not self.table("items").isEmpty():
            return False
        got = {}
        for name, ddl in TABLES.items():
            at, fs = self._fs(f"{path}/{name}")
            if name != "metadata" and fs.exists(at):
                got[name] = self.spark.read.schema(ddl).json(f"{path}/{name}")
        self.save(got, now)
        self.backfill_detections(now)
        return True
