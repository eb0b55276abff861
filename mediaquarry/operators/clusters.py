"""Greedy leader clustering of unassigned detections, exact: rows in one order (newest first, then ids), one pass.

A row only joins a cluster that holds a near row, and clusters only merge over near rows. So rows meet within the
connected components of the graph of near rows (by the thresholds of merging, which are the wider ones), and each component is
folded on its own: the result is that of one pass over the whole kind. Within a component the kept vectors of all
clusters are one matrix and their hashes one array, so a row costs one matrix product. `by` names columns that split a
library into independent ones.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha1

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CAT_LABELS, DISTINCT_COSINE, DISTINCT_HAMMING, DOG_LABELS, Settings
from ..functions.vectors import hamming_of
from ..sources.workspace import written
from .components import components, hash_links, star, vector_links
from .detect import distinct_references
from .distinct import learned_encodings
from .relations import cluster_candidates

MEMBER = "cluster_id string, kind string, item_id string, detection_id string, label string, confidence double, captured_at string, seq long, kept_encoding boolean, kept_signature boolean"


def node():
    """A row in the graph of near rows."""
    return F.xxhash64("item_id", "detection_id")


#: Rows up to which one task folds them all, which gives the same as component by component and takes one job.
FEW = 5_000
#: Rows, on average, of the components that are handed to a task together.
BUNDLE = 500


def cluster_id(kind: str, item_id: str, detection_id: str) -> str:
    return sha1(f"unknown-cluster:{kind}:{item_id}:{detection_id}".encode()).hexdigest()[:16]


class Cluster:
    """Members in order of arrival, and the vectors and hashes that later rows are compared with."""

    def __init__(self, id_: str):
        self.id, self.rows, self.units, self.hashes, self.labels = id_, [], [], [], Counter()
        self.kept: dict[int, list[bool]] = {}

    def learn_unit(self, unit) -> bool:
        if unit is None or self.units and max(float(unit @ u) if len(u) == len(unit) else -1.0 for u in self.units) >= DISTINCT_COSINE:
            return False
        self.units.append(unit)
        return True

    def learn_hash(self, h: str) -> bool:
        if not h or self.hashes and min(hamming_of(h, x) for x in self.hashes) <= DISTINCT_HAMMING:
            return False
        self.hashes.append(h)
        return True

    def add(self, row) -> None:
        self.rows.append(row)
        self.labels[row["label"]] += 1
        self.kept[row["seq"]] = [self.learn_unit(row["unit"]), self.learn_hash(row["signature"])]


def _unit(v):
    if v is None or not len(v):
        return None
    a = np.asarray(v, dtype=float)
    n = float(np.sqrt(a @ a))
    return a / n if n > 0 else None


class Leaders:
    """Clusters in order, and what they have kept, in flat arrays with the place of each entry's cluster."""

    def __init__(self, clusters: list[Cluster] = ()):
        self.clusters: list[Cluster] = []
        self.units: dict[int, list] = {}  # by length: matrix, owners, filled
        self.hashes, self.odd = [np.zeros(16, np.uint64), np.zeros(16, np.int64), 0], []
        for c in clusters:
            self.clusters.append(c)
            for u in c.units:
                self._unit(u, len(self.clusters) - 1)
            for h in c.hashes:
                self._hash(h, len(self.clusters) - 1)

    @staticmethod
    def _append(store: list, value, owner: int) -> None:
        if store[2] == len(store[1]):
            store[0] = np.concatenate([store[0], np.zeros_like(store[0])])
            store[1] = np.concatenate([store[1], np.zeros_like(store[1])])
        store[0][store[2]], store[1][store[2]] = value, owner
        store[2] += 1

    def _unit(self, u, owner: int) -> None:
        self._append(self.units.setdefault(len(u), [np.zeros((16, len(u))), np.zeros(16, np.int64), 0]), u, owner)

    def _hash(self, h: str, owner: int) -> None:
        if re.fullmatch("[0-9a-fA-F]{16}", h):
            self._append(self.hashes, np.uint64(int(h, 16)), owner)
        else:
            self.odd.append((h, owner))

    def add(self, at: int, row) -> None:
        """The row as a member of the cluster at a place."""
        c = self.clusters[at]
        n, m = len(c.units), len(c.hashes)
        c.add(row)
        for u in c.units[n:]:
            self._unit(u, at)
        for h in c.hashes[m:]:
            self._hash(h, at)

    def similar(self, units: list) -> np.ndarray:
        """Each cluster's best cosine with any of the vectors; -1 where there is none to compare."""
        out = np.full(len(self.clusters), -1.0)
        for size in {len(u) for u in units}:
            if size in self.units:
                kept, owner, n = self.units[size]
                np.maximum.at(out, owner[:n], (np.array([u for u in units if len(u) == size]) @ kept[:n].T).max(0))
        return out

    def apart(self, hashes: list[str]) -> np.ndarray:
        """Each cluster's least distance to any of the hashes."""
        out = np.full(len(self.clusters), np.inf)
        kept, owner, n = self.hashes
        for h in hashes:
            if n and re.fullmatch("[0-9a-fA-F]{16}", h):
                np.minimum.at(out, owner[:n], np.bitwise_count(kept[:n] ^ np.uint64(int(h, 16))).astype(float))
            for x, at in self.odd if re.fullmatch("[0-9a-fA-F]{16}", h) else [*self.odd, *((f"{int(k):016x}", o) for k, o in zip(kept[:n], owner[:n]))]:
                out[at] = min(out[at], hamming_of(h, x))
        return out


def place(leaders: Leaders, row, kind: str, s: Settings) -> None:
    """The row goes to the cluster of best cosine, else of least Hamming distance, within thresholds; else to a
    new one. Of equals the earliest cluster wins, and any vector match beats any hash match."""
    at = None
    if row["unit"] is not None and leaders.clusters:
        sims = leaders.similar([row["unit"]])
        best = float(sims.max())
        if best >= s.join_cosine(kind):
            at = int(np.flatnonzero(sims >= best - 1e-12)[0])
    if at is None and row["signature"] and leaders.clusters:
        gaps = leaders.apart([row["signature"]])
        if gaps.min() <= s.join_hamming(kind):
            at = int(gaps.argmin())
    if at is None:
        at = len(leaders.clusters)
        leaders.clusters.append(Cluster(cluster_id(kind, row["item_id"], row["detection_id"])))
    leaders.add(at, row)


def _alike(a: Counter, b: Counter) -> bool:
    a, b = set(a), set(b)
    return "pet" in a | b or any(a & set(group) and b & set(group) for group in (CAT_LABELS, DOG_LABELS)) or bool(a & b)


def merge_all(clusters: list[Cluster], kind: str, s: Settings) -> list[Cluster]:
    """Folds the later of the first mergeable pair into the earlier and starts over, until none is left."""
    i, flat = 0, Leaders(clusters)

    def partners(c: Cluster, places) -> list[int]:
        """Those of the places, in order, whose clusters merge with c."""
        near = np.zeros(len(clusters), dtype=bool)
        if c.units:
            near |= flat.similar(c.units) >= s.merge_cosine(kind)
        if c.hashes:
            near |= flat.apart(c.hashes) <= s.merge_hamming(kind)
        return [k for k in places if near[k] and (kind != "pet" or _alike(c.labels, clusters[k].labels))]

    while i < len(clusters):
        found = partners(clusters[i], range(i + 1, len(clusters)))
        if not found:
            i += 1
            continue
        left, right = clusters[i], clusters.pop(found[0])
        left.rows += right.rows
        left.labels.update(right.labels)
        for r in right.rows:
            unit, hashed = right.kept[r["seq"]]
            left.kept[r["seq"]] = [unit and left.learn_unit(r["unit"]), hashed and left.learn_hash(r["signature"])]
        flat = Leaders(clusters)
        # earlier clusters did not match the old left one; they may match what it has become
        i = next(iter(partners(left, range(i))), i)
    return clusters


def _fold(kind: str, s: Settings, merge: bool, by: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["captured_at", "item_id", "detection_id"], ascending=[False, True, True], kind="stable")
        leaders = Leaders()
        for seq, r in enumerate(pdf.to_dict("records")):
            place(leaders, {**r, "seq": seq, "unit": _unit(r["encoding"]), "signature": r["signature"] or ""}, kind, s)
        clusters = merge_all(leaders.clusters, kind, s) if merge else leaders.clusters
        out = [[*[r[b] for b in by], c.id, kind, r["item_id"], r["detection_id"], r["label"], r["confidence"], r["captured_at"], at, *c.kept[r["seq"]]] for c in clusters for at, r in enumerate(c.rows)]
        return pd.DataFrame(out, columns=[*by, *[f.split()[0] for f in MEMBER.split(", ")]])

    return run


def cluster_unknown(detections: DataFrame, kind: str, settings: Settings | None = None, merge: bool = True, by: list[str] | None = None, few: int = FEW) -> DataFrame:
    """Members of clusters (see MEMBER). Rows without persona, of the kind, with a vector or a hash."""
    s, by = settings or Settings(), by or []
    rows = cluster_candidates(detections, kind).select(*by, "item_id", "detection_id", "label", "confidence", "captured_at", "encoding", "signature")
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{b} {types[b]}" for b in by], MEMBER])
    rows = written(rows.withColumn("node", node()), "candidates")
    if rows.limit(few + 1).count() <= few:
        return rows.groupBy(*(by or [F.lit(kind)])).applyInPandas(_fold(kind, s, merge, by), schema)
    links = vector_links(rows.select("node", "encoding"), rows.select(F.col("node").alias("ref"), F.col("encoding").alias("reference")), s.merge_cosine(kind))
    links = links.unionByName(hash_links(rows.select("node", "signature"), rows.select("node", "signature"), s.merge_hamming(kind)))
    return _folded(rows, links, by, _fold(kind, s, merge, by), schema)


def _folded(rows: DataFrame, links: DataFrame, by: list[str], fold, schema: str) -> DataFrame:
    """The fold of each component of rows (node, ...); a row without links is its own. Most components are of a row or
    two, so many are handed to a task at once. Written, since what follows reads the members more than once."""
    bundles = -(-rows.count() // BUNDLE)
    rows = rows.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("component"), F.lit(max(1, bundles))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fold(own) for _, own in pdf.groupby("component", sort=False)], ignore_index=True)

    return written(rows.groupBy(*by, "bundle").applyInPandas(run, schema), "members")


def finalize(members: DataFrame, by: list[str] | None = None, revision: str = "") -> DataFrame:
    """One row a cluster: counts, mean confidence, most frequent label (first seen at ties), most confident
    member (first at ties), newest date."""
    key = [*(by or []), "cluster_id", "kind"]
    labels = members.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    mode = labels.groupBy(*key).agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))
    rep = F.max_by(F.struct("item_id", "detection_id"), F.struct("confidence", -F.col("seq")))
    out = members.groupBy(*key).agg(
        F.count_distinct("item_id", "detection_id").cast("int").alias("member_count"), F.count_distinct("item_id").cast("int").alias("item_count"), F.avg("confidence").alias("average_confidence"),
        F.max("captured_at").alias("latest_captured_at"), rep.alias("r"), F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    out = out.join(mode, key).withColumns({"representative_item_id": F.col("r.item_id"), "representative_detection_id": F.col("r.detection_id"), "revision": F.lit(revision), "is_partial": F.lit(False)})
    return out.drop("r")


def kept_references(members: DataFrame, detections: DataFrame) -> DataFrame:
    """(cluster_id, encodings, signatures): what clusters are compared by."""
    j = members.join(detections.select("item_id", "detection_id", "encoding", "signature"), ["item_id", "detection_id"])
    pick = lambda flag, col: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("seq", col)))), lambda s: s[col])
    return j.groupBy("cluster_id").agg(pick("kept_encoding", "encoding").alias("encodings"), pick("kept_signature", "signature").alias("signatures"))


def references_of(rows: DataFrame) -> DataFrame:
    """(cluster_id, encodings, signatures): what a cluster of these members (newest first) has learnt, vectors and hashes
    each that differ from those before. For clusters whose `kept_` flags are not at hand."""
    ranked = order_rank(rows, ["cluster_id"]).withColumnRenamed("cluster_id", "persona_id").select("persona_id", "seq", "encoding", F.coalesce("signature", F.lit("")).alias("signature"))
    bare = F.array().cast("array<double>")
    vectors = learned_encodings(ranked.filter(F.size("encoding") > 0)).filter("kept").select("persona_id", "seq", F.lit(True).alias("kept_encoding"))
    hashes = distinct_references(ranked.filter("signature <> ''").withColumn("encoding", bare)).filter("kept").select("persona_id", "seq", F.lit(True).alias("kept_signature"))
    j = ranked.join(vectors, ["persona_id", "seq"], "left").join(hashes, ["persona_id", "seq"], "left")
    pick = lambda flag, col: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("seq", col)))), lambda s: s[col])
    return j.groupBy(F.col("persona_id").alias("cluster_id")).agg(pick("kept_encoding", "encoding").alias("encodings"), pick("kept_signature", "signature").alias("signatures"))


def cluster_incremental(state: DataFrame, detections: DataFrame, dirty: DataFrame, kind: str, settings: Settings | None = None, few: int = FEW) -> DataFrame:
    """One incremental pass: (cluster_id, item_id, detection_id) after placing the dirty rows.

    state: members (cluster_id, item_id, detection_id) in any order; they are replayed newest first. A dirty
    row leaves its cluster and is placed again if it is still a candidate. Clusters are not merged here.
    """
    s = settings or Settings()
    cols = ["item_id", "detection_id", "label", "confidence", "captured_at", "encoding", "signature"]
    every = cluster_candidates(detections, kind).select(*cols)
    marked = every.join(state.select("item_id", "detection_id", "cluster_id"), ["item_id", "detection_id"], "left")
    marked = marked.join(dirty.select("item_id", "detection_id").withColumn("dirty", F.lit(True)), ["item_id", "detection_id"], "left")
    rows = written(marked.filter("cluster_id is not null or dirty").withColumn("node", node()), "candidates")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["captured_at", "item_id", "detection_id"], ascending=[False, True, True], kind="stable")
        found: dict[str, Cluster] = {}
        later = []
        for seq, r in enumerate(pdf.to_dict("records")):
            row = {**r, "seq": seq, "unit": _unit(r["encoding"]), "signature": r["signature"] or ""}
            if r["dirty"] is True:
                later.append(row)
            else:
                found.setdefault(r["cluster_id"], Cluster(r["cluster_id"])).add(row)
        leaders = Leaders(sorted(found.values(), key=lambda c: (-len(c.rows), c.id)))
        for row in later:
            place(leaders, row, kind, s)
        return pd.DataFrame([(c.id, r["item_id"], r["detection_id"]) for c in leaders.clusters for r in c.rows], columns=["cluster_id", "item_id", "detection_id"])

    schema = "cluster_id string, item_id string, detection_id string"
    if rows.limit(few + 1).count() <= few:
        return rows.groupBy(F.lit(kind)).applyInPandas(run, schema)
    # members of a cluster stay together, and a dirty row may join what it is near
    moved = rows.filter("dirty")
    links = star(rows.filter("cluster_id is not null"), "cluster_id")
    links = links.unionByName(vector_links(moved.select("node", "encoding"), rows.select(F.col("node").alias("ref"), F.col("encoding").alias("reference")), s.join_cosine(kind)))
    links = links.unionByName(hash_links(moved.select("node", "signature"), rows.select("node", "signature"), s.join_hamming(kind)))
    return _folded(rows, links, [], run, schema)


def refresh(clusters: DataFrame, state: DataFrame, detections: DataFrame, kind: str, settings: Settings | None = None) -> tuple[str, DataFrame]:
    """('incremental' or 'full', members): incremental where rows are dirty or clusters exist, else full with merging."""
    dirty = detections.filter(F.col("cluster_dirty"))
    own = clusters.filter(F.col("kind") == kind)
    if cluster_candidates(dirty, kind).limit(1).count() or own.limit(1).count():
        return "incremental", cluster_incremental(state.join(own.select("cluster_id"), "cluster_id", "left_semi"), detections, dirty, kind, settings)
    return "full", cluster_unknown(detections, kind, settings).select("cluster_id", "item_id", "detection_id")


def order_rank(df: DataFrame, by: list[str]) -> DataFrame:
    """df with the rank rows have in clustering order."""
    w = Window.partitionBy(*by).orderBy(F.col("captured_at").desc(), "item_id", "detection_id")
    return df.withColumn("seq", F.row_number().over(w) - 1)
