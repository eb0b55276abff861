"""Matching vectors and hashes against a reference set: persona assignment and suggestions.

The reference side is a stated query set (one row a reference), matched against all detections. A small set,
checked by count and bytes, meets every Arrow batch of vectors in one matrix product, and nothing is shuffled; a
larger one is searched by pivots, and hashes by chunks of their bits (`neighbours`). Nothing emits all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import hamming, hash_bits
from .neighbours import nearest_hashes, nearest_vectors
from .relations import can_own, unassigned

#: A reference set of at most so many vectors and bytes is sent to all tasks whole.
DIRECT, REFERENCE_BYTES = 4096, 32 << 20


def _vectors(column, size: int):
    """(places, matrix) of the vectors of one length in an Arrow list column, in double precision."""
    import numpy as np

    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    start = np.asarray(lists.offsets)
    own = np.flatnonzero((np.diff(start) == size) & ~np.asarray(lists.is_null()))
    flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    return own, flat[(start[own][:, None] + np.arange(size)[None, :])]


def best_vectors(rows: DataFrame, key: list[str], references: DataFrame, tie: list[str], keep: str, least: float | None = None, euclidean: bool = False, self_key: str | None = None, most: int = 1, direct: int = DIRECT) -> DataFrame:
    """(key..., score, keep, rank): for each row its `most` best references by cosine, or by negative Euclidean distance.

    rows: (key..., encoding), references: (tie..., keep, reference); vectors of other lengths do not compare.
    At most `direct` references of `REFERENCE_BYTES` bytes are sent whole; norms are taken once, a batch of rows
    meets them by one matrix product, and nothing is shuffled. Larger sets are searched by pivots. Scores that agree to
    12 digits are ties, and go to the first reference by `tie`.
    self_key names a column of key: a reference whose `keep` equals it is left out.
    """
    import numpy as np

    order = references.select(*dict.fromkeys([*tie, keep]), F.col("reference").cast("array<double>").alias("reference")).filter(F.size("reference") > 0)
    kind, schema = dict(references.dtypes)[keep], ", ".join(f"{c} {t}" for c, t in rows.select(*key).dtypes)
    if not fits(order, "reference", direct):
        return nearest_vectors(rows, key, references, tie, keep, least, euclidean, self_key, most)
    got = order.orderBy(*tie).collect()  # at most `direct` rows
    by_size = {}
    for size in {len(r["reference"]) for r in got}:
        mine = [(at, r[keep], r["reference"]) for at, r in enumerate(got) if len(r["reference"]) == size]
        by_size[size] = (np.array([m[0] for m in mine]), [m[1] for m in mine], np.array([m[2] for m in mine], dtype=np.float64))
    sent = rows.sparkSession.sparkContext.broadcast(by_size)
    found = rows.select(*key, F.col("encoding").cast("array<double>").alias("encoding")).mapInArrow(_nearest(sent, key, keep, kind, euclidean, least, self_key, most), f"{schema}, score double, {keep} {kind}, place long, rank int")
    return found.drop("place")


def fits(references: DataFrame, column: str, direct: int = DIRECT) -> bool:
    """Whether so few vectors of so few bytes are there that all tasks can have them."""
    n, held = references.limit(direct + 1).agg(F.count(F.lit(1)), F.sum(F.size(column).cast("long") * 8)).first()
    return n <= direct and (held or 0) <= REFERENCE_BYTES


def _nearest(shared, key: list[str], keep: str, kind: str, euclidean: bool, least: float | None, self_key: str | None, most: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out: list[tuple[int, float, object, int, int]] = []
            ids = b.column(self_key).to_pylist() if self_key else None
            for size, (places, names, refs) in shared.value.items():
                own, x = _vectors(b.column("encoding"), size)
                if not len(own):
                    continue
                norms = np.sqrt((refs * refs).sum(1))
                unit = refs / np.where(norms > 0, norms, 1)[:, None]
                for s in range(0, len(own), 1024):
                    v = x[s : s + 1024]
                    if euclidean:
                        scores = -np.sqrt(np.maximum((v * v).sum(1)[:, None] + (norms * norms)[None, :] - 2 * (v @ refs.T), 0))
                    else:
                        length = np.sqrt((v * v).sum(1))
                        scores = (v / np.where(length > 0, length, 1)[:, None]) @ unit.T
                    if self_key:
                        at = {n: k for k, n in enumerate(names)}
                        for i, row in enumerate(own[s : s + 1024].tolist()):
                            if ids[row] in at:
                                scores[i, at[ids[row]]] = -np.inf
                    rounded = np.round(scores, 12)
                    for rank in range(1, most + 1):
                        best = rounded.argmax(1)  # the first at ties
                        for i, j in enumerate(best.tolist()):
                            if np.isfinite(rounded[i, j]) and (least is None or scores[i, j] >= least):
                                out.append((int(own[s + i]), float(scores[i, j]), names[j], int(places[j]), rank))
                        rounded[np.arange(len(best)), best] = -np.inf
            out.sort(key=lambda o: (o[0], o[4]))
            rows = pa.array([o[0] for o in out], pa.int64())
            taken = [b.column(k).take(rows) for k in key]
            names_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], names_type), pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.int32())],
                names=[*key, "score", keep, "place", "rank"],
            )

    return run


def search_vectors(rows: DataFrame, queries: DataFrame, most: int = 5, digits: int = 9) -> DataFrame:
    """(query_id, id, rank, score): the `most` rows nearest by cosine to each query, itself left out.

    rows: (id, encoding), queries: (query_id, encoding) of ids of the same kind. Few queries are sent to all
    tasks, and a task keeps its best rows for each, so `most` rows a query and task are shuffled. More than
    `DIRECT` of them, or `REFERENCE_BYTES`, are searched by pivots of the rows. Ties go to the lesser id, to so many digits
    in the first case and to 12 in the second.
    """
    if not fits(queries.select("encoding").filter(F.size("encoding") > 0), "encoding"):
        near = nearest_vectors(queries, ["query_id"], rows.select("id", F.col("encoding").alias("reference")), ["id"], "id", self_key="query_id", most=most)
        return near.select("query_id", "id", "rank", "score")
    import numpy as np
    from pyspark.sql import Window

    got = queries.select("query_id", F.col("encoding").cast("array<double>").alias("v")).filter(F.size("v") > 0).orderBy("query_id").collect()
    sizes = {len(r[1]) for r in got}
    shared = {n: ([r[0] for r in got if len(r[1]) == n], np.array([r[1] for r in got if len(r[1]) == n], dtype=np.float64)) for n in sizes}
    kind = dict(rows.dtypes)["id"]
    sent = rows.sparkSession.sparkContext.broadcast(shared)
    found = rows.select("id", F.col("encoding").cast("array<double>").alias("encoding")).mapInArrow(_best_rows(sent, most, digits), f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "id", "rank", "score")


def _best_rows(shared, most: int, digits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept: dict[object, list[tuple[float, object, float]]] = {}
        types = None
        for b in batches:
            types = b.column("id").type
            ids = b.column("id").to_pylist()
            for size, (names, q) in shared.value.items():
                own, x = _vectors(b.column("encoding"), size)
                if not len(own):
                    continue
                unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
                scores = unit(q) @ unit(x).T
                for k, name in enumerate(names):
                    some = np.argpartition(-scores[k], min(most + 1, len(own)) - 1)[: most + 1]
                    edge = np.round(scores[k][some].min(), digits)
                    near = np.flatnonzero(np.round(scores[k], digits) >= edge)  # with all ties at the edge
                    best = [(-round(float(scores[k, j]), digits), ids[own[j]], float(scores[k, j])) for j in near.tolist() if ids[own[j]] != name]
                    kept[name] = sorted(kept.get(name, []) + best)[:most]
        if types is not None:
            flat = [(name, i, s) for name, best in kept.items() for _, i, s in best]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], types), pa.array([f[1] for f in flat], types), pa.array([f[2] for f in flat], pa.float64())], names=["query_id", "id", "score"])

    return run


def persona_references(personas: DataFrame, kind: str, what: str = "reference_encodings") -> DataFrame:
    """(persona_id, ref_pos, reference): personas are in order of their ids."""
    return personas.filter(F.col("kind") == kind).select(F.col("id").alias("persona_id"), F.posexplode(what).alias("ref_pos", "reference"))


def match_faces(faces: DataFrame, personas: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(item_id, detection_id, persona_id, score, how): cosine first, Euclidean distance if that fails."""
    s = settings or Settings()
    key, refs = ["item_id", "detection_id"], persona_references(personas, "person")
    faces = faces.select(*key, "encoding").filter(F.size("encoding") > 0)
    near = best_vectors(faces, key, refs, ["persona_id", "ref_pos"], "persona_id", s.face_embedding_similarity_threshold).withColumn("how", F.lit("cosine"))
    rest = faces.join(near.select(*key), key, "left_anti")
    close = best_vectors(rest, key, refs, ["persona_id", "ref_pos"], "persona_id", -s.face_match_threshold, euclidean=True).withColumn("how", F.lit("euclidean"))
    return near.unionByName(close).drop("rank")


def match_pets(pets: DataFrame, personas: DataFrame, settings: Settings | None = None) -> DataFrame:
    """As match_faces, by cosine, else by Hamming distance of hashes."""
    s = settings or Settings()
    key = ["item_id", "detection_id"]
    near = best_vectors(pets.filter(F.size("encoding") > 0).select(*key, "encoding"), key, persona_references(personas, "pet"), ["persona_id", "ref_pos"], "persona_id", s.pet_embedding_similarity_threshold).drop("rank")
    rest = pets.filter(F.coalesce("signature", F.lit("")) != "").join(near.select(*key), key, "left_anti").select(*key, "signature")
    close = near_signatures(rest, key, persona_references(personas, "pet", "reference_signatures"), s.pet_hash_distance_threshold)
    close = close.select(*key, (-F.col("distance")).alias("score"), "persona_id")
    return near.withColumn("how", F.lit("cosine")).unionByName(close.withColumn("how", F.lit("hamming")))


def near_signatures(rows: DataFrame, key: list[str], references: DataFrame, within: int, each: bool = False) -> DataFrame:
    """(key..., distance, persona_id): for rows (key..., signature) the nearest of references (persona_id, ref_pos, reference)
    within so many bits, or the least distance of each persona. Strings that are no 16-digit hex hashes compare with
    strings of their length by characters: they are joined by length."""
    hexed = lambda c: F.lower(c).rlike("^[0-9a-f]{16}$")
    row, ref = hexed("signature"), hexed("reference")
    tie, bits = ["persona_id", "ref_pos"], lambda df, c: df.filter(hexed(c)).withColumn("h", hash_bits(c))
    near = nearest_hashes(bits(rows, "signature").select(*key, "h"), key, bits(references, "reference"), tie, "persona_id", within, each=each)
    odd = rows.select(*key, "signature").join(references, F.length("signature") == F.length("reference")).filter(~(row & ref))
    odd = odd.withColumn("distance", hamming("signature", "reference")).filter(F.col("distance") <= within)
    if each:
        return near.unionByName(odd.select(*key, "distance", "persona_id")).groupBy(*key, "persona_id").agg(F.min("distance").alias("distance"))
    rank = F.struct("distance", *tie)
    odd = odd.groupBy(*key).agg(F.min(rank).alias("b")).select(*key, "b.distance", "b.persona_id")
    # a row of 16 hex digits may be near references of both kinds
    both = near.unionByName(odd).groupBy(*key).agg(F.min(F.struct("distance", "persona_id")).alias("b"))
    return both.select(*key, "b.distance", "b.persona_id")


def auto_assign(detections: DataFrame, personas: DataFrame, settings: Settings | None = None) -> DataFrame:
    """detections with persona ids filled in where unassigned ones match a persona that can own them."""
    free = detections.filter(unassigned())
    faces = match_faces(free.filter(can_own(F.lit("person"), F.col("kind"), F.col("label"))), personas, settings)
    pets = match_pets(free.filter(can_own(F.lit("pet"), F.col("kind"), F.col("label"))), personas, settings)
    found = faces.unionByName(pets).select("item_id", "detection_id", F.col("persona_id").alias("_p"))
    out = detections.join(found, ["item_id", "detection_id"], "left")
    return out.withColumn("persona_id", F.coalesce(F.nullif("persona_id", F.lit("")), "_p")).drop("_p").select(*detections.columns)


def cluster_scores(references: DataFrame, personas: DataFrame, kind: str, settings: Settings | None = None) -> DataFrame:
    """(cluster_id, persona_id, score, how). references: (cluster_id, encodings array, signatures array).

    The best cosine of kept vectors with a persona's references where it reaches the kind's threshold;
    for pets else 1 - d / limit of the least Hamming distance d within the limit.
    """
    s = settings or Settings()
    enc = references.select("cluster_id", F.explode("encodings").alias("encoding"))
    least = s.assign_cosine(kind)
    best = nearest_vectors(enc, ["cluster_id"], persona_references(personas, kind), ["persona_id", "ref_pos"], "persona_id", least, most=None)
    best = best.filter(F.col("score") >= least).select("cluster_id", "persona_id", "score", F.lit("embedding").alias("how"))
    if kind != "pet":
        return best
    limit = float(max(1, s.pet_hash_distance_threshold))
    sig = references.select("cluster_id", F.explode("signatures").alias("signature")).filter(F.coalesce("signature", F.lit("")) != "")
    near = near_signatures(sig, ["cluster_id"], persona_references(personas, kind, "reference_signatures"), s.pet_hash_distance_threshold, each=True)
    near = near.join(best.select("cluster_id", "persona_id"), ["cluster_id", "persona_id"], "left_anti")
    return best.unionByName(near.select("cluster_id", "persona_id", F.greatest(F.lit(0.0), 1 - F.col("distance") / limit).alias("score"), F.lit("signature").alias("how")))


def suggestions(scores: DataFrame, limit: int = 6) -> DataFrame:
    """The personas that fit each cluster best: a top-k report of max(1, limit) rows a cluster."""
    from pyspark.sql import Window

    w = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), "persona_id")
    return scores.filter(F.col("score") > 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, limit))
