"""Exact nearest neighbours among many references, without comparing all pairs.

Vectors: some references are pivots, every reference belongs to the cell of its nearest pivot, and for each
cell the least and greatest distance to each pivot is known (a table of pivots by pivots). The distances of a row to the
pivots then bound its distance to all of a cell from below (triangle inequality) and, pivots being references, its nearest
distance from above: it meets only the cells that these bounds leave. Cosines are compared as chords of unit vectors.
Near cells are packed up to a number of references, and a row is sent to a pack once, however many of its cells the bounds
leave: where they leave most, a row has as many copies as there are packs, not cells.

Hashes: the bits in chunks; two hashes within distance r agree in some chunk up to r / chunks bits, so rows
meet references by equal chunk values once the references stand under all values that near. The nearest one is found
by letting that radius grow until it covers the distance found.

Neither references nor rows pass through the driver, and no join is without an equality.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.workspace import written

#: Pivots of a set of references of one length; rows and references of a pack that meet in one task, and their scores
#: that are held at once.
PIVOTS, ROWS_TOGETHER, REFERENCES_TOGETHER, SCORES = 64, 16_384, 16_384, 1 << 22
#: Pivots are picked among so many times their number of references: below 1,000, so that tasks apply this limit
#: of a length before they shuffle.
SAMPLED = 15
#: Distances as near as this are taken for ties (cosines that agree to 12 digits differ less).
SLACK = 1e-5


def _usable(v: Column, cosine: bool) -> Column:
    v = F.transform(v.cast("array<double>"), lambda x: x)
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ok & (F.exists(v, lambda x: x != 0) if cosine else F.lit(True))


def _matrix(column):
    """Matrices of an Arrow list column: {length: (places, rows)}."""
    import numpy as np

    offsets = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    return {int(n): (own := np.flatnonzero(sizes == n), flat[offsets[own][:, None] + np.arange(n)[None, :]]) for n in np.unique(sizes)}


def _unit(m, cosine: bool):
    import numpy as np

    return m / np.sqrt((m * m).sum(1, keepdims=True)) if cosine else m


def _far(a, b):
    """Euclidean distances of all rows of a to all of b."""
    import numpy as np

    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _far_apart(m, most: int) -> list[int]:
    """Rows of m, each the farthest from those before it: they spread over the groups there are."""
    import numpy as np

    at, gap = [0], np.full(len(m), np.inf)
    while len(at) < most:
        gap = np.minimum(gap, _far(m, m[at[-1]][None])[:, 0])
        if gap.max() <= SLACK:
            break
        at.append(int(gap.argmax()))
    return at


def _packs(pivots, counts: list[int], most: int):
    """The pack of each cell: the nearest that are left join the first one that is, while a pack has at most so many references."""
    import numpy as np

    out, left, pack = np.full(len(pivots), -1), set(range(len(pivots))), 0
    while left:
        first, held = min(left), 0
        for k in [first, *np.argsort(_far(pivots[first][None], pivots)[0], kind="stable").tolist()]:
            if k in left and (k == first or held + counts[k] <= most):
                out[k], held = pack, held + counts[k]
                left.remove(k)
        pack += 1
    return out


class Pivots:
    """The cells of a set of references: pivots by vector length, and the references with their cells."""

    def __init__(self, references: DataFrame, tie: list[str], keep: str, cosine: bool, pivots: int = PIVOTS):
        """references: (tie..., keep, reference)."""
        from pyspark.sql import Window

        self.cosine, self.tie, self.keep, self.kind = cosine, tie, keep, references.schema[keep].dataType
        refs = references.select(*dict.fromkeys([*tie, keep]), F.col("reference").cast("array<double>").alias("reference")).filter(_usable(F.col("reference"), cosine))
        refs = written(refs.withColumn("size", F.size("reference")), "references")
        w = Window.partitionBy("size").orderBy(F.xxhash64(*tie), *tie)
        some = refs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLED * pivots).select("size", keep, "reference").collect()  # a bounded sample of each length
        import numpy as np

        self.pivots, self.names = {}, {}
        for n in {r["size"] for r in some}:
            own = [r for r in some if r["size"] == n]
            m = _unit(np.array([r["reference"] for r in own]), cosine)
            at = _far_apart(m, pivots)
            self.pivots[n], self.names[n] = m[at], [own[k][keep] for k in at]
        self.references = written(self._celled(refs), "cells")
        # for each cell the least and greatest distance to each pivot: at most pivots^2 pairs of numbers, from a task too
        some = self.references.select("reference", "cell").mapInArrow(self._spans(), "size int, cell int, pivot int, lo double, hi double, n long")
        some = some.groupBy("size", "cell", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
        self.low = {n: np.full((len(p), len(p)), np.inf) for n, p in self.pivots.items()}
        self.high = {n: np.full((len(p), len(p)), -np.inf) for n, p in self.pivots.items()}
        self.count: dict[tuple[int, int], int] = {}
        for r in some:
            self.low[r["size"]][r["cell"], r["pivot"]], self.high[r["size"]][r["cell"], r["pivot"]] = r["lo"], r["hi"]
            self.count[r["size"], r["cell"]] = r["n"]
        self.packs = {n: _packs(p, [self.count.get((n, k), 0) for k in range(len(p))], REFERENCES_TOGETHER) for n, p in self.pivots.items()}
        self.held: dict[tuple[int, int], int] = {}  # references of a pack
        for (n, cell), k in self.count.items():
            self.held[n, int(self.packs[n][cell])] = self.held.get((n, int(self.packs[n][cell])), 0) + k

    def packed(self) -> DataFrame:
        """The references, `cell` being the pack."""
        at = [(n, cell, int(pack)) for n, packs in self.packs.items() for cell, pack in enumerate(packs)]
        at = self.references.sparkSession.createDataFrame(at, "size int, cell int, pack int")
        return self.references.join(F.broadcast(at), ["size", "cell"]).drop("cell").withColumnRenamed("pack", "cell")

    def _spans(self):
        pivots, cosine = self.pivots, self.cosine

        def run(batches):
            import numpy as np
            import pyarrow as pa

            low = {n: np.full((len(p), len(p)), np.inf) for n, p in pivots.items()}
            high, count = {n: -m for n, m in low.items()}, {n: np.zeros(len(m), np.int64) for n, m in low.items()}
            for b in batches:
                cells = b.column("cell").to_numpy()
                for n, (own, v) in _matrix(b.column("reference")).items():
                    d = _far(_unit(v, cosine), pivots[n])
                    np.minimum.at(low[n], cells[own], d)
                    np.maximum.at(high[n], cells[own], d)
                    np.add.at(count[n], cells[own], 1)
            for n in pivots:
                own = np.flatnonzero(count[n])
                wide = len(count[n])
                columns = [np.full(len(own) * wide, n, np.int32), np.repeat(own, wide).astype(np.int32), np.tile(np.arange(wide, dtype=np.int32), len(own)), low[n][own].ravel(), high[n][own].ravel(), np.repeat(count[n][own], wide)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["size", "cell", "pivot", "lo", "hi", "n"])

        return run

    def _celled(self, refs: DataFrame) -> DataFrame:
        pivots, cosine = self.pivots, self.cosine

        def run(batches):
            import pyarrow as pa

            for b in batches:
                for n, (own, v) in _matrix(b.column("reference")).items():
                    d = _far(_unit(v, cosine), pivots[n])
                    part = b.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d.argmin(1), pa.int32())], names=[*part.schema.names, "cell"])

        return refs.mapInArrow(run, StructType([*refs.schema.fields, StructField("cell", IntegerType())]))

    def candidates(self, rows: DataFrame, key: list[str], most: int | None, limit: float | None, self_key: str | None, packed: bool = False) -> DataFrame:
        """(key..., encoding, size, cell): each row once for every cell that may hold one of its `most` nearest within
        the limit, or anything within it; `packed`, once for every pack with such a cell, and `cell` is the pack."""
        import numpy as np

        pivots, names, low, high, cosine = self.pivots, self.names, self.low, self.high, self.cosine
        into = {n: np.eye(int(p.max()) + 1, dtype=np.float32)[p] for n, p in self.packs.items()} if packed else {}
        rows = rows.select(*key, F.col("encoding").cast("array<double>").alias("encoding")).filter(_usable(F.col("encoding"), cosine) & F.size("encoding").isin(list(pivots)))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for n, (own, v) in _matrix(b.column("encoding")).items():
                    d = _far(_unit(v, cosine), pivots[n])
                    known = d.copy()
                    if self_key:  # a pivot that is the row itself tells nothing of its neighbours
                        at = {name: k for k, name in enumerate(names[n])}
                        for i, name in enumerate(b.column(self_key).take(pa.array(own)).to_pylist()):
                            if name in at:
                                known[i, at[name]] = np.inf
                    bound = np.partition(known, most - 1, axis=1)[:, most - 1] if most and known.shape[1] >= most else np.full(len(own), np.inf)
                    if limit is not None:
                        bound = np.minimum(bound, limit)
                    for s in range(0, len(own), 256):
                        x = d[s : s + 256, None, :]
                        least = np.maximum(x - high[n][None], low[n][None] - x).max(axis=2)  # an empty cell is infinitely far
                        near = least <= bound[s : s + 256, None] + SLACK
                        i, cell = np.nonzero(near.astype(np.float32) @ into[n] if into else near)
                        part = b.take(pa.array(own[s + i]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(i), n), pa.int32()), pa.array(cell, pa.int32())], names=[*part.schema.names, "size", "cell"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("size", IntegerType()), StructField("cell", IntegerType())]))

    def nearest(self, rows: DataFrame, key: list[str], most: int | None = 1, limit: float | None = None, self_key: str | None = None) -> DataFrame:
        """(key..., score, keep, rank): the `most` best references of each row, by cosine or negative distance; without
        `most` the best score for each value of `keep` within the limit (no rank).

        A pack's references and the rows that look into it meet in bounded pieces: the references in blocks, the
        rows dealt out by a salt, so that no pack is one task's work.
        """
        from pyspark.sql import Window

        met = written(self.candidates(rows, key, most, limit, self_key, packed=True), "candidates")
        sizes = met.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a pack
        salts = {(r["size"], r["cell"]): -(-r["n"] // ROWS_TOGETHER) for r in sizes}
        plan = [(n, cell, s, -(-self.held[n, cell] // REFERENCES_TOGETHER)) for (n, cell), s in salts.items()]
        pieces = rows.sparkSession.createDataFrame(plan, "size int, cell int, salts int, blocks int")
        left = met.join(F.broadcast(pieces), ["size", "cell"]).withColumn("salt", F.pmod(F.xxhash64(*key), "salts").cast("int"))
        left = left.select(*key, "encoding", "size", "cell", "salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = self.packed().join(F.broadcast(pieces), ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64(*self.tie), "blocks").cast("int"))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "blocks")
        group, tie, keep = ["size", "cell", "block", "salt"], self.tie, self.keep
        schema = StructType([*[rows.schema[k] for k in key], StructField("score", DoubleType()), StructField(keep, self.kind), *[StructField(f"_t{k}", right.schema[t].dataType) for k, t in enumerate(tie)]])
        found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_compared(key, tie, keep, self.cosine, limit, self_key, most), schema)
        if most is None:
            return found.groupBy(*key, keep).agg(F.max("score").alias("score")).select(*key, "score", keep)
        w = Window.partitionBy(*key).orderBy(F.round("score", 12).desc(), *[f"_t{k}" for k in range(len(tie))])
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(*key, "score", keep, "rank")


def _compared(key: list[str], tie: list[str], keep: str, cosine: bool, limit: float | None, self_key: str | None, most: int | None):
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        right = right.sort_by([(t, "ascending") for t in (tie if most else [keep])])
        v, r = left.column("encoding").combine_chunks(), right.column("reference").combine_chunks()
        rows, at, score = [], [], []
        if left.num_rows and right.num_rows:
            (_, v), (_, r) = _matrix(v).popitem()[1], _matrix(r).popitem()[1]
            v, r = _unit(v, cosine), _unit(r, cosine)
            ids, names = (left.column(self_key).to_pylist(), {n: k for k, n in enumerate(right.column(keep).to_pylist())}) if self_key else (None, {})
            step = min(1024, max(16, SCORES // len(r)))
            for s in range(0, len(v), step):
                scores = v[s : s + step] @ r.T if cosine else -_far(v[s : s + step], r)
                if ids:
                    for i, name in enumerate(ids[s : s + step]):
                        if name in names:
                            scores[i, names[name]] = -np.inf
                if limit is not None:
                    scores[scores < ((2 - limit * limit) / 2 if cosine else -limit) - (1e-12 if cosine else 0)] = -np.inf
                if most is None:
                    ref = right.column(keep).to_pylist()
                    heads = np.flatnonzero([k == 0 or ref[k] != ref[k - 1] for k in range(len(ref))])
                    best = np.maximum.reduceat(scores, heads, axis=1)
                    i, j = np.nonzero(np.isfinite(best))
                    rows.append(s + i)
                    at.append(heads[j])
                    score.append(best[i, j])
                    continue
                ranked = np.round(scores, 12)
                for _ in range(min(most, len(r))):
                    best = ranked.argmax(1)  # the first at ties
                    own = np.flatnonzero(np.isfinite(ranked[np.arange(len(best)), best]))
                    rows.append(s + own)
                    at.append(best[own])
                    score.append(scores[own, best[own]])
                    ranked[np.arange(len(best)), best] = -np.inf
        rows, at, score = (np.concatenate(x) if x else np.empty(0, dtype=t) for x, t in ((rows, np.int64), (at, np.int64), (score, np.float64)))
        left, right = left.take(pa.array(rows)), right.take(pa.array(at))
        return pa.table([*[left.column(k) for k in key], pa.array(score), right.column(keep), *[right.column(t) for t in tie]], names=[*key, "score", keep, *[f"_t{k}" for k in range(len(tie))]])

    return run


def nearest_vectors(rows: DataFrame, key: list[str], references: DataFrame, tie: list[str], keep: str, least: float | None = None, euclidean: bool = False, self_key: str | None = None, most: int | None = 1, pivots: int = PIVOTS) -> DataFrame:
    """(key..., score, keep, rank) for rows (key..., encoding) and references (tie..., keep, reference), as best_vectors of
    `similarity`; null, empty and non-finite vectors, and zero ones under the cosine, have no neighbours."""
    cells = Pivots(references, tie, keep, not euclidean, pivots)
    if not cells.pivots:
        none = rows.select(*key, F.lit(0.0).alias("score"), F.lit(None).cast(cells.kind).alias(keep), F.lit(0).alias("rank")).limit(0)
        return none if most else none.drop("rank")
    limit = None if least is None else -least if euclidean else math.sqrt(max(0.0, 2 - 2 * least))
    return cells.nearest(rows, key, most, limit, self_key)


# hashes ---------------------------------------------------------------------------------

BITS = 64
#: References up to which chunks have 8 bits: a bucket then holds at most some 256; beyond, 16 bits.
FEW_HASHES = 65_536
#: Rows of the flipped chunks of the references up to which the planner may broadcast them: it takes them for as few as the references.
FEW_FLIPPED = 200_000
#: Among so few the nearest hash is likely far, and the first round goes one bit further.
FAR_APART = 4_096


def chunks_of(h: Column, chunks: int) -> Column:
    """The chunks of a hash (hi, lo as in vectors.hash_bits), the highest first."""
    wide = BITS // chunks
    half = chunks // 2
    take = lambda part, k: F.call_function("shiftright", h[part], F.lit(wide * (half - 1 - k))).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))
    return F.array(*[take("hi", k) for k in range(half)], *[take("lo", k) for k in range(half)])


def near_values(t: int, wide: int) -> list[int]:
    """All differences of exactly t bits in a chunk."""
    return [sum(1 << b for b in bits) for bits in combinations(range(wide), t)]


def nearest_hashes(rows: DataFrame, key: list[str], references: DataFrame, tie: list[str], keep: str, within: int | None = None, chunks: int | None = None, each: bool = False) -> DataFrame:
    """(key..., distance, keep): for each row the reference of the least Hamming distance, ties to the least `tie`;
    with `each` the least distance for every value of `keep` (only with `within`).

    rows: (key..., h), references: (tie..., keep, h), h as vectors.hash_bits makes it. With `within`, one join
    covers all distances up to it and rows beyond it have no result. Without, the radius of a chunk grows by one bit a
    round; a row is settled once its distance is below `chunks` times the next radius, and only rows that are
    not go on. In a round references stand only under the values that differ by that many bits, so no value is met twice.
    """
    from ..functions.vectors import hamming_bits

    cols = dict.fromkeys([*tie, keep])
    has = F.col("h.hi").isNotNull() & F.col("h.lo").isNotNull()
    rows, refs = rows.filter(has), references.filter(has).select(*cols, "h")
    if within is None and refs.isEmpty():
        return rows.select(*key, F.lit(0.0).alias("distance"), F.lit(None).cast(refs.schema[keep].dataType).alias(keep)).limit(0)
    n = refs.limit(FEW_HASHES + 1).count()
    chunks = chunks or (8 if n <= FEW_HASHES else 4)
    wide = BITS // chunks
    last = wide if within is None else min(wide, within // chunks)
    dealt = lambda h: F.posexplode(chunks_of(h, chunks)).alias("chunk", "value")

    def joined(left: DataFrame, radii) -> DataFrame:
        flips = [x for t in radii for x in near_values(t, wide)]
        near = refs.select(*[F.col(c).alias(f"_r_{c}") for c in cols], F.col("h").alias("_rh"), dealt(F.col("h"))).withColumn("value", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]) if len(flips) < 64 else _table(flips), lambda x: F.col("value").bitwiseXOR(x))))
        if n * chunks * len(flips) > FEW_FLIPPED:
            near = near.hint("merge")
        met = left.select(*key, "h", dealt(F.col("h"))).join(near, ["chunk", "value"])
        d = hamming_bits("h", "_rh")
        met = met.select(*key, d.alias("_d"), *[f"_r_{c}" for c in cols])
        if within is not None:
            met = met.filter(F.col("_d") <= within)
        if each:
            return met.groupBy(*key, F.col(f"_r_{keep}").alias(keep)).agg(F.min("_d").alias("distance")).select(*key, "distance", keep)
        rank = F.struct("_d", *[f"_r_{t}" for t in tie])
        return met.groupBy(*key).agg(F.min(rank).alias("_b"), F.min_by(f"_r_{keep}", rank).alias(keep))

    if within is not None:
        best = joined(rows, range(last + 1))
        if each:
            return best
        return best.select(*key, F.col("_b._d").alias("distance"), keep)
    done, open_rows, so_far = None, written(rows.select(*key, "h"), "hashes"), None
    start = 2 if n <= FAR_APART else 1
    for t in range(start, last + 1):
        found = joined(open_rows, range(t + 1) if t == start else [t])
        so_far = found if so_far is None else so_far.unionByName(found).groupBy(*key).agg(F.min_by(keep, "_b").alias(keep), F.min("_b").alias("_b"))
        so_far = written(so_far.select(*key, "_b", keep), "nearest")
        settled = so_far.filter(F.col("_b._d") < chunks * (t + 1))
        done = settled if done is None else done.unionByName(settled)
        open_rows = written(open_rows.join(settled.select(*key), key, "left_anti"), "hashes")
        if open_rows.isEmpty():
            break
        so_far = so_far.filter(F.col("_b._d") >= chunks * (t + 1))
    return done.select(*key, F.col("_b._d").alias("distance"), keep)


def _table(flips: list[int]) -> Column:
    """Many numbers as one array literal."""
    return F.from_json(F.lit(str(flips)), "array<bigint>")
