"""Embedding near-duplicates through a forest of random-projection trees with spill.

Equal vectors collapse first. Each tree splits by random directions at medians fitted on a bounded
sample (`SAMPLE` rows of least hash); vectors within `SPILL` of a split go down both sides. Every row is
routed through every tree. Below the sampled splits, when the table is larger than the sample can split
to leaves of about `LEAF` rows, further random directions through the leaf's sampled centre split on, so
leaves stay of about one size whatever the table. In a leaf all pairs are compared by cosine in double
precision; a leaf of more than `BLOCK` rows is compared block by block in tasks of their own, so no leaf
is too large for a task and none is cut.

No pair leaves its task. A vector brings the codes of its leaves that come before the present one, and a
link counts only in the first leaf that both vectors share: a block gives each vector its number of such
links and one edge to the least vector it reaches in the block. Sums of the numbers are n_links, the
components of the edges are the groups; both shuffle rows by vectors, not by pairs.

Measured recall of links on the given tables is in the README; tests hold it to brute force. A vector
stands in several leaves of a tree (about 31 in all 12 trees at 20,000 rows, more as trees get deeper).

Defined results: null or zero vectors, and vectors with null or non-finite components, link with nothing;
vectors of different lengths are not compared; rows that repeat a vec_id are one vector; rows without a
vec_id link with nothing, have a null component_id and are kept, each; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, groups, release, small, table
from .components import connected_components

TREES, SAMPLE, LEAF, SPILL, BLOCK, SEED = 12, 20_000, 128, 0.02, 512, 11


class Tree:
    """Flat arrays of one tree: direction, threshold and children of each inner node; leaves are negative."""

    def __init__(self, sample, rng, leaf: int, deeper: int):
        import numpy as np

        dim = sample.shape[1]
        self.dirs, self.cuts, self.kids, self.centres = [], [], [], []
        self.deeper = rng.normal(size=(deeper, dim)) / math.sqrt(dim) if deeper else np.zeros((0, dim))

        def grow(rows):
            if len(rows) <= leaf:
                self.centres.append(sample[rows].mean(0) if len(rows) else np.zeros(dim))
                return -len(self.centres)
            g = rng.normal(size=dim)
            g /= np.linalg.norm(g)
            p = sample[rows] @ g
            cut = float(np.median(p))
            left, right = rows[p < cut], rows[p >= cut]
            if not len(left) or not len(right):  # all alike along g: nothing to split
                self.centres.append(sample[rows].mean(0))
                return -len(self.centres)
            at = len(self.dirs)
            self.dirs.append(g)
            self.cuts.append(cut)
            self.kids.append([0, 0])
            self.kids[at] = [grow(left), grow(right)]
            return at

        self.root = grow(np.arange(len(sample)))

    def route(self, x, spill: float):
        """(row, leaf) arrays: every leaf that a row reaches."""
        import numpy as np

        rows, leaves, stack = [], [], [(self.root, np.arange(len(x)))]
        while stack:
            at, own = stack.pop()
            if not len(own):
                continue
            if at < 0:
                code = np.full(len(own), -at - 1, dtype=np.int64)
                for d in self.deeper:
                    p = (x[own] - self.centres[-at - 1]) @ d
                    both = np.abs(p) < spill
                    code = code * 2 + (p >= 0)
                    own, code = np.concatenate([own, own[both]]), np.concatenate([code, code[both] ^ 1])
                rows.append(own)
                leaves.append(code)
            else:
                p = x[own] @ self.dirs[at] - self.cuts[at]
                stack += [(self.kids[at][0], own[p < spill]), (self.kids[at][1], own[p >= -spill])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _packed(a) -> bytes:
    """A vector's bytes behind their width, 4 where single precision holds it exactly."""
    import numpy as np

    with np.errstate(over="ignore"):
        half = a.astype(np.float32)
    return b"4" + half.tobytes() if (half == a).all() else b"8" + a.tobytes()


def _unpacked(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, dtype=np.float32 if raw[:1] == b"4" else np.float64, offset=1).astype(np.float64)


def _matrix(vectors):
    import numpy as np

    return np.array([_unpacked(v) for v in vectors])


def _clean(batches):
    """(vec_id, raw, dim): packed vectors that can link, null for others."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        raw, dim = [], []
        for v in b.column(1).to_pylist():
            a = np.array(v, dtype=np.float64) + 0.0 if v and None not in v else None
            able = a is not None and np.isfinite(a).all() and np.any(a)
            raw.append(_packed(a) if able else None)
            dim.append(len(a) if able else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(dim, pa.int32())], names=["vec_id", "raw", "dim"])


def _unit(x):
    """Rows of length 1. Scaling by the largest component first keeps tiny and huge vectors finite."""
    import numpy as np

    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _route(trees, spill: float):
    """(code, id, before): a row for each leaf a vector reaches; code names dimension, tree and leaf, before
    holds the vector's codes that are less than this one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, raw, dims = b.column("id").to_numpy(), b.column("raw").to_pylist(), b.column("dim").to_numpy()
            for size in np.unique(dims):
                own = np.flatnonzero(dims == size)
                x = _unit(_matrix([raw[i] for i in own]))
                rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for t, tree in enumerate(trees.value.get(int(size), [])):
                    r, leaves = tree.route(x, spill)
                    rows.append(r)
                    codes.append(leaves + ((int(size) * 64 + t) << 40))
                rows, codes = np.concatenate(rows), np.concatenate(codes)
                order = np.lexsort((codes, rows))
                rows, codes = rows[order], codes[order]
                start = np.searchsorted(rows, rows, side="left")
                flat = codes.tobytes()
                before = [flat[8 * s : 8 * k] for k, s in enumerate(start.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(ids[own][rows]), pa.array(before, pa.binary())], names=["code", "id", "before"])

    return run


def _shared(before, rows, n: int):
    """n x n: whether two of the chosen rows have a code in common among those before."""
    import numpy as np

    out = np.zeros((n, n), dtype=bool)
    codes = [np.frombuffer(before[r], dtype=np.int64) for r in rows]
    who = np.repeat(rows, [len(c) for c in codes])
    codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    order = np.argsort(codes, kind="stable")
    codes, who = codes[order], who[order]
    ends = np.flatnonzero(np.concatenate((codes[1:] != codes[:-1], [True]))) + 1 if len(codes) else []
    at = 0
    for end in ends:
        if end - at > 1:
            out[np.ix_(who[at:end], who[at:end])] = True
        at = end
    return out


def _least_reached(near):
    """For each row of a symmetric n x n relation the least row that it reaches."""
    import numpy as np

    n = len(near)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], n).min(1))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _links(least: float):
    """(id, root, n): for each vector of a block with links its new links' weight and the edge of its group."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for key, t in groups(batches, ["code", "ba", "bb"]):
            ids, block, weight = t.column("id").to_numpy(), t.column("block").to_numpy(), t.column("weight").to_numpy()
            x = _unit(_matrix(t.column("raw").to_pylist()))
            near = x @ x.T >= least
            if key[1] != key[2]:  # pairs inside a block are another task's
                near &= block[:, None] != block[None, :]
            near = (near | near.T) & (ids[:, None] != ids[None, :])
            some = np.flatnonzero(near.any(1))
            if not len(some):
                continue
            fresh = near & ~_shared(t.column("before").to_pylist(), some, len(ids))
            some = np.flatnonzero(fresh.any(1))
            root, n = _least_reached(fresh), fresh @ weight
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(n[some], pa.int64())], names=["id", "root", "n"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, spill: float = SPILL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id): a row for each vector."""
    import numpy as np

    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    nameless = clean.filter("vec_id is null").select("vec_id")
    clean = clean.filter("vec_id is not null").mapInArrow(_clean, "vec_id long, raw binary, dim int").groupBy("vec_id").agg(F.max("raw").alias("raw"), F.max_by("dim", "raw").alias("dim"))
    clean = scratch.write(clean, "vectors")
    reps = scratch.write(clean.filter("raw is not null").groupBy("raw", "dim").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")), "reps")
    by_size = {r[0]: r[1] for r in reps.groupBy("dim").count().collect()}
    forest: dict[int, list[Tree]] = {}
    for size, n in sorted(by_size.items()):
        picked = reps.filter(F.col("dim") == size).select("raw", F.xxhash64("id").alias("h")).orderBy("h", "raw").limit(sample).collect()
        x = _unit(_matrix([r[0] for r in picked]))
        own_leaf = max(8, min(leaf, int(leaf * len(x) / n)))
        deeper = max(0, round(math.log2(n / len(x) * own_leaf / leaf)))
        rng = np.random.default_rng(SEED)
        forest[size] = [Tree(x, rng, own_leaf, deeper) for _ in range(trees)]
    routed = scratch.write(reps.select("id", "raw", "dim").mapInArrow(_route(spark.sparkContext.broadcast(forest), spill), "code long, id long, before binary"), "routed")
    large = scratch.write(routed.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")).filter("nb > 1"), "large")
    dealt = routed.join(small(large), "code", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("code", F.least("block", "other").alias("ba"), F.greatest("block", "other").alias("bb"), "block", "id", "before")
    full = dealt.join(small(reps.select("id", "raw", "weight")), "id")
    keys = ["code", "ba", "bb"]
    found = full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(least), "id long, root long, n long")
    found = scratch.write(found, "links")
    scratch.drop(routed, large)
    release(spark)
    comps = connected_components(found.select("id", "root"), scratch).withColumnRenamed("id", "rep")
    others = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("others"))
    classes = clean.select("vec_id", "raw").join(reps.select("raw", F.col("id").alias("rep"), "weight"), "raw", "left").drop("raw")
    out = classes.join(others, "rep", "left").join(comps, "rep", "left")
    count = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.coalesce("others", F.lit(0)) + F.col("weight") - 1)
    out = out.select("vec_id", count.cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.unionByName(nameless.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op5_forest_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len([x for x in e if isfinite(x)]) = len(e) AND list_sum([abs(x) for x in e]) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM ok UNION SELECT pairs.b, r.c FROM r JOIN pairs ON pairs.a = r.id),
comp AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(comp.c, vec_id) AS component_id, coalesce(comp.c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.id = vec_id
"""
