"""Connected components of an edge table, by alternating large-star and small-star contractions.

Every step is a keyed minimum (combined map-side) and an equi-join, so a vertex of any degree is
spread over tasks; nothing but three counts a round reaches the driver. Before the first round each
partition shrinks its own edges to a forest of stars. As soon as at most `FEW` edges are left, one task
finishes them by union-find (`FEW` is below `MOST_KEPT`, so all meet in one forest): its memory is bounded
by that constant, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, tidied

MOST_ROUNDS, FEW, MOST_KEPT = 60, 100_000, 500_000


def forest(a, b):
    """Union-find over two arrays of ids: (node, root) pairs, root the least id of its tree."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b):
        rx, ry = find(x), find(y)
        parent.setdefault(x, x)
        parent.setdefault(y, y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
    return [(x, find(x)) for x in parent]


def _shrink(batches):
    """The edges of a partition as forests of stars: one, but for every `MOST_KEPT` links a new one."""
    import pyarrow as pa

    def starred(links):
        kept = [(x, r) for x, r in forest(*zip(*links)) if x != r]
        for i in range(0, len(kept), 50_000):
            part = kept[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["u", "v"])

    kept: list[tuple[int, int]] = []
    for b in batches:
        kept += [(x, r) for x, r in forest(b.column(0).to_pylist(), b.column(1).to_pylist()) if x != r]
        if len(kept) > MOST_KEPT:
            yield from starred(kept)
            kept = []
    if kept:  # batches are forests of their own: their links meet here
        yield from starred(kept)


def connected_components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """edges: two long columns, in any order and with repeats. Returns (id, component): every vertex of
    an edge with the least id it reaches. Self-loops and edges with nulls are left out."""
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    e = scratch.write(e.mapInArrow(tidied(_shrink), "u long, v long"), "edges")
    for _ in range(MOST_ROUNDS):
        n, heads = e.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n <= few:
            e = e.coalesce(1).mapInArrow(tidied(_shrink), "u long, v long")
            break
        if n == heads and not e.join(e.select(F.col("u").alias("w")), e.v == F.col("w"), "left_semi").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("y"), F.least("u", "m").alias("m"))
        large = e.join(least, e.v == least.y).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), large.u == F.col("w")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small, "edges")
        scratch.drop(e)
        e = new
        release(scratch.spark)
    else:
        raise RuntimeError("components have not settled")
    return scratch.write(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
