"""Groups of detections that may meet in a clustering: connected components of the graph of near ones.

Links are found in pieces (cells of pivots, equal hashes, near hashes), and a piece sends a forest of what it has
connected, never its pairs. Nodes are 64-bit hashes of ids: should two ids share one, their groups are united, which
keeps what must stay together together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hash_bits
from ..sources.workspace import written
from . import neighbours
from .neighbours import Pivots, _matrix, _unit, nearest_hashes

#: Rows of a piece: as many as let it hold one bit of nearness for every row and reference; of those it looks at STEP at once.
TOGETHER, STEP = 8192, 256
LINKS = "a long, b long"


def _united(least: float):
    """For a piece's rows and references: each to the first reference that its links lead to."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if left.num_rows and right.num_rows:
            (_, v), (_, r) = _matrix(left.column("encoding").combine_chunks()).popitem()[1], _matrix(right.column("reference").combine_chunks()).popitem()[1]
            v, r = _unit(v, True), _unit(r, True)
            bits = np.concatenate([np.packbits(v[s : s + STEP] @ r.T >= least - 1e-9, axis=1) for s in range(0, len(v), STEP)])
            near = lambda s: np.unpackbits(bits[s : s + STEP], axis=1, count=len(r)).astype(bool)
            rows, refs = left.column("node").to_numpy(), right.column("ref").to_numpy()
            far = len(refs)
            label, own = np.arange(far), np.full(len(rows), far)
            while True:
                moved = label.copy()
                for s in range(0, len(rows), STEP):
                    some = near(s)
                    own[s : s + STEP] = np.where(some, label[None, :], far).min(axis=1)
                    moved = np.minimum(moved, np.where(some, own[s : s + STEP, None], far).min(axis=0))
                if (moved == label).all():
                    break
                label = moved
            hit = own < far
            a += [rows[hit], refs]
            b += [refs[own[hit]], refs[label]]
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return run


def vector_links(rows: DataFrame, references: DataFrame, least: float) -> DataFrame:
    """LINKS between rows (node, encoding) and references (ref, reference) of cosine `least` or more, as forests."""
    cells = Pivots(references, ["ref"], "ref", True)
    if not cells.pivots:
        return rows.sparkSession.createDataFrame([], LINKS)
    met, refs = written(cells.candidates(rows, ["node"], None, math.sqrt(max(0.0, 2 - 2 * least)), None, packed=True), "candidates"), cells.packed()
    place = ["size", "cell"]
    many = lambda df, most, name: df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    pieces = many(met, TOGETHER, "salts").join(many(refs, neighbours.REFERENCES_TOGETHER, "blocks"), place)
    left = met.join(pieces, place).withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = refs.join(pieces, place).withColumn("block", F.pmod(F.xxhash64("ref"), "blocks").cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    group = [*place, "salt", "block"]
    left, right = left.select(*group, "node", "encoding"), right.select(*group, "ref", "reference")
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_united(least), LINKS)


def star(rows: DataFrame, by: str) -> DataFrame:
    """LINKS from each node of a group to the group's least."""
    least = rows.groupBy(by).agg(F.min("node").alias("b"))
    return rows.join(least, by).select(F.col("node").alias("a"), "b").filter("a <> b")


def hash_links(rows: DataFrame, references: DataFrame, within: float) -> DataFrame:
    """LINKS between rows and references (node, signature) within so many bits. Equal hashes are linked to one of
    them, and distinct ones compared. Strings that are no 16-digit hex hashes may compare with anything: if there are any, all
    rows with a signature are linked."""
    every = rows.unionByName(references).filter(F.coalesce("signature", F.lit("")) != "").withColumn("signature", F.lower("signature")).distinct()
    if not every.filter(~F.col("signature").rlike("^[0-9a-f]{16}$")).isEmpty():
        return star(every.withColumn("every", F.lit(True)), "every")
    equal = star(every, "signature")
    one = lambda df: df.filter(F.coalesce("signature", F.lit("")) != "").select(F.lower("signature").alias("signature")).distinct()
    some = every.groupBy("signature").agg(F.min("node").alias("node"))
    near = nearest_hashes(one(rows).withColumn("h", hash_bits("signature")), ["signature"], one(references).select(F.col("signature").alias("other"), hash_bits("signature").alias("h")), ["other"], "other", int(within), each=True)
    near = near.filter("signature <> other").join(some.withColumnRenamed("node", "a"), "signature").join(some.select(F.col("signature").alias("other"), F.col("node").alias("b")), "other")
    return equal.unionByName(near.select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node reaches. Stars are drawn towards least nodes,
    turn by turn over larger and over smaller neighbours, until nothing moves."""

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()

    # a > b in all edges
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    last = None
    while (now := state(edges)) != last:
        last = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = written(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
