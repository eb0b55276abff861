"""Learning references in parallel: of vectors in order, those that are far from all kept before them.

One after the other this is a fold over everything a persona has. Here all rows move in rounds: a row without an
earlier near row among the open ones is kept, rows near a kept one that comes before them go, the rest stay open for the
next round. The result is that of the fold, and the rounds are as many as the longest run of rows each of which
waits for the one before it. Near rows are found in the cells of pivots (`neighbours`); a row only
learns whether it has an earlier near row, so a thousand copies cost a thousand answers, not a million pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DISTINCT_COSINE
from ..sources.workspace import written
from . import neighbours
from .detect import distinct_references
from .neighbours import Pivots, _matrix, _unit

KEY = ["persona_id", "seq"]
#: Rows up to which one task a persona folds them in order, which gives the same and takes one job.
FEW = 5_000


def _earlier(least: float, step: int = 1024):
    """For a piece's rows and references: the rows with a reference before them at `least` or more. References come
    in order and in steps, and a row that has found one is not compared any more."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        hit = np.zeros(left.num_rows, dtype=bool)
        if left.num_rows and right.num_rows:
            right = right.sort_by("seq")
            (_, v), (_, r) = _matrix(left.column("encoding").combine_chunks()).popitem()[1], _matrix(right.column("reference").combine_chunks()).popitem()[1]
            v, r = _unit(v, True), _unit(r, True)
            at, before = left.column("seq").to_numpy(), right.column("seq").to_numpy()
            for s in range(0, len(r), step):
                for a in range(0, len(v), step):
                    own = a + np.flatnonzero(~hit[a : a + step] & (at[a : a + step] > before[s]))
                    if len(own):
                        hit[own] = ((v[own] @ r[s : s + step].T >= least) & (before[None, s : s + step] < at[own, None])).any(axis=1)
        return left.filter(pa.array(hit)).select(KEY)

    return run


def _with_earlier(rows: DataFrame, references: DataFrame, least: float) -> DataFrame:
    """KEY of the rows (candidates of their cells) that have an earlier near reference of their persona."""
    place = ["persona_id", "size", "cell"]
    many = lambda df, most, name: df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    pieces = many(rows, neighbours.ROWS_TOGETHER, "salts").join(many(references, neighbours.REFERENCES_TOGETHER, "blocks"), place)
    spread = lambda df, own, other, into, copied: df.join(pieces, place).withColumn(into, F.pmod(F.xxhash64("seq"), own).cast("int")).withColumn(copied, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("salts", "blocks")
    left, right = spread(rows, "salts", "blocks", "salt", "block"), spread(references, "blocks", "salts", "block", "salt")
    group = [*place, "salt", "block"]
    schema = StructType([rows.schema[k] for k in KEY])
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_earlier(least), schema).distinct()


def first_encodings(rows: DataFrame, least: float = DISTINCT_COSINE) -> DataFrame:
    """rows (persona_id, seq, encoding), one a persona and seq: persona_id, seq, first. A vector is a first one if its cosine to
    every vector before it, learnt or not, is below `least`. Odd vectors are near nothing, as in `learned_encodings`.

    First ones are what the first round below keeps; later rounds also keep rows that are near rows left out only.
    """
    rows = written(rows.select(*KEY, F.col("encoding").cast("array<double>").alias("encoding")), "learnt")
    found = _cells(rows, least)
    if found is None:
        return rows.select(*KEY, F.lit(True).alias("first"))
    later = _with_earlier(*found, least).withColumn("_later", F.lit(True))
    return rows.select(*KEY).join(later, KEY, "left").select(*KEY, F.col("_later").isNull().alias("first"))


def _cells(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame] | None:
    """Rows as candidates of the packs of cells that may hold one near them, and rows as references in their packs; None if no row has
    a vector that can be compared."""
    cells = Pivots(rows.withColumnRenamed("encoding", "reference"), KEY, "seq", True)
    if not cells.pivots:
        return None
    met = written(cells.candidates(rows, KEY, None, math.sqrt(2 - 2 * least), None, packed=True), "candidates")
    return met, cells.packed().select(*KEY, "reference", "size", "cell")


def learned_encodings(rows: DataFrame, least: float = DISTINCT_COSINE, few: int = FEW, since: int | None = None) -> DataFrame:
    """rows (persona_id, seq, encoding), one a persona and seq: persona_id, seq, kept. A vector is learnt if its cosine to all
    kept ones before it is below `least`. Rows without a vector, or with one of zeros or with null or non-finite
    components, are near nothing: they are kept. Vectors of unequal length are not near. Rows whose seq is below `since`
    are references already: they are all kept, near each other or not, and what is near one of them is not learnt.
    """
    rows = written(rows.select(*KEY, F.col("encoding").cast("array<double>").alias("encoding")), "learnt")
    if rows.limit(few + 1).count() <= few:
        usable = F.forall("encoding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return distinct_references(rows.select(*KEY, F.when(usable, F.col("encoding")).alias("encoding"), F.lit("").alias("signature")), least, since)
    found = _cells(rows, least)
    if found is None:
        return rows.select(*KEY, F.lit(True).alias("kept"))
    met, refs = found
    still, dropped = None, None
    if since is not None:
        new = F.col("seq") >= since
        dropped = written(_with_earlier(met.filter(new), refs.filter(~new), least), "gone")
        still = written(rows.select(*KEY).filter(new).join(dropped, KEY, "left_anti"), "open")
    while True:
        open_ = (lambda df: df) if still is None else (lambda df, own=still: df.join(own, KEY, "left_semi"))
        waiting = written(_with_earlier(open_(met), open_(refs), least), "waiting")
        if waiting.isEmpty():
            break
        # open rows that wait for none are kept; what is near them and later goes
        sure = open_(refs).join(waiting, KEY, "left_anti")
        gone = written(_with_earlier(met.join(waiting, KEY, "left_semi"), sure, least), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        still = written(waiting.join(gone, KEY, "left_anti"), "open")
        if still.isEmpty():
            break
    if dropped is None:
        return rows.select(*KEY, F.lit(True).alias("kept"))
    return rows.select(*KEY).join(dropped.withColumn("_gone", F.lit(True)), KEY, "left").select(*KEY, F.col("_gone").isNull().alias("kept"))
