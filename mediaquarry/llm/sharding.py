"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts stay together).

Groups go in falling size to the bin with the least remaining room that still takes them; bins hang in
a balanced tree keyed by that room. Groups of one size are alike, so the driver packs the histogram of
group sizes (its rows: the distinct sizes, not the groups), many groups of a size at a step, with the
same outcome as one at a time. A group's place in the falling order then tells its bin.

With a fixed number of shards the capacity is the least one for which best fit needs no more bins; a
group larger than an even share of what is left gets a shard of its own first. Sizes so come out near
equal (law `bytes`).

Defined results: a null text has no bytes, checksum 0, and is in one group with other nulls, apart from
empty texts; repeated rows are rows of their own in one group; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, running, small, table

SHARDS, OVERHEAD = 24, 8
SLICE_ROWS = 50_000


class RoomTree:
    """An AA tree of (room, bin) pairs: insert, remove and the least pair with at least some room."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # nodes: [level, key, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][0] == t[0]:
            low = t[2]
            t[2], low[3] = low[3], t
            return low
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][0] == t[0]:
            high = t[3]
            t[3], high[2] = high[2], t
            high[0] += 1
            return high
        return t

    def insert(self, key):
        def add(t):
            if t is None:
                return [1, key, None, None]
            side = 2 if key < t[1] else 3
            t[side] = add(t[side])
            return self._split(self._skew(t))

        self.root = add(self.root)

    def remove(self, key):
        def cut(t, key):
            if t is None:
                return None
            if key != t[1]:
                side = 2 if key < t[1] else 3
                t[side] = cut(t[side], key)
            elif t[2] is None and t[3] is None:
                return None
            elif t[2] is None:
                low = t[3]
                while low[2]:
                    low = low[2]
                t[1] = low[1]
                t[3] = cut(t[3], low[1])
            else:
                high = t[2]
                while high[3]:
                    high = high[3]
                t[1] = high[1]
                t[2] = cut(t[2], high[1])
            least = 1 + min(t[2][0] if t[2] else 0, t[3][0] if t[3] else 0)
            if least < t[0]:
                t[0] = least
                if t[3] and t[3][0] > least:
                    t[3][0] = least
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t

        self.root = cut(self.root, key)

    def tightest(self, room):
        """The least (room', bin) with room' >= room, or None."""
        t, best = self.root, None
        while t:
            if t[1][0] >= room:
                best, t = t[1], t[2]
            else:
                t = t[3]
        return best


def best_fit(classes: list[tuple[int, int]], capacity: int, most: int | None = None):
    """classes: (size, how many) in falling size. Returns ([(bin, how many), ...] in that order, bins),
    or None when more than `most` bins are needed. A group above the capacity gets a bin of its own."""
    tree, runs, bins = RoomTree(), [], 0
    for size, count in classes:
        while count:
            at = tree.tightest(size)
            if at is None:
                at = (max(capacity, size), bins)
                bins += 1
                if most is not None and bins > most:
                    return None
            else:
                tree.remove(at)
            room, b = at
            k = min(count, room // size) if size else count
            runs.append((b, k))
            count -= k
            if room - k * size > 0 or not size:
                tree.insert((room - k * size, b))
    return runs, bins


def pack_fixed(classes: list[tuple[int, int]], shards: int):
    """Runs for a fixed number of shards, with the least capacity best fit can keep to."""
    runs, first, classes = [], 0, list(classes)
    total = sum(s * c for s, c in classes)
    while classes and first < shards - 1 and classes[0][0] * (shards - first) >= total and classes[0][0] > 0:
        size, count = classes[0]
        runs.append((first, 1))
        first, total = first + 1, total - size
        classes = ([(size, count - 1)] if count > 1 else []) + classes[1:]
    if not classes:
        return runs
    left = shards - first
    low = max(classes[0][0], -(-total // left)) if total else 1
    high = low
    while (found := best_fit(classes, high, left)) is None:
        high = high + max(1, high // 64)
    best = found
    while high - low > max(0, low // 200_000):
        mid = (low + high) // 2
        found = best_fit(classes, mid, left)
        if found is None:
            low = mid + 1
        else:
            high, best = mid, found
    return runs + [(first + b, k) for b, k in best[0]]


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, overhead: int = OVERHEAD, whole: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; give `shards`, or `capacity` for the fewest shards
    of that size. `whole` adds the struct `row`, the row's own columns."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col("text")
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(*own, "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.md5(text), F.lit("null")).alias("same"))
    rows = scratch.write(rows, "rows")
    sets = rows.groupBy("same").agg(F.sum("size").alias("weight"))
    ordered = scratch.write(running(sets, [F.col("weight").desc(), F.col("same")], F.lit(1.0), scratch, "groups"), "ordered")
    classes = [(r[0], r[1]) for r in ordered.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("weight").desc()).collect()]
    runs = pack_fixed(classes, shards) if capacity is None else best_fit(classes, capacity)[0]

    def place(batches):
        import numpy as np
        import pyarrow as pa

        ends = np.cumsum([k for _, k in runs])
        bins = np.array([b for b, _ in runs], dtype=np.int32)
        for b in batches:
            pos = np.rint(b.column("_pos").to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("same"), pa.array(bins[np.searchsorted(ends, pos, side="right")])], names=["same", "shard"])

    to = ordered.select("same", "_pos").mapInArrow(place, "same string, shard int")
    placed = rows.join(small(scratch.write(to, "bins")), "same")
    count = rows.count()
    slices = max(16, count // (SLICE_ROWS * max(1, shards or 1)))
    placed = scratch.write(placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "same"), F.lit(slices)).cast("int")), "placed")
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.write(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "starts")
    rank = Window.partitionBy("shard", "slice").orderBy("doc_id", "same")
    out = placed.withColumn("rank", F.row_number().over(rank) - 1).join(small(starts), ["shard", "slice"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), *(["row"] if whole else []))


def shard_rows(docs: DataFrame, shards: int = SHARDS, whole: bool = False) -> DataFrame:
    """The digest columns; `whole` adds the struct `row`, the row's own columns."""
    out = shard(docs, shards, whole=whole)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(["row"] if whole else []))


def op3_bfd_shards(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))
