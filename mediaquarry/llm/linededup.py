"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table (key binary(16), n long), bucketed and sorted by key. Documents come in batches. A batch
counts its keys (documents that hold them), and merge-anti-joins all runs: keys that no run holds become a
run of level 0; counts of keys that some run holds already go to the increments. A key so lies in exactly
one run. `fanout` runs of a level are merged into one of the next as soon as they are there, while batches
still arrive, so a batch meets few runs. Runs and batches are bucketed alike, so that neither these joins
nor compactions move a run's rows between tasks. At last each run meets the summed increments, again by a
merge join: a key's count is that of its run plus its increments, however documents are dealt to batches.

The text is read once for its hashes, and shuffled once to meet the positions of the lines it loses (not
at all where the documents that lose lines are few enough for a broadcast).

Defined results: a null or empty text is one empty line; keys shorter than `min_chars` code points are
never dropped; a document that loses all lines is the empty string; every row counts as a document of its
own, also rows that repeat a doc_id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import contextlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, ascii_lower, small, table

MIN_DOCS, MIN_CHARS = 10, 1
BATCHES, FANOUT = 4, 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hashed(key: Column) -> Column:
    return F.unhex(F.md5(key))


class LineRuns:
    """The levels of runs of one corpus, kept in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "lines")
        self.levels: list[list[DataFrame]] = [[]]
        self.increments: list[DataFrame] = []
        self._names: dict[str, str] = {}

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @contextlib.contextmanager
    def _in_order(self):
        """Lets plans made inside trust the order of a bucket's one file, so that merge joins need no sort."""
        conf, key = self.spark.conf, "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            yield
        finally:
            conf.set(key, before)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table bucketed and sorted by key: one file a bucket, as df is dealt by key."""
        at = self.scratch.fresh(name)
        known = f"mq_{name}_{uuid.uuid4().hex}"
        with self._in_order():
            df.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd").option("path", at).saveAsTable(known)
        out = self.spark.table(known)
        out._mq_at = at
        self._names[at] = known
        return out

    def _drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(t._mq_at)}")
            self.scratch.drop(t)

    def add(self, keys: DataFrame) -> None:
        """keys: a row (key) for each document of the batch that holds the key."""
        batch = self._written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "batch")
        if self.runs:
            fresh = self._written(self._unseen(batch), "run")
            self.increments.append(self._written(self._without(batch, fresh), "more"))
            self._drop(batch)
        else:
            fresh = batch
        self.levels[0].append(fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    @staticmethod
    def _without(rows: DataFrame, run: DataFrame) -> DataFrame:
        return rows.join(run.select("key").hint("merge"), "key", "left_anti")

    def _unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key lies in no run."""
        return reduce(self._without, self.runs, batch)

    def _compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next."""
        if len(self.levels) == level + 1:
            self.levels.append([])
        runs, self.levels[level] = self.levels[level], []

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb").hint("merge"), "key", "full")
            return both.select("key", F.coalesce("na", "nb").alias("n"))  # a key lies in one run

        self.levels[level + 1].append(self._written(reduce(merge, runs), "run"))
        self._drop(*runs)

    def frequent(self) -> DataFrame:
        """The keys found in at least min_docs documents so far."""
        more = None
        if self.increments:
            # read as plain files: a union of bucketed tables would pass for dealt by key, which its rows are not
            plain = [self.spark.read.schema(t.schema).parquet(t._mq_at) for t in self.increments]
            more = reduce(DataFrame.unionByName, plain).groupBy("key").agg(F.sum("n").alias("more"))
            more = self._written(more, "sums")

        def of(run: DataFrame) -> DataFrame:
            if more is not None:
                run = run.join(more.hint("merge"), "key", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
            return run.filter(F.col("n") >= self.min_docs).select("key")

        with self._in_order():
            out = self.scratch.write(reduce(DataFrame.unionByName, map(of, self.runs)), "frequent")
        if more is not None:
            self._drop(more)
        return out

    def close(self) -> None:
        """Removes runs and increments; tables that frequent() has given stay."""
        self._drop(*self.runs, *self.increments)
        self.levels, self.increments = [[]], []


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each text without the lines whose key is in min_docs documents."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    keys = F.transform(lines_of(F.col("text")), line_key)
    # by hash and place, so that a key's first line in a document is the one whose predecessor has another hash
    placed = F.transform(keys, lambda k, i: F.struct(F.when(F.char_length(k) >= min_chars, _hashed(k)).alias("key"), i.alias("pos")))
    placed = F.array_sort(F.filter(placed, lambda p: p["key"].isNotNull()))
    each = base.select("doc_id", "h", F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)).cast("int").alias("batch"), placed.alias("placed"))
    first = F.transform("placed", lambda p, i: F.struct(p["key"].alias("key"), p["pos"].alias("pos"), ((i == 0) | (F.get("placed", i - 1)["key"] != p["key"])).alias("first")))
    each = each.withColumn("at", F.explode(first)).select("doc_id", "h", "batch", "at.*")
    at = runs.scratch.fresh("lines")
    each.write.partitionBy("batch").option("compression", "zstd").parquet(at)
    lines = spark.read.schema(each.schema).parquet(at)
    for b in range(batches):
        runs.add(lines.filter((F.col("batch") == b) & F.col("first")).select("key"))
    frequent = runs.frequent()
    runs.close()
    gone = lines.join(small(frequent), "key", "left_semi").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # a mask with a byte for each line up to the last one that goes: 1 where it goes
    steps = F.transform("gone", lambda g, j: F.concat(F.repeat(F.lit("0"), (g - F.when(j == 0, F.lit(-1)).otherwise(F.get("gone", j - 1)) - 1)), F.lit("1")))
    gone = runs.scratch.write(gone.select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"), F.size("gone").cast("long").alias("n_dropped"), F.encode(F.array_join(steps, ""), "UTF-8").alias("mask")), "gone")
    runs.scratch.drop(at)
    both = base.join(small(gone), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    split = lines_of(F.col("text"))
    kept = F.filter(split, lambda x, i: F.coalesce(F.substring("mask", i + 1, F.lit(1)) != F.encode(F.lit("1"), "UTF-8"), F.lit(True)))
    text = F.when(F.col("mask").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return both.select("doc_id", text.alias("text"), F.size(split).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def op9_line_dedup(spark, sf_dir):
    out = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rid, doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS i FROM d)),
heavy AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT l.*, h.key IS NOT NULL AS gone FROM l LEFT JOIN heavy h ON l.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
