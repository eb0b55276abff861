"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source with words S and target t gets floor(t / S) whole copies of every document for certain.
The rest, f = t / S - floor(t / S), is sampled: each document gets inclusion odds f / (1 - f) and
random odds U / (1 - U), and the documents with the smallest ratio of both are taken until their
words come nearest to the rest of the target. f differs from source to source, so over the whole
mix the inclusion probabilities are unequal; `importance` makes them unequal inside a source too.

The cut is found without sorting a source in one task: ranks fall into `cells` equal cells, the
cells are summed (map-side first), and only the cell that holds the cut is ordered, rows of one rank
and doc_id summed first. A source taken in whole copies alone has no cut. The decision is then a
function of the row and of its source's cut, so no row meets another.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its
own, last in order; rows that repeat a doc_id, or have none, share one decision a source; an empty
table gives an empty mix; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, small, unit_hash

WEIGHTS = (5, 2, 1)
SEED = 17
CELLS = 4096


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(_source, _size) rows to one row a source: words, target and the cut of the water-filling.

    Targets are min(most * words, level * weight) with the level at which they add up to share * all
    words: what resharing the excess by weight, again and again, comes to.
    """
    per = sized.groupBy("_source").agg(F.sum("_size").alias("_words"))
    order = Window.orderBy(F.col("_source").isNull(), F.encode("_source", "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("_cap", F.lit(float(most)) * F.col("_words").cast("double"))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), F.encode("_source", "UTF-8"))
    every = Window.partitionBy()
    per = (
        per.withColumn("_before", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.lit(float(share)) * F.sum("_words").over(every).cast("double"))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    )
    free = F.col("_cap") / F.col("_w") >= F.col("_level")
    per = per.withColumn("_level", F.min(F.when(free, F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(every).getField("_level"))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return per.select("_source", "_words", target.alias("_target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0, seed: int = SEED, cells: int = CELLS, importance: str | None = None) -> DataFrame:
    """Structs `row` (the columns of docs) and `mix`: size, source_size, target, copies (how often the mix takes the row)."""
    fields = [F.col(f"`{c}`") for c in docs.columns]
    base = docs.select(
        F.struct(*fields).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("_size"),
        unit_hash(F.col("doc_id"), seed).alias("_u"), (F.col(importance).cast("double") if importance else F.lit(1.0)).alias("_rel"),
    )
    scratch = Scratch(docs.sparkSession, "mix")
    light = scratch.write(base.select("_id", "_source", "_size", "_u", "_rel"), "light")
    plan = source_targets(light, weights, share, most)
    ratio = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_whole", F.floor(ratio).cast("long")).withColumn("_f", ratio - F.floor(ratio))
    plan = scratch.write(plan.withColumn("_left", F.col("_target") - F.col("_whole") * F.col("_words")), "plan")

    def ranked(df: DataFrame) -> DataFrame:
        p = F.least(F.col("_f") * F.col("_rel"), F.lit(1.0 - 1e-9))
        q = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
        q = F.when(F.col("_f") > 0, q).otherwise(F.lit(1e300))
        return df.withColumn("_q", q).withColumn("_cell", F.floor(F.col("_q") / (1 + F.col("_q")) * cells).cast("long"))

    def with_plan(df: DataFrame, other: DataFrame) -> DataFrame:
        other = small(other.withColumnRenamed("_source", "_of"))
        return df.join(other, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")

    rows = ranked(with_plan(light, plan)).filter("_f > 0")
    by_cell = rows.groupBy("_source", "_cell").agg(F.sum("_size").alias("_n"), F.first("_left").alias("_left"))
    up_to = Window.partitionBy("_source").orderBy("_cell")
    by_cell = by_cell.withColumn("_to", F.sum("_n").over(up_to))
    cut = by_cell.filter(F.col("_to") > F.col("_left")).groupBy("_source").agg(F.min(F.struct("_cell", (F.col("_to") - F.col("_n")).alias("_base"))).alias("_c"))
    cut = scratch.write(cut.select("_source", F.col("_c._cell").alias("_cut"), F.col("_c._base").alias("_base")), "cut")
    inside = with_plan(rows, cut).filter(F.col("_cell") == F.col("_cut"))
    inside = inside.groupBy("_source", "_q", "_id").agg(F.sum("_size").alias("_size"), F.first("_base").alias("_base"), F.first("_left").alias("_left"))
    before = Window.partitionBy("_source").orderBy("_q", "_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_sum", F.col("_base") + F.coalesce(F.sum("_size").over(before), F.lit(0)))
    inside = inside.filter(F.col("_sum") + F.col("_size") / 2 <= F.col("_left"))
    last = inside.groupBy("_source").agg(F.max(F.struct("_q", "_id")).alias("_last"))
    plan = plan.join(cut.withColumnRenamed("_source", "_s1"), F.col("_source").eqNullSafe(F.col("_s1")), "left").drop("_s1")
    plan = plan.join(last.withColumnRenamed("_source", "_s2"), F.col("_source").eqNullSafe(F.col("_s2")), "left").drop("_s2")

    out = ranked(with_plan(base, scratch.write(plan, "cuts")))
    taken = (F.col("_f") > 0) & (F.col("_cut").isNull() | (F.col("_cell") < F.col("_cut")) | ((F.col("_cell") == F.col("_cut")) & F.coalesce(F.struct("_q", "_id") <= F.col("_last"), F.lit(False))))
    copies = F.col("_whole") + F.when(taken, F.lit(1)).otherwise(F.lit(0))
    mixed = F.struct(F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), F.coalesce(copies, F.lit(0)).cast("long").alias("copies"))
    return out.select(F.col("_row").alias("row"), mixed.alias("mix"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of docs."""
    out = mix(docs, **options).filter(F.col("mix.copies") > 0)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int")))).select("row.*")


def op10_pareto_mix(spark, sf_dir):
    from .common import table

    m = mix(table(spark, sf_dir, "documents"))
    return m.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


SQL = r"""
WITH base AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS words FROM base GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 3.0::DOUBLE * words::DOUBLE AS cap FROM per),
lv AS (SELECT *, (sum(words) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
best AS (SELECT level AS best FROM lv WHERE cap / w >= level ORDER BY cap / w LIMIT 1),
plan AS (SELECT source, words, CASE WHEN (SELECT count(*) FROM best) = 0 THEN cap ELSE least(cap, (SELECT best FROM best) * w) END AS target FROM lv),
p2 AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS whole, CASE WHEN words > 0 THEN target / words - floor(target / words) ELSE 0 END AS f FROM plan),
r AS (SELECT b.*, p.words, p.target, p.whole, p.f, p.target - p.whole * p.words AS rest, (u / (1 - u)) / (f / (1 - f)) AS q FROM base b JOIN p2 p ON b.source IS NOT DISTINCT FROM p.source),
g AS (SELECT source, q, doc_id, rest, sum(size) AS group_size FROM r WHERE f > 0 GROUP BY ALL),
c AS (SELECT source, doc_id, group_size, rest, coalesce(sum(group_size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
t AS (SELECT source, doc_id, 1 AS one FROM c WHERE before + group_size / 2 <= rest)
SELECT r.doc_id, size, words AS source_size, target, CAST(size * (whole + coalesce(one, 0)) AS BIGINT) AS taken
FROM r LEFT JOIN t ON r.source IS NOT DISTINCT FROM t.source AND r.doc_id IS NOT DISTINCT FROM t.doc_id
"""
