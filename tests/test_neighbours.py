"""Nearest vectors by pivots and nearest hashes by chunks, against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaquarry.functions import vectors
from mediaquarry.operators import neighbours, similarity

PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def clustered(rng, n, groups, dim=12, spread=0.03):
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * spread


def frame(spark, m, key, column):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in m], f"{key} long, {column} array<double>").repartition(3)


def best(rows, refs, euclid, least, most, own):
    out = set()
    for i, v in rows:
        found = []
        for j, r in refs:
            if own and i == j or v is None or r is None or len(v) != len(r) or not len(v):
                continue
            v, r = np.array(v), np.array(r)
            if euclid:
                s = -float(np.sqrt(((v - r) ** 2).sum()))
            else:
                n = float(np.sqrt((v * v).sum()) * np.sqrt((r * r).sum()))
                s = float(v @ r) / n if n else None
            if s is not None and (least is None or s >= least):
                found.append((-round(s, 9), j))
        out |= {(i, j, k + 1) for k, (_, j) in enumerate(sorted(found)[:most])}
    return out


@pytest.mark.parametrize("euclid,least,most,own", [(False, None, 1, False), (False, 0.9, 2, True), (True, None, 3, True), (True, -0.2, 1, False)])
def test_pivots_equal_all_pairs(spark, monkeypatch, euclid, least, most, own):
    monkeypatch.setattr(neighbours, "ROWS_TOGETHER", 40)
    monkeypatch.setattr(neighbours, "REFERENCES_TOGETHER", 30)
    rng = np.random.default_rng(5)
    m = clustered(rng, 260, 9)
    rows = [(i, v) for i, v in enumerate(m)] + [(900, None), (901, []), (902, [0.0] * 12), (903, [1.0, 2.0]), (904, m[3])]
    refs = [(i, v) for i, v in enumerate(m) if i % 2 == 0] + [(500, [1.0, 2.5]), (501, [0.0] * 12), (502, None), (503, m[4]), (504, m[4])]
    got = neighbours.nearest_vectors(frame(spark, rows, "id", "encoding"), ["id"], frame(spark, refs, "ref", "reference"), ["ref"], "ref", least, euclid, "id" if own else None, most, pivots=8)
    want = best(rows, refs, euclid, least, most, own)
    assert {(r["id"], r["ref"], r["rank"]) for r in got.collect()} == want and not any(p in plan_of(got) for p in PAIRWISE)


def test_cells_leave_a_tenth_of_the_pairs(spark):
    rng = np.random.default_rng(6)
    m = clustered(rng, 3000, 60)
    refs, rows = list(enumerate(m[:2000])), list(enumerate(m[2000:]))
    cells = neighbours.Pivots(frame(spark, refs, "ref", "reference"), ["ref"], "ref", True)
    met = cells.candidates(frame(spark, rows, "id", "encoding"), ["id"], 1, None, None).groupBy("size", "cell").count().collect()
    compared = sum(r["count"] * cells.count[r["size"], r["cell"]] for r in met) + len(rows) * len(cells.pivots[12])
    assert compared < 0.1 * len(rows) * len(refs)
    assert sum(cells.count.values()) == len(refs)


def test_best_of_each_name_within_a_limit(spark):
    rng = np.random.default_rng(7)
    m = clustered(rng, 200, 5)
    refs = spark.createDataFrame([(f"n{i % 7}", i, [float(x) for x in v]) for i, v in enumerate(m[:100])], "name string, pos int, reference array<double>")
    rows = frame(spark, list(enumerate(m[100:])), "id", "encoding")
    got = {(r["id"], r["name"]): r["score"] for r in neighbours.nearest_vectors(rows, ["id"], refs, ["name", "pos"], "name", 0.95, most=None).collect()}
    want = {}
    for i, v in enumerate(m[100:]):
        for j, r in enumerate(m[:100]):
            c = float(v @ r) / math.sqrt(float(v @ v) * float(r @ r))
            if c >= 0.95:
                want[i, f"n{j % 7}"] = max(c, want.get((i, f"n{j % 7}"), -1))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_references(spark):
    rows = frame(spark, [(1, [1.0])], "id", "encoding")
    assert neighbours.nearest_vectors(rows, ["id"], frame(spark, [], "ref", "reference"), ["ref"], "ref").count() == 0
    h = spark.createDataFrame([(1, "0" * 16)], "id long, s string").select("id", vectors.hash_bits("s").alias("h"))
    assert neighbours.nearest_hashes(h, ["id"], h.limit(0).withColumnRenamed("id", "ref"), ["ref"], "ref").count() == 0


def test_large_reference_sets_go_by_pivots(spark, monkeypatch):
    rng = np.random.default_rng(8)
    m = list(enumerate(clustered(rng, 60, 4)))
    rows, refs = frame(spark, m, "id", "encoding"), frame(spark, m[:30], "ref", "reference")
    direct = similarity.best_vectors(rows, ["id"], refs, ["ref"], "ref", self_key="id")
    pivots = similarity.best_vectors(rows, ["id"], refs, ["ref"], "ref", self_key="id", direct=5)
    show = lambda df: sorted((r["id"], r["ref"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert show(direct) == show(pivots)
    queries = frame(spark, m[:9], "query_id", "encoding")
    one = similarity.search_vectors(rows, queries, 4).collect()
    monkeypatch.setattr(similarity, "DIRECT", 3)
    monkeypatch.setattr(similarity.fits, "__defaults__", (3,))
    assert sorted(tuple(r)[:3] for r in similarity.search_vectors(rows, queries, 4).collect()) == sorted(tuple(r)[:3] for r in one)


@pytest.mark.parametrize("chunks", [4, 8])
@pytest.mark.parametrize("within", [None, 0, 9, 14])
def test_hashes_equal_all_pairs(spark, chunks, within):
    rng = random.Random(9)
    refs = [(i, rng.getrandbits(64)) for i in range(25)] + [(100, 5), (101, 5)]
    flip = lambda h, k: h ^ sum(1 << b for b in rng.sample(range(64), k))
    rows = [(i, flip(rng.choice(refs)[1], rng.choice([0, 1, 7, 8, 13, 14, 15]))) for i in range(60)] + [(800, rng.getrandbits(64)), (801, 5)]
    df = lambda t, name: spark.createDataFrame([(i, f"{h:016x}") for i, h in t] + [(7777, None)], f"{name} long, s string").select(name, vectors.hash_bits("s").alias("h"))
    got = neighbours.nearest_hashes(df(rows, "id"), ["id"], df(refs, "ref"), ["ref"], "ref", within, chunks)
    want = {}
    for i, h in rows:
        d, j = min(((h ^ g).bit_count(), j) for j, g in refs)
        if within is None or d <= within:
            want[i] = (d, j)
    assert {r["id"]: (r["distance"], r["ref"]) for r in got.collect()} == want and not any(p in plan_of(got) for p in PAIRWISE)


def test_signatures_that_are_no_hashes(spark):
    own = ["00000000000000ff", "zz00", "zz01", "00000000000000Xf", "", "abc"]
    refs = spark.createDataFrame([("p", 0, "000000000000000f"), ("q", 0, "zz11"), ("q", 1, "00000000000000Yf")], "persona_id string, ref_pos int, reference string")
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(own)], "id int, signature string")
    got = {r["id"]: (r["persona_id"], r["distance"]) for r in similarity.near_signatures(rows, ["id"], refs, 5).collect()}
    want = {}
    for i, s in enumerate(own):
        d = [(float(vectors.hamming_of(s, r.reference)), r.persona_id) for r in refs.collect() if len(s) == len(r.reference) and s]
        if d and min(d)[0] <= 5:
            want[i] = min(d)[::-1]
    assert got == want


def test_pet_matches_score_as_their_sql(spark, tmp_path):
    """A near vector that is no copy of a reference counts as one."""
    import duckdb

    from mediaquarry.plans import registry, state_queries  # noqa: F401

    rows = [(20, 6, [1.0, 0.0]), (21, 6, [1.0, 0.1]), (22, 7, [0.0, 1.0]), (40, 8, [-1.0, 0.3])]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in registry.queries()["pet_matches"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {tuple(r) for r in db.sql(registry.oracle_sql()["pet_matches"]).fetchall()}
    assert got == want and ("21", "cosine", 1.0) in want


def test_a_row_goes_to_a_pack_once(spark):
    """Vectors without groups: the bounds leave most cells, and a row is still sent but once to each pack."""
    rng = np.random.default_rng(10)
    m = list(enumerate(rng.normal(size=(700, 24))))
    cells = neighbours.Pivots(frame(spark, m[:500], "ref", "reference"), ["ref"], "ref", False)
    rows = frame(spark, m[500:], "id", "encoding")
    assert cells.candidates(rows, ["id"], 1, None, None).count() > 200 * 20
    assert cells.candidates(rows, ["id"], 1, None, None, packed=True).count() == 200
    assert {(r["size"], r["cell"], r["count"]) for r in cells.packed().groupBy("size", "cell").count().collect()} == {(24, 0, 500)} == {(*k, n) for k, n in cells.held.items()}


def test_packs_hold_near_cells_up_to_a_number_of_references():
    pivots = np.array([[0.0], [10.0], [0.1], [10.1], [0.2]])
    assert neighbours._packs(pivots, [4, 4, 4, 4, 4], 8).tolist() == [0, 1, 0, 1, 2]
    assert neighbours._packs(pivots, [20, 1, 1, 1, 1], 8).tolist() == [0, 1, 1, 1, 1]


def test_flipped_hashes_of_many_references_are_not_broadcast(spark):
    """Every reference stands under 72 values: the planner, which sees as many rows as there are references, would broadcast them all."""
    own = spark.range(4000).select(F.col("id").alias("id"), vectors.hash_bits(F.substring(F.sha1(F.col("id").cast("string").cast("binary")), 1, 16)).alias("h"))
    got = neighbours.nearest_hashes(own, ["id"], own.withColumnRenamed("id", "ref"), ["ref"], "ref", 10, each=True)
    assert "BroadcastHashJoin" not in plan_of(got) and "SortMergeJoin" in plan_of(got)
    few = neighbours.nearest_hashes(own, ["id"], own.filter("id < 50").withColumnRenamed("id", "ref"), ["ref"], "ref", 10, each=True)
    assert few.filter("id = ref").count() == 50
