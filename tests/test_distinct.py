"""Learning in rounds equals the fold in order."""

import math
import random

import pytest

from mediaquarry.functions.vectors import cosine_of
from mediaquarry.operators import distinct, neighbours


def fold(rows, least):
    kept = {}
    out = {}
    for p, s, v in sorted(rows, key=lambda r: r[:2]):
        own = kept.setdefault(p, [])
        usable = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        out[p, s] = not usable or all(cosine_of(v, k) < least for k in own)
        if out[p, s] and usable:
            own.append(v)
    return out


def turned(angle):
    return [math.cos(angle), math.sin(angle)]


@pytest.mark.parametrize("pieces", [(16_384, 4_096), (7, 5)])
def test_rounds_equal_the_fold(spark, monkeypatch, pieces):
    monkeypatch.setattr(neighbours, "ROWS_TOGETHER", pieces[0])
    monkeypatch.setattr(neighbours, "REFERENCES_TOGETHER", pieces[1])
    rng = random.Random(3)
    step = math.acos(0.985)
    rows = [("chain", k, turned(k * step * 0.8)) for k in range(9)]  # each is near the one before it only
    rows += [("copies", k, [0.3, 0.4]) for k in range(60)] + [("copies", 100 + k, turned(1.2 + k * 0.001)) for k in range(40)]
    rows += [("mixed", k, turned(rng.uniform(0, 3))) for k in range(50)] + [("mixed", 200 + k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(30)]
    rows += [("odd", 0, None), ("odd", 1, []), ("odd", 2, [0.0, 0.0]), ("odd", 3, [0.0, 0.0]), ("odd", 4, [math.nan, 1.0]), ("odd", 5, [1.0, 0.0]), ("odd", 6, [2.0, 0.0]), ("odd", 7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "persona_id string, seq long, encoding array<double>").repartition(3)
    got = {(r["persona_id"], r["seq"]): r["kept"] for r in distinct.learned_encodings(df, few=0).collect()}
    assert got == {(r["persona_id"], r["seq"]): r["kept"] for r in distinct.learned_encodings(df).collect()} == fold(rows, 0.985) and sum(not k for k in got.values()) > 100


def test_no_rows(spark):
    assert distinct.learned_encodings(spark.createDataFrame([], "persona_id string, seq long, encoding array<double>"), few=-1).count() == 0


def test_first_ones_have_no_near_row_before_them(spark, tmp_path):
    """Third of a chain: near the second, which is itself left out. The fold keeps it, the query's SQL does not."""
    from pathlib import Path

    import duckdb

    from mediaquarry.plans import registry

    turn = math.acos(0.985) * 0.8
    rows = [(k, 0, turned(k * turn)) for k in range(9)] + [(20 + k, 1, turned(k * 0.5)) for k in range(5)] + [(30 + k, 1, turned(2.0)) for k in range(4)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["learned_references"](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{Path(tmp_path)}/embeddings.parquet/*.parquet')")
    want = {tuple(r) for r in db.sql(registry.oracle_sql()["learned_references"]).fetchall()}
    assert {(r["persona_id"], r["n"], r["ids"]) for r in got.collect()} == want and ("label-0", 1, 0) in want
    df = spark.createDataFrame([("p", k, v) for k, _, v in rows[:9]] + [("p", 50, None), ("p", 51, [0.0, 0.0])], "persona_id string, seq long, encoding array<double>")
    assert {r["seq"] for r in distinct.first_encodings(df).filter("first").collect()} == {0, 50, 51}
    assert {r["seq"] for r in distinct.learned_encodings(df, few=0).filter("kept").collect()} == {0, 2, 4, 6, 8, 50, 51}
    assert distinct.first_encodings(df.filter("seq >= 50")).filter("first").count() == 2


def test_learnt_personas_equals_its_sql(spark, tmp_path):
    """Chains, references near each other, and ids whose order differs from that of their items."""
    from pathlib import Path

    import duckdb

    from mediaquarry.plans import registry

    turn = math.acos(0.985) * 0.8
    chain = [(k, 1, turned(j * turn)) for j, k in enumerate((101, 102, 103, 104, 105, 106))]
    # '11', of item 2, comes before '9', of item 2, and '41', of item 10, before '5', of item 1
    turning = [(41, 1, turned(2.0)), (5, 1, turned(2.0 + turn)), (9, 1, turned(2.0 + 2 * turn)), (11, 1, turned(2.0 + 3 * turn))]
    # 40 is near 20 and no reference less for that: 201 is near 40 only
    known = [(20, 1, turned(-1.0)), (40, 1, turned(-1.0 - turn)), (201, 1, turned(-1.0 - 2 * turn)), (202, 1, turned(-1.0 + 2 * turn))]
    spark.createDataFrame([*chain, *turning, *known, (60, 0, turned(0.0))], "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["learnt_personas"](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{Path(tmp_path)}/embeddings.parquet/*.parquet')")
    want = db.sql(registry.oracle_sql()["learnt_personas"]).fetchall()
    assert [(r["id"], r["n_vectors"], r["n_hashes"], r["avatar"]) for r in got.collect()] == want and want[0][1] < 2 + len(chain)


@pytest.mark.parametrize("few", [0, 5_000])
def test_what_is_near_a_known_reference_is_not_learnt(spark, few):
    """All known references count, those near an earlier one too; new rows still are a fold."""
    turn = math.acos(0.985) * 0.8
    rows = [("p", 0, turned(0.0)), ("p", 1, turned(turn)), ("p", 10, turned(2 * turn)), ("p", 11, turned(3 * turn)), ("p", 12, turned(4 * turn)), ("p", 13, turned(5 * turn)), ("q", 10, turned(0.0)), ("q", 11, turned(0.0))]
    df = spark.createDataFrame(rows, "persona_id string, seq long, encoding array<double>")
    kept = lambda got: {(r["persona_id"], r["seq"]) for r in got.filter("kept").collect()}
    assert kept(distinct.learned_encodings(df, few=few, since=10)) == {("p", 0), ("p", 1), ("p", 11), ("p", 13), ("q", 10)}
    assert kept(distinct.learned_encodings(df.filter("seq < 10"), few=few, since=10)) == {("p", 0), ("p", 1)}
    assert kept(distinct.learned_encodings(df.filter("seq >= 10"), few=few, since=10)) == {("p", 10), ("p", 12), ("q", 10)}
