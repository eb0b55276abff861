"""Clustering component by component equals one pass, and components equal a plain union."""

import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.config import Settings
from mediaquarry.operators import clusters, components, neighbours

from .test_catalog import DET, plain_clusters, planted


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster_id"], set()).add(r["detection_id"])
    return {frozenset(v) for v in out.values()}, {k: frozenset(v) for k, v in out.items()}


@pytest.mark.parametrize("kind,seed", [("person", 0), ("pet", 2)])
def test_clusters_by_component(spark, monkeypatch, kind, seed):
    monkeypatch.setattr(components, "TOGETHER", 11)
    monkeypatch.setattr(neighbours, "REFERENCES_TOGETHER", 7)
    rows, s = planted(seed), Settings(face_embedding_similarity_threshold=0.60 + seed / 20)
    df = spark.createDataFrame(rows, DET)
    got = clusters.cluster_unknown(df, kind, s, few=0)
    assert sets(got)[0] == plain_clusters(rows, kind, s)
    show = lambda d: sorted(tuple(r) for r in d.collect())
    assert show(got) == show(clusters.cluster_unknown(df, kind, s))
    state = got.select("cluster_id", "item_id", "detection_id")
    dirty = df.filter(F.col("cluster_dirty"))
    one, parts = (clusters.cluster_incremental(state, df, dirty, kind, s, few=n) for n in (5000, 0))
    assert sets(one)[1] == sets(parts)[1] and one.count() > 0


def test_signatures_of_other_forms_stay_together(spark):
    rows = [(f"i{k}", f"d{k}", "face", "face", 0.5, None, [], s, "2024", True) for k, s in enumerate(["ff", "00000000000000fe", "zz", "zy", "0f0f0f0f0f0f0f0f"])]
    df = spark.createDataFrame(rows, DET)
    assert sets(clusters.cluster_unknown(df, "person", few=0))[1] == sets(clusters.cluster_unknown(df, "person"))[1]


def test_components_equal_a_union(spark):
    rng = random.Random(4)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(55)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2030)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, components.LINKS)).collect()}
    assert got == want and components.components(spark.createDataFrame([], components.LINKS)).count() == 0
