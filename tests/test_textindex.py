"""The trigram index: same items as LIKE, from the postings of the query's own runs."""

import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.functions.text import like_token
from mediaquarry.operators import search, textindex
from mediaquarry.schema import conform, empty
from mediaquarry.sources.store import Library


def texts(spark):
    rng = random.Random(4)
    rows = [(f"i{k}", "".join(rng.choice("abé \U0001f600\\%") for _ in range(rng.randint(0, 60)))) for k in range(150)] + [("n", None), ("e", ""), ("s", "ab")]
    return spark.createDataFrame(rows, "item_id string, search_blob string").repartition(3).cache()


@pytest.mark.parametrize("query", ["aba", "abab é", "ab_a", "aab%bba b", "a", "%", "ba\\", "aaaaaaaaaaaaaaaaaaaa", "baab ab_ab%aa", "\U0001f600ab", "abaabb abaabb"])
def test_tokens_equal_like(spark, query):
    df = texts(spark)
    hit = F.lit(True)
    for t in query.split():
        hit = hit & like_token(F.col("search_blob"), t)
    got = textindex.with_tokens(textindex.postings(df), df, query.split())
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in df.filter(hit).collect())


def test_without_the_broadcast(spark, monkeypatch):
    df = texts(spark)
    monkeypatch.setattr(textindex, "FEW_ITEMS", 0)
    got = textindex.with_tokens(textindex.postings(df), df, ["abab"])
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in df.filter("search_blob like '%abab%'").collect())


def test_a_saved_index_follows_changes_and_is_read_by_its_runs(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), parts=2)
    items = spark.createDataFrame([(f"i{k}", f"Holiday number{k:04d} at the lake") for k in range(400)], "id string, title string").transform(lambda df: conform(df, "items"))
    lib.save_state(items, *[empty(spark, t) for t in ("personas", "albums", "memories")], "t0")
    find = lambda q: search.with_text(lib.table("items"), lib.table("item_search"), q, lib.grams())
    assert [r.id for r in find("HOLIDAY number0123").collect()] == ["i123"]
    assert find("lake number01_3").count() == 10 and find("lak").count() == 400 and find("lake nowhere").count() == 0
    lib.save_items(items.filter("id = 'i123'").withColumn("title", F.lit("Winter")), items.filter("id = 'i7'").select("id"), "t1")
    assert find("number0123").count() == 0 and [r.id for r in find("winter").collect()] == ["i123"] and find("number0007").count() == 0
    plan = find("number0042")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "")
    assert "search_blob" not in plan  # a token without wildcards needs no text


def test_files_are_sorted_by_run(spark, tmp_path):
    import pyarrow.parquet as pq

    lib = Library(spark, str(tmp_path / "lib"), parts=2)
    lib.save_state(conform(spark.createDataFrame([(f"i{k}", f"some title {k * 7919}") for k in range(60)], "id string, title string"), "items"), *[empty(spark, t) for t in ("personas", "albums", "memories")], "t0")
    files = [f for at in lib.manifest()["tables"]["item_grams"].values() for f in (tmp_path / "lib" / at).glob("*.parquet")]
    for f in files:
        g = pq.read_table(f, columns=["gram"]).column(0).to_pylist()
        assert g == sorted(g)
    assert files


def test_vacuum_deletes_what_no_manifest_names(spark, tmp_path, monkeypatch):
    from mediaquarry.sources import store

    monkeypatch.setattr(store, "KEPT_MANIFESTS", 2)
    lib = Library(spark, str(tmp_path / "lib"), parts=3)
    items = conform(spark.createDataFrame([(f"i{k}", f"title {k}") for k in range(30)], "id string, title string"), "items")
    lib.save_state(items, *[empty(spark, t) for t in ("personas", "albums", "memories")], "t0")
    first = lib.table("items")
    for t in range(3):
        lib.save_items(items.filter("id = 'i5'").withColumn("title", F.lit(f"new {t}")), items.limit(0).select("id"), f"t{t + 1}")
    folders = lambda: len(list((tmp_path / "lib" / "items").glob("*/_part=*")))
    before, reader = folders(), lib.table("items")
    assert lib.vacuum() == 0 and folders() == before and first.count() == 30  # all too young
    assert lib.vacuum(older_than=-5) > 0 and 3 <= folders() < before
    assert reader.count() == 30 and {r.title for r in lib.table("items").filter("id = 'i5'").collect()} == {"new 2"}
    assert lib.vacuum(older_than=-5) == 0 and all(lib.table(t).count() >= 0 for t in lib.manifest()["tables"])


def test_postings_of_a_query_are_those_of_its_runs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "the orantion, the end"), ("b", "or"), ("c", None), ("d", "nothing of it"), ("e", "oration")], "item_id string, search_blob string")
    tokens = ["ora_tion", "the", "a"]
    show = lambda d: sorted((r["item_id"], r["gram"], r["places"]) for r in d.collect())
    own = textindex.wanted_runs(tokens)
    want = show(textindex.postings(df).filter(F.col("gram").isin(own)))
    assert show(textindex.postings(df, own)) == show(textindex.postings_for(df, tokens)) == want and len(want) > 3
    assert [r["item_id"] for r in textindex.with_tokens(textindex.postings_for(df, ["%oran%", "the"]), df, ["%oran%", "the"]).collect()] == ["a"]


def test_fuzzy_texts_come_in_batches_of_bounded_bytes(spark):
    from pyspark.sql import functions as F

    from mediaquarry.operators import search

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key, None)
    spark.conf.unset(key)
    search.fuzzy_ranked(spark.createDataFrame([("a", "x")], "id string, blob string"), "y", "blob", [F.col("id")])
    assert spark.conf.get(key) == "8m"
    spark.conf.unset(key) if had is None else spark.conf.set(key, had)


def test_collections_read_their_tables_once(spark):
    from mediaquarry.plans import registry

    got = registry.queries()["memory_top24"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders" not in plan


def test_a_part_of_the_index_is_written_by_several_tasks(spark, tmp_path):
    import pyarrow.parquet as pq

    lib = Library(spark, str(tmp_path / "lib"), parts=1)
    items = spark.createDataFrame([(f"i{k}", f"some title {k * 7919}") for k in range(60)], "id string, title string").repartition(3)
    lib.save_state(conform(items, "items"), *[empty(spark, t) for t in ("personas", "albums", "memories")], "t0")
    files = [f for at in lib.manifest()["tables"]["item_grams"].values() for f in (tmp_path / "lib" / at).glob("*.parquet")]
    own = [pq.read_table(f).column("gram").to_pylist() for f in files]
    assert len(own) == 3 and all(g == sorted(g) for g in own) and sum(map(len, own)) == lib.grams().count()


@pytest.mark.parametrize("together", [1, 7, 20, 1 << 19])
def test_texts_are_taken_apart_together(spark, monkeypatch, together):
    """Runs do not go from one text into the next, and every text has its own places, however many share a step."""
    monkeypatch.setattr(textindex, "TOGETHER", together)
    texts = ["aaaa", "", None, "ab", "abcabc", "bca", "ÿ😀ÿ😀ÿ", "x" * 30, "abc"]
    df = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "item_id string, search_blob string").coalesce(1)
    want = {}
    for k, t in enumerate(texts):
        for p in range(len(t or "") - 2):
            want.setdefault((f"i{k}", textindex.gram_of(t[p : p + 3])), []).append(p)
    got = textindex.postings(df).collect()
    assert {(r.item_id, r.gram): r.places for r in got} == want and len(got) == len(want)
    some = textindex.wanted_runs(["abc", "xxx"])
    assert {(r.item_id, r.gram): r.places for r in textindex.postings(df, some).collect()} == {k: v for k, v in want.items() if k[1] in some}


def test_a_save_leaves_detections_of_other_items(spark, tmp_path):
    """Rows of items that are neither changed nor gone are carried over as stored; those of changed ones follow the items."""
    lib = Library(spark, str(tmp_path / "lib"), parts=1)
    face = "named_struct('id', 'd', 'kind', 'face', 'label', '', 'confidence', 1.0D, 'bbox', cast(null as array<int>), 'persona_id', cast(null as string), 'encoding', cast(null as array<double>), 'signature', '')"
    items = conform(spark.createDataFrame([(k,) for k in "abcd"], "id string").withColumn("detections", F.expr(f"array({face})")), "items")
    lib.save_state(items, *[empty(spark, t) for t in ("personas", "albums", "memories")], "t0")
    lib.save({"detections": lib.table("detections").withColumn("cluster_dirty", F.lit(False)).withColumn("source_frame_token", F.lit("7"))})
    own = lib.table("items")
    changed = own.filter("id in ('a', 'd')").withColumn("title", F.lit("new")).withColumn("detections", F.when(F.col("id") == "d", F.transform("detections", lambda x: x.withField("label", F.lit("cat")))).otherwise(F.col("detections")))
    lib.save_items(changed, spark.createDataFrame([("c",), ("d",)], "id string"), "t1")
    got = {r.item_id: (r.label, r.source_frame_token, r.cluster_dirty, r.updated_at) for r in lib.table("detections").collect()}
    assert got["b"] == ("", "7", False, "t0") and got["d"] == ("cat", "", True, "t1") and set(got) == {"a", "b", "d"}
    assert {r.id: r.title for r in lib.table("items").collect()} == {"a": "new", "b": "", "d": "new"}
