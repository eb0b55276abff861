"""The pipeline against a plain model of its stages, and its contract."""

from collections import Counter

import pytest

import corpus_pipeline
from mediaquarry.llm import decontam, mixing, quality

from .fixtures import components, edited, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    bench = [(k, prose(900 + k, 25)) for k in range(4)]
    docs, labels = [], []
    for i in range(240):
        t = prose(i % 90, 60 + i % 40) if i % 4 else edited(prose(i % 90, 60 + i % 40), i, 0.01)
        bad = i % 6 == 0
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif i % 17 == 0:
            t += " " + bench[i % 4][1]
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(not bad), 0))
    docs += [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_pipeline(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    score = {r.doc_id: r._score for r in quality.quality_scores(docs, quality.learnable(labels), ["doc_id"]).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i: r for i, r in rows.items() if score[i] >= 0.3}
    bad = {i for i in range(240) if i % 6 == 0}
    assert len(bad & set(kept)) <= 2 and len(set(range(240)) - bad - set(kept)) <= 2
    comp = components([(i, r.text) for i, r in kept.items()], 5, 80)
    kept = {i: r for i, r in kept.items() if comp[i] == i}
    items = [" ".join(decontam.words_of(r.text)) for r in bench.collect()]
    kept = {i: r for i, r in kept.items() if not any(x in " ".join(decontam.words_of(r.text)) for x in items)}
    mixed = {r.row.doc_id: r.mix.copies for r in mixing.mix(docs.filter(docs.doc_id.isin(*kept))).collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: c for i, c in mixed.items() if c})
    assert all(r.law == "bytes" and 0 <= r.shard < 24 for r in out)
    assert all(r.row == rows[r.doc_id] for r in out)


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


CLASH = "quality score predicted held_out component_id kept n_shingles size source_size target taken copies shard slot law row mix text_crc32 item_id key node h word _w _pos".split()


def test_stages_with_clashing_columns_and_repeated_rows(spark, folder):
    """Columns of the operators' own names pass through with their values; a repeated row stays as often as its stage keeps it."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is null or doc_id < 40 or doc_id >= 500")
    docs = docs.unionByName(docs.filter("doc_id in (1, 2, 501)")).unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, folder), stage(spark, wide, folder)
        if name in ("near_dedup", "decontaminate"):
            assert got.filter("doc_id is null").count() == 1
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASH), name
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in plain.collect()), name
    out = corpus_pipeline.shard(spark, wide, folder).collect()
    assert len(out) == docs.count() and all(r.row[c] == f"own {c}" for r in out for c in CLASH)


def test_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
