"""The contract file, and every registered query with SQL against DuckDB on the smallest tables."""

import math
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from mediaquarry.plans import registry

SF = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_nothing_else_imports_the_corpus_operators():
    for f in (ROOT / "mediaquarry").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "mediaquarry").parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.queries()) <= set(entry.queries())


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and hasattr(v, "hour") else v


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    import duckdb

    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert df.columns
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "captured_at", "media_kind", "favorite"] and df.count() > 0
