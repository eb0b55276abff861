"""Fuzzy scores of whole batches, held to one window at a time."""

import random
from pathlib import Path

import pytest

from mediaquarry.functions import text

SF = Path("/root/testdata/sf0.001")


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_score(query, blob):
    q, b = set(query.split()), set(blob.split())
    both = " ".join(sorted(q & b))
    one, two = f"{both} {' '.join(sorted(q - b))}".strip(), f"{both} {' '.join(sorted(b - q))}".strip()
    score = 100.0 if both and (q <= b or b <= q) else max([ratio(one, two), *([ratio(both, one), ratio(both, two)] if both else [])])
    for token in query.split():
        short, long = sorted((token, blob), key=len)
        score = max([score, *(ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)) if short)])
    return int(score)


def test_scores_equal_one_window_at_a_time(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(text, "WINDOWS", 37)
    for _ in range(250):
        query = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 3)))
        blobs = ["".join(rng.choice("abcdefé \n\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(5)]
        assert text.fuzzy_scores(query, blobs) == [plain_score(query, b) for b in blobs], (query, blobs)


def test_tokens_longer_than_a_lane_and_texts_shorter_than_a_token():
    rng = random.Random(3)
    for n in (63, 64, 65, 90):
        token = "".join(rng.choice("abc") for _ in range(n))
        blobs = ["", "a", token[:20], token[5:] + "x", token + token, "c" * 300, "z"]
        assert text.fuzzy_scores(token, blobs) == [plain_score(token, b) for b in blobs]


def test_column_with_nulls_repeats_and_verbatim_tokens(spark):
    blobs = ["a steel beam", None, "", "stel", "stel", "Steel", "s t e e l"] * 3
    df = spark.createDataFrame(list(enumerate(blobs)), "id int, blob string")
    got = {r[0]: r[1] for r in df.select("id", text.fuzzy_score("steel wool", "blob")).collect()}
    assert got == {i: plain_score("steel wool", b or "") for i, b in enumerate(blobs)}


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_ranking_of_whole_texts_is_dealt_out(spark):
    from mediaquarry.plans import adapters, registry

    df = registry.queries()["search_fuzzy_ranked"](spark, str(SF))
    assert "RoundRobinPartitioning" in df._jdf.queryExecution().toString()
    rows = df.collect()
    assert [(-r[1], r[0]) for r in rows] == sorted((-r[1], r[0]) for r in rows)
    texts = {r["id"]: r["text"].lower() for r in adapters.text_items(spark, str(SF)).collect()}
    for r in rows[::40]:
        if len(texts[r["id"]]) < 3000:
            assert r["score"] == plain_score("Polished STEEL", texts[r["id"]])
