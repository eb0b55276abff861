"""Centroids, spelling variants and token counts, each held to a plain model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import types as T

from mediaquarry.llm import centroids, queries, spelling, tokencounts

SF = Path("/root/testdata/sf0.001")


# centroids ---------------------------------------------------------------------


def plain_clusters(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]))
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [r[1] for r in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, own)), j) for j, own in enumerate(c))
    for _ in range(rounds if c else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            c[j] = [sum(x) // len(g) for x in zip(*g)]
    last = [(i, *near(v)) for i, v in kept] if c else []
    sums = Counter()
    for _, d, j in last:
        sums[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, fits(d), fits(sums[j]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last), key=repr)


def vectors(spark, rows, element=T.DoubleType()):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(element)), T.StructField("cluster", T.StringType())])
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], schema).repartition(3)


def got_clusters(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def test_centroids_equal_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) + rng.gauss(0, 0.1) for _ in range(6)]) for i in range(300)]
    rows += [(900 + i, rows[7][1]) for i in range(90)]  # a group of copies
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1]), (1000, None), (1001, []), (1002, [0.1] * 5), (1003, [0.1] * 5 + [None]), (1004, [math.nan] + [0.0] * 5), (1005, [math.inf] + [0.0] * 5)]
    out = centroids.cluster(vectors(spark, rows), k=7, rounds=3, size=6)
    assert got_clusters(out) == plain_clusters(rows, 7, 3, 6)


def test_centroids_beyond_the_bound_of_exact_products(spark):
    """Large components take Python integers; a few of them leave the other rows' results exact."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 10.0 ** rng.choice([0, 3, 6, 9])) for _ in range(4)]) for i in range(120)] + [(500, [1e306, 0.0, -1.0, 2.0]), (501, [-1e306, 1e-300, 0.5, 2.0])]
    out = centroids.cluster(vectors(spark, rows), k=5, rounds=2, size=4)
    want = plain_clusters(rows, 5, 2, 4)
    assert got_clusters(out) == want and any(w[2] is None for w in want) and any(w[2] is not None for w in want)


def test_ties_few_rows_and_no_rows(spark):
    same = [(i, [0.5, 0.5]) for i in range(4)]
    assert got_clusters(centroids.cluster(vectors(spark, same), k=9, rounds=2, size=2)) == plain_clusters(same, 9, 2, 2)
    assert centroids.cluster(vectors(spark, []), k=3, size=2).count() == 0
    assert centroids.cluster(vectors(spark, [(1, [0.5])]), k=3, size=2).count() == 0


def test_block_products_are_exact_up_to_the_bound():
    import numpy as np

    rng, edge = np.random.default_rng(1), math.isqrt(centroids.EXACT // (4 * 64)) - 2
    v = rng.integers(-edge, edge, (50, 64)).astype(float)
    c = rng.integers(-edge, edge, (6, 64)).tolist()
    best, far, whole = centroids.nearest(v, c, scale=1)
    assert whole is not None
    for row, j, d in zip(v.tolist(), best.tolist(), far.tolist()):
        each = [sum((int(a) - b) ** 2 for a, b in zip(row, own)) for own in c]
        assert d == min(each) and each.index(d) == j


# spelling variants -----------------------------------------------------------------


def plain_words(rows, garbled=31, least=7, count=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if garbled and h % garbled == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words, ratio=10):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words), key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").repartition(3)


def got_variants(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def edited(rng, w, letters):
    k, ch = rng.randrange(len(w) + 1), rng.choice(letters)
    return rng.choice([w[:k] + ch + w[k:], w[:k] + w[k + 1 :], w[:k] + ch + w[k + 1 :]])


def test_variants_equal_plain_comparison(spark):
    rng, letters = random.Random(6), "abcdeiouéÿÀ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(25)] + ["aaaaaaa", "abababab", "bababab"]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 30, 400])
        for _ in range(12):
            words += [edited(rng, w, letters)] * rng.choice([1, 2, 3, 25])
            words += [edited(rng, edited(rng, w, letters), letters)] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[s : s + 40])) for i, s in enumerate(range(0, len(words), 40))]
    rows += [(3, rows[3][1]), (None, "Gardening gardening GARDENING"), (7000, None), (7001, ""), (7002, "x1y2 short"), (7003, "gardenin gardenin " + "z" * 5000 + " " + "z" * 5000)]
    for garbled in (31, 3, None):
        assert got_variants(spelling.variants(spelling.word_counts(docs(spark, rows), garbled=garbled))) == plain_variants(plain_words(rows, garbled)), garbled


def test_chains_of_forms_end_at_one_root(spark):
    """Each step has ten times the count: the pointers double along the chain."""
    chain = [("abcdefghij"[:k] + "x" * (12 - k), 2 * 10 ** (k - 4)) for k in range(4, 10)]
    words = spark.createDataFrame(chain, "word string, n long")
    assert got_variants(spelling.variants(words)) == plain_variants(dict(chain))
    assert spelling.variants(words.limit(0)).count() == 0


def test_masks_of_near_words_share_a_band():
    rng, letters = random.Random(9), [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]
    bit = lambda ch: ord(ch) - 97 if ord(ch) < 128 else (ord(ch) - 192 + 26) % spelling.BITS
    for _ in range(3000):
        w = "".join(rng.choice(letters) for _ in range(9))
        masks = [0, 0]
        for k, word in enumerate((w, edited(rng, w, letters))):
            for ch in word:
                masks[k] ^= 1 << bit(ch)
        flips = masks[0] ^ masks[1]
        assert flips.bit_count() <= 2 and any(flips & m == 0 for m in spelling.BANDS)


# tokens --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    path = public_tokenizers.path(tokencounts.MODEL)
    import sentencepiece

    return tokencounts.Counter(tokencounts.load_vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path), path


def odd_texts():
    rng = random.Random(8)
    out = ["", " ", "   ", " a", "a ", "  a  b ", "a\nb\tc \n\n d", "<s>x</s><unk> <0x41>", "▁x ▁▁", "ﬁ Å", "a\x00b", "１ 日本語の", "\U0001f600\U0001f600 ok", "a" * 5000, "ab" * 3000, " " * 3000, "▁ ▁"]
    letters = "abcdefghi ▁\n\t0123 ,.éñ日本<>s/ ▁the in er on"
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    out += ["".join(rng.choice("aeinorstdlAZ") for _ in range(rng.randint(500, 6000))) for _ in range(12)]
    return out


def test_counts_equal_the_library(counter):
    own, model, _ = counter
    texts = odd_texts()
    assert own.count([*texts, None]) == [*(len(x) for x in model.encode(texts)), 0]


def test_counts_of_slices_and_with_a_full_cache(counter, monkeypatch):
    _, model, path = counter
    monkeypatch.setattr(tokencounts, "SLICE", 50)
    monkeypatch.setattr(tokencounts, "SYMBOLS", 100)
    monkeypatch.setattr(tokencounts, "LONG", 30)
    own, texts = tokencounts.Counter(tokencounts.load_vocabulary(path), kept=40), odd_texts()
    want = [len(x) for x in model.encode(texts)]
    assert own.count(texts) == want and own.count(texts) == want


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_token_query_over_all_documents(spark, counter):
    import pyarrow.parquet as pq

    rows = pq.read_table(SF / "documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(counter[1].encode(r["text"] or ""))) for r in rows}
    got = queries.queries()["op13_rank_merge_tokens"](spark, str(SF)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == len(rows)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_token_rows_of_odd_tables(spark, counter):
    df = spark.createDataFrame([(None, "a b", 1), (2, None, 2), (2, "", 3), (2, "a b", 4), (2, "a b", 4)], "doc_id long, text string, n_tokens int")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencounts.count_tokens(df, counter[2], limit=1).collect()), key=repr)
    assert got == sorted([(None, 3, 2, True), (2, 0, 0, False), (2, 0, 0, False), (2, 3, 2, True), (2, 3, 2, True)], key=repr)
    assert tokencounts.count_tokens(df.limit(0), counter[2]).count() == 0


# SQL -----------------------------------------------------------------------------


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_gemm_centroids", "op12_parity_spelling"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, str(SF))
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)
