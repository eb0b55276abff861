"""Operators on documents against brute force, edge rows included."""

import math
import zlib
from collections import Counter, defaultdict
from functools import reduce

import pytest

from mediaquarry.llm import components, decontam, linededup, minhash, mixing, quality, sharding
from mediaquarry.llm.common import Scratch

from .fixtures import DOCS, components as brute, corpus, edge_rows, edited, prose, shingles, words


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# line dedup -----------------------------------------------------------------


def lines_model(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter()
    for _, t in rows:
        seen.update({key(x) for x in (t or "").split("\n") if key(x)})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("least,batches", [(10, 4), (2, 3)])
def test_lines(docs, edges, least, batches):
    for df in (docs, edges):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = linededup.drop_frequent_lines(df, min_docs=least, batches=batches, fanout=2).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == sorted(lines_model(rows, least), key=repr)


BATCHES = [{b"a": 3, b"b": 1}, {b"a": 5, b"b": 2, b"c": 1}, {b"a": 1, b"b": 4, b"c": 1}, {b"a": 1, b"b": 1, b"c": 1, b"d": 1}]


def batch_of(spark, counts):
    return spark.createDataFrame([(bytearray(k),) for k, n in counts.items() for _ in range(n)], "key binary")


def held(run):
    return {bytes(r.key): r.n for r in run.collect()}


def test_batches_meet_runs(spark):
    """A key lies in one run, that of its first batch; later counts are increments; runs merge while batches come."""
    runs = linededup.LineRuns(spark, min_docs=7, fanout=2)
    for batch in BATCHES:
        runs.add(batch_of(spark, batch))
        if batch is BATCHES[1]:
            assert [[held(r) for r in level] for level in runs.levels] == [[], [{b"a": 3, b"b": 1, b"c": 1}]]
        if batch is BATCHES[2]:
            assert [[held(r) for r in level] for level in runs.levels] == [[{}], [{b"a": 3, b"b": 1, b"c": 1}]]
    assert [[held(r) for r in level] for level in runs.levels] == [[], [], [{b"a": 3, b"b": 1, b"c": 1, b"d": 1}]]
    assert [held(r) for r in runs.increments] == [{b"a": 5, b"b": 2}, {b"a": 1, b"b": 4, b"c": 1}, {b"a": 1, b"b": 1, b"c": 1}]
    assert {bytes(r.key) for r in runs.frequent().collect()} == {b"a", b"b"}
    runs.close()


def test_result_hangs_on_the_anti_join(spark, monkeypatch):
    def frequent():
        runs = linededup.LineRuns(spark, min_docs=8, fanout=2)
        for batch in BATCHES:
            runs.add(batch_of(spark, batch))
        found = sorted(bytes(r.key) for r in runs.frequent().collect())
        runs.close()
        return found

    assert frequent() == [b"a", b"b"]
    with monkeypatch.context() as m:  # no run is met
        m.setattr(linededup.LineRuns, "_unseen", lambda self, batch: batch)
        assert frequent() != [b"a", b"b"]
    with monkeypatch.context() as m:  # one run is withheld
        m.setattr(linededup.LineRuns, "_unseen", lambda self, batch: reduce(self._without, self.runs[:-1], batch))
        assert frequent() != [b"a", b"b"]


def test_runs_are_merged_where_they_lie(spark):
    """The joins of a batch with the runs are merge joins without any exchange or sort of a run."""
    runs = linededup.LineRuns(spark, fanout=3)
    for batch in BATCHES[:2]:
        runs.add(batch_of(spark, batch))
    batch = runs._written(batch_of(spark, BATCHES[2]).groupBy("key").count().withColumnRenamed("count", "n"), "batch")
    with runs._in_order():
        plan = runs._unseen(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 == plan.count("LeftAnti") and "Exchange" not in plan and "Sort [" not in plan
    runs._drop(batch)
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("mq_")]


def test_repeated_rows_are_documents(spark):
    df = spark.createDataFrame([(1, "x\ny")] * 3 + [(2, "x\nz"), (None, "X \n"), (None, None)], "doc_id long, text string")
    rows = [tuple(r) for r in df.collect()]
    got = linededup.drop_frequent_lines(df, min_docs=4, batches=3).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == sorted(lines_model(rows, 4), key=repr)


def test_lines_of_nothing(none):
    assert linededup.drop_frequent_lines(none).count() == 0


# mixing ---------------------------------------------------------------------


def targets_model(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(docs, edges):
    for df in (docs, edges):
        rows = df.collect()
        got = mixing.mix(df).collect()
        assert len(got) == len(rows) and set(got[0].row.asDict()) == {*df.columns}
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.source] += len(words(r.text))
        want, took, largest = targets_model(sizes), defaultdict(int), defaultdict(int)
        for r in got:
            m = r.mix
            r = r.row
            assert m.size == len(words(r.text)) and m.source_size == sizes[r.source] and m.target == pytest.approx(want[r.source])
            assert 0 <= m.copies <= 3
            took[r.source] += m.size * m.copies
            largest[r.source] = max(largest[r.source], m.size)
        for s, t in want.items():
            assert abs(took[s] - t) <= 2 * largest[s] + 1
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(5)).collect()))


def test_mixed_rows(docs):
    m = {r.row.doc_id: r.mix.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in m.items() if c})


def test_mix_unequal_importance(spark):
    rows = [(i, "w " * 10, "s", 1.6 if i < 200 else 0.4) for i in range(400)] + [(1000 + i, "w " * 10, "t", 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, imp double")
    got = [r for r in mixing.mix(df, weights=(1, 4), importance="imp").collect() if r.row.source == "s"]
    heavy = sum(r.mix.copies for r in got if r.row.doc_id < 200)
    light = sum(r.mix.copies for r in got if r.row.doc_id >= 200)
    assert heavy > 2 * light > 0


def test_mix_takes_columns_of_any_name(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 2}", i, i, i, i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix long, mix long, row long, _row long, copies long")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and all(r._mix == r.doc_id == r.copies for r in out.collect())


def test_capped_sources_and_nameless_rows_are_not_ordered(spark, monkeypatch):
    """A source at its cap has no cut; rows without a doc_id meet as one sum."""
    rows = [(i, "w " * 9, "a") for i in range(100)] + [(None, "w " * 9, "b") for i in range(3000)] + [(5000 + i, "w " * 9, "b") for i in range(1000)]
    written = {}
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: written.setdefault(name, write(self, df, name)))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.mix.copies for r in got if r.row.source == "a"} == {3}
    assert {r._source for r in written["cut"].collect()} == {"b"}
    assert len({r.mix.copies for r in got if r.row.doc_id is None}) == 1


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0


# sharding -------------------------------------------------------------------


def plain_bfd(sizes, capacity):
    room, where = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        if fits:
            r, b = min(fits)
            room[b] -= s
        else:
            b = len(room)
            room.append(max(capacity, s) - s)
        where.append((s, b))
    return Counter(where), len(room)


@pytest.mark.parametrize("seed", range(25))
def test_bulk_packing_is_best_fit(seed):
    import random

    r = random.Random(seed)
    sizes = [r.choice([1, 3, 3, 5, 8, 13, r.randint(1, 40)]) for _ in range(r.randint(1, 120))]
    classes = sorted(Counter(sizes).items(), reverse=True)
    cap = r.randint(10, 60)
    runs, bins = sharding.best_fit(classes, cap)
    got, it = Counter(), iter(runs)
    for s, c in classes:
        while c:
            b, k = next(it)
            got[s, b] += k
            c -= k
    assert (got, bins) == plain_bfd(sizes, cap)


def test_room_tree():
    import random

    r, tree, keys = random.Random(1), sharding.RoomTree(), set()
    for _ in range(3000):
        k = (r.randint(0, 50), r.randint(0, 20))
        if k in keys:
            keys.remove(k)
            tree.remove(k)
        else:
            keys.add(k)
            tree.insert(k)
        want = r.randint(0, 55)
        assert tree.tightest(want) == min((x for x in keys if x[0] >= want), default=None)


def test_shards(docs, edges):
    for df, n in ((docs, 24), (edges, 5), (docs, 3)):
        rows = df.collect()
        got = sharding.shard_rows(df, n).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
        slots, size, groups = defaultdict(list), Counter(), defaultdict(set)
        for r in got:
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
            groups[r.size, r.text_crc32].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
        assert all(len(g) == 1 for k, g in groups.items() if k[0] > 8)
        if df is docs:
            assert max(size.values()) - min(size.values()) <= 0.35 * sum(size.values()) / n


def test_fewest_shards_of_a_capacity(docs):
    got = sharding.shard(docs, None, capacity=5000).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) <= 5000 and len(size) <= math.ceil(sum(size.values()) / 5000) + 2


def test_shards_of_nothing(none):
    assert sharding.shard_rows(none).count() == 0


# minhash --------------------------------------------------------------------


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, k, percent)
    assert len(set(want.values())) < len(want)
    got = minhash.near_duplicates(docs, k, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id], k)) for r in got)


def test_large_family_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    base = prose(3, 150)
    rows = [(i, edited(base, i, (i % 7) * 0.01)) for i in range(80)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 3, 85)


def test_tiles_of_one_family_do_not_all_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    written, write = {}, Scratch.write

    def noted(self, df, name):
        written[name] = out = write(self, df, name)
        return out

    monkeypatch.setattr(Scratch, "write", noted)
    base = prose(3, 300)
    rows = [(i, edited(base, i, 0.004)) for i in range(160)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 3, 85)
    tiles = written["tiles"].agg({"tile": "max"}).first()[0] + 1
    assert tiles >= 10 and written["stars"].count() >= tiles - 1 and written["pairs"].count() <= tiles


def test_near_duplicates_edges(edges, none):
    rows = edges.collect()
    got = minhash.near_duplicates(edges, 3, 85).collect()
    assert len(got) == len(rows)
    want = brute([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 3, 85)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert minhash.near_duplicates(none, 3, 85).count() == 0
    kept = minhash.keep_one(edges, 3, 85)
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({**{i: 1 for i, c in want.items() if i == c}, None: 1})


def test_estimate_corrects_collisions():
    import numpy as np

    rng = np.random.default_rng(0)
    est, truth = [], []
    for share in (0.0, 0.3, 0.85):
        for _ in range(30):
            both = rng.integers(0, 2**63, int(3000 * share), dtype=np.uint64)
            a = np.unique(np.concatenate([both, rng.integers(0, 2**63, 3000 - len(both), dtype=np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**63, 3000 - len(both), dtype=np.uint64)]))
            equal = int((minhash.registers(a) == minhash.registers(b)).sum())
            est.append(minhash.may_link(equal, len(a), len(b), 0.85)[1])
            truth.append(len(both) / (len(a) + len(b) - len(both)))
    assert np.abs(np.array(est) - np.array(truth)).mean() < 0.03


def test_components(spark):
    import random

    r = random.Random(4)
    for n, m in ((0, 1), (60, 40), (400, 350), (30, 200)):
        pairs = [(r.randint(0, n * 3), r.randint(0, n * 3)) for _ in range(m)] if n else []
        pairs += [(k, k + 1) for k in range(1000, 1040)]
        parent = {x: x for p in pairs for x in p}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        for few in (10, 100_000):
            got = {r.id: r.component for r in components.connected_components(df, Scratch(spark, "t"), few).collect()}
            assert got == {x: find(x) for x in linked}


def test_components_over_many_arrow_batches(spark):
    import random

    pairs = [(g * 100 + i, g * 100 + i + 1) for g in range(500) for i in range(60)]
    random.Random(5).shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = components.connected_components(df, Scratch(spark, "t")).collect()
    assert len(got) == 500 * 61 and {(r.id, r.component) for r in got} == {(g * 100 + i, g * 100) for g in range(500) for i in range(61)}


# decontamination ------------------------------------------------------------


def test_leaks(spark):
    items = [(k, prose(1000 + k, 20 + k)) for k in range(12)] + [(90, None), (91, ""), (92, "unseen pair")]
    rows = []
    for k in range(12):
        copy = items[k][1]
        rows += [(k, prose(k, 100) + " " + copy + " " + prose(k + 50, 90)), (100 + k, prose(k, 50) + " " + edited(copy, k, 0.12) + " " + prose(9, 40)), (200 + k, prose(5000 + k, 150)), (300 + k, copy.upper().replace(" ", ",  "))]
    rows += [(400, None), (401, ""), (402, "one"), (403, prose(7, 30_000) + " " + items[3][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id long, score string")
    bench = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(df, bench).collect()}
    for k in range(12):
        assert got[k, k].score == 1.0 and got[300 + k, k].score == 1.0
        assert (100 + k, k) in got
        w = decontam.words_of(dict(rows)[k])[got[k, k].start_word : got[k, k].end_word]
        assert w == decontam.words_of(items[k][1])
    assert (403, 3) in got and not [d for d, _ in got if 200 <= d < 300 or 400 <= d < 403]
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.leaks(df.limit(0), bench).count() == 0


def found_leaks(spark, rows, items):
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r.score for r in got}


def plain_alignment(item, passage):
    """The best local alignment's score, cell by cell."""
    best, prev = 0, [0] * (len(passage) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(passage):
            row.append(max(0, prev[j] + (decontam.MATCH if a == b else decontam.OTHER), prev[j + 1] + decontam.GAP, row[j] + decontam.GAP))
        best, prev = max(best, *row), row
    return best


def test_leaks_are_all_pairs_that_align(spark, monkeypatch):
    """Every document against every item, aligned whole; two blocks of items, and their words counted apart."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 800)
    monkeypatch.setattr(decontam, "COUNTED", 1)
    items = [(k, prose(7000 + k, 14 + 6 * k)) for k in range(6)] + [(20, "only three words"), (21, None), (22, " "), (None, prose(1, 20))]
    docs = [(k, f"{prose(k, 30)} {edited(items[k % 6][1], k, (0.0, 0.05, 0.1, 0.3, 0.9)[k % 5])} {prose(k + 40, 25)}") for k in range(40)]
    docs += [(100, "said Only three, words here"), (101, None), (102, ""), (None, items[2][1]), (103, f"{items[0][1]} and {items[5][1]}"), *[(200 + k, prose(k + 300, 60)) for k in range(10)]]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.score for r in got.collect()}
    want = {}
    for i, t in docs:
        for k, u in items:
            a, b = decontam.words_of(u), decontam.words_of(t)
            if k is not None and a and b and (s := plain_alignment(a, b) / (2 * len(a))) >= decontam.SCORE:
                want[i, k] = s
    assert found == pytest.approx(want) and len(want) > 25 and (None, 2) in want


def test_leaks_in_a_tiny_table(spark):
    items = [(1, "alpha beta gamma delta epsilon"), (2, "one two"), (3, "solo")]
    rows = [(k, t) for k, (_, t) in enumerate(items)] + [(3, "alpha beta gamma delta zeta"), (4, "nothing here")]
    assert found_leaks(spark, rows, items) == {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0, (3, 1): 0.8}


def test_leaks_of_an_item_that_dominates(spark):
    item = "what is the tall river that runs past our old town"
    rows = [(k, f"{prose(k, 4)} {item} {prose(k + 900, 4)}") for k in range(200)] + [(500, item.replace("tall", "long"))] + [(600 + k, prose(2000 + k, 40)) for k in range(20)]
    got = found_leaks(spark, rows, [(1, item)])
    assert all(got[k, 1] == 1.0 for k in range(200)) and got[500, 1] > 0.8 and len(got) == 201


def test_leaks_of_common_words(spark):
    import random

    r = random.Random(3)
    common = "the of and a to in is it on as".split()
    plain = [(k, " ".join(r.choice(common) if r.random() < 0.5 else f"w{r.randint(0, 5000)}" for _ in range(300))) for k in range(40)]
    items = [(1, "it is as the a on in and of to"), (2, "to the in of a and on as is it qq rr ss")]
    copies = [(100, f"w1 w2 {items[0][1]} w3"), (101, f"w4 {items[1][1]} w5"), (102, "w6 to the in of a and on as is it w7 w8 w9"), (103, "w6 it is as the w3 on in and of to w7")]
    got = found_leaks(spark, plain + copies, items)
    assert got[100, 1] == got[101, 2] == 1.0 and (102, 2) in got and (103, 1) in got


@pytest.mark.parametrize("shares", [[0.001] * 8, [0.05] * 8, [0.05] * 6 + [0.0, 0.001], [0.5] * 12, [1.0] * 30, [0.02, 0.3] * 9])
def test_seeds_are_the_shortest_windows(shares):
    words, n, chance = [f"w{i}" for i in range(len(shares))], 3, 5.0
    at = range(len(shares))
    passing = [(p, z) for p in at for z in range(p + n, len(shares) + 1) if 1e6 * math.prod(shares[p:z]) <= chance]
    least = [(p, z - p) for p, z in passing if not any((a, b) != (p, z) and p <= a and b <= z for a, b in passing)]
    want = least if any(m == n for _, m in least) else [(p, n) for p in at[: len(shares) - n + 1]]
    assert decontam.seeds_of(words, dict(zip(words, shares)), n, chance) == want


def test_align_is_smith_waterman():
    import random

    import numpy as np

    def plain(a, b):
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    r = random.Random(2)
    for _ in range(200):
        a, b = [r.randint(1, 5) for _ in range(r.randint(1, 12))], [r.randint(1, 5) for _ in range(r.randint(1, 20))]
        score, start, end = decontam.align(np.array(a), np.array(b))
        assert score == plain(a, b) and (not score or plain(a, b[start:end]) == score)


# quality --------------------------------------------------------------------


def test_quality(spark, edges, none):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = prose(i, 40 + i % 50)
        t = " ".join(w.upper() + "!!" for w in t.split()) if bad and i % 8 else t.replace(" ", " $$$ ") if bad else t
        rows.append((i, t, "xx" if bad else "en", "bad" if bad else "good"))
        labels.append((i, 0 if bad else 1, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(df, quality.learnable(lab)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r._score >= quality.CUT) == (r.doc_id % 4 != 0) for r in held)
    assert len(got) == 600 and right >= 0.97 * len(held) and all(0 <= r._score <= 1 for r in got)
    shifted = df.withColumn("source", df.lang)
    again = {r.doc_id: r._score for r in quality.quality_scores(shifted.repartition(5), quality.learnable(lab)).collect()}
    assert all(again[r.doc_id] == r._score for r in got)  # however the rows are dealt
    e = quality.quality_scores(edges, quality.learnable(lab))
    assert e.columns == [*edges.columns, "_score"] and e.count() == edges.count() and e.filter("_score is null").count() == 0
    assert quality.quality_scores(none, lab).count() == 0
    assert {r._score for r in quality.quality_scores(edges, lab.limit(0)).collect()} == {0.5}


def test_words_are_forgotten_between_batches():
    """A task that has met many tokens starts anew; places always lead to a token's own row and index vector."""
    words = quality._Words(most=25)
    for k in range(12):
        texts = [prose(3 * k + j, 5 + 4 * j) for j in range(3)] + [None, ""]
        codes = words.codes([type("T", (), {"as_py": lambda self, t=t: t})() for t in texts], index=True)
        for t, c in zip(texts, codes):
            h = quality.hashes_of(quality.tokens_of(t))
            assert len(c) == len(h) and (not len(c) or (words.rows[c] == h % quality.ROWS).all() and (words.index[c] == quality.index_vectors(h)).all())
        assert len(words) <= 25 + 60


def test_quality_is_the_plain_model(spark, monkeypatch):
    """Word vectors, features and scores against loops over tokens, with stretches shorter than texts."""
    import numpy as np

    monkeypatch.setattr(quality, "ROWS", 512)
    texts = [prose(i, 3 + 7 * i) for i in range(60)] + [None, "", "one", "a b", "!! a !! a !! a"]
    df = spark.createDataFrame([(i, t, float(i % 2)) for i, t in enumerate(texts)], "doc_id long, text string, _score double")
    tokens = [quality.tokens_of(t) for t in texts]
    row = lambda w: int(quality.hashes_of([w])[0] % np.uint64(512))
    index = {w: quality.index_vectors(quality.hashes_of([w]))[0].astype(int) for t in tokens for w in t}
    assert len({v.tobytes() for v in index.values()}) == len(index)  # of the token itself, not of its row
    table = np.zeros((512, quality.DIM))
    for t in tokens:
        for i, w in enumerate(t):
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if i != j:
                    table[row(w)] += index[t[j]]

    batches = lambda k: [type("B", (), {"column": lambda self, _, p=texts[s : s + k]: [type("T", (), {"as_py": lambda self, t=t: t})() for t in p]})() for s in range(0, len(texts), k)]
    for stretch in (5, 20_000):
        monkeypatch.setattr(quality, "STRETCH", stretch)
        got = np.zeros((512, quality.DIM))
        for b in quality._context(iter(batches(7))):
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[k] += np.frombuffer(v, dtype=np.int8 if len(v) == quality.DIM else np.int32)
        assert (got == table).all()
        stored = np.rint(127 * table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.int8)
        unit = stored / 127
        for t in tokens:
            v = unit[[row(w) for w in t]]
            want = np.zeros(quality.FEATURES)
            if t:
                want[:64], want[64:128] = v.mean(0), v.std(0)
            for k in (1, 2):
                if len(t) > k:
                    near = (v[k:] * v[:-k]).sum(1)
                    want[126 + 2 * k : 128 + 2 * k] = near.mean(), near.std()
            assert quality.features(np.array([row(w) for w in t], dtype=np.int64), stored) == pytest.approx(want, abs=2e-4)
    monkeypatch.undo()
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    sc = spark.sparkContext
    vectors = quality.word_vectors(df)
    model = quality.learn(df, labels, sc.broadcast(vectors))
    want = {i: float(model.score(np.array([quality.features((quality.hashes_of(t) % np.uint64(quality.ROWS)).astype(np.int64), vectors)]))[0]) for i, t in enumerate(tokens)}
    assert {r.doc_id: r.mine for r in quality.quality_scores(df, labels, name="mine").collect()} == pytest.approx(want, abs=1e-6)
    good = quality.keep_good(df, labels, 0.0)
    assert good.columns == df.columns and {r.doc_id: r._score for r in good.collect()} == {i: float(i % 2) for i in range(len(texts))}


def test_shared_folder_is_named_or_local():
    from types import SimpleNamespace

    from mediaquarry.llm.common import shared_root

    def session(master, folder=None):
        conf = {"spark.master": master, **({"spark.checkpoint.dir": folder} if folder else {})}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(getConf=lambda: conf))

    assert shared_root(session("spark://host:7077", "hdfs:///x/")) == "hdfs:///x"
    assert shared_root(session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://h"):
        with pytest.raises(RuntimeError):
            shared_root(session(master))
