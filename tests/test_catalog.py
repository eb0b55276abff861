"""Operators of the catalog engine against hand-computed results and plain models."""

import math
import re
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mediaquarry.config import Settings
from mediaquarry.functions import dates, media, text, vectors
from mediaquarry.operators import clusters, detect, memories, mutations, projection, relations, search, similarity
from mediaquarry.schema import conform
from mediaquarry.sources import scan
from mediaquarry.sources.store import Library
from mediaquarry.streaming import ingest


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def items_of(spark, rows):
    """rows: dicts; other fields get their defaults."""
    base = "id string, captured_at string, modified_ts double, media_kind string, favorite boolean, hidden boolean, tags array<string>, title string, relative_key string, manual_persona_ids array<string>, notes string"
    names = [f.split()[0] for f in base.split(", ")]
    return conform(spark.createDataFrame([[r.get(n) for n in names] for r in rows], base), "items")


# parsing and scalars ----------------------------------------------------------


@pytest.mark.parametrize("q,filters,rest", [("cat", {}, "cat"), ("type:video", {"type": "video"}, ""), ("type:live_photo person:alice", {"type": "live_photo", "person": "alice"}, ""), ("year:2026 tag:dog", {"year": "2026", "tag": "dog"}, ""), ("year: foo:bar tag:a tag:b Person:x", {"tag": "b"}, "year: foo:bar Person:x"), ("", {}, "")])
def test_parse(q, filters, rest):
    assert search.parse_query(q) == search.Query(filters, rest)


def test_settings():
    s = Settings()
    assert [round(s.join_cosine(k), 2) for k in ("person", "pet")] == [0.69, 0.78] and [round(s.merge_cosine(k), 2) for k in ("person", "pet")] == [0.64, 0.76]
    assert s.join_hamming("pet") == 8 and s.merge_hamming("person") == 10
    assert Settings.load('{"memory_min_items": 3}').memory_min_items == 3 and Settings.load(Settings().dump()) == Settings()
    with pytest.raises(ValueError):
        Settings.load('{"nope": 1}')


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    empty = F.expr("cast(array() as array<double>)")
    r = one(spark, vectors.cosine(a(1, 0), a(2, 0)), vectors.cosine(a(1, 0), a(0, 3)), vectors.cosine(a(1, 0), a(-1, 0)), vectors.cosine(a(0, 0), a(1, 0)), vectors.cosine(a(1), a(1, 0)), vectors.cosine(empty, empty), vectors.euclidean(a(0, 3), a(4, 0)), vectors.euclidean(a(1), a(1, 2)))
    assert list(r) == [1, 0, -1, -1, -1, -1, 5, math.inf]
    h = lambda x, y: vectors.hamming(F.lit(x), F.lit(y))
    r = one(spark, h("0" * 16, "0" * 16), h("0" * 16, "f" * 16), h("8" + "0" * 15, "0" * 16), h("zz", "zy"), h("ab", "abc"))
    assert list(r) == [0, 64, 1, 1, math.inf]
    b = lambda *v: F.array(*[F.lit(x) for x in v])
    r = one(spark, vectors.iou(b(0, 0, 2, 2), b(1, 1, 2, 2)), vectors.iou(b(0, 0, 2, 2), b(2, 0, 2, 2)), vectors.iou(b(0, 0, 2, 2), b(0, 0, 2, 2)), vectors.iou(b(0, 0), b(1, 1, 2, 2)), vectors.padded_box(b(1, 2)))
    assert r[0] == pytest.approx(1 / 7) and list(r)[1:4] == [0, 1, 0] and r[4] == [1, 2, 0, 0]


def test_text(spark):
    r = one(spark, text.title_from_stem(F.lit("_my-cat_")), text.title_from_stem(F.lit("--")), text.tags_from_key(F.lit("Trip_2024/IMG-12/cat.JPG")), text.title_case(F.lit("o'neil a-b")), text.search_tokens(F.lit("  A  b ")), text.pet_label(F.lit("Tom-Cat"), F.lit(False), F.lit(True)), text.pet_label(F.lit("x"), F.lit(False), F.lit(True)), text.pet_tags(F.lit("Dog"), F.lit(True)))
    assert list(r) == ["my cat", "--", ["trip", "2024", "img", "cat", "jpg"], "O'Neil A-B", ["a", "b"], "cat", "dog", ["animal", "dog", "dog face", "pet"]]


def test_fuzzy():
    assert text.fuzzy_score_of("cat", "a cat sat") == 100 and text.fuzzy_score_of("zzz", "aaa") == 0
    assert 60 <= text.fuzzy_score_of("kitten", "a sitting dog") < 100
    assert text._ratio("abcd", "bcde") == pytest.approx(75)


def test_dates(spark):
    g = lambda k: dates.guessed_date(F.lit(k), F.lit(86400.0))
    r = one(spark, g("2026/04/21/IMG_0001.HEIC"), g("2024/02/31/x"), g("a/b"), g("2020/2020/7"), g("IMG_99999999999999999999_1999"), dates.exif_date(F.lit("2020:01:02 03:04:05")), dates.exif_date(F.lit("junk")))
    assert list(r) == ["2026-04-21T00:00:00+00:00", "1970-01-02T00:00:00+00:00", "1970-01-02T00:00:00+00:00", "2020-07-01T00:00:00+00:00", "1999-01-01T00:00:00+00:00", "2020-01-02T03:04:05+00:00", None]
    r = one(spark, dates.captured_ts(F.lit("2020-01-02T03:04:05.123456+00:00"), F.lit(0.0)), dates.captured_ts(F.lit("nope"), F.lit(86400.0)))
    assert r[0] == datetime(2020, 1, 2, 3, 4, 5, 123456) and r[1] == datetime(1970, 1, 2)
    assert dates.eta_seconds(10, 2, 4) == 10 and dates.eta_seconds(1, 0, 3) is None and dates.eta_seconds(1, 3, 3) is None


def test_media(spark):
    r = one(spark, *[media.media_kind(F.lit(p)) for p in ("a/B.JPeG", "x.mov", "x.gif", "x.txt", ".jpg", "dir.jpg/x")])
    assert list(r) == ["image", "video", "gif", None, None, None]
    assert media.sample_frames_of(5, 30) == [0, 1, 2, 3, 4] and media.sample_frames_of(0, 30) == []
    got = media.sample_frames_of(3000, 30)
    assert got[0] == 0 and got[-1] == 2999 and len(got) == 12
    px = [random.Random(1).random() for _ in range(64)]
    assert one(spark, media.average_hash(F.array(*[F.lit(p) for p in px])))[0] == media.average_hash_of(px)


# search ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        dict(id="a", captured_at="2026-01-03T00:00:00+00:00", modified_ts=1.0, media_kind="image", favorite=True, tags=["Cat", "cat", ""], title="Cat 100%", manual_persona_ids=["p2"]),
        dict(id="b", captured_at="2026-01-03T00:00:00+00:00", modified_ts=2.0, media_kind="video", tags=["dog"], title="a_b c:\\d"),
        dict(id="c", captured_at="2025-01-01T00:00:00+00:00", modified_ts=3.0, media_kind="image", hidden=True, tags=[], title="hidden cat"),
        dict(id="d", captured_at="junk", modified_ts=86400.0, media_kind="live_photo", tags=["x"], title="axb", manual_persona_ids=["p1", "p2"]),
    ]
    items = items_of(spark, rows)
    personas = conform(spark.createDataFrame([("p1", "Alice", "person"), ("p2", "ALICE", "pet"), ("p3", "Ünal", "person")], "id string, name string, kind string"), "personas")
    return items, personas, relations.item_tags(items), relations.item_personas(items), relations.item_search(items, personas)


def ids(df):
    return [r.id for r in df.collect()]


def test_query_items(small):
    items, personas, tags, links, blobs = small
    q = lambda **k: ids(search.query_items(items, tags, links, personas, blobs, **k))
    assert q() == ["d", "b", "a"] and q(include_hidden=True) == ["d", "b", "a", "c"] and q(favorites=True) == ["a"] and q(year="2026") == ["b", "a"]
    assert q(tag="CAT") == ["a"] and q(persona_kind="person") == ["d"] and q(persona_ids=["p2"], persona_kind="person") == ["d", "a"]
    assert q(text="CAT 100%") == ["a"] and q(text="a_b") == ["d", "b"] and q(text="c:\\d") == ["b"] and q(limit=1, offset=1) == ["b"] and q(limit=0) == ["d", "b", "a"] and q(offset=2) == ["a"]


def test_composite(small):
    items, personas, tags, links, blobs = small
    q = lambda s, **k: ids(search.search(items, tags, links, personas, blobs, s, **k))
    assert q("person:alice") == ["d"] and q("pet:ALICE") == ["d", "a"] and q("person:alice pet:alice") == [] and q("person:nobody") == []
    assert q("cat") == ["a"] and q("type:image year:2026 cat") == ["a"] and q("cat", persona_id="p1") == []
    assert ids(search.search_in_memory(items, links, personas, blobs, "person:alice pet:alice")) == ["d"]
    assert set(ids(search.search_in_memory(items, links, personas, blobs, "cat"))) >= {"a", "c"}


def test_fuzzy_queries_read_whole_texts(spark, tmp_path):
    from mediaquarry.plans import registry

    filler = " ".join(f"zq{k}" for k in range(400))
    rows = [(k, f"{filler} {tail} {filler}") for k, tail in enumerate(["x", "polished stel", "The heing or motion", "of thing ration or caution", "xx yy", "th a ing or b ion", "heing", "POLISHED", "th yy ing oration"] * 3)] + [(90, None), (91, "the heing")]
    spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["search_fuzzy_ranked"](spark, str(tmp_path)).collect()
    scores = {str(k): text.fuzzy_score_of("Polished STEEL", (t or "").lower()) for k, t in rows}
    assert [(r.id, r.score) for r in got] == sorted(((k, s) for k, s in scores.items() if s >= 35), key=lambda x: (-x[1], x[0])) and got
    got = registry.queries()["search_composite_text"](spark, str(tmp_path)).collect()
    found = {str(k): text.fuzzy_score_of("Th%ing Or%ion", t.lower()) for k, t in rows if t and k % 10 and re.search("th.*ing", t.lower()) and re.search("or.*ion", t.lower())}
    assert len(set(found.values())) > 1  # no token stands there verbatim, so scores differ
    assert {r.id: r.score for r in got} == {k: s for k, s in found.items() if s >= 35} and got and [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_pages(spark, small):
    items = small[0]
    ordered = items.orderBy(*search.recency())
    whole, at = [], 0
    while True:
        p = search.collect_page(ordered, 3, at)
        whole += [r.id for r in p.items]
        at = p.next_offset
        if not p.has_more:
            break
    assert whole == ids(ordered) and search.collect_page(ordered, 0).items == [] and not search.collect_page(ordered, 3, 99).has_more
    last, chained = None, []
    while rows := search.page_after(items, 2, last).collect():
        chained += [r.id for r in rows]
        last = (rows[-1].captured_at, rows[-1].modified_ts, rows[-1].id)
    assert chained == ids(ordered)
    peeked = [search.peeked_page(items, search.recency(), 3, at).collect() for at in (0, 3, 99)]
    assert [r.id for p in peeked for r in p] == ids(ordered)[:6] and peeked[0][0].more and peeked[0][0].next == 3
    ties = items.limit(1).crossJoin(spark.range(7).select(F.col("id").cast("string").alias("k"))).withColumn("id", F.col("k")).drop("k")
    assert [r.id for r in search.page_after(ties, 3, ("zz", 0.0, "")).collect()] == ["0", "1", "2"]
    one = search.page_after(ties, 3).collect()[-1]
    assert [r.id for r in search.page_after(ties, 9, (one.captured_at, one.modified_ts, one.id)).collect()] == ["3", "4", "5", "6"]
    assert [r.id for r in search.load_in_order(items, search.id_list(spark, ["c", "a", "c", "zz", ""])).orderBy("pos").collect()] == ["c", "a", "c"]
    album = spark.createDataFrame([(["b", "gone", "a"],)], "item_ids array<string>")
    assert ids(search.members_page(album, items, 2)) == ["b"] and ids(search.members(album, items)) == ["b", "a"]


def test_relations(small):
    items, personas, tags, links, blobs = small
    assert sorted((r.item_id, r.tag) for r in tags.collect()) == [("a", "cat"), ("b", "dog"), ("d", "x")]
    assert {r.item_id: r.search_blob for r in blobs.collect()}["d"] == "axb live_photo x alice alice"
    assert {r.item_id: r.names for r in relations.personas_of_items(items, personas).collect()} == {"a": ["ALICE"], "d": ["Alice", "ALICE"]}
    lines = {r.id: r.details.split("\n") for r in relations.item_details(items, personas).collect()}
    assert "Favorite: yes" in lines["a"] and "Tags: None" in lines["c"] and "Detected Subjects: None" in lines["b"]


# collections ------------------------------------------------------------------


def test_memories(spark):
    rows = [dict(id=f"m{i:02}", captured_at=f"2024-05-{1 + i % 2:02}T00:00:{i:02}+00:00", modified_ts=0.0, tags=["beach", "image", "ab", "kitten"] if i < 8 else [], favorite=i < 6) for i in range(50)]
    rows += [dict(id=f"n{i}", captured_at=f"2024-05-{10 + 3 * (i // 3):02}T23:59:00+00:00", modified_ts=0.0, tags=[]) for i in range(6)]
    items = items_of(spark, rows)
    month = memories.month_memories(items).first()
    assert (month.weight, len(month.item_ids), month.start_date, month.item_ids[0]) == (74, 48, "2024-05-01T00:00:00+00:00", "n3") and month.title == "May 2024"
    assert {r.title: r.weight for r in memories.day_memories(items).collect()} == {"May 01, 2024": 49, "May 02, 2024": 49}
    span = memories.span_memories(items).collect()
    assert [(r.title, r.subtitle) for r in span] == [("May 01 to May 02, 2024", "50 moments across 2 days")]
    theme = {r.title: r.weight for r in memories.theme_memories(items).collect()}
    assert theme == {"Beach": 16, "Cats": 22} and memories.favorite_memories(items).first().weight == 18
    links = spark.createDataFrame([(f"m{i:02}", p) for i in range(7) for p in "abcde"], "item_id string, persona_id string")
    people = spark.createDataFrame([(p, p.upper(), "pet" if p == "a" else "person") for p in "abcde"], "id string, name string, kind string")
    pairs = memories.pair_memories(items, links, people).collect()
    assert len(pairs) == 6 and {p.title for p in pairs} == {"A and B", "A and C", "A and D", "B and C", "B and D", "C and D"}
    assert {r.title: r.weight for r in memories.persona_memories(items, links, people).collect()}["A"] == 37
    top = memories.regenerate(items, links, people).collect()
    assert len(top) <= 24 and len({r.id for r in top}) == len(top) and top[0].weight == max(r.weight for r in top)


# similarity and clusters --------------------------------------------------------


def unit(r, dim=8):
    v = [r.gauss(0, 1) for _ in range(dim)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def planted(seed, n=60, dim=8):
    r, out = random.Random(seed), []
    centres = [unit(r, dim) for _ in range(6)]
    for i in range(n):
        c = centres[i % 6]
        v = [x + r.gauss(0, 0.15) for x in c]
        sig = f"{r.getrandbits(64):016x}" if i % 3 == 0 else ""
        out.append((f"i{i // 2}", f"d{i}", "face" if i % 10 else "pet", "face" if i % 10 else ("cat" if i % 20 else "pet"), 0.5 + (i % 5) / 10, None if i % 11 else "someone", v if i % 7 else [], sig, f"2024-01-{1 + i % 9:02}", i % 2 == 0))
    return out


DET = "item_id string, detection_id string, kind string, label string, confidence double, persona_id string, encoding array<double>, signature string, captured_at string, cluster_dirty boolean"


def plain_clusters(rows, kind, s):
    """Leader clustering with restarting merges, in lists and loops."""
    own = [r for r in rows if not r[5] and ((r[2] == "face") if kind == "person" else r[2].startswith("pet") or r[3] == "cat") and (r[6] or r[7])]
    own.sort(key=lambda r: (r[0], r[1]))
    own.sort(key=lambda r: r[8], reverse=True)
    cos, ham, out = vectors.cosine_of, vectors.hamming_of, []

    def learn(c, r):
        if r[6] and (not c["v"] or max(cos(r[6], v) for v in c["v"]) < 0.985):
            c["v"].append(r[6])
        if r[7] and (not c["h"] or min(ham(r[7], h) for h in c["h"]) > 8):
            c["h"].append(r[7])

    for r in own:
        best, top, near, least = None, -1, None, math.inf
        for c in out:
            if r[6] and c["v"] and (x := max(cos(r[6], v) for v in c["v"])) >= s.join_cosine(kind) and x > top:
                best, top = c, x
            if r[7] and c["h"] and (x := min(ham(r[7], h) for h in c["h"])) <= s.join_hamming(kind) and x < least:
                near, least = c, x
        c = best or near
        if c is None:
            c = {"rows": [], "v": [], "h": []}
            out.append(c)
        c["rows"].append(r)
        learn(c, r)
    again = True
    while again:
        again = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                a, b = out[i], out[j]
                la, lb = {r[3] for r in a["rows"]}, {r[3] for r in b["rows"]}
                if kind == "pet" and not ("pet" in la | lb or la & lb):
                    continue
                if any(cos(x, y) >= s.merge_cosine(kind) for x in a["v"] for y in b["v"]) or any(ham(x, y) <= s.merge_hamming(kind) for x in a["h"] for y in b["h"]):
                    a["rows"] += b["rows"]
                    for v in b["v"]:
                        learn(a, [None] * 6 + [v, ""])
                    for h in b["h"]:
                        learn(a, [None] * 6 + [[], h])
                    out.pop(j)
                    again = True
                    break
            if again:
                break
    return {frozenset(r[1] for r in c["rows"]) for c in out}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("kind", ["person", "pet"])
def test_clusters(spark, seed, kind):
    rows, s = planted(seed), Settings(face_embedding_similarity_threshold=0.60 + seed / 20)
    m = clusters.cluster_unknown(spark.createDataFrame(rows, DET), kind, s).collect()
    got = {}
    for r in m:
        got.setdefault(r.cluster_id, set()).add(r.detection_id)
    assert {frozenset(v) for v in got.values()} == plain_clusters(rows, kind, s)


def test_finalize_and_incremental(spark):
    rows = planted(1)
    det = spark.createDataFrame(rows, DET)
    m = clusters.cluster_unknown(det, "person")
    f = clusters.finalize(m).collect()
    assert sum(r.member_count for r in f) == m.count() and all(r.item_count <= r.member_count for r in f)
    refs = clusters.kept_references(m, det)
    assert refs.count() == len(f)
    mode, part = clusters.refresh(clusters.finalize(m), m.select("cluster_id", "item_id", "detection_id"), det, "person")
    assert mode == "incremental" and part.select("detection_id").distinct().count() == part.count() == m.count()
    clean = det.withColumn("cluster_dirty", F.lit(False))
    assert clusters.refresh(clusters.finalize(m).limit(0), m.limit(0).select("cluster_id", "item_id", "detection_id"), clean, "person")[0] == "full"


def test_matching(spark):
    people = spark.createDataFrame([("p1", "person", [[1.0, 0.0]], []), ("p2", "person", [[0.9, 0.1], [0.0, 1.0]], []), ("q", "pet", [[1.0, 0.0]], ["0" * 16])], "id string, kind string, reference_encodings array<array<double>>, reference_signatures array<string>")
    rows = [("i", "a", "face", "face", 0.9, None, [0.0, 2.0], "", "", True), ("i", "b", "face", "face", 0.9, None, [-1.0, 0.01], "", "", True), ("i", "c", "pet", "cat", 0.9, None, [], "0" * 15 + "7", "", True), ("i", "d", "face", "face", 0.9, "zz", [1.0, 0.0], "", "", True), ("i", "e", "object", "car", 0.9, None, [1.0, 0.0], "", "", True), ("i", "f", "face", "face", 0.9, None, [3.0, 0.0], "", "", True)]
    got = {r.detection_id: r.persona_id for r in similarity.auto_assign(spark.createDataFrame(rows, DET), people).collect()}
    assert got == {"a": "p2", "b": None, "c": "q", "d": "zz", "e": None, "f": "p1"}
    refs = spark.createDataFrame([("c", [[1.0, 0.0]], ["0" * 16])], "cluster_id string, encodings array<array<double>>, signatures array<string>")
    best = similarity.suggestions(similarity.cluster_scores(refs, people, "person"), 1).collect()
    assert [(r.persona_id, r.score) for r in best] == [("p1", 1.0)]


def test_folds_on_spark(spark):
    cols = "item_id string, frame int, pos int, id string, kind string, label string, confidence double, bbox array<int>, persona_id string, encoding array<double>, signature string"
    rows = [("x", f, 0, f"d{f}", "face", "face", 0.5 + f / 10, [0, 0, 9, 9], None, [1.0, f / 100], None) for f in range(3)] + [("y", 0, 0, "e", "object", "car", 0.5, [0, 0, 9, 9], None, [], None)]
    df = spark.createDataFrame(rows, cols)
    got = detect.merge_frames(df).collect()
    assert sorted((r.item_id, r.id) for r in got) == [("x", "d2"), ("y", "e")]
    prev = df.filter("frame = 0").drop("frame").withColumn("persona_id", F.lit("p"))
    now = df.filter("frame = 1").drop("frame")
    carried = detect.carry_assignments(now, prev).collect()
    assert [(r.item_id, r.persona_id) for r in carried] == [("x", "p")]
    refs = spark.createDataFrame([("p", 0, [1.0, 0.0], None), ("p", 1, [1.0, 0.001], None), ("p", 2, [0.0, 1.0], None), ("p", 3, [], "0" * 16)], "persona_id string, seq int, encoding array<double>, signature string")
    assert [r.kept for r in detect.distinct_references(refs).orderBy("seq").collect()] == [True, False, True, True]


def test_projection(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, [r.gauss(0, 3), r.gauss(0, 2), r.gauss(0, 1), 0.0]) for i in range(200)], "vec_id long, embedding array<double>")
    stats = projection.project(df).agg(F.avg("x"), F.stddev_pop("x"), F.stddev_pop("z")).first()
    assert abs(stats[0]) < 1e-9 and stats[1] == pytest.approx(1) and stats[2] == pytest.approx(1)


# ingest, changes, storage -------------------------------------------------------


def test_scan(spark):
    files = [("t/IMG_1.HEIC", 5, 10), ("t/IMG_1.MOV", 7, 30), ("t/IMG_1.gif", 1, 20), ("u/a.mp4", 3, 1), ("u/b.TXT", 3, 1), ("2026/04/21/IMG_0001.HEIC", 2, 5)]
    got = {r.relative_key: r for r in scan.build_assets(spark.createDataFrame(files, "path string, size_bytes long, mtime_ns long")).collect()}
    assert set(got) == {"t/IMG_1", "u/a.mp4", "2026/04/21/IMG_0001.HEIC"}
    live = got["t/IMG_1"]
    assert (live.media_kind, live.size_bytes, live.path, len(live.component_paths)) == ("live_photo", 13, "t/IMG_1.HEIC", 3) and got["2026/04/21/IMG_0001.HEIC"].captured_at.startswith("2026-04-21")


def test_list_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jpg").write_bytes(b"123")
    r = scan.list_files(spark, str(tmp_path)).first()
    assert (r.path, r.size_bytes) == ("a/x.jpg", 3)


def test_diff_and_feed(spark):
    now = spark.createDataFrame([("a", "1", "r"), ("b", "2", "r"), ("c", "3", "r"), ("d", "4", "r")], "id string, file_signature string, rev string")
    old = spark.createDataFrame([("b", "2", "r"), ("c", "9", "r"), ("d", "4", "q"), ("e", "5", "r")], "id string, file_signature string, rev string")
    diff = ingest.snapshot_diff(now, old, revision="rev")
    assert {r.id: r.action for r in diff.collect()} == {"a": "added", "b": "unchanged", "c": "changed", "d": "reanalyse", "e": "removed"}
    assert ingest.diff_counts(diff).first().asDict() == {"added": 1, "updated": 2, "removed": 1, "unchanged": 1}


def test_library(spark, tmp_path, small):
    items, personas = small[0], small[1]
    lib = Library(spark, str(tmp_path / "lib"))
    d = "array(named_struct('id', 'd1', 'kind', 'face', 'label', 'face', 'confidence', 0.5D, 'bbox', array(1, 2), 'persona_id', '', 'encoding', array(1.0D), 'signature', cast(null as string)))"
    items = items.withColumn("detections", F.expr(f"if(id = 'a', {d}, detections)"))
    empty = {n: lib.table(n) for n in ("albums", "memories")}
    lib.save_state(items, personas, empty["albums"], empty["memories"], "t1")
    det = lib.table("detections")
    r = det.first()
    assert (det.count(), r.bbox_x, r.bbox_w, r.persona_id, r.cluster_dirty) == (1, 1, 0, None, True) and lib.metadata("updated_at") == "t1" and lib.metadata("schema_version") == "1"
    lib.save({"detections": ingest.mark_clean(det, det, "r1")})
    lib.save_items(lib.table("items").filter("id = 'a'").withColumn("title", F.lit("new")), spark.createDataFrame([("b",)], "id string"), "t2")
    assert lib.find("items", "a").first().title == "new" and lib.table("items").count() == 3 and not lib.table("detections").first().cluster_dirty
    lib.export_json(str(tmp_path / "json"))
    other = Library(spark, str(tmp_path / "other"))
    assert other.import_json(str(tmp_path / "json")) and other.table("items").count() == 3 and not other.import_json(str(tmp_path / "json"))


def test_mutations(spark, small):
    items, personas = small[0], small[1]
    more = mutations.create_persona(mutations.create_persona(personas, " Bob ", "person", "t"), "BOB", "person", "t")
    assert [r.color for r in more.filter("name = 'Bob'").collect()] == ["#B56576"] and more.count() == 4
    fav = lambda want: {r.id: r.favorite for r in mutations.toggle_favorite(items, spark.createDataFrame([(i,) for i in want], "id string")).collect()}
    assert fav(["a"])["a"] is False and fav(["a", "b"])["a"] is True and fav(["a", "b"])["b"] is True
    albums = mutations.create_album(conform(spark.createDataFrame([], "id string"), "albums"), items, "Trip", ["a", "zz", "a"], "t")
    album = albums.first()
    assert album.item_ids == ["a"] and mutations.add_to_album(albums, items, album.id, ["b", "a"]).first().item_ids == ["a", "b"] and mutations.delete_album(albums, "none").count() == 1
    det = spark.createDataFrame(planted(3), DET)
    members = clusters.cluster_unknown(det, "person").select("cluster_id", "item_id", "detection_id")
    first = members.limit(1)
    n = members.join(first.select("cluster_id"), "cluster_id", "left_semi").count()
    assert mutations.assign_region(det, members, first, "me", "person").filter("persona_id = 'me'").count() == n
    m = mutations.upsert(items.select("id", "title"), spark.createDataFrame([("a", "x"), ("new", "y")], "id string, title string"))
    assert m.count() == 5 and mutations.upsert(m, m.filter("id = 'a'")).count() == 5
    r = one(spark, mutations.merge_maps(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3)")))
    assert r[0] == {"a": 1, "b": 3}


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k int, t int, v string").parquet(src)
    ingest.stream_upserts(stream, str(tmp_path / "out"), "k", "t", str(tmp_path / "ck")).awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()} == {(1, "b"), (2, "c")}


def test_stream_batches_rewrite_touched_parts(spark, tmp_path):
    src, out, ddl = str(tmp_path / "src"), str(tmp_path / "out"), "k int, t int, v string"
    run = lambda: ingest.stream_upserts(spark.readStream.schema(ddl).parquet(src), out, "k", "t", str(tmp_path / "ck"), parts=8).awaitTermination()
    spark.createDataFrame([(k, 1, f"a{k}") for k in range(60)], ddl).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([(7, 2, "b7"), (7, 3, "c7")], ddl).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {(r.k, r.v) for r in ingest.read_upserts(spark, out, ddl).collect()} == {(k, "c7" if k == 7 else f"a{k}") for k in range(60)}
    assert len(list((tmp_path / "out" / "v=0").glob("_part=*"))) == 8 and len(list((tmp_path / "out" / "v=1").glob("_part=*"))) == 1
    (tmp_path / "out" / "v=1" / "_SUCCESS").unlink()  # as if the batch had stopped
    assert {(r.k, r.v) for r in ingest.read_upserts(spark, out, ddl).collect()} == {(k, f"a{k}") for k in range(60)}


def test_api(spark, tmp_path):
    from mediaquarry.api import LibraryApi, int_param

    assert [int_param(v, 180) for v in (None, "", "x", "0", "7")] == [180, 180, 180, 1, 7]
    api = LibraryApi(Library(spark, str(tmp_path / "api")))
    files = lambda rows: spark.createDataFrame(rows, "path string, size_bytes long, mtime_ns long")
    r = api.sync(files([("2024/05/cat.jpg", 1, 1), ("2024/05/dog.mp4", 2, 2)]), "t1").first()
    assert (r.added, r.updated, r.removed) == (2, 0, 0)
    r = api.sync(files([("2024/05/cat.jpg", 9, 1), ("2024/06/new.gif", 2, 2)]), "t2").first()
    assert (r.added, r.updated, r.removed) == (1, 1, 1)
    assert {x.title for x in api.items("type:gif").collect()} == {"new"} and {x.title for x in api.items("cat").collect()} == {"cat"}
    cat = api.items("cat").first().id
    api.create_persona("Alice", "person", "t3")
    who = api.personas().first().id
    api.assign_item(cat, who, "t4")
    assert api.items("person:alice").first().personaNames == ["Alice"] and api.persona_items(who).count() == 1
    assert api.item(cat).first().details.startswith("Title: cat\nType: image")
    api.create_album("Trip", [cat], "t5")
    album = api.albums().first()
    assert album.itemCount == 1 and api.album_items(album.id).count() == 1
    api.toggle_favorite([cat], "t6")
    assert api.items(favorites="1").count() == 1 and {x.name: x.n for x in api.status().collect()}["people"] == 1
    api.clear_item(cat, "t7")
    assert api.items("person:alice").count() == 0
    api.rebuild_clusters("person", "t8")
    api.regenerate_memories("t9")
    assert api.unknown_clusters().count() == 0 and api.memories().count() == 0


FOUND = "id string, detections array<struct<id:string,kind:string,label:string,confidence:double,bbox:array<int>,persona_id:string,encoding:array<double>,signature:string>>, tags array<string>, metadata map<string,string>"


def faces(*rows):
    """Detections (id, kind, label, vector, hash); the box tells the place."""
    return [(i, kind, name, 0.9, [10 * k, 0, 8, 8], None, v, h) for k, (i, kind, name, v, h) in enumerate(rows)]


def test_assignments_persist(spark, tmp_path):
    """Assigned people are found, teach matching, and survive new analysis, syncs, clearing and deletion."""
    from mediaquarry.api import LibraryApi

    api = LibraryApi(Library(spark, str(tmp_path / "lib")))
    files = lambda rows: spark.createDataFrame(rows, "path string, size_bytes long, mtime_ns long")
    names = ["2024/05/a.jpg", "2024/05/b.jpg", "2024/06/c.jpg"]
    seen = {"a": faces(("f1", "face", "", [1.0, 0.0, 0.0], ""), ("f2", "face", "", [0.0, 1.0, 0.0], "")), "b": faces(("f1", "face", "", [0.6, 0.8, 0.0], "")), "c": faces(("p1", "pet", "dog", [], "00ff00ff00ff00ff"))}

    def analyse(found, pipeline="v1"):
        def run(items):
            rows = [(r.id, found[r.title], ["face", "found"], {"human_face_pipeline": pipeline}) for r in items.select("id", "title").collect()]
            return spark.createDataFrame(rows, FOUND)

        return run

    r = api.sync(files([(n, 1, 1) for n in names]), "t1", analyse(seen)).first()
    assert (r.added, r.updated, r.removed) == (3, 0, 0) and api.count_detections() == 4 and api.count_detections("pet") == 1
    assert api.count_detections("person", dirty_only=True) == 3
    at = {x.title: x.id for x in api.items().collect()}
    api.assign_region(at["a"], "f1", "", "t2", new_name="Alice")
    who = api.personas("person").first()
    assert who.name == "Alice" and who.avatarItemId == at["a"]
    people = lambda: {x.id: (x.reference_encodings, x.reference_signatures) for x in api.t("personas").collect()}
    assert people()[who.id] == ([[1.0, 0.0, 0.0]], [])
    assert ids(api.items("person:alice")) == [at["a"]] and ids(api.items("alice")) == [at["a"]]
    owner = lambda: {(x.item_id, x.detection_id): x.persona_id for x in api.t("detections").collect()}
    assert owner() == {(at["a"], "f1"): who.id, (at["a"], "f2"): None, (at["b"], "f1"): None, (at["c"], "p1"): None}

    # a sync keeps what users set; new analysis of a changed file carries the persona, its match gets it
    api.sync(files([(n, 1, 1) for n in names]), "t3")
    assert owner()[at["a"], "f1"] == who.id and ids(api.items("person:alice")) == [at["a"]]
    again = {**seen, "a": faces(("g9", "face", "", [0.99, 0.05, 0.0], ""), ("g8", "face", "", [0.0, 1.0, 0.0], "")), "b": faces(("f1", "face", "", [0.6, 0.8, 0.0], ""))}
    r = api.sync(files([(names[0], 7, 1), (names[1], 7, 1), (names[2], 1, 1)]), "t4", analyse(again), batches=2).first()
    assert (r.added, r.updated, r.unchanged) == (0, 2, 1)
    assert owner() == {(at["a"], "g9"): who.id, (at["a"], "g8"): None, (at["b"], "f1"): who.id, (at["c"], "p1"): None}
    assert set(ids(api.items("person:alice"))) == {at["a"], at["b"]}
    # without analysis a changed file keeps detections and metadata
    api.sync(files([(names[0], 8, 1), (names[1], 7, 1), (names[2], 1, 1)]), "t5")
    assert owner()[at["a"], "g9"] == who.id and api.library.find("items", at["a"]).first().metadata == {"human_face_pipeline": "v1"}
    # another face pipeline: faces anew, other detections stay
    r = api.sync(files([(names[0], 8, 1), (names[1], 7, 1), (names[2], 1, 1)]), "t6", analyse({**again, "c": faces(("n1", "face", "", [0.0, 0.0, 1.0], ""))}, "v2"), face_pipeline="v2").first()
    assert r.updated == 3 and set(owner()) == {(at["a"], "g9"), (at["a"], "g8"), (at["b"], "f1"), (at["c"], "p1"), (at["c"], "n1")} and owner()[at["a"], "g9"] == who.id

    # learning: near vectors add nothing, hashes once; a pet item teaches its pets
    api.assign_region(at["a"], "g8", who.id, "t7")
    assert people()[who.id][0] == [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    api.assign_item(at["c"], "", "t8", new_name="Rex", kind="pet")
    rex = api.personas("pet").first()
    assert people()[rex.id] == ([], ["00ff00ff00ff00ff"]) and rex.avatarItemId == at["c"] and ids(api.items("pet:rex")) == [at["c"]]
    with pytest.raises(ValueError):
        api.assign_region(at["c"], "p1", who.id, "t9")  # a person can not own a dog

    # clusters: members go to a persona together, incremental clustering goes on
    api.clear_region(at["b"], "f1", "u1")
    assert owner()[at["b"], "f1"] is None and ids(api.items("person:alice")) == [at["a"]]
    assert api.refresh_clusters("person", "u2") in ("incremental", "full")
    groups = api.t("unknown_cluster_members").filter(F.col("item_id") == at["b"]).collect()
    assert len(groups) == 1 and api.count_detections("person", dirty_only=True) <= 2
    api.assign_clusters([groups[0].cluster_id], "", "u3", new_name="Bob")
    bob = next(x for x in api.personas("person").collect() if x.name == "Bob")
    assert owner()[at["b"], "f1"] == bob.id and ids(api.items("person:bob")) == [at["b"]]
    api.clear_item(at["b"], "u4")
    assert owner()[at["b"], "f1"] is None and api.items("person:bob").count() == 0

    # a deleted file goes from albums and avatars too
    api.create_album("All", list(at.values()), "u5")
    api.sync(files([(names[1], 7, 1)]), "u6")
    assert api.albums().first().itemCount == 1 and {x.name: x.avatarItemId or "" for x in api.personas().collect()} == {"Alice": "", "Bob": at["b"], "Rex": ""}
    assert {k[0] for k in owner()} == {at["b"]}


def test_saves_are_atomic(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.set_metadata(a="1")
    lib.set_metadata(b="2")
    assert lib.metadata("a") == "1" and [n for n, _ in lib._manifests()] == [1, 2]
    before = lib.manifest()
    lib.set_metadata(c="3")
    before["metadata"]["c"] = "lost"
    with pytest.raises(RuntimeError):
        lib._publish(before)  # from a state that is no longer the newest
    assert lib.metadata("c") == "3"
    (tmp_path / "lib" / "_manifest-x.tmp").write_text("half a mani")  # a save that stopped
    assert Library(spark, str(tmp_path / "lib")).metadata("b") == "2"
    for k in range(15):
        lib.set_metadata(k=str(k))
    assert len(lib._manifests()) <= 10 and lib.metadata("k") == "14" and lib.metadata("a") == "1"


def test_a_save_leaves_other_parts(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), parts=8)
    items = items_of(spark, [{"id": f"i{k}", "title": f"t{k}", "tags": [f"g{k}"]} for k in range(40)])
    none = {n: lib.table(n) for n in ("personas", "albums", "memories")}
    lib.save_state(items, none["personas"], none["albums"], none["memories"], "t1")
    before = lib.manifest()["tables"]
    assert len(before["items"]) == 8
    gone = spark.createDataFrame([("i9",)], "id string")
    lib.save_items(lib.table("items").filter("id = 'i7'").withColumn("title", F.lit("new")), gone, "t2")
    after = Library(spark, str(tmp_path / "lib")).manifest()
    assert after["parts"] == 8 and 1 <= sum(after["tables"]["items"][k] != at for k, at in before["items"].items()) <= 2
    assert {r.id: r.title for r in lib.table("items").collect()} == {f"i{k}": "new" if k == 7 else f"t{k}" for k in range(40) if k != 9}
    assert {r.item_id: r.tag for r in lib.table("item_tags").collect()} == {f"i{k}": f"g{k}" for k in range(40) if k != 9}
    assert {r.item_id for r in lib.table("item_search").filter("search_blob like '%new%'").collect()} == {"i7"}


def test_reference_images_are_distinct(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    items = conform(spark.createDataFrame([("i", faces(("d1", "face", "", [1.0, 0.0], ""), ("d2", "face", "", [0.999, 0.001], ""), ("d3", "face", "", [0.0, 1.0], "")))], FOUND.split(", tags")[0]), "items")
    image = lambda path, d, at: (path, "i", d, "", "person", at)
    refs = [image("p3", "d3", "3"), image("p2", "d2", "2"), image("p1", "d1", "1"), image("p1", "d3", "4"), image("", "d3", "0"), image("p9", "gone", "9")]
    people = conform(spark.createDataFrame([("x", refs), ("y", [])], "id string, reference_images array<struct<path:string,source_item_id:string,source_region_id:string,label:string,kind:string,created_at:string>>"), "personas")
    got = {r.id: [x.path for x in r.reference_images] for r in mutations.dedupe_references(people, items).collect()}
    assert got == {"x": ["p1", "p3", "p9"], "y": []}


def test_listings(spark):
    keys = ["2024/b/x.jpg", "2025/a/y.jpg", "trip/z.jpg", "2025/c 10/q.jpg", "2025/c 9/q.jpg", "top.jpg", "2025/a/Z.jpg"]
    df = spark.createDataFrame([(k, float(i == 6)) for i, k in enumerate(keys)], "relative_key string, modified_ts double")
    got = [r[0] for r in df.orderBy(*search.scan_order()).collect()]

    def key(k, mtime):
        import re

        seg = lambda p: (1, int(n[0]), p.lower()) if (n := re.findall(r"\d+", p)) else (0, 0, p.lower())
        *folders, name = k.split("/")
        return [seg(p) for p in folders], mtime, name.lower()

    assert got == sorted(keys, key=lambda k: key(k, float(k == keys[6])), reverse=True)
    p = spark.createDataFrame([("1", "b", "pet"), ("2", "B", "person"), ("3", "a", "person")], "id string, name string, kind string")
    assert ids(search.list_personas(p)) == ["3", "2", "1"] and ids(search.list_albums(p)) == ["3", "1", "2"]
    m = spark.createDataFrame([("1", "", "2020"), ("2", "2021", "2019"), ("3", "", "2022"), ("4", "2022", "2021")], "id string, end_date string, created_at string")
    assert ids(search.list_memories(m)) == ["3", "4", "2", "1"]
    runs = search.timeline_runs(spark.createDataFrame([(i, t) for i, t in enumerate("aabbab")], "i int, t string"), F.col("t"), [F.col("i")])
    assert [r.run for r in runs.orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]
