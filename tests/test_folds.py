"""Folds of one asset's detections, against plain loops over planted frames."""

import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.config import Settings
from mediaquarry.functions.vectors import cosine_of, hamming_of, iou_of
from mediaquarry.operators import detect

CATS, DOGS = ("cat", "kitten"), ("dog", "puppy")
PETS = (*CATS, *DOGS, "bird", "horse", "rabbit", "hamster", "guinea pig", "ferret")
COLS = "item_id string, frame int, pos int, seconds double, id string, kind string, label string, confidence double, bbox array<int>, persona_id string, encoding array<double>, signature string"


def drawn(n, seed, items=25):
    rng, out = random.Random(seed), []
    for k in range(n):
        kind = rng.choice(["face", "pet", "pet_face", "object"])
        label = "face" if kind == "face" else rng.choice(["pet", "Cat", "kitten", "dog", "bird", "car"])
        own = rng.random()
        enc = [[1.0, 0.0], [0.95, 0.31], [0.7, 0.7], [0.0, 1.0]][rng.randrange(4)] if own < 0.4 else None if own < 0.7 else []
        sig = rng.choice(["00000000000000ff", "000000000000000f", "ffffffffffffffff"]) if 0.3 < own < 0.8 else rng.choice(["", None])
        box = [rng.choice([0, 1, 40]), rng.choice([0, 2, 40]), 20, rng.choice([20, 30])]
        out.append((f"i{rng.randrange(items)}", rng.randrange(3), k, rng.randrange(50) / 4, f"d{k}", kind, label, round(rng.random(), 2), box, rng.choice([None, "", "p", "q", "gone"]), enc, sig))
    return out


def dicts(rows):
    names = [c.split()[0] for c in COLS.split(", ")]
    return [dict(zip(names, r)) for r in rows]


def low(d):
    return d["label"].lower()


def same(a, b, s=Settings()):
    pet = lambda d: d["kind"].startswith("pet") or low(d) in (*PETS, "pet")
    kin = lambda d: "cat" if low(d) in CATS else "dog" if low(d) in DOGS else low(d)
    faces = a["kind"] == "face" and b["kind"] == "face"
    if faces or pet(a) and pet(b):
        if not faces and kin(a) != kin(b) and "pet" not in (low(a), low(b)):
            return False
        if a["encoding"] and b["encoding"]:
            return cosine_of(a["encoding"], b["encoding"]) >= (0.72 if faces else 0.78)
        if a["signature"] and b["signature"]:
            return hamming_of(a["signature"], b["signature"]) <= 8
        return iou_of(a["bbox"], b["bbox"]) >= 0.55
    return low(a) == low(b) and iou_of(a["bbox"], b["bbox"]) >= 0.65


def value(d):
    return d["confidence"] + (0.2 if d["kind"] == "pet_face" else 0.15 if d["kind"] == "face" else 0) + (0.08 if low(d) in CATS + DOGS else 0) + (0.04 if low(d) != "pet" else 0)


def merged(rows):
    kept = []
    for d in rows:
        for i, k in enumerate(kept):
            if same(k, d):
                if value(d) > value(k):
                    kept[i] = dict(d)
                elif low(k) == "pet" and low(d) in CATS + DOGS:
                    k |= {"label": d["label"], "encoding": k["encoding"] or d["encoding"], "signature": k["signature"] or d["signature"]}
                break
        else:
            kept.append(dict(d))
    return kept


def by_item(rows):
    out = {}
    for d in rows:
        out.setdefault(d["item_id"], []).append(d)
    return out


def shown(rows):
    return sorted((r["item_id"], r["pos"], r["id"], r["kind"], r["label"], r["confidence"], r["signature"] or "", tuple(r["encoding"] or ())) for r in rows)


def no_python(df):
    return "Python" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan and "Arrow" not in plan


def test_frames_merge_as_a_loop_does(spark):
    rows = drawn(400, 1)
    got = detect.merge_frames(spark.createDataFrame(rows, COLS).repartition(3))
    want = [{**d, "pos": i} for ds in by_item(sorted(dicts(rows), key=lambda d: (d["frame"], d["pos"]))).values() for i, d in enumerate(merged(ds))]
    assert shown(got.collect()) == shown(want) and no_python(got)
    assert len(want) < 350 and detect.merge_frames(spark.createDataFrame([], COLS)).count() == 0


def test_still_and_video(spark):
    still, video = drawn(150, 2), drawn(150, 3)
    got = detect.merge_still_and_video(spark.createDataFrame(still, COLS), spark.createDataFrame(video, COLS))
    rows = [{**d, "frame": -1} for d in dicts(still)] + [{**d, "id": f"video-{d['frame']:02d}-{d['seconds']:07.2f}-{d['id']}"} for d in dicts(video) if d["kind"] == "face" or d["kind"].startswith("pet")]
    want = [{**d, "pos": i} for ds in by_item(sorted(rows, key=lambda d: (d["frame"], d["pos"]))).values() for i, d in enumerate(merged(ds))]
    assert shown(got.collect()) == shown(want) and no_python(got)


def continued(d, prior, used):
    best, top = None, -1.0
    pet = lambda x: x["kind"].startswith("pet") or low(x) in PETS
    for p in prior:
        if p["id"] in used or p["kind"] != d["kind"]:
            continue
        score = -1.0
        if d["kind"] == "face" or pet(d) and pet(p):
            if d["encoding"] and p["encoding"]:
                c = cosine_of(d["encoding"], p["encoding"])
                score = 2 + c if c >= (0.5 if d["kind"] == "face" else 0.6) else -1.0
            elif d["signature"] and p["signature"]:
                h = hamming_of(d["signature"], p["signature"])
                score = 1.5 - h / 20 if h <= 10 else -1.0
        o = iou_of(d["bbox"], p["bbox"])
        score = max(score, 1 + o) if o >= 0.55 else score
        if score > top:
            best, top = p, score
    return best


@pytest.mark.parametrize("known", [None, ["p", "q"]])
def test_assignments_are_carried_as_a_loop_does(spark, known):
    old, new = drawn(200, 4), [(*r[:4], r[4] if k % 5 else f"n{k}", *r[5:]) for k, r in enumerate(drawn(220, 5))]
    people = spark.createDataFrame([(k,) for k in known], "id string") if known else None
    df = lambda rows: spark.createDataFrame(rows, COLS).drop("frame", "seconds").repartition(3)
    got = detect.carry_assignments(df(new), df(old), people)
    want, before = [], by_item(sorted(dicts(old), key=lambda d: d["pos"]))
    for item, ds in by_item(sorted(dicts(new), key=lambda d: d["pos"])).items():
        prior, used = before.get(item, []), set()
        ids = {p["id"]: p for p in prior}
        for i, d in enumerate(ds):
            m = ids[d["id"]] if d["id"] in ids and d["id"] not in used else continued(d, prior, used)
            own = d["persona_id"]
            if m:
                used.add(m["id"])
                if m["persona_id"] and (known is None or m["persona_id"] in known) and not own:
                    own = m["persona_id"]
            want.append((item, i, d["id"], own))
    assert sorted((r["item_id"], r["pos"], r["id"], r["persona_id"]) for r in got.collect()) == sorted(want, key=lambda x: x[:3]) and no_python(got)


def test_pets_and_their_tags(spark):
    rows = [r for r in drawn(300, 6) if r[5] in ("object", "pet_face")]
    got = detect.pet_detections(spark.createDataFrame(rows, COLS))
    want = {}
    for item, ds in by_item(dicts(rows)).items():
        faces, tags, pets = [d for d in ds if d["kind"] == "pet_face"], set(), []
        for f in faces:
            tags |= {"animal", "pet", low(f), "cat face" if low(f) in CATS else "dog face" if low(f) in DOGS else "pet face"}
            pets.append((f["id"], "pet_face", f["label"]))
        for o in ds:
            if o["kind"] == "object" and low(o) in PETS:
                covered = any(iou_of(o["bbox"], f["bbox"]) >= 0.12 for f in faces)
                name = "cat" if low(o) in CATS else "dog" if low(o) in DOGS and covered else low(o)
                tags |= {"animal", "pet", name} | ({f"{name} face"} if covered and name in ("cat", "dog") else set())
                if not (covered and low(o) in CATS + DOGS):
                    pets.append((f"pet-{o['id']}", "pet", name))
        want[item] = (pets, sorted(tags))
    assert {r["item_id"]: ([(p["id"], p["kind"], p["label"]) for p in r["pets"]], r["tags"]) for r in got.collect()} == want and no_python(got)


def test_repeated_ids_and_rows(spark):
    rows = [("i", 0, k, 0.0, "same", "face", "face", 0.5, [0, 0, 9, 9], p, [1.0, 0.0], None) for k, p in enumerate([None, "a", "b"])]
    df = spark.createDataFrame(rows, COLS).drop("frame", "seconds")
    got = detect.carry_assignments(df.withColumn("persona_id", F.lit(None).cast("string")), df).collect()
    assert [r["persona_id"] for r in sorted(got, key=lambda r: r["pos"])] == ["b", None, None]


def test_anchors_decode_to_boxes_and_points(spark):
    """Two anchors at each place of a 3 x 2 grid of stride 8, the input being 24 x 16 and shrunk by half."""
    scores = [0.1, 0.5, 0.9, 0.2, 0.48, 0.479, 0.0, 0.0, 0.0, 0.0, 0.0, 0.7]
    distances, points = [k / 8 for k in range(48)], [k / 4 for k in range(120)]
    cols = "image_id string, stride int, width int, height int, scale double, scores array<double>, distances array<double>, keypoints array<double>"
    df = spark.createDataFrame([("a", 8, 24, 16, 0.5, scores, distances, points), ("b", 8, 24, 16, 1.0, None, None, None), ("c", 8, 24, 16, 1.0, [], [], []), ("d", 8, 24, 16, 1.0, [0.9], None, None)], cols)
    got = {r["box_id"]: r for r in detect.decode_anchors(df).collect()}
    want = {}
    for i, s in enumerate(scores):
        if s >= 0.48:
            x, y, d = i // 2 % 3 * 8, i // 2 // 3 * 8, distances[4 * i : 4 * i + 4]
            own = [((x, y)[k % 2] + points[10 * i + k] * 8) / 0.5 for k in range(10)]
            want[f"0008-{i:09d}"] = ([(x - d[0] * 8) / 0.5, (y - d[1] * 8) / 0.5, (x + d[2] * 8) / 0.5, (y + d[3] * 8) / 0.5], s, own)
    assert {k: ([r["x1"], r["y1"], r["x2"], r["y2"]], r["score"], r["keypoints"]) for k, r in got.items()} == want
    ranked = detect.detect_faces(df.drop("keypoints")).orderBy("rank").collect()
    assert [r["score"] for r in ranked] == sorted((r["score"] for r in ranked), reverse=True) and ranked[0]["score"] == 0.9
