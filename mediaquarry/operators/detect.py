"""Folds over the detections of one asset: suppression, merging of frames, pet rules, carrying assignments.

A group is one image, video or item, so its rows are few by nature. They become one sorted array of structs, which
F.aggregate walks with an array or a struct as its state; vectors, hashes and boxes are compared inside.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CAT_LABELS, DISTINCT_COSINE, DISTINCT_HAMMING, DOG_LABELS, PET_LABELS, Settings
from ..functions.text import is_pet
from ..functions.vectors import cosine, cosine_of, hamming, hamming_of, iou

FIELDS = ["id", "kind", "label", "confidence", "bbox", "persona_id", "encoding", "signature"]
SCHEMA = "item_id string, pos int, id string, kind string, label string, confidence double, bbox array<int>, persona_id string, encoding array<double>, signature string"


def suppress(boxes: DataFrame, most: float = 0.4, key: str = "image_id") -> DataFrame:
    """boxes (key, box_id, x1, y1, x2, y2, score): those that survive, with their rank.

    An image's boxes are one array, best score first, then by id; a box stays if it overlaps none that has
    stayed before it by more than `most`. Sides count one pixel more than their difference.
    """
    side = lambda lo, hi: hi - lo + 1
    area = lambda b: side(b["x1"], b["x2"]) * side(b["y1"], b["y2"])

    def overlap(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])))
        h = F.greatest(F.lit(0.0), side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"])))
        return w * h / (area(a) + area(b) - w * h)

    box = F.struct((-F.col("score")).alias("worst"), "box_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], "score")
    per = boxes.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("b"))
    none = F.slice("b", 1, 0)
    kept = F.aggregate("b", none, lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > most), kept).otherwise(F.concat(kept, F.array(b))))
    return per.select(key, F.posexplode(kept).alias("rank", "box")).select(key, "box.box_id", "box.score", "rank")


#: Least score of an anchor, anchors at each place of the grid.
LEAST_SCORE, ANCHORS = 0.48, 2


def decode_anchors(levels: DataFrame, least: float = LEAST_SCORE, anchors: int = ANCHORS) -> DataFrame:
    """levels (image_id, stride, width, height, scale, scores, distances[, keypoints]), one row an image and stride of a
    detector's grid: image_id, box_id, x1, y1, x2, y2, score, keypoints for the anchors of `least` or more.

    Anchors stand row by row, `anchors` at each place. Distances (four an anchor: left, up, right, down) and
    keypoints (pairs of offsets, or null) are in strides; `width` and `height` are the input's, boxes are divided by
    `scale`. Only anchors that pass leave their arrays. Rows of null scores or distances have none.
    """
    stride, n = F.col("stride").cast("double"), F.col("i")
    hits = F.filter(F.transform("scores", lambda s, i: F.struct(s.cast("double").alias("score"), i.alias("i"))), lambda x: x["score"] >= least)
    per = levels.withColumn("hit", F.explode(hits)).select("*", "hit.*")
    across = F.floor(F.col("width") / F.col("stride"))
    place = F.floor(n / anchors)
    x, y = (place % across) * stride, F.floor(place / across) * stride
    far = lambda k: F.try_element_at("distances", 4 * n + k + 1).cast("double") * stride
    scaled = lambda c: c / F.col("scale")
    size = (F.size("keypoints") / F.size("scores")).cast("int") if "keypoints" in levels.columns else None
    points = F.transform(F.slice("keypoints", n * size + 1, size), lambda p, k: scaled(F.when(k % 2 == 0, x).otherwise(y) + p.cast("double") * stride)) if size is not None else F.lit(None).cast("array<double>")
    out = per.select("image_id", F.concat_ws("-", F.lpad(F.col("stride").cast("string"), 4, "0"), F.lpad(n.cast("string"), 9, "0")).alias("box_id"), scaled(x - far(0)).alias("x1"), scaled(y - far(1)).alias("y1"), scaled(x + far(2)).alias("x2"), scaled(y + far(3)).alias("y2"), "score", points.alias("keypoints"))
    return out.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null")


def detect_faces(levels: DataFrame, least: float = LEAST_SCORE, anchors: int = ANCHORS, most: float = 0.4) -> DataFrame:
    """decode_anchors over all strides of an image, then suppression across them, with the rank of each box."""
    boxes = decode_anchors(levels, least, anchors)
    return suppress(boxes, most).select("image_id", "box_id", "rank").join(boxes, ["image_id", "box_id"])


#: How alike two detections are that show one subject (faces, pets; bits; overlap of subjects, of objects).
SAME_FACE, SAME_PET, SAME_BITS, SAME_BOX, SAME_OBJECT_BOX = 0.72, 0.78, 8, 0.55, 0.65
#: The same for a detection and the one of an earlier analysis that it continues.
NEXT_FACE, NEXT_PET, NEXT_BITS = 0.50, 0.60, 10
#: What kinds and labels add to a detection's confidence where one of a subject is chosen.
RANK_KIND, RANK_SPECIES, RANK_NAMED = {"pet_face": 0.20, "face": 0.15}, 0.08, 0.04
#: Fixed value: overlap from which a body and a pet face belong together.
COVERED = 0.12


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tag(d: Column) -> Column:
    return F.lower(d["label"])


def _species(d: Column) -> Column:
    """cat or dog for their labels, else the label itself."""
    t = _tag(d)
    return F.when(t.isin(*CAT_LABELS), "cat").when(t.isin(*DOG_LABELS), "dog").otherwise(t)


def _named(d: Column) -> Column:
    return _tag(d).isin(*CAT_LABELS, *DOG_LABELS)


def _long(v: Column) -> Column:
    return F.coalesce(F.size(v), F.lit(0)) > 0


def _text(v: Column) -> Column:
    return F.coalesce(v, F.lit("")) != ""


def by_evidence(a: Column, b: Column, vectors, hashes, boxes) -> Column:
    """What the best evidence that both detections have says: vectors, else hashes, else boxes. The arguments
    are functions of the cosine, of the differing bits, and of both boxes."""
    return F.when(_long(a["encoding"]) & _long(b["encoding"]), _let(cosine(a["encoding"], b["encoding"]), vectors)).when(
        _text(a["signature"]) & _text(b["signature"]), _let(hamming(a["signature"], b["signature"]), hashes)
    ).otherwise(boxes(a["bbox"], b["bbox"]))


def one_subject(a: Column, b: Column, settings: Settings) -> Column:
    """Whether detections of two frames show one subject: two faces, or two pets that may be of one species
    (a generic pet may be of any), by their evidence; other things by label and place."""
    faces = (a["kind"] == "face") & (b["kind"] == "face")
    pet = lambda d: is_pet(d["kind"], d["label"]) | (_tag(d) == "pet")
    pets = pet(a) & pet(b)
    species = (_species(a) == _species(b)) | (_tag(a) == "pet") | (_tag(b) == "pet")
    least = F.when(faces, max(settings.face_embedding_similarity_threshold, SAME_FACE)).otherwise(max(settings.pet_embedding_similarity_threshold, SAME_PET))
    alike = by_evidence(a, b, lambda c: c >= least, lambda h: h <= SAME_BITS, lambda p, q: iou(p, q) >= SAME_BOX)
    things = (_tag(a) == _tag(b)) & (iou(a["bbox"], b["bbox"]) >= SAME_OBJECT_BOX)
    return F.coalesce(F.when(faces | pets & species, alike).when(pets, F.lit(False)).otherwise(things), F.lit(False))


def worth(d: Column) -> Column:
    """Confidence, and what the kind and a telling label add."""
    kind = F.lit(0.0)
    for name, more in RANK_KIND.items():
        kind = F.when(d["kind"] == name, more).otherwise(kind)
    return d["confidence"] + kind + F.when(_named(d), RANK_SPECIES).otherwise(0.0) + F.when(_tag(d) != "pet", RANK_NAMED).otherwise(0.0)


def _settled(kept: Column, new: Column) -> Column:
    """The better of two detections of one subject; a generic pet that stays takes a cat's or dog's name from the
    other, and the evidence that it lacks."""
    same = lambda f: F.when(_long(kept[f]), kept[f]).otherwise(new[f]) if f == "encoding" else F.when(_text(kept[f]), kept[f]).otherwise(new[f])
    renamed = F.struct(*[(new[f] if f == "label" else same(f) if f in ("encoding", "signature") else kept[f]).alias(f) for f in FIELDS])
    return F.when(worth(new) > worth(kept), new).when((_tag(kept) == "pet") & _named(new), renamed).otherwise(kept)


def _fields(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{f}").alias(f) for f in FIELDS])


def merge_frames(detections: DataFrame, settings: Settings | None = None) -> DataFrame:
    """detections (item_id, frame, pos, detection fields): one list of subjects an item (SCHEMA), frames in order.

    A detection joins the first subject of the list that it shows, or becomes one.
    """
    s = settings or Settings()
    per = detections.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("frame", "pos", _fields().alias("d")))).alias("all"))
    ordered = F.transform("all", lambda x: x["d"])

    def step(kept: Column, d: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: one_subject(k, d, s)), True)
        return _let(hit, lambda at: F.when(at == 0, F.concat(kept, F.array(d))).otherwise(F.transform(kept, lambda k, i: F.when(i == at - 1, _settled(k, d)).otherwise(k))))

    kept = F.aggregate(ordered, F.slice(ordered, 1, 0), step)
    return per.select("item_id", F.posexplode(kept).alias("pos", "d")).select("item_id", "pos", "d.*")


def merge_tags(frames: DataFrame) -> DataFrame:
    """frames (item_id, tags): the distinct tags of all frames of an item, in order; empty ones left out."""
    each = frames.select("item_id", F.explode("tags").alias("tag")).filter("tag <> ''")
    return each.groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def merge_still_and_video(still: DataFrame, video: DataFrame, settings: Settings | None = None) -> DataFrame:
    """still and video (item_id, frame, pos, seconds, fields): a video adds faces and pets only, its ids are
    prefixed by frame and time."""
    seen = video.filter((F.col("kind") == "face") | F.col("kind").startswith("pet"))
    seen = seen.withColumn("id", F.format_string("video-%02d-%07.2f-%s", F.col("frame").cast("int"), F.col("seconds").cast("double"), F.col("id"))).withColumn("frame", F.col("frame") + 1)
    return merge_frames(still.withColumn("frame", F.lit(0).cast(dict(seen.dtypes)["frame"])).unionByName(seen, allowMissingColumns=True), settings)


def continues(d: Column, p: Column) -> Column:
    """How well an earlier detection p of the same kind fits d: by vector above 2, else by hash from 1 to 1.5,
    in either case by overlap from 1.55 if that is more; null if in no way."""
    face, pets = d["kind"] == "face", is_pet(d["kind"], d["label"]) & is_pet(p["kind"], p["label"])
    nothing = F.lit(None).cast("double")
    alike = by_evidence(d, p, lambda c: F.when(c >= F.when(face, NEXT_FACE).otherwise(NEXT_PET), 2.0 + c), lambda h: F.when(h <= NEXT_BITS, 1.5 - h / 20.0), lambda p, q: nothing)
    overlap = _let(iou(d["bbox"], p["bbox"]), lambda o: F.when(o >= SAME_BOX, 1.0 + o))
    return F.when(d["kind"] == p["kind"], F.greatest(F.when(face | pets, alike), overlap))


def carry_assignments(current: DataFrame, previous: DataFrame, personas: DataFrame | None = None) -> DataFrame:
    """current (SCHEMA) with persona ids of the previous detections they continue: the one of the same id first, else
    the best fit, each used once, in order."""
    old = previous.join(personas.select(F.col("id").alias("persona_id")), "persona_id", "left_semi") if personas is not None else previous.filter("persona_id is not null and persona_id <> ''")
    known = old.select("item_id", "id").distinct().withColumn("live", F.lit(True))
    prior = previous.join(known, ["item_id", "id"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    before = prior.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", _fields().alias("d"), "live"))).alias("prior"))
    now = current.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", _fields().alias("d")))).alias("now"))
    both = now.join(before, "item_id", "left").withColumn("prior", F.coalesce("prior", F.array().cast(before.schema["prior"].dataType)))
    # the state: ids already used, and the detections so far
    start = F.struct(F.array().cast("array<string>").alias("used"), F.transform(F.slice("now", 1, 0), lambda x: x["d"]).alias("out"))

    def step(state: Column, x: Column) -> Column:
        d, free = x["d"], F.filter("prior", lambda p: ~F.array_contains(state["used"], p["d"]["id"]))
        found = lambda p, i, score: F.struct(score.alias("score"), i.alias("place"), p["d"]["id"].alias("id"), F.when(p["live"], p["d"]["persona_id"]).alias("persona"))
        same = F.filter(F.transform(free, lambda p, i: found(p, i, F.when(p["d"]["id"] == d["id"], 9.0))), lambda m: m["score"].isNotNull())
        fits = F.filter(F.transform(free, lambda p, i: found(p, -i, continues(d, p["d"]))), lambda m: m["score"].isNotNull())
        match = F.coalesce(F.array_max(same), F.array_max(fits))  # of equal ids the last, of equal scores the first
        return _let(match, lambda m: F.struct(
            F.when(m.isNull(), state["used"]).otherwise(F.concat(state["used"], F.array(m["id"]))).alias("used"),
            F.concat(state["out"], F.array(d.withField("persona_id", F.when(_text(d["persona_id"]), d["persona_id"]).when(m.isNotNull() & m["persona"].isNotNull(), m["persona"]).otherwise(d["persona_id"])))).alias("out"),
        ))

    out = F.aggregate("now", start, step, lambda state: state["out"])
    return both.select("item_id", F.posexplode(out).alias("pos", "d")).select("item_id", "pos", "d.*")


def pet_detections(detections: DataFrame) -> DataFrame:
    """detections (SCHEMA; kinds object and pet_face): item_id, pets (array of detections), tags, for each item.

    A cat's or dog's body that a pet face overlaps adds tags only; other pets become detections of their own.
    """
    per = detections.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", _fields().alias("d")))).alias("all"))
    of = lambda kind: F.transform(F.filter("all", lambda x: x["d"]["kind"] == kind), lambda x: x["d"])
    per = per.select("item_id", of("pet_face").alias("faces"), F.filter(of("object"), lambda o: _tag(o).isin(*PET_LABELS)).alias("bodies"))
    covered = lambda o: has_pet_face(F.transform("faces", lambda f: f["bbox"]), o["bbox"])
    name = lambda o: F.when(_tag(o).isin(*CAT_LABELS), "cat").when(_tag(o).isin(*DOG_LABELS) & covered(o), "dog").otherwise(_tag(o))
    own = F.transform(F.filter("bodies", lambda o: ~(covered(o) & _named(o))), lambda o: o.withField("id", F.concat(F.lit("pet-"), o["id"])).withField("kind", F.lit("pet")).withField("label", name(o)))
    face_tags = F.transform("faces", lambda f: F.array(F.lit("animal"), F.lit("pet"), _tag(f), F.when(_tag(f).isin(*CAT_LABELS), "cat face").when(_tag(f).isin(*DOG_LABELS), "dog face").otherwise("pet face")))
    body_tags = F.transform("bodies", lambda o: F.array(F.lit("animal"), F.lit("pet"), name(o), F.when(covered(o) & name(o).isin("cat", "dog"), F.concat(name(o), F.lit(" face")))))
    tags = F.array_sort(F.array_distinct(F.filter(F.flatten(F.concat(face_tags, body_tags)), lambda t: t.isNotNull() & (t != ""))))
    return per.select("item_id", F.concat("faces", own).alias("pets"), tags.alias("tags"))


def has_pet_face(boxes: Column | str, bbox: Column | str) -> Column:
    """Column: some pet-face box of the array overlaps the box."""
    return F.exists(boxes, lambda b: iou(b, bbox) >= COVERED)


def _has(x) -> bool:
    return x is not None and len(x) > 0


def distinct_references(rows: DataFrame, least: float = DISTINCT_COSINE, since: int | None = None) -> DataFrame:
    """rows (persona_id, seq, encoding, signature): with `kept`, whether each adds to its persona's references.

    A vector must differ from all kept vectors; without kept vectors a hash must differ from kept hashes. Rows whose seq is
    below `since` are references already and kept as they are.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        kept, flags = [], []
        for r in pdf.to_dict("records"):
            sims = [cosine_of(r["encoding"], k["encoding"]) for k in kept if _has(r["encoding"]) and _has(k["encoding"])]
            gaps = [hamming_of(r["signature"], k["signature"]) for k in kept if r["signature"] and k["signature"]]
            new = True if since is not None and r["seq"] < since else max(sims) < least if sims else min(gaps) > DISTINCT_HAMMING if gaps else True
            flags.append(new)
            if new:
                kept.append(r)
        return pd.DataFrame({"persona_id": pdf["persona_id"], "seq": pdf["seq"], "kept": flags})

    types = dict(rows.dtypes)
    return rows.groupBy("persona_id").applyInPandas(run, f"persona_id {types['persona_id']}, seq {types['seq']}, kept boolean")
