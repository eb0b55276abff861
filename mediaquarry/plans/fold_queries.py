"""Registered queries of the folds over one asset's detections, with recursive SQL that walks the same lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..operators import detect
from .adapters import table
from .registry import SUPPRESSED, query

CATS, DOGS = "('cat', 'kitten')", "('dog', 'puppy')"
PETS = "('cat', 'kitten', 'dog', 'puppy', 'bird', 'horse', 'rabbit', 'hamster', 'guinea pig', 'ferret')"

#: Vectors seen in two frames of an item of eight: half of them with vectors, half with hashes, a quarter with neither.
SEEN = """seen AS (SELECT vec_id // 8 AS item, f AS frame, (vec_id % 8)::INT AS pos, vec_id, {'id': CASE WHEN vec_id % 5 = 0 THEN 'both' ELSE f::VARCHAR END || '-' || vec_id,
  'kind': CASE WHEN label < 6 THEN 'face' WHEN label = 8 THEN 'object' ELSE 'pet' END, 'label': CASE WHEN label < 6 THEN 'face' WHEN label = 6 THEN 'Cat' WHEN label = 7 THEN CASE f WHEN 0 THEN 'puppy' ELSE 'dog' END WHEN label = 8 THEN 'car' ELSE CASE f WHEN 0 THEN 'pet' ELSE 'kitten' END END,
  'confidence': round(0.3 + ((vec_id * 7 + f * vec_id * 13) % 50) / 100, 2)::DOUBLE, 'x': vec_id % 3 * 10, 'y': vec_id % 2 * 10, 'w': 20, 'h': 20 + f * (vec_id % 5), 'e': CASE WHEN vec_id % 4 < 2 THEN embedding::DOUBLE[] ELSE []::DOUBLE[] END,
  's': CASE WHEN vec_id % 4 IN (1, 2) THEN substr(sha1(vec_id::VARCHAR), 1, 16) ELSE '' END} AS d FROM embeddings, (SELECT unnest([0, 1]) AS f))"""


def seen(spark, d) -> DataFrame:
    """The same as rows (item_id, frame, pos, vec_id, detection fields)."""
    e = table(spark, d, "embeddings").withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1))))
    v, f, label = F.col("vec_id"), F.col("frame"), F.col("label")
    first = lambda a, b: F.when(f == 0, a).otherwise(b)
    box = [v % 3 * 10, v % 2 * 10, F.lit(20), 20 + f * (v % 5)]
    return e.select(
        F.floor(v / 8).cast("long").alias("item_id"), "frame", (v % 8).cast("int").alias("pos"), "vec_id", F.concat(F.when(v % 5 == 0, "both").otherwise(f.cast("string")), F.lit("-"), v.cast("string")).alias("id"),
        F.when(label < 6, "face").when(label == 8, "object").otherwise("pet").alias("kind"), F.when(label < 6, "face").when(label == 6, "Cat").when(label == 7, first("puppy", "dog")).when(label == 8, "car").otherwise(first("pet", "kitten")).alias("label"),
        F.round(F.lit(0.3) + (v * 7 + f * v * 13) % 50 / 100, 2).cast("double").alias("confidence"), F.array(*[b.cast("int") for b in box]).alias("bbox"), F.lit(None).cast("string").alias("persona_id"),
        F.when(v % 4 < 2, F.col("embedding").cast("array<double>")).alias("encoding"), F.when((v % 4).isin(1, 2), stable_id(v.cast("string"))).otherwise("").alias("signature"),
    )


def _iou(a: str, b: str) -> str:
    both = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"(CASE WHEN {both} = 0 THEN 0.0 ELSE ({both})::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {both}) END)"


def _bits(a: str, b: str) -> str:
    return "(" + " + ".join(f"bit_count(xor(('0x' || substr({a}.s, {k}, 8))::BIGINT, ('0x' || substr({b}.s, {k}, 8))::BIGINT))" for k in (1, 9)) + ")"


def _case(a: str, b: str, vectors: str, hashes: str, boxes: str) -> str:
    return f"CASE WHEN len({a}.e) > 0 AND len({b}.e) > 0 THEN {vectors.format(f'list_cosine_similarity({a}.e, {b}.e)')} WHEN {a}.s <> '' AND {b}.s <> '' THEN {hashes.format(_bits(a, b))} ELSE {boxes} END"


def _subject(a: str, b: str) -> str:
    pet = lambda d: f"({d}.kind LIKE 'pet%' OR lower({d}.label) IN {PETS[:-1]}, 'pet'))"
    kin = lambda d: f"(CASE WHEN lower({d}.label) IN {CATS} THEN 'cat' WHEN lower({d}.label) IN {DOGS} THEN 'dog' ELSE lower({d}.label) END)"
    faces, any_ = f"({a}.kind = 'face' AND {b}.kind = 'face')", f"(lower({a}.label) = 'pet' OR lower({b}.label) = 'pet')"
    alike = _case(a, b, f"{{}} >= CASE WHEN {faces} THEN 0.72 ELSE 0.78 END", "{} <= 8", f"{_iou(a, b)} >= 0.55")
    return f"CASE WHEN {faces} OR {pet(a)} AND {pet(b)} AND ({kin(a)} = {kin(b)} OR {any_}) THEN {alike} WHEN {pet(a)} AND {pet(b)} THEN false ELSE lower({a}.label) = lower({b}.label) AND {_iou(a, b)} >= 0.65 END"


def _worth(d: str) -> str:
    return f"({d}.confidence + CASE {d}.kind WHEN 'pet_face' THEN 0.2 WHEN 'face' THEN 0.15 ELSE 0.0 END::DOUBLE + CASE WHEN lower({d}.label) IN {CATS} OR lower({d}.label) IN {DOGS} THEN 0.08 ELSE 0.0 END::DOUBLE + CASE WHEN lower({d}.label) <> 'pet' THEN 0.04 ELSE 0.0 END::DOUBLE)"


def _merged(rows: str, columns: str) -> str:
    """rows: (item, a, b, d) in order of a and b; the subjects of each item."""
    better = f"""CASE WHEN {_worth('d')} > {_worth('x')} THEN d WHEN lower(x.label) = 'pet' AND (lower(d.label) IN {CATS} OR lower(d.label) IN {DOGS}) THEN {{'id': x.id, 'kind': x.kind, 'label': d.label, 'confidence': x.confidence, 'x': x.x, 'y': x.y, 'w': x.w, 'h': x.h,
      'e': CASE WHEN len(x.e) > 0 THEN x.e ELSE d.e END, 's': CASE WHEN x.s <> '' THEN x.s ELSE d.s END}} ELSE x END"""
    return f"""WITH RECURSIVE {SEEN}, o AS MATERIALIZED (SELECT item, row_number() OVER (PARTITION BY item ORDER BY a, b) AS k, d FROM ({rows})),
      w(item, k, kept) AS (SELECT item, k, [d] FROM o WHERE k = 1 UNION ALL SELECT item, k, CASE WHEN hit = 0 THEN list_append(kept, d) ELSE list_transform(kept, lambda x, i: CASE WHEN i = hit THEN {better} ELSE x END) END
        FROM (SELECT o.item, o.k, kept, d, coalesce(list_position(list_transform(kept, lambda x: {_subject('x', 'd')}), true), 0) AS hit FROM w JOIN o ON o.item = w.item AND o.k = w.k + 1)),
      last AS (SELECT item, max_by(kept, k) AS kept FROM w GROUP BY item), f AS (SELECT item, unnest(kept) AS d, unnest(range(len(kept))) AS pos FROM last) SELECT item AS item_id, pos::INT AS pos, {columns} FROM f"""


COLUMNS = "d.id AS id, d.kind AS kind, d.label AS label, d.confidence AS confidence, len(d.e) AS dims, d.s AS signature"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("item_id", "pos", "id", "kind", "label", "confidence", F.coalesce(F.size("encoding"), F.lit(0)).cast("long").alias("dims"), "signature")


@query("merge_frames", _merged("SELECT item, frame AS a, pos AS b, d FROM seen", COLUMNS))
def _(spark, d):
    return _shown(detect.merge_frames(seen(spark, d)))


@query("still_and_video", _merged("""SELECT item, frame AS a, pos AS b, CASE frame WHEN 0 THEN d ELSE {'id': printf('video-%02d-%07.2f-%s', frame, vec_id / 4.0, d.id), 'kind': d.kind, 'label': d.label, 'confidence': d.confidence, 'x': d.x, 'y': d.y, 'w': d.w, 'h': d.h, 'e': d.e, 's': d.s} END AS d
  FROM seen WHERE frame = 0 OR d.kind = 'face' OR d.kind LIKE 'pet%'""", COLUMNS))  # fmt: skip
def _(spark, d):
    rows = seen(spark, d).withColumn("seconds", F.col("vec_id") / 4)
    return _shown(detect.merge_still_and_video(rows.filter("frame = 0"), rows.filter("frame = 1")))


NEXT = f"""CASE WHEN p.d.kind = d.kind THEN greatest(CASE WHEN d.kind = 'face' OR (d.kind LIKE 'pet%' OR lower(d.label) IN {PETS}) AND (p.d.kind LIKE 'pet%' OR lower(p.d.label) IN {PETS}) THEN
  {_case('d', 'p.d', "CASE WHEN {0} >= CASE WHEN d.kind = 'face' THEN 0.5 ELSE 0.6 END THEN 2.0 + {0} END", "CASE WHEN {0} <= 10 THEN 1.5 - {0} / 20.0 END", "NULL")} END::DOUBLE, CASE WHEN {_iou('d', 'p.d')} >= 0.55 THEN 1.0 + {_iou('d', 'p.d')} END::DOUBLE) END"""


@query("carried_assignments", f"""WITH RECURSIVE {SEEN}, prior AS MATERIALIZED (SELECT item, list({{'d': d, 'persona': CASE WHEN vec_id % 3 <> 1 THEN 'p' || vec_id END}} ORDER BY pos) AS prior FROM seen WHERE frame = 0 AND vec_id % 7 <> 3 GROUP BY item),
  o AS MATERIALIZED (SELECT item, row_number() OVER (PARTITION BY item ORDER BY pos) AS k, d FROM seen WHERE frame = 1),
  w(item, k, used, id, persona) AS (SELECT DISTINCT item, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM o UNION ALL SELECT item, k, CASE WHEN m IS NULL THEN used ELSE list_append(used, m.id) END, d.id, m.persona FROM (
    SELECT item, k, used, d, coalesce(list_max(list_filter(list_transform(free, lambda p, i: {{'score': CASE WHEN p.d.id = d.id THEN 9.0 END, 'place': i, 'id': p.d.id, 'persona': p.persona}}), lambda m: m.score IS NOT NULL)),
      list_max(list_filter(list_transform(free, lambda p, i: {{'score': {NEXT}, 'place': -i, 'id': p.d.id, 'persona': p.persona}}), lambda m: m.score IS NOT NULL))) AS m
    FROM (SELECT o.item, o.k, used, d, list_filter(coalesce(prior, []), lambda p: NOT list_contains(used, p.d.id)) AS free FROM w JOIN o ON o.item = w.item AND o.k = w.k + 1 LEFT JOIN prior ON prior.item = o.item)))
  SELECT item AS item_id, id, persona AS persona_id FROM w WHERE k > 0""")  # fmt: skip
def _(spark, d):
    """A second analysis: some ids are the same, other detections are found again by vector, hash or place, and one in seven is new."""
    rows = seen(spark, d)
    old = rows.filter("frame = 0 and vec_id % 7 <> 3").withColumn("persona_id", F.when(F.col("vec_id") % 3 != 1, F.concat(F.lit("p"), F.col("vec_id").cast("string"))))
    return detect.carry_assignments(rows.filter("frame = 1"), old).select("item_id", "id", "persona_id")


@query("pet_decisions", f"""WITH {SEEN}, t AS (SELECT item, frame * 8 + pos AS pos, d, CASE WHEN d.kind = 'pet' AND (pos + frame) % 2 = 0 THEN 'pet_face' WHEN d.kind <> 'face' THEN 'object' END AS kind FROM seen),
  g AS (SELECT item, coalesce(list(d ORDER BY pos) FILTER (kind = 'pet_face'), []) AS faces FROM t WHERE kind IS NOT NULL GROUP BY item),
  b AS (SELECT item, pos, d, len(list_filter(faces, lambda f: {_iou('f', 'd')} >= 0.12)) > 0 AS covered FROM t JOIN g USING (item) WHERE kind = 'object' AND lower(d.label) IN {PETS}),
  n AS (SELECT *, CASE WHEN lower(d.label) IN {CATS} THEN 'cat' WHEN lower(d.label) IN {DOGS} AND covered THEN 'dog' ELSE lower(d.label) END AS name FROM b),
  pets AS (SELECT item, 0 AS part, pos, d.id || ':pet_face:' || d.label AS pet FROM t WHERE kind = 'pet_face' UNION ALL SELECT item, 1, pos, 'pet-' || d.id || ':pet:' || name FROM n WHERE NOT (covered AND (lower(d.label) IN {CATS} OR lower(d.label) IN {DOGS}))),
  tags AS (SELECT item, unnest(['animal', 'pet', lower(d.label), CASE WHEN lower(d.label) IN {CATS} THEN 'cat face' WHEN lower(d.label) IN {DOGS} THEN 'dog face' ELSE 'pet face' END]) AS tag FROM t WHERE kind = 'pet_face'
    UNION SELECT item, unnest(['animal', 'pet', name, CASE WHEN covered AND name IN ('cat', 'dog') THEN name || ' face' ELSE 'pet' END]) FROM n)
  SELECT g.item AS item_id, coalesce((SELECT string_agg(pet, ',' ORDER BY part, pos) FROM pets WHERE pets.item = g.item), '') AS pets, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM tags WHERE tags.item = g.item), '') AS tags FROM g""")  # fmt: skip
def _(spark, d):
    rows = seen(spark, d).withColumn("pos", F.col("frame") * 8 + F.col("pos"))
    kind = F.when((F.col("kind") == "pet") & ((F.col("pos") % 8 + F.col("frame")) % 2 == 0), "pet_face").otherwise("object")
    out = detect.pet_detections(rows.filter("kind <> 'face'").withColumn("kind", kind))
    return out.select("item_id", F.array_join(F.transform("pets", lambda p: F.concat_ws(":", p["id"], p["kind"], p["label"])), ",").alias("pets"), F.array_join("tags", ",").alias("tags"))


@query("anchor_faces", """WITH RECURSIVE l AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest([{'s': 8, 'w': 4, 'n': 32, 'o': 0}, {'s': 16, 'w': 2, 'n': 8, 'o': 32}]) AS g FROM embeddings),
  a AS (SELECT vec_id, e, g.s AS s, g.w AS w, g.o AS o, unnest(range(g.n)) AS i FROM l), p AS (SELECT *, i // 2 % w * s AS x, i // 2 // w * s AS y, abs(e[o + i + 1]) * 2 AS score FROM a),
  b AS (SELECT vec_id AS image_id, lpad(s::VARCHAR, 4, '0') || '-' || lpad(i::VARCHAR, 9, '0') AS box_id, (x - abs(e[(4 * i) % 64 + 1]) * 4 * s) / 0.5 AS x1, (y - abs(e[(4 * i + 1) % 64 + 1]) * 4 * s) / 0.5 AS y1,
    (x + abs(e[(4 * i + 2) % 64 + 1]) * 4 * s) / 0.5 AS x2, (y + abs(e[(4 * i + 3) % 64 + 1]) * 4 * s) / 0.5 AS y2, score FROM p WHERE score >= 0.48),
""" + SUPPRESSED.replace("SELECT image_id, o.box_id AS box_id, o.score AS score, rank::INT AS rank FROM f", "SELECT image_id, o.box_id AS box_id, round(o.x1, 6) AS x1, round(o.y2, 6) AS y2, round(o.score, 6) AS score, rank::INT AS rank FROM f"))
def _(spark, d):
    """Scores and distances of two strides, drawn from the vectors: an image each."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("e"))
    grids = F.array(*[F.struct(F.lit(s).alias("stride"), F.lit(n).alias("n"), F.lit(o).alias("o")) for s, n, o in ((8, 32, 0), (16, 8, 32))])
    each = e.withColumn("g", F.explode(grids)).select("image_id", "e", "g.*")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    levels = each.select(
        "image_id", "stride", F.lit(32).alias("width"), F.lit(32).alias("height"), F.lit(0.5).alias("scale"), F.transform(upto(F.col("n")), lambda i: F.abs(F.element_at("e", F.col("o") + i + 1)) * 2).alias("scores"),
        F.transform(upto(F.col("n") * 4), lambda i: F.abs(F.element_at("e", i % 64 + 1)) * 4).alias("distances"),
    )
    return detect.detect_faces(levels).select("image_id", "box_id", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), F.round("score", 6).alias("score"), "rank")
