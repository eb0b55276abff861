"""HyperMinHash near-duplicate detection.

One hash a shingle. Its high half picks one of `REGISTERS` buckets, a remix of it is the value whose
minimum the bucket keeps, stored as a count of leading zeros and `MANTISSA` bits behind the first one
(16 bits in all). Empty buckets borrow from a bucket that depends on their own number only, so small
sets can be banded too. Documents with equal sets collapse first. Then

1. bands of `ROWS` registers name the candidates; the documents of a band's bucket are tied to its
   least id, and the components of these ties ("families") give a locality order;
2. documents are dealt along that order into tiles of bounded weight. In a tile, or in two tiles that
   share a bucket, pairs are first judged by sizes and by the collision-corrected estimate, and what
   may reach the threshold is confirmed on the full shingle sets, best first; pairs that earlier links
   already connect need no confirmation, as only components are asked for;
3. families that fit one tile are then finished. In the others one document of each component in a
   bucket is first confirmed against one of the bucket's least component: as many pairs as there are
   components in buckets, which join most of a family of real copies. What is left is dealt anew with
   components side by side, and only tiles that still hold different components meet. No pair that
   shares a bucket is left out, and no group lands in one task.

The estimate may only reject a pair that lies `SIGMAS` standard errors below the threshold.

Full sets are sets of 64-bit shingle hashes. A link at the threshold share s is missed by all bands with
chance (1 - s^6)^24: 1e-5 at 0.85, 7e-4 at 0.8, and a group needs but one spanning set of its links.

Defined results: a null text, or one without words, has the empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle; rows that share a doc_id are one document; a row
without a doc_id is linked with nothing, its component_id is null and it is kept; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, groups, lean, release, running, small, table, tidied
from .components import connected_components, forest

REGISTERS, ROWS, MANTISSA, SIGMAS = 144, 6, 10, 4.0
TILE, LONG = 192, 3000


# ---------------------------------------------------------------- sketches


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles. bytes.lower and bytes.split touch ASCII only."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=n)
    k = min(k, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : n - k + 1 + j])
    return np.unique(h)


@functools.cache
def _probes():
    """For each register the order in which it asks others when it is empty."""
    import numpy as np

    i = np.arange(REGISTERS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(64, dtype=np.uint64)[None, :]
    with np.errstate(over="ignore"):
        return (_mix(_mix(i + np.uint64(1)) + np.uint64(7)) % np.uint64(REGISTERS)).astype(np.int64)


def registers(shingles):
    """The 16-bit registers of a non-empty set, empty ones filled from others."""
    import numpy as np

    with np.errstate(over="ignore"):
        bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        value = _mix(shingles + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(8)
    both = (bucket << np.uint64(56)) | value
    both.sort()
    at = (both >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    v = (both[first] & np.uint64((1 << 56) - 1)).astype(np.float64)
    mant, exp = np.frexp(v)
    reg = ((56 - exp).astype(np.int64) << MANTISSA) | np.minimum(np.maximum((mant - 0.5) * 2 * (1 << MANTISSA), 0), (1 << MANTISSA) - 1).astype(np.int64)
    out, there = np.zeros(REGISTERS, dtype=np.uint16), np.zeros(REGISTERS, dtype=bool)
    out[at[first]], there[at[first]] = reg, True
    empty = np.flatnonzero(~there)
    if len(empty):
        probe = _probes()[empty]
        hit = there[probe]
        found = hit.any(1)
        src = np.where(found, probe[np.arange(len(empty)), hit.argmax(1)], at[first][np.searchsorted(at[first], empty) % len(first)])
        out[empty] = out[src]
    return out


def band_keys(regs):
    """One 64-bit key a band for a matrix of registers."""
    import numpy as np

    bands = REGISTERS // ROWS
    r = regs.reshape(len(regs), bands, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(regs), bands)).copy()
        for j in range(ROWS):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j] + np.uint64(j + 1))
    return acc.view(np.int64)


def chance_match(na, nb):
    """Chance that registers of two disjoint sets of these sizes agree: the collision correction.

    A bucket's minimum has density rate * exp(-rate * x); cells are 2^-(zeros + 1 + MANTISSA) wide.
    """
    import numpy as np

    la, lb = na / REGISTERS, nb / REGISTERS
    s = la + lb
    out = 0.0
    for zeros in range(24):
        lo, hi = 2.0 ** -(zeros + 1), 2.0**-zeros
        out = out + 2.0 ** -(zeros + 1 + MANTISSA) * (np.exp(-s * lo) - np.exp(-s * hi))
    return la * lb / s * out


def may_link(equal, na, nb, share: float):
    """Whether pairs with so many equal registers may reach the share, given both set sizes."""
    import numpy as np

    chance = chance_match(na, nb)
    est = (equal / REGISTERS - chance) / (1 - chance)
    seen = REGISTERS * (1 - np.exp(-np.maximum(na, nb) / REGISTERS))
    return est + SIGMAS * np.sqrt(share * (1 - share) / np.maximum(seen, 1.0)) >= share, est


# ---------------------------------------------------------------- operator


def _pack(shingles) -> bytes:
    """The sorted distinct hashes, all eight bytes of each."""
    return shingles.tobytes()


def _unpack(b: bytes):
    import numpy as np

    return np.frombuffer(b, dtype=np.uint64)


def _sign(k: int):
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh128_digest

        for b in batches:
            ids, n, digest, regs = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set(t.as_py(), k)
                ids.append(i)
                n.append(len(s))
                digest.append(xxh128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "digest", "regs"])

    return run


def _bands(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        for s in range(0, len(regs), 2000):
            keys = band_keys(regs[s : s + 2000])
            ids = np.repeat(b.column("id").to_numpy()[s : s + 2000], keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], names=["key", "id"])


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            packed = [_pack(shingle_set(t.as_py(), k)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed, pa.binary())], names=["id", "packed"])

    return run


def link_tile(ids, comps, sides, n, regs, packed, percent: int):
    """Links (a, b) that join components among the rows of one tile or two (side 0 and 1; 2 is both).

    Pairs go best estimate first; a pair within one component by then is skipped.
    """
    import numpy as np

    share, out = percent / 100.0, []
    n = np.asarray(n, dtype=np.float64)
    comp = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    parent = list(range(len(comp)))
    own = np.array([comp[c] for c in comps])

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = np.flatnonzero(np.asarray(sides) != 1)
    right = np.flatnonzero(np.asarray(sides) != 0)
    pairs = []
    for i in left:
        js = right[right > i] if sides[i] == 2 else right
        js = js[(own[js] != own[i]) & (np.minimum(n[js], n[i]) >= share * np.maximum(n[js], n[i]) - 1e-9)]
        if len(js):
            equal = (regs[js] == regs[i]).sum(1)
            ok, est = may_link(equal, n[i], n[js], share)
            pairs += [(-e, i, j) for e, j in zip(est[ok].tolist(), js[ok].tolist())]
    pairs.sort()
    full: dict[int, object] = {}
    for _, i, j in pairs:
        a, b = find(own[i]), find(own[j])
        if a == b:
            continue
        for x in (i, j):
            if x not in full:
                full[x] = _unpack(packed[x])
        common = len(np.intersect1d(full[i], full[j], assume_unique=True))
        if 100 * common >= percent * (len(full[i]) + len(full[j]) - common):
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _link(percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, t in groups(batches, ["ta", "tb"]):
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            found = link_tile(t.column("id").to_numpy(), t.column("comp").to_pylist(), t.column("side").to_pylist(), t.column("n").to_numpy(), regs, t.column("packed").to_pylist(), percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _confirm(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (ta, tb, side, id, comp, n, regs, packed)."""
    return rows.repartition("ta", "tb").sortWithinPartitions("ta", "tb").mapInArrow(tidied(_link(percent)), "a long, b long")


def _star_links(docs: DataFrame, members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Confirmed links between the least component of each bucket and the others in it, a document of each.

    docs: (id, n, regs, ...); members: (key, id); comps: (id, component); sets: (id, packed).
    """
    own = docs.select("id").join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    one = members.select("key", "id").join(own, "id").groupBy("key", "comp").agg(F.min("id").alias("id"))
    one = scratch.write(one, "ends")
    least = scratch.write(one.groupBy("key").agg(F.min(F.struct("comp", "id")).alias("lo"), F.max("comp").alias("hi")).filter("lo.comp <> hi").drop("hi"), "least")
    pairs = one.join(small(least), "key").filter("comp <> lo.comp").select(F.col("lo.id").alias("ta"), F.col("id").alias("tb"), F.col("lo.comp").alias("ca"), F.col("comp").alias("cb"))
    pairs = scratch.write(pairs.groupBy("ca", "cb").agg(F.min(F.struct("ta", "tb")).alias("p")).select("p.ta", "p.tb"), "stars")
    # the sets are filtered where they lie; only those of the stars' ends travel
    ends = small(scratch.write(pairs.select(F.col("ta").alias("id")).unionByName(pairs.select(F.col("tb").alias("id"))).distinct(), "star_ids"))
    full = scratch.write(docs.select("id", "n", "regs").join(ends, "id", "left_semi").join(sets.join(ends, "id", "left_semi"), "id"), "star_sets")
    a = pairs.join(full, F.col("ta") == F.col("id")).withColumn("side", F.lit(0))
    b = pairs.join(full, F.col("tb") == F.col("id")).withColumn("side", F.lit(1))
    rows = a.unionByName(b).withColumn("comp", F.col("id"))
    return scratch.write(_confirm(rows.select("ta", "tb", "side", "id", "comp", "n", "regs", "packed"), percent), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    spark = docs.sparkSession
    lean(spark)
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = scratch.write(base.mapInArrow(tidied(_sign(shingle)), "doc_id long, n long, digest binary, regs binary"), "signs")
    reps = scratch.write(sigs.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")).filter("id is not null"), "sets")
    bands = reps.select("id", "regs").mapInArrow(tidied(_bands), "key long, id long")
    lows = bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key", "lo")
    members = scratch.write(bands.join(lows, "key"), "buckets")
    release(spark)
    families = connected_components(members.filter("id <> lo").select("id", "lo").distinct(), scratch)

    weight = F.greatest(F.lit(1.0), F.col("n") / LONG)
    cand = families.withColumnRenamed("component", "family").join(reps.select("id", "n", "regs"), "id")
    placed = running(cand, ["family", "id"], weight, scratch, "order").withColumn("tile", F.floor(F.col("_pos") / TILE).cast("long")).drop("_pos")
    placed = scratch.write(placed, "tiles")
    texts = base.join(small(placed.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
    sets = scratch.write(texts.mapInArrow(tidied(_sets(shingle)), "id long, packed binary").repartition("id").dropDuplicates(["id"]), "full")
    rows = placed.join(sets, "id").select(F.col("tile").alias("ta"), F.col("tile").alias("tb"), F.lit(2).alias("side"), "id", F.col("id").alias("comp"), "n", "regs", "packed")
    links = scratch.write(_confirm(rows, percent), "links")
    release(spark)

    # families over more than one tile: components side by side, and only tiles that differ meet
    spread = placed.groupBy("family").agg(F.min("tile").alias("lo"), F.max("tile").alias("hi")).filter("lo <> hi").select("family")
    open_ = scratch.write(placed.join(spread, "family", "left_semi").drop("tile"), "open")
    if open_.limit(1).count():
        comps = connected_components(links, scratch)
        links = links.unionByName(_star_links(open_, members, comps, sets, percent, scratch))
        comps = connected_components(links, scratch)
        now = open_.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        again = scratch.write(running(now, ["family", "comp", "id"], weight, scratch, "order2").withColumn("tile", F.floor(F.col("_pos") / TILE).cast("long")).drop("_pos"), "tiles2")
        met = members.select("key", "id").join(again.select("id", "tile", "comp"), "id").groupBy("key", "tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        met = scratch.write(met, "met")
        other = met.select("key", F.col("tile").alias("tb"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        differ = F.least("lo", "lo2") != F.greatest("hi", "hi2")
        pairs = scratch.write(met.withColumnRenamed("tile", "ta").join(other, "key").filter((F.col("ta") <= F.col("tb")) & differ).select("ta", "tb").distinct(), "pairs")
        full = again.join(sets, "id").select("tile", "id", "comp", "n", "regs", "packed")
        one = full.join(pairs.filter("ta = tb"), F.col("tile") == F.col("ta")).withColumn("side", F.lit(2))
        a = full.join(pairs.filter("ta <> tb"), F.col("tile") == F.col("ta")).withColumn("side", F.lit(0))
        b = full.join(pairs.filter("ta <> tb"), F.col("tile") == F.col("tb")).withColumn("side", F.lit(1))
        rows = one.unionByName(a).unionByName(b).select("ta", "tb", "side", "id", "comp", "n", "regs", "packed")
        links = links.unionByName(scratch.write(_confirm(rows, percent), "links"))
        release(spark)
    comps = connected_components(links, scratch)
    classes = reps.select("digest", "id").join(comps, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = sigs.drop("regs").join(classes, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the least of their component, with all their columns. Of rows that repeat a
    doc_id one stays; rows without a doc_id stay."""
    marked = Scratch(docs.sparkSession, "keep").write(near_duplicates(docs, shingle, percent), "marked")
    gone = marked.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    if marked.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))
    return docs.join(small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_hyperminhash_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, md5(text) AS h, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, h, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS sh FROM t),
u AS (SELECT h, min(doc_id) AS id, any_value(sh) AS sh, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY h),
x AS (SELECT id, n, unnest(sh) AS g FROM u),
pairs AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
          GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r(id, c) AS (SELECT id, id FROM u UNION SELECT sides.b, r.c FROM r JOIN sides ON sides.a = r.id),
comp AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id, s.doc_id = coalesce(comp.c, s.doc_id) AS kept
FROM s LEFT JOIN u ON s.h = u.h LEFT JOIN comp ON comp.id = u.id
"""
