"""Centroid clustering of vectors in exact integers: assignments by matrix products, sums by a tree of partials.

Components become integers floor(scale * x). A block of rows meets all centroids by |x|^2 - 2 x.c + |c|^2 in one
float64 BLAS product; every term and partial sum is an integer, so the result is exact as long as all
magnitudes stay below 2^53, which is checked for each block from its largest component. Rows beyond that bound
are measured in Python integers instead, so no distance is ever rounded. Each task sends one small table of
sums and counts, which RDD.treeAggregate adds up.

Defined cases: vectors that are null, of another size, or hold null, NaN or infinite components are left out. A
null id is assigned and summed but never starts a centroid. Repeated rows count as often as they stand there; where
equal ids tie for a start, the lesser vector comes first. Fewer rows than centroids give fewer centroids, none give no
rows. A centroid without vectors stays where it is. A distance or inertia beyond 63 bits is null.
"""

from __future__ import annotations

import hashlib
import math
import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import lean, table

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
BLOCK = 4096
EXACT, LONG = 1 << 53, (1 << 63) - 1


def integers_of(vector, scale: int = SCALE) -> list[int]:
    """floor(scale * x) of every component, for any finite doubles."""
    return [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in vector]


def kept_vectors(column, size: int):
    """(places, matrix) of the vectors of this size without null or non-finite components, as doubles."""
    import numpy as np

    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    own = np.flatnonzero((np.diff(offsets) == size) & ~np.asarray(column.is_null()))
    v = values[offsets[own][:, None] + np.arange(size)[None, :]] if len(own) else np.empty((0, size))
    good = np.isfinite(v).all(axis=1)
    return own[good], v[good]


def exact_bound(size: int) -> int:
    """The largest component for which 4 * size * component^2, more than any term or partial sum, is below 2^53."""
    return math.isqrt((EXACT - 1) // (4 * size))


def nearest(v, centroids: list[list[int]], scale: int = SCALE):
    """(clusters, distances, whole): the nearest centroid of each row of v, the lesser number at ties.

    whole: the rows as float64 integers where the products are exact, else None; then distances are Python integers.
    """
    import numpy as np

    size = v.shape[1]
    bound = exact_bound(size)
    with np.errstate(over="ignore"):
        q = np.floor(v * scale)
    most = [max(map(abs, row)) for row in centroids]
    # within the bound a centroid over 32 times as far out is never nearest while there is one within it:
    # 31^2 exceeds 4 * size up to this size, so it is left out of the product
    own = [k for k, m in enumerate(most) if m <= bound]
    if own and float(np.abs(q).max(initial=0)) <= bound and all(m <= bound or m > 32 * bound and 4 * size <= 31 * 31 for m in most):
        c = np.array([centroids[k] for k in own], dtype=np.float64)
        d = (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None, :]
        best = d.argmin(1)
        return np.array(own)[best], d[np.arange(len(best)), best].astype(np.int64), q
    best, least = [], []
    for row in v.tolist():
        x = integers_of(row, scale)
        far = [sum((a - b) * (a - b) for a, b in zip(x, own)) for own in centroids]
        least.append(min(far))
        best.append(far.index(least[-1]))
    return np.array(best, dtype=np.int64), least, None


def blocks(column, centroids: list[list[int]], size: int, scale: int):
    """(places, vectors, clusters, distances, whole) of an Arrow list column, block by block. Rows beyond the
    bound of exact products form blocks of their own, so one of them does not slow its neighbours down."""
    import numpy as np

    own, v = kept_vectors(column, size)
    with np.errstate(over="ignore"):
        wide = np.abs(v).max(axis=1, initial=0) * scale > exact_bound(size) - 1
    for some in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        for s in range(0, len(some), BLOCK):
            rows = some[s : s + BLOCK]
            yield own[rows], v[rows], *nearest(v[rows], centroids, scale)


def added(a: dict, b: dict) -> dict:
    """Sums of two partials {cluster: (rows, distance, [component sums])}; Python integers, so none overflows."""
    for k, (n, far, sums) in b.items():
        m, f, own = a.get(k, (0, 0, None))
        a[k] = (m + n, f + far, sums if own is None else [x + y for x, y in zip(own, sums)])
    return a


def partial_sums(centroids: list[list[int]], size: int, scale: int):
    """An Arrow batch function: one pickled partial a task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            for _, v, best, far, whole in blocks(b.column(0), centroids, size, scale):
                for k in np.unique(best).tolist():
                    rows = np.flatnonzero(best == k)
                    if whole is not None:  # at most BLOCK addends below 2^53 / (4 * size): exact
                        sums, d = [int(x) for x in whole[rows].sum(0)], int(far[rows].sum())
                    else:
                        mine = [integers_of(v[r].tolist(), scale) for r in rows.tolist()]
                        sums, d = [sum(x) for x in zip(*mine)], sum(far[r] for r in rows.tolist())
                    added(total, {k: (len(rows), d, sums)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    return run


def gathered(vectors: DataFrame, centroids: list[list[int]], size: int, scale: int) -> dict:
    """{cluster: (rows, inertia, component sums)} over all vectors: at most one entry a centroid and task, added in a tree."""
    parts = vectors.mapInArrow(partial_sums(centroids, size, scale), "part binary").rdd
    depth = 2 + int(math.log(max(1, parts.getNumPartitions()), 1000))
    return parts.treeAggregate({}, lambda a, row: added(a, pickle.loads(row[0])), added, depth)


def starts(vectors: DataFrame, key: str, column: str, k: int, seed: int, size: int, scale: int) -> list[list[int]]:
    """The k vectors of the least sha256 of `seed:key`: a top-k, k rows reach the driver."""
    good = F.col("_v").isNotNull() & (F.size("_v") == size) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    first = vectors.select(F.col(key).alias("_k"), F.col(column).cast("array<double>").alias("_v")).filter(good & F.col("_k").isNotNull())
    first = first.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_k").cast("string")), 256), "_v").limit(k)
    return [integers_of(r[0], scale) for r in first.select("_v").collect()]


def centroid_rounds(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> list[list[int]]:
    """The centroids after so many rounds, each the componentwise floor of its vectors' mean."""
    only = vectors.select(F.col(column).alias("embedding"))
    centroids = starts(vectors, key, column, k, seed, size, scale)
    for _ in range(rounds if centroids else 0):
        for at, (n, _, sums) in gathered(only, centroids, size, scale).items():
            centroids[at] = [s // n for s in sums]
    return centroids


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids and inertias (k small rows) travel with the last pass; nothing is shuffled or joined for it.
    """
    lean(vectors.sparkSession)
    centroids = centroid_rounds(vectors, key, column, k, rounds, seed, size, scale)
    last = gathered(vectors.select(F.col(column).alias("embedding")), centroids, size, scale) if centroids else {}
    fits = lambda x: x if x <= LONG else None
    own = [fits(last[at][1]) if at in last else 0 for at in range(len(centroids))]
    whole, digests = fits(sum(x[1] for x in last.values())), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            for places, _, best, far, _ in blocks(b.column(1), centroids, size, scale) if centroids else ():
                at = best.tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(places)), pa.array(best, pa.int32()), pa.array([fits(int(x)) for x in far], pa.int64()), pa.array([own[x] for x in at], pa.int64()), pa.array([whole] * len(at), pa.int64()), pa.array([digests[x] for x in at])],
                    names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    from pyspark.sql.types import IntegerType

    schema = StructType([StructField(key, vectors.schema[key].dataType), StructField("cluster", IntegerType()), *[StructField(c, LongType()) for c in ("distance", "cluster_inertia", "inertia")], StructField("centroid_sha256", StringType())])
    return vectors.select(F.col(key), F.col(column).alias("embedding")).mapInArrow(rows, schema)


def op11_gemm_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids over all embeddings, five rounds from the vectors of the least sha256 of `2:<vec_id>`."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """All rounds spelled out. Inner products of integers of this size are exact in doubles."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min({{'d': (x2 - 2 * list_inner_product(q, c) + c2)::BIGINT, 'k': cluster}}) AS m FROM v, (SELECT *, list_inner_product(c, c) AS c2 FROM c{i}) GROUP BY vec_id)")
        if i < ROUNDS:
            steps.append(f"u{i} AS (SELECT m.k AS cluster, unnest(range({SIZE})) AS pos, unnest(q)::BIGINT AS x FROM a{i})")
            steps.append(f"s{i} AS (SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM u{i} GROUP BY 1, 2)")
            steps.append(f"n{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS c FROM s{i} GROUP BY 1)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n USING (cluster))")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, q, list_inner_product(q, q) AS x2 FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
      WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, q AS c FROM v QUALIFY cluster < {CENTROIDS}), {", ".join(steps)}
      SELECT vec_id, m.k::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON cluster = m.k"""


SQL = _sql()
