"""Embedding maps: three principal components, centred and scaled. Signs of components are arbitrary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 3) -> DataFrame:
    """(key, x, y, z): components over all rows, mean 0 and deviation 1 (deviations below 1e-6 count as 1)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    dim = vectors.select(F.size(column)).first()
    k = min(k, dim[0]) if dim else k
    out = PCA(k=k, inputCol="v", outputCol="p").fit(rows).transform(rows).select(key, vector_to_array("p").alias("p"))
    names = ["x", "y", "z"][:3]
    out = out.select(key, *[(F.col("p")[i] if i < k else F.lit(0.0)).alias(n) for i, n in enumerate(names)])
    stats = out.agg(*[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"s{n}") for n in names])
    scaled = out.crossJoin(F.broadcast(stats))  # one row
    return scaled.select(key, *[((F.col(n) - F.col(f"m{n}")) / F.when(F.col(f"s{n}") < 1e-6, 1.0).otherwise(F.col(f"s{n}"))).alias(n) for n in names])
