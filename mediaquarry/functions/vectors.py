"""Similarity of vectors, hashes and boxes as Column functions, and their plain twins for sequential folds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """-1 for null, empty or zero vectors and for unequal lengths."""
    a, b = _c(a), _c(b)
    n = norm(a) * norm(b)
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0)
    return F.when(ok, dot(a, b) / n).otherwise(F.lit(-1.0))


def euclidean(a, b) -> Column:
    """+inf for unequal lengths."""
    a, b = _c(a), _c(b)
    d = F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(math.inf))


def hamming(a, b) -> Column:
    """Differing bits of two 16-digit hex hashes; other strings of one length count differing characters,
    strings of unequal length are infinitely far."""
    a, b = F.lower(_c(a)), F.lower(_c(b))
    half = lambda s, k: F.conv(F.substring(s, k, 8), 16, 10).cast("long")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    hexed = a.rlike("^[0-9a-f]{16}$") & b.rlike("^[0-9a-f]{16}$")
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(hexed, bits.cast("double")).when(F.length(a) == F.length(b), differ.cast("double")).otherwise(F.lit(math.inf))


def hash_bits(a) -> Column:
    """A 16-digit hex hash as two numbers, to be taken apart once before many comparisons."""
    half = lambda k: F.conv(F.substring(_c(a), k, 8), 16, 10).cast("long")
    return F.struct(half(1).alias("hi"), half(9).alias("lo"))


def hamming_bits(a, b) -> Column:
    """Differing bits of two hashes in the form of hash_bits."""
    a, b = _c(a), _c(b)
    return (F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))).cast("double")


def iou(a, b) -> Column:
    """Intersection over union of [x, y, w, h] boxes; areas are at least 1, disjoint boxes give 0."""
    a, b = _c(a), _c(b)
    left, right = [F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(0)).cast("double") for i in range(1, 5)], [F.coalesce(F.try_element_at(b, F.lit(i)), F.lit(0)).cast("double") for i in range(1, 5)]
    w = F.greatest(F.lit(0.0), F.least(left[0] + left[2], right[0] + right[2]) - F.greatest(left[0], right[0]))
    h = F.greatest(F.lit(0.0), F.least(left[1] + left[3], right[1] + right[3]) - F.greatest(left[1], right[1]))
    both = w * h
    area = lambda z: F.greatest(F.lit(1.0), z[2] * z[3])
    union = area(left) + area(right) - both
    return F.when((both <= 0) | (union <= 0), F.lit(0.0)).otherwise(both / union)


def l2_normalise(a) -> Column:
    """Length 1 (norms below 1e-12 count as that), rounded to six places."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(_c(a).cast("array<double>"), lambda x: F.round(x / n, 6))


def padded_box(bbox) -> Column:
    """Four integers, zeros where the box is short."""
    return F.slice(F.concat(F.coalesce(_c(bbox), F.array().cast("array<int>")), F.array(*[F.lit(0)] * 4)), 1, 4)


# plain twins ---------------------------------------------------------------


def cosine_of(a, b) -> float:
    if a is None or b is None or len(a) == 0 or len(a) != len(b):
        return -1.0
    n = math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(x * x for x in b))
    return math.fsum(x * y for x, y in zip(a, b)) / n if n > 0 else -1.0


def hamming_of(a: str, b: str) -> float:
    try:
        return float((int(a, 16) ^ int(b, 16)).bit_count())
    except ValueError:
        return float(sum(x != y for x, y in zip(a, b))) if len(a) == len(b) else math.inf


def iou_of(a, b) -> float:
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    both = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
    return both / (max(1, aw * ah) + max(1, bw * bh) - both) if both > 0 else 0.0
