"""Media files: kinds by extension, average hashes, video frames to sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind.
EXTENSIONS = {
    "image": (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".heic", ".heif", ".avif"),
    "video": (".mov", ".mp4", ".m4v", ".avi", ".mkv", ".webm"),
    "gif": (".gif",),
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(path) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(_c(path), r"([^/]+)$", 1), r".(\.[^.]+)$", 1))


def media_kind(path) -> Column:
    """image, video or gif by extension, in any case; null for others."""
    e = extension(path)
    out = F.when(e.isin(*EXTENSIONS["gif"]), "gif")
    return out.when(e.isin(*EXTENSIONS["video"]), "video").when(e.isin(*EXTENSIONS["image"]), "image")


def sample_frames_of(frame_count: int, fps: float, seconds: float = 2.0, most: int = 12) -> list[int]:
    """Frames of a video to look at: all of a short one, else one every so many seconds with first and last,
    thinned evenly to `most`."""
    most = max(1, most)
    if frame_count <= most:
        return list(range(frame_count))
    stride = max(1, round(fps * max(0.5, seconds)) if fps > 0 else frame_count // most)
    picks = sorted({*range(0, frame_count, stride), frame_count - 1})
    if len(picks) > most:
        last = len(picks) - 1
        picks = sorted({picks[int(last * k / (most - 1)) if most > 1 else 0] for k in range(most)})
    return picks[:most]


def sample_frames(frame_count, fps, seconds: float = 2.0, most: int = 12) -> Column:
    """Column form of sample_frames_of."""
    n, rate = F.coalesce(_c(frame_count).cast("int"), F.lit(0)), F.coalesce(_c(fps).cast("double"), F.lit(0.0))
    stride = F.greatest(F.lit(1), F.when(rate > 0, F.bround(rate * max(0.5, seconds))).otherwise(F.floor(n / most)).cast("int"))
    spread = F.array_distinct(F.concat(F.sequence(F.lit(0), n - 1, stride), F.array(n - 1)))
    last = F.size(spread) - 1
    thinned = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get(spread, (last * k / max(1, most - 1)).cast("int")))))
    none = F.array().cast("array<int>")
    return F.when(n <= 0, none).when(n <= most, F.sequence(F.lit(0), n - 1)).when(F.size(spread) > most, F.slice(thinned, 1, most)).otherwise(spread)


def average_hash_of(pixels) -> str:
    """64 grey values (8 x 8, row by row) to 16 hex digits: a bit for each value at or above the mean."""
    values = [float(p) for p in pixels]
    mean = sum(values) / len(values)
    bits = 0
    for v in values:
        bits = bits << 1 | (v >= mean)
    return f"{bits:016x}"


def average_hash(pixels) -> Column:
    """Column form over an array of 64 grey values."""
    px = _c(pixels).cast("array<double>")
    mean = F.aggregate(px, F.lit(0.0), lambda s, x: s + x) / F.size(px)
    nibble = lambda k: F.aggregate(F.slice(px, k * 4 + 1, 4), F.lit(0), lambda s, x: s * 2 + (x >= mean).cast("int"))
    return F.when(F.size(px) == 64, F.lower(F.concat(*[F.conv(nibble(k).cast("string"), 10, 16) for k in range(16)])))
