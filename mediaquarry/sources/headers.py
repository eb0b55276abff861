"""What media files say of themselves in their headers: size, date, animation, duration.

PNG, GIF, JPEG, BMP, WebP, and MP4 or MOV, read by plain parsers over Arrow batches. Files are opened where a task runs
and read by seeking: chunks and boxes that tell nothing are skipped by their lengths, so a video costs a few
pages whatever its size. A file that is none of these, or is cut short, has no size; nothing is decoded.
"""

from __future__ import annotations

import re
from struct import calcsize, error, unpack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import exif_date
from ..functions.media import media_kind

SCHEMA = "path string, width int, height int, taken string, animated boolean, duration_seconds double"
#: EXIF tags of the date an image was taken or changed, and of its orientation.
TAKEN, CHANGED, ORIENTATION = 36867, 306, 274
PAGE = 64 << 10
#: Stores that tasks can open themselves, and their names there.
OPENED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


class Pages:
    """A file's bytes by index and slice, read a page at a time; two pages are kept."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.pages = stream, size, {}

    def __len__(self) -> int:
        return self.size

    def _page(self, k: int) -> bytes:
        if k not in self.pages:
            self.stream.seek(k * PAGE)
            while len(self.pages) > 1:
                self.pages.pop(next(iter(self.pages)))
            self.pages[k] = self.stream.read(PAGE)
        return self.pages[k]

    def __getitem__(self, at):
        if isinstance(at, int):
            if not 0 <= at < self.size:
                raise IndexError(at)
            return self._page(at // PAGE)[at % PAGE]
        a, z, _ = at.indices(self.size)
        return b"".join(self._page(k)[max(0, a - k * PAGE) : z - k * PAGE] for k in range(a // PAGE, -(-z // PAGE))) if a < z else b""


class Part:
    """Some of a file's bytes, not read yet."""

    def __init__(self, whole, start: int, end: int):
        self.whole, self.start, self.end = whole, start, min(end, len(whole))

    def __len__(self) -> int:
        return max(0, self.end - self.start)

    def __getitem__(self, at):
        if isinstance(at, int):
            if not 0 <= at < len(self):
                raise IndexError(at)
            return self.whole[self.start + at]
        a, z, _ = at.indices(len(self))
        return self.whole[self.start + a : self.start + z]


def unpack_from(form: str, b, at: int) -> tuple:
    return unpack(form, b[at : at + calcsize(form)] if at >= 0 else b"")


def _png(b: bytes) -> dict:
    out = {"width": unpack_from(">I", b, 16)[0], "height": unpack_from(">I", b, 20)[0], "animated": False}
    at = 8
    while at + 8 <= len(b):
        size, name = unpack_from(">I4s", b, at)
        if name == b"acTL":
            out["animated"] = unpack_from(">I", b, at + 8)[0] > 1
        elif name == b"eXIf":
            out |= _exif(Part(b, at + 8, at + 8 + size))
        elif name == b"IEND":
            break
        at += 12 + size
    return out


def _gif(b: bytes) -> dict:
    """Frames are image descriptors; their delays, in hundredths of a second, stand before them."""
    width, height, flags = unpack_from("<HHB", b, 6)
    at, frames, delay = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0, 0

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1

    while at < len(b) and b[at] != 0x3B:
        if b[at] == 0x21:
            if b[at + 1] == 0xF9:
                delay += unpack_from("<H", b, at + 4)[0]
            at = blocks(at + 2)
        elif b[at] == 0x2C:
            frames += 1
            own = b[at + 9]
            at = blocks(at + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0))
        else:
            break
    return {"width": width, "height": height, "animated": frames > 1, "duration_seconds": delay / 100}


def _exif(b: bytes) -> dict:
    """Date and orientation of the first directory of a TIFF block."""
    if b[:6] == b"Exif\0\0":
        b = Part(b, 6, len(b))
    e = {b"II": "<", b"MM": ">"}.get(b[:2])
    if e is None:
        return {}
    at, found = unpack_from(f"{e}I", b, 4)[0], {}
    for k in range(unpack_from(f"{e}H", b, at)[0]):
        tag, kind, n = unpack_from(f"{e}HHI", b, at + 2 + 12 * k)
        spot = at + 10 + 12 * k
        if tag == ORIENTATION:
            found["turned"] = unpack_from(f"{e}H", b, spot)[0] in (5, 6, 7, 8)
        elif tag in (TAKEN, CHANGED) and kind == 2:
            spot = unpack_from(f"{e}I", b, spot)[0] if n > 4 else spot
            found[tag] = b[spot : spot + n].split(b"\0")[0].decode("latin-1")
    taken = found.get(TAKEN) or found.get(CHANGED)
    return {"turned": found.get("turned", False)} | ({"taken": taken} if taken else {})


def _jpeg(b: bytes) -> dict:
    at, out = 2, {"animated": False}
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            break
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark in (0xD8, 0x01) or 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        size = unpack_from(">H", b, at + 2)[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = unpack_from(">HH", b, at + 5)
            break
        if mark == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
            out |= _exif(Part(b, at + 4, at + 2 + size))
        at += 2 + size
    return out


def _webp(b: bytes) -> dict:
    kind = b[12:16]
    if kind == b"VP8X":
        size = lambda k: 1 + int.from_bytes(b[k : k + 3], "little")
        return {"width": size(24), "height": size(27), "animated": bool(b[20] & 2)}
    if kind == b"VP8L":
        bits = unpack_from("<I", b, 21)[0]
        return {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF), "animated": False}
    width, height = unpack_from("<HH", b, 26)
    return {"width": width & 0x3FFF, "height": height & 0x3FFF, "animated": False}


def _bmp(b: bytes) -> dict:
    width, height = unpack_from("<ii", b, 18)
    return {"width": abs(width), "height": abs(height), "animated": False}


def _atoms(b: bytes, at: int, end: int):
    while at + 8 <= end:
        size, name = unpack_from(">I4s", b, at)
        head = 8
        if size == 1:
            size, head = unpack_from(">Q", b, at + 8)[0], 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield name, at + head, min(end, at + size)
        at += size


def _mp4(b: bytes) -> dict:
    """Size and duration of the first track that shows something."""
    out: dict = {}
    for name, at, end in _atoms(b, 0, len(b)):
        if name != b"moov":
            continue
        for kind, a, z in _atoms(b, at, end):
            if kind != b"trak" or "width" in out:
                continue
            track: dict = {}
            for part, x, y in _atoms(b, a, z):
                if part == b"tkhd":
                    track["width"], track["height"] = (v >> 16 for v in unpack_from(">II", b, y - 8))
                elif part == b"mdia":
                    for leaf, s, _ in _atoms(b, x, y):
                        if leaf == b"mdhd":
                            scale, length = unpack_from(">IQ", b, s + 20) if b[s] == 1 else unpack_from(">II", b, s + 12)
                            track["duration_seconds"] = length / scale if scale else 0.0
            if track.get("width") and track.get("height"):
                out = track
    return out


def headers_of(b: bytes | Pages | None) -> dict:
    """What a file's bytes tell: any of width, height, taken (as written), animated, duration_seconds."""
    b = b if b is not None else b""
    reader = (
        _png if b[:8] == b"\x89PNG\r\n\x1a\n" else _gif if b[:6] in (b"GIF87a", b"GIF89a") else _jpeg if b[:3] == b"\xff\xd8\xff" else _bmp if b[:2] == b"BM"
        else _webp if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else _mp4 if b[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free") else None
    )
    try:
        out = reader(b) if reader else {}
    except (error, IndexError):
        return {}
    if out.pop("turned", False) and "width" in out:
        out["width"], out["height"] = out["height"], out["width"]
    return out


def _rows(told, paths, pa):
    fields = [("width", pa.int32()), ("height", pa.int32()), ("taken", pa.string()), ("animated", pa.bool_()), ("duration_seconds", pa.float64())]
    return pa.RecordBatch.from_arrays([paths, *[pa.array([r.get(n) for r in told], t) for n, t in fields]], names=["path", *[n for n, _ in fields]])


def read_headers(files: DataFrame) -> DataFrame:
    """files (path, content) to SCHEMA, a row each; what a file does not tell is null."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield _rows([headers_of(c.as_py()) for c in b.column("content")], b.column("path"), pa)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def open_headers(files: DataFrame) -> DataFrame:
    """files (path, uri, length) to SCHEMA, each file opened by the task that holds its row. One that is gone by
    then tells nothing."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        def told(uri: str, length: int) -> dict:
            scheme, rest = re.match(r"([a-z0-9]+):/*(.*)", uri, re.S).groups()
            store, at = (fs.LocalFileSystem(), f"/{rest}") if scheme == "file" else fs.FileSystem.from_uri(f"{OPENED[scheme]}://{rest}")
            try:
                with store.open_input_file(at) as stream:
                    return headers_of(Pages(stream, length))
            except FileNotFoundError:
                return {}

        for b in batches:
            yield _rows([told(u, n) for u, n in zip(b.column("uri").to_pylist(), b.column("length").to_pylist())], b.column("path"), pa)

    sc = files.sparkSession.sparkContext
    return files.select("path", "uri", "length").repartition(4 * sc.defaultParallelism, "path").mapInArrow(run, SCHEMA)


def extract_metadata(assets: DataFrame, headers: DataFrame) -> DataFrame:
    """assets (of build_assets) with what the headers of their files tell: width, height, duration_seconds, metadata,
    and captured_at where an image is dated.

    Size and date come from the first image, the size else from the first video; the duration is the longest of
    a GIF's frames and the videos. Paths are those of the assets.
    """
    shown = headers.withColumn("kind", media_kind("path"))
    each = assets.select("id", "media_kind", F.posexplode("component_paths").alias("pos", "path")).join(shown, "path")
    image = F.col("kind") != "video"
    pick = lambda column, cond: F.min_by(column, F.when(cond & F.col(column).isNotNull(), F.col("pos")))
    times = F.when((F.col("kind") == "video") | ((F.col("kind") == "gif") & (F.col("media_kind") == "gif")), F.col("duration_seconds"))
    got = each.groupBy("id").agg(
        F.coalesce(pick("width", image), pick("width", ~image), F.lit(0)).alias("width"), F.coalesce(pick("height", image), pick("height", ~image), F.lit(0)).alias("height"),
        pick("taken", image).alias("_taken"), pick("animated", image).alias("_animated"), F.coalesce(F.max(times), F.lit(0.0)).alias("duration_seconds"),
    )
    out = assets.join(got, "id", "left")
    count = F.create_map(F.lit("component_count"), F.size("component_paths").cast("string"))
    told = F.when(F.col("_animated").isNotNull(), F.map_concat(count, F.create_map(F.lit("animated"), F.col("_animated").cast("string")))).otherwise(count)
    return out.withColumns({"captured_at": F.coalesce(exif_date("_taken"), "captured_at"), "metadata": told}).drop("_taken", "_animated")


def headers_under(spark: SparkSession, root: str) -> DataFrame:
    """Headers of the media files under a folder, paths relative to it. Where tasks cannot open the store
    themselves, Spark reads the files, each as one value."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").lstrip("/") if root.startswith(("/", "file:")) else root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", ""), "^" + "".join("\\" + c if c in r".^$*+?{}[]|()\\" else c for c in base) + "/", "")
    media = files.filter(media_kind("path").isNotNull())
    scheme = root.split(":", 1)[0] if ":" in root else "file" if spark.conf.get("spark.hadoop.fs.defaultFS", "file:").startswith("file:") else ""
    if scheme in OPENED:
        return open_headers(media.select(relative.alias("path"), F.col("path").alias("uri"), "length"))
    return read_headers(media.select(relative.alias("path"), "content"))
