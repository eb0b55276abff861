"""File headers: bytes written by hand, the operator over files, and assets with what their files tell."""

from struct import pack

from mediaquarry.sources import headers
from mediaquarry.sources.scan import build_assets, list_files


def png(w, h, frames=0):
    chunk = lambda name, data: pack(">I", len(data)) + name + data + b"crc!"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + (chunk(b"acTL", pack(">II", frames, 0)) if frames else b"") + chunk(b"IDAT", b"xx") + chunk(b"IEND", b"")


def gif(w, h, delays):
    frame = lambda d: b"\x21\xf9\x04\x00" + pack("<H", d) + b"\x00\x00" + b"\x2c" + pack("<HHHHB", 0, 0, w, h, 0) + b"\x02\x03abc\x00"
    return b"GIF89a" + pack("<HHBBB", w, h, 0x80, 0, 0) + b"\0" * 6 + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00" + b"".join(map(frame, delays)) + b"\x3b"


def jpeg(w, h, date=None, turn=1, order="<"):
    seg = lambda mark, data: bytes([0xFF, mark]) + pack(">H", len(data) + 2) + data
    text = (date or "").encode() + b"\0"
    entries = [pack(f"{order}HHIHH", 274, 3, 1, turn, 0)] + ([pack(f"{order}HHII", 306, 2, len(text), 8 + 2 + 24 + 4)] if date else [])
    tiff = (b"II" if order == "<" else b"MM") + pack(f"{order}HI", 42, 8) + pack(f"{order}H", len(entries)) + b"".join(entries) + pack(f"{order}I", 0) + text
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0" + b"\0" * 9) + seg(0xE1, b"Exif\0\0" + tiff) + seg(0xC2, pack(">BHHB", 8, h, w, 3) + b"\0" * 9) + b"\xff\xda\x00\x02data\xff\xd9"


def mp4(w, h, scale, length):
    atom = lambda name, data: pack(">I", 8 + len(data)) + name + data
    track = lambda a, b: atom(b"trak", atom(b"tkhd", b"\0" * 76 + pack(">II", a << 16, b << 16)) + atom(b"mdia", atom(b"mdhd", b"\0" * 12 + pack(">II", scale, length) + b"\0" * 4)))
    return atom(b"ftyp", b"isom\0\0\0\0") + atom(b"mdat", b"frames") + atom(b"moov", atom(b"mvhd", b"\0" * 100) + track(0, 0) + track(w, h))


def test_formats():
    of = headers.headers_of
    assert of(png(640, 480)) == {"width": 640, "height": 480, "animated": False} and of(png(1, 2, 3))["animated"]
    assert of(gif(20, 10, [10, 25])) == {"width": 20, "height": 10, "animated": True, "duration_seconds": 0.35} and not of(gif(5, 5, [7]))["animated"]
    assert of(jpeg(300, 200, "2024:05:06 07:08:09")) == {"width": 300, "height": 200, "animated": False, "taken": "2024:05:06 07:08:09"}
    assert of(jpeg(300, 200, "2024:05:06 07:08:09", 6, ">")) == {"width": 200, "height": 300, "animated": False, "taken": "2024:05:06 07:08:09"}
    assert of(mp4(1920, 1080, 600, 1500)) == {"width": 1920, "height": 1080, "duration_seconds": 2.5}
    assert of(b"BM" + b"\0" * 16 + pack("<ii", 7, -9)) == {"width": 7, "height": 9, "animated": False}
    assert of(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 4 + b"\x02\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == {"width": 100, "height": 50, "animated": True}
    whole = [png(640, 480, 2), gif(20, 10, [10, 25]), jpeg(300, 200, "2024:05:06 07:08:09"), mp4(64, 48, 600, 1500)]
    for b in [None, b"", b"text, not media", *[w[:k] for w in whole for k in range(len(w))]]:
        assert isinstance(of(b), dict)  # cut anywhere


def test_assets_with_headers(spark, tmp_path):
    (tmp_path / "2024" / "05").mkdir(parents=True)
    files = {"2024/05/a.JPG": jpeg(300, 200, "2023:01:02 03:04:05"), "2024/05/live.png": png(10, 20), "2024/05/live.mov": mp4(64, 48, 10, 35), "2024/05/b.gif": gif(20, 10, [10, 25]), "2024/05/v.mp4": mp4(64, 48, 100, 150), "2024/05/bad.jpg": b"\xff\xd8\xff", "note.txt": b"x"}
    for name, b in files.items():
        (tmp_path / name).write_bytes(b)
    found = headers.headers_under(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == set(files) - {"note.txt"}
    out = {r.relative_key: r for r in headers.extract_metadata(build_assets(list_files(spark, str(tmp_path))), found).collect()}
    tell = lambda k: (out[k].width, out[k].height, out[k].duration_seconds, out[k].metadata)
    assert tell("2024/05/a.JPG") == (300, 200, 0.0, {"component_count": "1", "animated": "false"}) and out["2024/05/a.JPG"].captured_at.startswith("2023-01-02T03:04:05")
    assert tell("2024/05/live") == (10, 20, 3.5, {"component_count": "2", "animated": "false"}) and out["2024/05/live"].captured_at.startswith("2024-05")
    assert tell("2024/05/b.gif") == (20, 10, 0.35, {"component_count": "1", "animated": "true"}) and tell("2024/05/v.mp4")[:3] == (64, 48, 1.5)
    assert tell("2024/05/bad.jpg")[:3] == (0, 0, 0.0)
    from mediaquarry.api import LibraryApi
    from mediaquarry.sources.store import Library

    api = LibraryApi(Library(spark, str(tmp_path / "lib")))
    api.sync(list_files(spark, str(tmp_path / "2024")), "t1", headers=headers.headers_under(spark, str(tmp_path / "2024")))
    assert {r.title: (r.width, r.height, r.durationSeconds) for r in api.items().collect()} == {"a": (300, 200, 0.0), "live": (10, 20, 3.5), "b": (20, 10, 0.35), "v": (64, 48, 1.5), "bad": (0, 0, 0.0)}


def test_pages_read_as_bytes_do(monkeypatch):
    import io

    monkeypatch.setattr(headers, "PAGE", 7)
    for whole in [png(640, 480, 2), gif(20, 10, [10, 25]), jpeg(300, 200, "2024:05:06 07:08:09", 6), mp4(64, 48, 600, 1500), b"", b"BM"]:
        for n in range(len(whole) + 1):
            pages = headers.Pages(io.BytesIO(whole), n)
            assert headers.headers_of(pages) == headers.headers_of(whole[:n]) and pages[3:11] == whole[:n][3:11]


def test_a_large_video_costs_a_few_pages(spark, tmp_path):
    """A gigabyte of frames (a sparse file) before the box that tells size and duration."""
    head, tail = mp4(64, 48, 600, 1500).split(b"frames")
    with open(tmp_path / "long.mp4", "wb") as f:
        f.write(head[:-8] + pack(">I4sQ", 1, b"mdat", 16 + (1 << 30)))
        f.seek(1 << 30, 1)
        f.write(tail)
    (tmp_path / "gone.txt").write_bytes(b"")
    row = headers.headers_under(spark, str(tmp_path)).collect()
    assert [(r.path, r.width, r.height, r.duration_seconds) for r in row] == [("long.mp4", 64, 48, 2.5)]
    reads = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            reads.append(n)
            return self.f.read(n)

    with open(tmp_path / "long.mp4", "rb") as f:
        assert headers.headers_of(headers.Pages(Counted(f), (tmp_path / "long.mp4").stat().st_size))["width"] == 64
    assert len(reads) <= 6
