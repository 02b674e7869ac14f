"""Sizes from headers of four formats, written by hand, and how few bytes that takes."""

import struct

from millrace.sources import images


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0" + b"x" * 50_000


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"x" * 50_000


def jpeg(w, h, before=b""):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9
    exif = b"\xff\xe1" + struct.pack(">H", 60_002) + b"\xff\xc0" * 30_000
    table = b"\xff\xc4" + struct.pack(">H", 5) + b"abc"
    return b"\xff\xd8" + app + exif + before + table + b"\xff\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, h, w) + b"x" * 50_000


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 100) + b"WEBP" + kind + struct.pack("<I", 30) + body + b"x" * 50_000


def test_four_formats(spark, tmp_path):
    cases = {
        "a.png": (png(640, 480), ("png", 640, 480)), "b.gif": (gif(3, 70_000 % 65536), ("gif", 3, 4464)), "c.jpg": (jpeg(4000, 3000), ("jpeg", 4000, 3000)),
        "d e+%.jpg": (jpeg(7, 9, b"\xff\xd0\xff\x01"), ("jpeg", 7, 9)),
        "e.webp": (webp(b"VP8X", b"\0" * 4 + struct.pack("<I", 1999)[:3] + struct.pack("<I", 999)[:3]), ("webp", 2000, 1000)),
        "f.webp": (webp(b"VP8L", b"\x2f" + struct.pack("<I", 299 | 149 << 14)), ("webp", 300, 150)), "g.webp": (webp(b"VP8 ", b"abc\x9d\x01\x2a" + struct.pack("<HH", 320 | 1 << 14, 240)), ("webp", 320, 240)),
        "h.bin": (b"nothing of the kind" * 100, None), "i.png": (b"", None), "j.jpg": (b"\xff\xd8\xff\xe0\0", None), "k.webp": (webp(b"ABCD", b"\0" * 20), None), "l.jpg": (b"\xff\xd8" + b"\xff\xe0\0\x02" * 2000, None),
    }
    for name, (raw, _) in cases.items():
        (tmp_path / name).write_bytes(raw)
    paths = [str(tmp_path / n) for n in cases] + [str(tmp_path / "a.png"), str(tmp_path / "none.png"), None, str(tmp_path)]
    rows = images.image_headers(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert len(rows) == len(paths)
    got = {r["path"]: r for r in rows}
    for name, (_, want) in cases.items():
        r = got[str(tmp_path / name)]
        assert ((r["format"], r["width"], r["height"]) if want else r["format"]) == want, name
        assert (r["error"] is None) == (want is not None) and r["bytes_read"] <= 32 + 4 * images.SEGMENTS
    assert got[str(tmp_path / "c.jpg")]["bytes_read"] < 80
    assert sum(r["path"] == str(tmp_path / "a.png") and r["width"] == 640 for r in rows) == 2
    assert got[None]["error"] and got[str(tmp_path / "none.png")]["error"] and got[str(tmp_path)]["error"]
