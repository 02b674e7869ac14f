"""Sizes of images from their headers: a few ranged reads of each file, which is neither read whole nor decoded."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Read = Callable[[int, int], bytes]
SEGMENTS = 512  # of a JPEG that are walked over before its frame header


def big(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def little(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


def jpeg_size(read: Read) -> tuple[int, int]:
    """Walks over the segments, by their lengths, to the first frame header."""
    at = 2
    for _ in range(SEGMENTS):
        head = read(at, 4)
        while head[:2] == b"\xff\xff":  # a marker may be filled up
            at += 1
            head = read(at, 4)
        if len(head) < 4 or head[0] != 0xFF:
            break
        marker = head[1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            frame = read(at + 5, 4)
            return big(frame[2:4]), big(frame[:2])
        else:
            at += 2 + big(head[2:4])
    raise ValueError("no frame header")


def webp_size(head: bytes) -> tuple[int, int]:
    """By the first chunk: a lossy frame, a lossless one, or a canvas."""
    if head[12:16] == b"VP8X":
        return 1 + little(head[24:27]), 1 + little(head[27:30])
    if head[12:16] == b"VP8L" and head[20] == 0x2F:
        bits = little(head[21:25])
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if head[12:16] == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        return little(head[26:28]) & 0x3FFF, little(head[28:30]) & 0x3FFF
    raise ValueError("unknown chunk")


def image_size(read: Read) -> tuple[str, int, int]:
    """(format, width, height) of a file of which ``read`` gives some bytes from a place."""
    head = read(0, 32)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
        return "png", big(head[16:20]), big(head[20:24])
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", little(head[6:8]), little(head[8:10])
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp", *webp_size(head)
    if head[:3] == b"\xff\xd8\xff":
        return "jpeg", *jpeg_size(read)
    raise ValueError("unknown format")


def image_headers(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, format, width, height, bytes_read, error) of each file, a row for each row of ``paths``; equal paths are read once.

    Files are opened by the worker through Arrow's file systems (local, HDFS, S3, GCS by the path's scheme), 32 bytes at the head
    and, of a JPEG, four for each segment. A null path, and a file that is not there or that is not understood, has an error and no size.
    """

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                n = 0

                def read(at: int, size: int) -> bytes:
                    nonlocal n
                    file.seek(at)
                    raw = file.read(size)
                    n += len(raw)
                    return raw

                try:
                    system, place = fs.FileSystem.from_uri(path)
                    with system.open_input_file(place) as file:
                        out.append((path, *image_size(read), n, None))
                except (OSError, ValueError, IndexError, TypeError, pa.ArrowException) as e:
                    out.append((path, None, None, None, n, type(e).__name__))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["path", "format", "width", "height", "bytes_read", "error"])

    shape = "path string, format string, width long, height long, bytes_read long, error string"
    wanted = paths.select(F.col(path_col).cast("string").alias("path"))
    # dealt out anew, as a list of paths is small and its files are far away
    found = wanted.distinct().repartition("path").mapInArrow(run, shape)
    return wanted.join(found.withColumnRenamed("path", "_path"), F.col("path").eqNullSafe(F.col("_path"))).drop("_path")
