"""Substring dedup: word windows that a document with a smaller id also holds are cut out of later documents.

Every window has two Rabin-Karp hashes. One says to which bucket the window goes, the other stands for it there; as there
are as many buckets as the bytes of text ask for, what both tell apart grows with the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: The bases of the Rabin-Karp polynomials modulo 2**64, and what words are mixed with for the second; any odd numbers of full width do.
BASE, SECOND, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
CHUNK_WINDOWS = 400_000  # windows a task holds before it sends them on
ROWS = 512  # documents cut at a time
LEAST_BUCKETS = 512
BUCKET_BYTES = 8_000_000  # bytes of text for a bucket, about
TASK_BUCKETS = 8  # buckets of a task, about, and
MOST_TASKS = 16_384  # tasks at most; beyond that a task goes through more buckets, one after the other


def polynomial(w: np.ndarray, width: int, base: int) -> np.ndarray:
    """Horner's rule for all windows at once."""
    n = len(w) - width + 1
    h = w[:n].copy()
    for i in range(1, width):
        h *= np.uint64(base)
        h += w[i : i + n]
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(x) for x in words], np.uint64)


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all windows of ``width`` words; none for a shorter text."""
    return polynomial(word_hashes(words), width, BASE) if len(words) >= width else np.empty(0, np.uint64)


def window_buckets(words: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """The bucket of each window, from hashes of words mixed so that the second polynomial does not follow the first."""
    mixed = (words ^ (words >> np.uint64(29))) * np.uint64(MIX)
    return (polynomial(mixed ^ (mixed >> np.uint64(32)), width, SECOND) >> np.uint64(32)) % np.uint64(buckets)


def covered(starts: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def merged_intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words as (first, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def split_words(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _send_windows(width: int, buckets: int):
    """Per portion of documents and bucket one row of packed (hash, doc_id) with the smallest doc_id of each hash.

    A window that a smaller document of the same portion also holds is known to be repeated at once. It needs no count and
    is dealt out by its document, whatever its bucket. So however common a window, a portion sends it to its bucket once.
    """

    def run(batches):
        hashes, places, owners, held = [], [], [], 0

        def rows(h, d, b, found):
            order = np.lexsort((d, b))  # by document within the bucket: the ids then compress well
            h, d, b = h[order], d[order], b[order]
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.empty(0, np.int64)
            out = [(int(b[i]), found, h[i:j].tobytes(), d[i:j].tobytes()) for i, j in zip(cut, np.append(cut[1:], len(b)))]
            for at in range(0, len(out), 256):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[at : at + 256]), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["bucket", "found", "hashes", "docs"])

        def flush():
            h, b, d = np.concatenate(hashes), np.concatenate(places), np.concatenate(owners)
            order = np.lexsort((d, b, h))
            h, b, d = h[order], b[order], d[order]
            other = np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])])
            new = other | np.concatenate([[True], d[1:] != d[:-1]])  # a window counts once in a document
            h, b, d, head = h[new], b[new], d[new], other[new]
            yield from rows(h[head], d[head], b[head], False)
            h, d = h[~head], d[~head]
            yield from rows(h, d, (d.view(np.uint64) * np.uint64(MIX) >> np.uint64(32)) % np.uint64(buckets), True)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(text.as_py())
                if len(words) < width:
                    continue
                w = word_hashes(words)
                hashes.append(polynomial(w, width, BASE))
                places.append(window_buckets(w, width, buckets).astype(np.uint32))
                owners.append(np.full(len(hashes[-1]), doc, np.int64))
                held += len(hashes[-1])
                if held >= CHUNK_WINDOWS:
                    yield from flush()
                    hashes, places, owners, held = [], [], [], 0
        if held:
            yield from flush()

    return run


def _count_bucket(table: pa.Table) -> pa.Table:
    """The windows of a bucket whose hash also stands in a smaller document: per document, its packed hashes."""
    h, d, out_h, out_d = [], [], [], []
    for found, hashes, docs in zip(*(table.column(c).to_pylist() for c in ("found", "hashes", "docs"))):
        a, b = np.frombuffer(hashes, np.uint64), np.frombuffer(docs, np.int64)
        (out_h if found else h).append(a)
        (out_d if found else d).append(b)
    if h:
        h, d = np.concatenate(h), np.concatenate(d)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        head = np.concatenate([[True], h[1:] != h[:-1]])
        least = d[head][np.cumsum(head) - 1]
        out_h.append(h[d > least])
        out_d.append(d[d > least])
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.empty(0, np.int64)
    parts = [h[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(d)))]
    return pa.table({"doc_id": pa.array(d[cut], pa.int64()), "hashes": pa.array(parts, pa.binary())})


def task_count(buckets: int, least: int) -> int:
    return max(least, min(MOST_TASKS, -(-buckets // TASK_BUCKETS)))


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes): per document and bucket, packed hashes of its windows that a smaller doc_id also holds."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    sent = docs.mapInArrow(_send_windows(width, buckets), "bucket long, found boolean, hashes binary, docs binary")
    tasks = task_count(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_count_bucket, "doc_id long, hashes binary")


def _cut(width: int, with_text: bool):
    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = []
            for doc, text, found in zip(*(batch.column(i) for i in range(3))):
                words = split_words(text.as_py())
                mask = np.zeros(len(words), bool)
                if found.is_valid:
                    gone = np.frombuffer(b"".join(found.as_py()), np.uint64)
                    mask = covered(np.flatnonzero(np.isin(window_hashes(words, width), gone)), len(words), width)
                kept = b" ".join([w for w, m in zip(words, mask) if not m]) if mask.any() else b" ".join(words)
                spans = [{"first": a, "end": b} for a, b in merged_intervals(mask)]
                out.append((doc.as_py(), len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8", "surrogatepass") if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string())
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"][: 5 + with_text]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)][: 5 + with_text], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, removed (maximal intervals of words), kept_text if asked for.

    A word goes if it lies in a window of ``width`` words whose sequence also starts in a document with a smaller id.
    Windows are judged on the input. 64 bits of hash stand for a window within a bucket of about 1.5 million windows,
    which an independent hash deals: a bucket has a wrong match with odds of about 1 in 10 million, so even 100 TB of text, with
    12 million buckets, has about one.

    Texts that are null, empty or shorter than ``width`` words lose nothing. Rows with a null id are dropped from the
    count and lose nothing. Rows that repeat an id are told apart by nothing and share what is removed. Other columns
    of ``docs`` are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(repeated_windows(rows.filter("doc_id IS NOT NULL AND text IS NOT NULL"), width), "windows")
    found = found.groupBy("doc_id").agg(F.collect_list("hashes").alias("found"))
    joined = rows.join(found, "doc_id", "left").select("doc_id", "text", "found")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first: long, end: long>>"
    return joined.mapInArrow(_cut(width, with_text), schema + (", kept_text string" if with_text else ""))
