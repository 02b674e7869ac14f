"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds those of its letters, each permuted by its place
(turned by one coordinate a place), as a product. A text's vector bundles those of its n-grams as a sum; a language's profile
bundles its texts, each of the same length. Languages are compared with a text by cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import sliced
from .scratch import materialize

DIMENSIONS = 2048
N = 3
SLICE_BYTES = 2 << 20  # text and
SLICE_ROWS = 512  # rows that are bundled at a time
GRAMS = 4096  # n-grams whose vectors are held at a time
LANGUAGES = 256  # profiles that are held, and broadcast, at a time
UNIT = 64.0  # a text's vector is rounded at this many steps for a coordinate of average size
UNKNOWN = "und"
CODE_POINTS = 0x110000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its letter in lower case, 0 for all that is no letter."""
    out = np.zeros(CODE_POINTS, np.uint32)
    for code in range(CODE_POINTS):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


@lru_cache(maxsize=8192)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The +1 and -1 of a letter, or of the gap between words (0): the bits of a hash, alike on every machine."""
    bits = np.unpackbits(np.frombuffer(hashlib.shake_256(f"letter:{code}".encode()).digest(-(-dimensions // 8)), np.uint8))
    return (2 * bits[:dimensions].astype(np.int8) - 1).astype(np.int8)


def numbers(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(different values in order, number of each value among them); values are below ``size``."""
    if size > 1 << 24:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[values] = True
    different = np.flatnonzero(seen)
    number = np.zeros(size, np.int64)
    number[different] = np.arange(len(different))
    return different, number[values]


def n_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of each different n-gram, text of each occurrence, n-gram of each), occurrences by text.

    Runs of other than letters are one gap, and each text stands between two. An n-gram has a letter, and letters of one
    text only, so a text of one letter has one at least.
    """
    joined = "\n" + "\n".join([*texts, ""])
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    text = np.concatenate([text[:1], text])
    symbols = letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    gap = symbols == 0
    kept = ~gap | ~np.concatenate([[False], gap[:-1]])
    symbols, text = symbols[kept], text[kept]
    windows = max(0, len(symbols) - n + 1)
    letter_at = symbols != 0
    first = np.full(windows, len(texts), np.int64)
    last = np.full(windows, -1, np.int64)
    for k in range(n):
        here, own = letter_at[k : k + windows], text[k : k + windows]
        first = np.where(here, np.minimum(first, own), first)
        last = np.where(here, np.maximum(last, own), last)
    whole = first == last
    alphabet, which = numbers(symbols, CODE_POINTS)
    gram = which[:windows].astype(np.int64)
    for k in range(1, n):
        gram = gram * len(alphabet) + which[k : k + windows]
    different, gram = numbers(gram[whole], len(alphabet) ** n)
    spelt = np.stack([different // len(alphabet) ** (n - 1 - k) % len(alphabet) for k in range(n)], axis=1) if len(different) else np.zeros((0, n), np.int64)
    return alphabet[spelt], first[whole], gram


def bound(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of n-grams: the product of their letters' vectors, that of the last as it is, the one before turned by one, and so on."""
    codes, which = np.unique(grams, return_inverse=True)
    which = which.reshape(grams.shape)
    table = np.stack([letter_vector(int(c), dimensions) for c in codes])
    n = grams.shape[1]
    out = table[which[:, n - 1]]
    for k in range(n - 1):
        out *= np.roll(table, n - 1 - k, axis=1)[which[:, k]]
    return out


def bundled(texts: list[str], n: int = N, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(vector of each text, how many n-grams it has, 1 to 3 letters each); sums of whole numbers, exact."""
    if not 1 <= n <= 3:
        raise ValueError(f"n-grams have 1 to 3 letters, not {n}")
    grams, text, gram = n_grams(texts, n)
    sizes = np.bincount(text, minlength=len(texts))
    kind = np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64
    counts = np.bincount(text * len(grams) + gram, minlength=len(texts) * len(grams)).reshape(len(texts), len(grams)) if len(grams) else np.zeros((len(texts), 0))
    out = np.zeros((len(texts), dimensions), kind)
    for at in range(0, len(grams), GRAMS):
        out += counts[:, at : at + GRAMS].astype(kind) @ bound(grams[at : at + GRAMS], dimensions).astype(kind)
    return out, sizes


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, column, SLICE_BYTES):
            for at in range(0, part.num_rows, SLICE_ROWS):
                yield part.slice(at, SLICE_ROWS)


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", n: int = N, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, profile): what the texts of each language bundle to, as whole numbers, so that no order of sums matters.

    Every text weighs the same, whatever its length. Texts that are null or have no letter, and rows of no language,
    teach nothing. Tasks send one row of sums for each language they see.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def told():
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "profile"])
            sums.clear()

        for part in pieces(batches, 1):
            vectors, sizes = bundled(part.column(1).to_pylist(), n, dimensions)
            size = lengths(vectors)
            steps = np.rint(vectors / np.where(size > 0, size, 1.0)[:, None] * (UNIT * dimensions**0.5)).astype(np.int64)
            langs, which = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
            for k, lang in enumerate(langs):
                if (own := (which == k) & (sizes > 0)).any():
                    sums[lang] = sums.get(lang, 0) + steps[own].sum(axis=0)
            if len(sums) > LANGUAGES:
                yield from told()
        if sums:
            yield from told()

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    told = rows.mapInArrow(run, "lang string, profile array<long>").select("lang", F.posexplode("profile").alias("at", "value"))
    each = told.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    model = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).select("lang", F.col("v.value").alias("profile"))
    return materialize(model, "languages")


def compared(rows: DataFrame, known, n: int, dimensions: int, last: bool) -> DataFrame:
    """Rows (.., text, lang_pred, score) with the language that is nearest, those of ``known`` included; the text goes with the last."""
    kept = [c for c in rows.columns if c not in ("text", "lang_pred", "score")]
    shape = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), *([] if last else ["text string"]), "lang_pred string", "score double"])

    def run(batches):
        langs, profiles = known.value
        names = np.array(langs, object)
        units = profiles / np.maximum(lengths(profiles), 1e-300)[:, None]
        for part in pieces(batches, len(kept)):
            texts = pc.fill_null(part.column("text"), "").to_pylist()
            vectors, sizes = bundled(texts, n, dimensions)
            near = np.clip(vectors.astype(np.float64) @ units.T / np.maximum(lengths(vectors), 1e-300)[:, None], 0.0, 1.0)
            at = near.argmax(axis=1)
            score, lang = near[np.arange(len(at)), at], names[at]
            was, before = part.column("score").to_numpy(zero_copy_only=False), np.array(part.column("lang_pred").to_pylist(), object)
            older = np.array([b is not None and b != UNKNOWN and (w > s or w == s and b < x) for w, s, b, x in zip(was, score, before, lang)], bool)
            none = sizes == 0
            score = np.where(none, 0.0, np.where(older, was, score))
            lang = np.where(none, UNKNOWN, np.where(older, before, lang))
            cols = {c: part.column(c) for c in kept} | ({} if last else {"text": part.column("text")}) | {"lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score)}
            yield pa.record_batch(list(cols.values()), names=list(cols))

    return rows.mapInArrow(run, shape)


def predict(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, dimensions: int = DIMENSIONS, along: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, columns taken ``along``, lang_pred (the profile of the largest cosine), score (that cosine, 0 at least).

    ``und`` with a score of 0 for a null text, one without letters, and where no profile is known. Ties go to the smaller
    name. Null and repeated ids are kept as they are; other columns are not read. An empty table gives no rows. Profiles
    are compared LANGUAGES at a time, so a task holds no more of them, however many there are; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *along, F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    blocks = -(-model.count() // LANGUAGES)
    for b in range(blocks):
        part = sorted(model.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).collect(), key=lambda r: r["lang"])
        if part or b == blocks - 1:
            known = [r["lang"] for r in part] or [UNKNOWN], np.array([r["profile"] for r in part] or [[0] * dimensions], np.float64)
            rows = compared(rows, docs.sparkSession.sparkContext.broadcast(known), n, dimensions, b == blocks - 1)
    return rows if blocks else rows.drop("text").withColumn("lang_pred", F.lit(UNKNOWN))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, n: int = N, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; the profiles are learnt from documents that are not held out.

    A document is held out if the CRC-32 of its id as text is ``held_out`` modulo ``folds``; a null id counts as an empty
    text. Nothing but the text has a part in a prediction. For the rest see ``learn`` and ``predict``.
    """
    out = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == held_out).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out, F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    model = learn(rows.filter(~F.col("held_out")), "lang", "text", n, dimensions)
    return predict(rows, model, "doc_id", "text", n, dimensions, along=("held_out",))
