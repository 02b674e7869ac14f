"""Fill-in-the-middle: texts cut at seeded token boundaries and put in another order, by bit-parallel big integers.

A text's bytes become masks with one bit for each byte, the first byte in the highest bit. Classes come from one
``bytes.translate`` each, boundaries from shifts and boolean operations on whole masks, the number of tokens from
``bit_count``, and the place of a token of some rank from halving its mask.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import sliced

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SLICE_BYTES = 16 << 20  # text of a task's rows that is rewritten at a time

#: For bytes.translate: "1" for the bytes of a class. A code point begins at each byte that does not continue one.
LETTERS = bytes(ord("1") if chr(b).isascii() and chr(b).isalpha() else ord("0") for b in range(256))
FIRSTS = bytes(ord("0") if 0x80 <= b < 0xC0 else ord("1") for b in range(256))


def masks(text: bytes) -> tuple[int, int]:
    """(places where a code point begins, places where a token begins): a token is a run of A-Z and a-z, or one other code point."""
    if not text:
        return 0, 0
    firsts, letters = int(text.translate(FIRSTS), 2), int(text.translate(LETTERS), 2)
    return firsts, (firsts & ~letters) | (letters & ~(letters >> 1))


def ranked_place(mask: int, width: int, rank: int) -> int:
    """The place, from the highest of ``width`` bits, of the set bit of ``rank`` (from 0); ``width`` where there is none.

    Each step counts the upper half and goes on with the half that holds the bit, so the whole costs two passes over the mask.
    """
    at = 0
    while width > 1:
        low = width // 2
        upper = mask >> low
        n = upper.bit_count()
        if rank < n:
            mask, width = upper, width - low
        else:
            mask, rank, at, width = mask & ((1 << low) - 1), rank - n, at + width - low, low
    return at if rank < mask else at + width


def cut(text: bytes, h1: int, h2: int) -> tuple[int, int, int, int, int]:
    """(tokens, end of the prefix, end of the middle, code points of the prefix, of the middle); ends are places in the bytes."""
    firsts, starts = masks(text)
    n, size = starts.bit_count(), len(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = ranked_place(starts, size, low), ranked_place(starts, size, high)
    before, upto = (firsts >> (size - i)).bit_count(), (firsts >> (size - j)).bit_count()
    return n, i, j, before, upto - before


def rearranged(text: bytes, draws: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text under its four draws."""
    h1, h2, h3, h4 = draws
    n, i, j, before, within = cut(text, h1, h2)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < spm_rate:
        return n, "spm", before, within, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, within, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 90, spm_rate: int = 20, seed: str = "1") -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output (the text in its form).

    The four draws of a document are the first four groups of 8 hex digits of the SHA-256 of ``seed:`` and its id. Of 100
    documents about ``rate`` are rearranged, of these ``spm_rate`` of 100 with the suffix first. plain texts are those not
    drawn, empty ones and those that hold one of the marks already; their counts of characters are null, the output is the text.

    A null text counts as empty: n is 0, the form plain, the output empty. A null id draws like ``seed:`` with nothing
    behind it; rows of one id share their draws. Other columns of ``docs`` are not read. An empty table gives no rows.
    A task holds SLICE_BYTES of text, or one text, with its masks at a time; nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for part in (s for batch in batches for s in sliced(batch, 1, SLICE_BYTES)):
            texts, *drawn = (part.column(k).to_pylist() for k in range(1, 6))
            made = [rearranged(text, h, rate, spm_rate) for text, *h in zip(texts, *drawn)]
            n, form, before, within, output = zip(*made)
            yield pa.record_batch(
                [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(output, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    made = rows.select("doc_id", "text", *draws).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of, from output and form alone.

    A rearranged text holds no mark of its own, and no mark can arise where a part of it meets one, so the first of each is the one put there.
    """
    marks = [m.decode() for m in (PREFIX, SUFFIX, MIDDLE)]
    part = {m: F.element_at(F.split(F.element_at(F.split(output, m, 2), 2), "|".join(marks), 2), 1) for m in marks}
    return F.when(form == "plain", output).otherwise(F.concat(part[marks[0]], part[marks[2]], part[marks[1]]))


def digests(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with SHA-256 of each output and of the text restored from it in place of the texts."""
    cols = [c for c in made.columns if c != "output"]
    return made.select(*cols, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), e AS (
    SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
        ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS s
    FROM d
), f AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(t[1:least(a, b)], '') AS prefix, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(t[greatest(a, b) + 1:], '') AS suffix
    FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM f
"""
