"""Ranked lexical search: a threshold-seeded join of items with all documents, by integer impacts.

A term's impact in a document is its weight times a part that grows with its occurrences and falls with the document's
length. Each term stores the largest parts over the corpus, with their documents. An item's kth score is at least the kth
largest sum of what it is known to have from these (so at least any term's kth impact). With an item's terms from the
largest bound of their impact to the smallest, documents that hold only terms of a suffix whose bounds sum to less than that
threshold cannot be among the first k: the suffix generates no candidates. The other terms do, the suffix's bounds drop those out
of reach, and what is left is scored exactly.

Items come in blocks, each with bounded terms; a block's terms and bounds go to all tasks, and no document is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import sliced
from .scratch import discard, materialize

K = 10
BLOCK_TERMS = 500_000  # different terms of each item, summed over the items of a block, about: what a task holds of the items
SLICE_BYTES = 4 << 20  # text that is cut into terms at a time
SCORED = 4_000_000  # occurrences of terms in documents that are scored at a time

#: For bytes.translate: A-Z lower-cased, blanks in place of the other ASCII characters that are neither letters nor digits.
CLASSES = bytes(ord(chr(b).lower()) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of about SLICE_BYTES of text."""
    text, at = text.translate(CLASSES), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE_BYTES) if at + SLICE_BYTES < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats, text of each pair, known term of each pair, occurrences), pairs by text and term."""
    n, of_text, found = np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        for terms in term_lists(text):
            n[i] += len(terms)
            ids = np.array([k for k in map(known.get, terms) if k is not None], np.int64)
            of_text.append(np.full(len(ids), i, np.int64))
            found.append(ids)
    pairs, times = np.unique(np.concatenate(of_text or [n[:0]]) * (len(known) + 1) + np.concatenate(found or [n[:0]]), return_counts=True)
    return n, pairs // (len(known) + 1), pairs % (len(known) + 1), times


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): each item is a row, whatever its id."""

    def run(batches):
        for part in (s for batch in batches for s in sliced(batch, 2, SLICE_BYTES)):
            for item, item_id, text in zip(*(c.to_pylist() for c in part.columns)):
                known: dict[bytes, int] = {}
                for terms in term_lists(text):
                    for t in terms:
                        known[t] = known.get(t, 0) + 1
                n = len(known)
                yield pa.record_batch([pa.array([item] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.int64())], names=["item", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item long, item_id long, term binary, times long")


def held_terms(docs: DataFrame, id_col: str, text_col: str, known) -> DataFrame:
    """(key, doc_id, n, terms, times): documents with a term, how many terms they have, and which known ones how often."""

    def run(batches):
        for part in (s for batch in batches for s in sliced(batch, 2, SLICE_BYTES)):
            n, of_text, terms, times = counted(part.column(2).to_pylist(), known.value)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of_text, minlength=len(n)))])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, times)]
            rows = pa.record_batch([part.column(0), part.column(1), pa.array(n), *lists], names=["key", "doc_id", "n", "terms", "times"])
            yield rows.filter(pc.greater(rows.column("n"), 0))

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, doc_id long, n long, terms array<int>, times array<int>")


def parts(n: np.ndarray, times: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The part of a term in a document of ``n`` terms, without its weight; whole numbers, in Python's where 64 bits are too few."""
    wide = 75 * documents * int(n.max(initial=0)) >= 1 << 63
    m = 25 + ((75 * documents * n.astype(object)) // total).astype(np.int64) if wide else 25 + (75 * n * documents) // total
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each pair, term, occurrences) of a batch of ``held_terms``."""
    lists = batch.column("terms")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    numbers = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), numbers(lists), numbers(batch.column("times"))


def largest(terms: np.ndarray, values: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest values of each term, ties to the smaller key."""
    order = np.lexsort((keys, -values, terms))
    begins = np.flatnonzero(np.concatenate([[True], terms[order][1:] != terms[order][:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


def term_figures(held: DataFrame, documents: int, total: int, k: int) -> DataFrame:
    """(term, df, keys, parts) of each task: documents with the term, and the k largest parts with their documents."""

    def run(batches):
        df, best = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows, terms, times = flat(batch)
            more = np.bincount(terms, minlength=len(df))
            more[: len(df)] += df
            df = more
            each = parts(batch.column("n").to_numpy()[rows], times, documents, total)
            best = [np.concatenate(x) for x in zip(best, (terms, each, batch.column("key").to_numpy()[rows]))]
            kept = largest(*best, k)
            best = [x[kept] for x in best]
        some = np.flatnonzero(df)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(best[0], minlength=len(df))[some])]), pa.int32())
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(df[some]), pa.ListArray.from_arrays(ends, pa.array(best[2])), pa.ListArray.from_arrays(ends, pa.array(best[1]))], names=["term", "df", "keys", "parts"])

    return held.mapInArrow(run, "term int, df long, keys array<long>, parts array<long>")


class Bounds:
    """What a task needs of a block's items: their terms from the largest bound down, what bounds sum to from each on, thresholds."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, factors: np.ndarray, bounds: np.ndarray, least: dict[int, int]):
        order = np.lexsort((terms, -bounds, items))
        items, self.terms, self.factors, bounds = items[order], terms[order], factors[order], bounds[order]
        self.items, begins = np.unique(items, return_index=True)
        self.ends = np.append(begins, len(items))
        self.suffix = [np.append(np.cumsum(bounds[a:b][::-1])[::-1], 0) for a, b in zip(self.ends, self.ends[1:])]
        self.least = np.array([least.get(int(i), 0) for i in self.items], np.int64)


def scored(bounds: Bounds, batches: Iterator[pa.RecordBatch], documents: int, total: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, doc_ids, scores): the first k of each item among these documents, if they may be among the first k of all."""
    least, best = bounds.least.copy(), {}
    for batch in batches:
        rows, terms, times = flat(batch)
        part = parts(batch.column("n").to_numpy()[rows], times, documents, total)
        order = np.argsort(terms, kind="stable")
        rows, part, terms = rows[order], part[order], terms[order]
        ids = batch.column("doc_id")
        ranks = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()  # a null id comes last
        begins = np.searchsorted(terms, np.arange(bounds.terms.max(initial=0) + 2))
        total_of = np.zeros(batch.num_rows, np.int64)
        for j in range(len(bounds.items)):
            own, factors = (v[bounds.ends[j] : bounds.ends[j + 1]] for v in (bounds.terms, bounds.factors))
            suffix, floor = bounds.suffix[j], max(int(least[j]), 1)
            probes = int(np.argmax(suffix < floor))  # terms from here on reach nothing by themselves
            total_of[:] = 0
            for t, f in zip(own[:probes], factors[:probes]):
                at = slice(begins[t], begins[t + 1])
                total_of[rows[at]] += f * part[at]
            docs = np.flatnonzero(total_of + suffix[probes] >= floor)
            scores = total_of[docs]
            for i in range(probes, len(own)):
                if not len(docs):
                    break
                at = slice(begins[own[i]], begins[own[i] + 1])
                if at.start < at.stop:
                    place = np.minimum(np.searchsorted(rows[at], docs), at.stop - at.start - 1)
                    scores = scores + np.where(rows[at][place] == docs, factors[i] * part[at][place], 0)
                live = scores + suffix[i + 1] >= floor
                docs, scores = docs[live], scores[live]
            if len(docs):
                kept = np.lexsort((ranks[docs], -scores))[:k]
                found = [(int(s), ids[int(d)].as_py()) for s, d in zip(scores[kept], docs[kept])]
                found = sorted(best.get(j, []) + found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
                best[j] = found
                if len(found) == k:
                    least[j] = max(least[j], found[-1][0])
    for j, found in best.items():
        yield int(bounds.items[j]), [d for _, d in found], [s for s, _ in found]


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``size`` occurrences."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ranked_block(docs: DataFrame, wanted: pa.Table, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, doc_id, score): candidates for the first k of each item of a block, the first k among them."""
    spark = docs.sparkSession
    terms = pc.unique(wanted.column("term")).to_pylist()
    known = {t: i for i, t in enumerate(sorted(terms))}
    held = materialize(held_terms(docs, id_col, text_col, spark.sparkContext.broadcast(known)), "lexical-terms")
    documents, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return None
    figures = materialize(term_figures(held, documents, total, k), "lexical-figures")
    weight = F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (2 * F.col("df") + 1)))
    stats = figures.groupBy("term").agg(F.sum("df").alias("df"), F.max(F.get("parts", F.lit(0))).alias("top")).select("term", weight.alias("weight"), "top")
    stats = materialize(stats, "lexical-weights")
    each = np.array(stats.select("term", "weight", "top").orderBy("term").toArrow().to_pandas(), np.int64).reshape(-1, 3)
    weight_of, top = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    weight_of[each[:, 0]], top[each[:, 0]] = each[:, 1], each[:, 2]

    of_term = np.array([known[t] for t in wanted.column("term").to_pylist()], np.int64)
    items, times = (wanted.column(c).to_numpy() for c in ("item", "times"))
    factors = times * weight_of[of_term]
    by_term = spark.createDataFrame(pa.table({"item": items, "term": pa.array(of_term, pa.int32()), "factor": factors}))
    first = Window.partitionBy("term").orderBy(F.desc("part"), "key")
    seeds = figures.select("term", F.explode(F.arrays_zip("keys", "parts")).alias("x")).select("term", F.col("x.keys").alias("key"), F.col("x.parts").alias("part"))
    seeds = seeds.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    known_of = seeds.join(by_term, "term").groupBy("item", "key").agg(F.sum(F.col("factor") * F.col("part")).alias("score"))
    kth = known_of.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))).filter(F.col("r") == k)
    least = {r["item"]: r["score"] for r in kth.select("item", "score").collect()}
    plan = spark.sparkContext.broadcast(Bounds(items, of_term, factors, factors * top[of_term], least))

    def run(batches):
        for item, ids, scores in scored(plan.value, gathered(batches, SCORED), documents, total, k):
            yield pa.record_batch([pa.array([item] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    best = held.mapInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = materialize(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "lexical-best")
    discard(held, figures, stats)
    return best


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0, ties by ascending doc_id.

    Terms are the maximal runs of ASCII letters and digits and of other than ASCII characters, A-Z lower-cased. N documents
    have a term, L terms all of them, n one; a term stands in df documents, tf times in one. Its weight w is
    floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + 75 n N div L, and a document's score sums
    w (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included. All documents are scored, whatever their number.

    A null, empty or blank text has no terms: such an item has no rows, such a document is in none and does not count. An item
    is a row: items of one id are ranked each for itself. Rows of one doc_id are documents of their own; a null doc_id
    comes last among equal scores. Other columns are not read. Empty tables give no rows.

    Items are dealt to blocks of about ``block_terms`` terms, each block reads the documents once and is a broadcast of that
    size. A task keeps k documents for each item, and scores SCORED occurrences of terms at a time.
    """
    spark = docs.sparkSession
    wanted = materialize(item_terms(items, item_id_col, item_text_col), "lexical-items")
    blocks = max(1, -(-wanted.count() // block_terms))
    out = []
    for b in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "term", "times").toArrow()
        if block.num_rows and (best := ranked_block(docs, block, k, id_col, text_col)) is not None:
            out.append(best)
    names = wanted.select("item", "item_id").distinct()
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = out[0]
    for best in out[1:]:
        every = every.unionByName(best)
    return every.join(names, "item").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), wanted AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
all_docs AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
occurrences AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM occurrences, all_docs GROUP BY term, docs),
parts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))) AS part
    FROM occurrences JOIN lengths USING (doc_id) JOIN weights USING (term), all_docs
), scores AS (
    SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
