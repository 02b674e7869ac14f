"""SimHash near-duplicate detection with a generalised pigeonhole search.

Fingerprints link when at most ``distance`` of their 64 bits differ. The 64 bits are dealt to partitions so that
correlated bits share one; partition i gets a threshold t_i, where the t_i add up to distance - partitions + 1. By the
generalised pigeonhole principle two linked fingerprints differ by at most t_i bits in some partition i, so it is enough
to probe each partition's index with all values within t_i bits, and to verify. The thresholds are those with the least
estimated cost, found by dynamic programming.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_dedup
from .components import connected_components
from .scratch import discard, materialize

BITS = 64


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text's word shingles; 0 for a text without words.

    A-Z are lower-cased and words are runs of other than ASCII white space. A bit is set if it is set in over half of
    the shingles' XXH64 hashes. A text of fewer words than ``width`` is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)))]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[lo : lo + (1 << 16)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each document as a signed 64-bit integer, computed over the whole text."""

    def run(batches):
        for batch in batches:
            out = [simhash(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Over all fingerprints: how many, and how often each two of the 64 bits are both set. 4096 sums reach the driver."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        if n:
            yield pa.record_batch([pa.array(range(BITS * BITS + 1)), pa.array([n, *total.astype(np.int64).ravel()])], names=["i", "v"])

    rows = distinct.select("fp").mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return 0, np.zeros((BITS, BITS))
    sums = np.zeros(BITS * BITS + 1)
    for r in rows:
        sums[r["i"]] = r["v"]
    return int(sums[0]), sums[1:].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Deal the bits to partitions of like width; each next bit is the one most correlated with those already there."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(partitions):
        width = BITS // partitions + (k < BITS % partitions)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def partition_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a partition, packed to an unsigned integer."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def equal_pairs(distinct: DataFrame, groups: list[list[int]]) -> list[float]:
    """How many pairs of fingerprints agree in each partition, counted over all of them."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, bits in enumerate(groups):
                yield pa.record_batch([pa.array(np.full(len(fp), k, np.int32)), pa.array(partition_values(fp, bits).view(np.int64))], names=["k", "v"])

    counts = distinct.select("fp").mapInArrow(run, "k int, v long").groupBy("k", "v").count()
    found = {r["k"]: r["pairs"] for r in counts.groupBy("k").agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("pairs")).collect()}
    return [float(found.get(k, 0)) for k in range(len(groups))]


def estimated_costs(n: int, both: np.ndarray, groups: list[list[int]], pairs: list[float], distance: int, verify: float) -> list[list[float]]:
    """cost[i][t]: probes sent plus ``verify`` times the candidates met with threshold t in partition i.

    Candidates are of two kinds. Those that independent bits give follow from the odds that a bit differs: elementary
    symmetric sums over the partition's bits. The agreeing pairs counted beyond those are near copies; they meet at
    t = 0 already, and each further bit is taken to add as many again. Index t = -1 (not probed) costs nothing.
    """
    p = both.diagonal() / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-9, 0.5)
    costs = []
    for bits, agree in zip(groups, pairs):
        chance = n * (n - 1) / 2 * float(np.prod(1 - differ[bits]))
        copies = max(0.0, agree - chance)
        sums = [1.0] + [0.0] * distance
        for b in bits:
            for k in range(distance, 0, -1):
                sums[k] += sums[k - 1] * differ[b] / (1 - differ[b])
        costs.append([n * sum(comb(len(bits), j) for j in range(t + 1)) + verify * (chance * sum(sums[: t + 1]) + copies * (t + 1)) for t in range(distance + 1)])
    return costs


def allocate_thresholds(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 that add up to distance - partitions + 1 with the least total cost, by dynamic programming."""
    target = distance - len(costs) + 1
    best = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                c = cost + (row[t] if t >= 0 else 0)
                if total + t not in new or c < new[total + t][0]:
                    new[total + t] = (c, [*chosen, t])
        best = new
    return best[target][1]


def flips(width: int, threshold: int) -> np.ndarray:
    """All masks of at most ``threshold`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(threshold + 1) for c in combinations(range(width), k)], np.uint64)


def near_fingerprints(distinct: DataFrame, distance: int = 3, partitions: int = 2, verify: float = 4.0) -> DataFrame:
    """Links (a, b), a < b, between the ``rep`` of fingerprints that differ by at most ``distance`` bits.

    ``distinct`` holds each fingerprint once: (fp, rep). Two partitions of 32 bits keep the candidates of a probe rare
    up to billions of fingerprints; more partitions probe less and meet more. Every link is found.
    """
    n, both = bit_statistics(distinct)
    groups = correlated_groups(n, both, partitions)
    costs = estimated_costs(n, both, groups, equal_pairs(distinct, groups), distance, verify)
    thresholds = allocate_thresholds(costs, distance)
    used = [(k, bits, flips(len(bits), t)) for k, (bits, t) in enumerate(zip(groups, thresholds)) if t >= 0]

    def rows(probe: bool):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    fp, rep = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                    for k, bits, masks in used:
                        value = partition_values(fp.view(np.uint64), bits)
                        value = (value[:, None] ^ masks).ravel() if probe else value
                        times = len(masks) if probe else 1
                        key = value * np.uint64(partitions) + np.uint64(k)
                        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, times)), pa.array(np.repeat(rep, times))], names=["key", "fp", "rep"])

        return run

    kind = "key long, fp long, rep long"
    index = distinct.select("fp", "rep").mapInArrow(rows(False), kind).toDF("key", "fp_a", "a")
    probes = distinct.select("fp", "rep").mapInArrow(rows(True), kind).toDF("key", "fp_b", "b")
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance
    return index.join(probes, (index["key"] == probes["key"]) & (F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, partitions: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Documents of one fingerprint are one node, the smallest doc_id among them, so copies cost no pairs. A null or empty
    text, or one of white space, has fingerprint zero and is linked like any other; rows with a null id keep a null
    component and link with nothing; repeated rows give repeated rows. An empty table gives no rows. Other columns of
    ``docs`` are not read, whatever their names.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    groups = connected_components(near_fingerprints(distinct, distance, partitions))
    named = distinct.join(groups, distinct["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def described(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp, n, sign, h1, h2): the fingerprint of each text, how many different shingles it has, their signature, and 128 bits of hash that stand for them."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t.as_py() for t in part.column(1)]
                sets = [shingle_dedup.shingle_codes(t, width) for t in texts]
                hashes = [np.array([xxhash.xxh64_intdigest(s.tobytes(), k) for s in sets], np.uint64).view(np.int64) for k in (1, 2)]
                prints = np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64)
                signs = pa.array([shingle_dedup.signature(s) for s in sets], pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), pa.array(prints), pa.array(list(map(len, sets)), pa.int64()), signs, *map(pa.array, hashes)], names=["doc_id", "fp", "n", "sign", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, n long, sign array<long>, h1 long, h2 long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = shingle_dedup.WIDTH, alike: tuple[int, int] = shingle_dedup.ALIKE, distance: int = 3, partitions: int = 2) -> DataFrame:
    """Near duplicates by similarity: doc_id, component_id (smallest doc_id reachable). Ids must be unique.

    Texts are linked if the Jaccard similarity of their shingles is ``alike`` or more. Fingerprints within ``distance``
    bits say where to look first, and each such pair is verified on its shingles. A similarity of 0.8 moves about 10 of 64
    bits, which no fingerprint search reaches at a cost below comparing all pairs; so the links that fingerprints cannot
    show are found by prefix filtering, among what they have not joined. No link is lost.

    Texts with the same shingles are one node, those without words too. Rows with a null id keep a null component and
    link with nothing. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = materialize(described(docs, id_col, text_col, width), "described")
    same = materialize(rows.filter("doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")), "same-shingles").withColumnRenamed("doc_id", "rep")
    reps = materialize(rows.filter("n > 0").join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "fp", "n", "sign"), "reps")
    signs = reps.select("rep", "n", "sign")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(reps.select("rep"), "rep", "left_semi")
    texts = materialize(texts, "texts")
    distinct = materialize(reps.groupBy("fp").agg(F.min("rep").alias("rep")), "distinct")
    equal = reps.join(distinct.withColumnRenamed("rep", "a"), "fp").filter("rep <> a").select("a", F.col("rep").alias("b"))
    close = near_fingerprints(distinct, distance, partitions).unionByName(equal)
    known = shingle_dedup.similar(close, texts, signs, width, alike)
    groups = connected_components(shingle_dedup.similar_texts(texts, signs, width, alike, known))
    named = same.join(groups, same["rep"] == groups["node"], "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    discard(texts, distinct, reps)
    rows = rows.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    return rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
