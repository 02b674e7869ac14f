"""Pairs of texts by the Jaccard similarity of word shingles: every pair at or above a threshold is found, by prefix filtering.

All shingles are put in one order, rare ones first. Two sets of similarity s or more have a shingle in common among the
first n - ceil(s n) + 1 of either, n being the set's size, so only these are indexed, and each pair that meets is
verified on its whole sets. The order need only be the same for all texts: it is by the number of shingles in a
shingle's bin, then by hash. Sets are made from the texts again wherever they are looked at, as they take more room than these.

A large group of near copies shares its shingles, and would be compared in pairs. So the members of a shingle are first
compared with one of them; links found join components, and only members of different components are then compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard, materialize

WIDTH = 5  # words in a shingle
ALIKE = (4, 5)  # texts are near duplicates from this Jaccard similarity on
BINS = 1 << 18
SIGN_BITS = 1024  # of a set's signature


def shingle_codes(text: str | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The different XXH64 hashes of a text's word shingles; words and letters as in ``simhash.simhash``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    shingles = [words] if len(words) < width else zip(*(words[i:] for i in range(width)))
    return np.unique(np.array([digest(b" ".join(s), seed) for s in shingles], np.uint64))


def signature(codes: np.ndarray) -> np.ndarray:
    """For each of SIGN_BITS bins whether an odd number of shingles falls in it, as 64-bit numbers."""
    odd = np.bincount(((codes >> np.uint64(20)) % np.uint64(SIGN_BITS)).astype(np.int64), minlength=SIGN_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bin_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles of (rep, text) fall in each bin; BINS numbers reach the driver, whatever the input."""

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount((shingle_codes(text.as_py(), width) % np.uint64(BINS)).astype(np.int64), minlength=BINS) if text.is_valid else 0
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bin", "n"])

    rows = texts.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS, np.int64)
    out[rows.column("bin").to_numpy()] = rows.column("n").to_numpy()
    return out


def prefixes(texts: DataFrame, counts: np.ndarray, width: int, alike: tuple[int, int]) -> DataFrame:
    """(key, rep, n): the shingles of each text that one as similar as ``alike`` cannot miss all of; n is how many it has."""
    num, den = alike

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keys, sizes, reps = [], [], part.column(0).to_numpy()
                for text in part.column(1):
                    own = shingle_codes(text.as_py(), width)
                    n = len(own)
                    order = np.lexsort((own, counts[(own % np.uint64(BINS)).astype(np.int64)]))
                    keys.append(own[order[: n - -(-num * n // den) + 1]])
                    sizes.append(n)
                many = list(map(len, keys))
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(reps, many)), pa.array(np.repeat(np.array(sizes, np.int64), many))], names=["key", "rep", "n"])

    return texts.select("rep", "text").mapInArrow(run, "key long, rep long, n long")


def may_be_similar(pairs: DataFrame, signs: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) but those whose signatures rule them out: these differ in no more bits than the sets in shingles."""
    num, den = alike
    mine, theirs = signs.toDF("a", "n", "x"), signs.toDF("b", "m", "y")
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, k: a + k)
    return pairs.join(mine, "a").join(theirs, "b").filter((den + num) * differ <= (den - num) * (F.col("n") + F.col("m"))).select("a", "b")


def similar(pairs: DataFrame, texts: DataFrame, signs: DataFrame, width: int, alike: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b), written, whose texts' Jaccard similarity is ``alike`` or more; ``signs`` has (rep, n, sign) of each text."""
    num, den = alike

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_codes(t.as_py(), width) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["rep", "codes"])

    # sets are made only for the texts that are in a pair
    pairs = materialize(may_be_similar(pairs, signs, alike), "pairs")
    met = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = materialize(texts.join(met, "rep", "left_semi").select("rep", "text").mapInArrow(run, "rep long, codes array<long>"), "met-sets")
    joined = pairs.join(sets.select(F.col("rep").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("codes").alias("y")), "b")
    joined = joined.select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("common"))
    links = materialize(joined.filter((den + num) * F.col("common") >= num * F.col("both")).select("a", "b"), "similar")
    discard(pairs, sets)
    return links


def size_fits(n: Column, m: Column, alike: tuple[int, int]) -> Column:
    """Whether sets of these sizes can be as similar as ``alike``."""
    return alike[1] * F.least(n, m) >= alike[0] * F.greatest(n, m)


def similar_texts(texts: DataFrame, signs: DataFrame, width: int = WIDTH, alike: tuple[int, int] = ALIKE, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of texts (rep, text), each with a word and one of ``signs``, as similar as ``alike``.

    ``known`` links (a, b) are taken as they are; what they join is not compared again.
    """
    found = materialize(prefixes(texts, bin_counts(texts, width), width, alike), "prefixes")
    shared = found.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    met = materialize(found.join(shared, "key", "left_semi"), "postings")
    discard(found)
    links = met.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0) if known is None else known

    def joined(links: DataFrame) -> DataFrame:
        """Postings of shingles that stand in several components, with c, the component."""
        groups = connected_components(links).withColumnRenamed("node", "rep")
        placed = met.join(groups, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
        apart = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
        return materialize(placed.join(apart, "key", "left_semi"), "apart")

    # each member of a shingle with its first one
    placed = joined(links)
    hubs = placed.groupBy("key").agg(F.min(F.struct("rep", "n", "c")).alias("hub"))
    star = placed.join(hubs, "key").filter((F.col("c") != F.col("hub.c")) & size_fits(F.col("n"), F.col("hub.n"), alike))
    links = materialize(links.unionByName(similar(star.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct(), texts, signs, width, alike)), "links-so-far")
    discard(placed)
    # then all that are not joined yet
    placed = joined(links)
    other = placed.toDF("key", "b", "m", "d")
    pairs = placed.join(other, "key").filter((F.col("c") < F.col("d")) & size_fits(F.col("n"), F.col("m"), alike)).select(F.col("rep").alias("a"), "b").distinct()
    more = similar(pairs, texts, signs, width, alike)
    discard(placed, met)
    return links.unionByName(more)
