"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents stand in a seeded line, which is cut into blocks of equal numbers of words. The mix has as many blocks
as the corpus; Sainte-Lague gives each shard of it an integer quota of each source's blocks. A source's draws go
through all its blocks in a seeded order before any comes again, and fill its shards' quotas one after the other.
"""

from __future__ import annotations

import hashlib
import heapq
from fractions import Fraction
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import ROW_HASH, ROW_KEY, materialize, numbered
from .words import n_words, words

WEIGHTS = (5, 2, 1)
REPEATS = 3  # passes over a source at most
LEAST_BLOCK = 16  # words of a block at least
BLOCKS = 1 << 16  # blocks of a mix, about, where they have more words than that: what its shares are rounded to
SHARDS = 64


def capped_targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[Fraction]:
    """The sum of all sizes shared by weight; a share stops at ``repeats`` times its source, the excess goes round again."""
    targets = [Fraction(0)] * len(sizes)
    left, live = sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while live:
        total = sum(weights[i] for i in live)
        full = [i for i in live if Fraction(left * weights[i], total) > repeats * sizes[i]]
        if not full:
            for i in live:
                targets[i] = Fraction(left * weights[i], total)
            break
        for i in full:
            targets[i] = Fraction(repeats * sizes[i])
            left -= repeats * sizes[i]
        live = [i for i in live if i not in set(full)]
    return targets


def sainte_lague(votes: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """``seats`` to the highest quotients vote / (2 k + 1), ties to the earlier; nobody gets over ``most``.

    The seats whose quotients are above a divisor low enough are counted at once; a heap deals out the few left, so the
    work grows with the number of sources and not of seats.
    """
    n, total, got = len(votes), sum(votes), [0] * len(votes)
    if seats > n and total > 0:
        divisor = Fraction(total, 2 * (seats - n))
        got = [min(m, int((v / divisor + 1) / 2)) for v, m in zip(votes, most)]
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most)) if v > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *along: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *along)
    return materialize(rows, "sizes")


def block_words(total: int) -> int:
    """Words of a block for a corpus of ``total`` words."""
    return max(LEAST_BLOCK, -(-total // BLOCKS))


def seeded_step(seed: int, position: int, n: int) -> tuple[int, int]:
    """(step, first): block j of n is drawn as number (step * j + first) mod n of its source, a seeded order of all blocks."""
    digest = hashlib.md5(f"{seed}:{position}".encode()).hexdigest()
    step = int(digest[:7], 16) % n if n else 0
    while n and gcd(step, n) != 1:
        step += 1
    return step, int(digest[7:14], 16) % n if n else 0


def source_plan(sizes: DataFrame, seed: int, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, shards: int = SHARDS) -> DataFrame:
    """A row per source: source, source_size, target, block (words of one), blocks, step, first, shard_ends (draws made by each shard's end), draws.

    Sainte-Lague is house-monotone: the quotas of the first shards are a part of those of all, so each shard has an
    integer quota of blocks of each source that is near its target too.
    """
    # a row for each source: sources are the names of data sets, not of documents
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    total = [int(r["size"]) for r in rows]
    targets = capped_targets(total, [weights[i % len(weights)] for i in range(len(rows))], repeats)
    block = block_words(sum(total))
    blocks = [-(-s // block) for s in total]
    seats = -(-sum(total) // block)
    ends = [sainte_lague(targets, seats * (k + 1) // shards, [repeats * n for n in blocks]) for k in range(shards)]
    plan = [(r["source"], s, float(t), block, n, *seeded_step(seed, i, n), [e[i] for e in ends]) for i, (r, s, t, n) in enumerate(zip(rows, total, targets, blocks))]
    made = sizes.sparkSession.createDataFrame(plan, "source string, source_size long, target double, block long, blocks long, step long, first long, shard_ends array<bigint>")
    return made.withColumn("draws", F.element_at("shard_ends", -1))


def placed(sizes: DataFrame, seed: int, *along: str) -> DataFrame:
    """``sizes`` with ``start``: the words of the documents before it, in a seeded order of its source.

    The order is that of md5(seed:doc_id). Its first three hex digits deal each source to 4096 bins, whose sums are
    added up first, so no task holds a whole source.
    """
    keyed = sizes.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    keyed = keyed.withColumn("bin", F.substring("key", 1, 3))
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", *along).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = keyed.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    return joined.select("doc_id", "source", "size", *along, (F.col("before") + F.col("inside")).alias("start"))


def block_parts() -> Column:
    """The blocks that a document of ``size`` words from ``start`` on reaches into, in order: words of it before the block
    (from), words in it (n), draw (the number of the block's first draw)."""
    first, last = F.floor(F.col("start") / F.col("block")).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")).cast("long")

    def part(j: Column) -> Column:
        lo, hi = F.greatest(j * F.col("block"), F.col("start")), F.least((j + 1) * F.col("block"), F.col("start") + F.col("size"))
        return F.struct((lo - F.col("start")).alias("from"), (hi - lo).alias("n"), ((F.col("step") * j + F.col("first")) % F.col("blocks")).alias("draw"))

    none = F.array().cast("array<struct<from:bigint,n:bigint,draw:bigint>>")
    return F.when(F.col("size") > 0, F.transform(F.sequence(first, last), part)).otherwise(none)


def times(draw: Column) -> Column:
    """How often a block is taken: its draws are draw, draw + blocks, and so on, as far as the source's quotas go."""
    return F.when(F.col("draws") > draw, F.floor((F.col("draws") - draw - 1) / F.col("blocks")) + 1).otherwise(0).cast("long")


def mix(sizes: DataFrame, plan: DataFrame, seed: int, *along: str) -> DataFrame:
    """Per document: its columns, those of its source's plan, and parts, those of its blocks with how often each is taken."""
    joined = placed(sizes, seed, *along).join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the blocks are worked out once, and then looked at by their numbers of draws
    parts = F.flatten(F.transform(F.array(block_parts()), lambda held: F.transform(held, lambda p: F.struct(p["from"].alias("from"), p["n"].alias("n"), p["draw"].alias("draw"), times(p["draw"]).alias("times")))))
    return joined.withColumn("parts", parts)


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    Sources in code point order, null last, weigh 5, 2, 1, repeating. taken counts repeats; it is at most three times
    the size. A null or empty text has size 0 and is never taken; a source of such texts has target 0. Null ids and
    repeated rows are placed like others. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    sizes = sized(docs, id_col, text_col, source_col)
    mixed = mix(sizes, source_plan(sizes, seed), seed)
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"] * p["times"])
    return mixed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_slices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, along: tuple[str, ...] = ()) -> DataFrame:
    """What the mix is made of: doc_id, repeat (which pass over the source), first, n_words (words of the document), size, shard, and columns taken ``along``.

    In each pass the blocks of a document that are drawn and stand next to each other are one slice; its shard is that
    of its first block's draw. Columns taken along also order rows of one id and size.
    """
    sizes = sized(docs, id_col, text_col, source_col, *along)
    mixed = mix(sizes, source_plan(sizes, seed), seed, *along)
    most = F.coalesce(F.array_max(F.transform("parts", lambda p: p["times"])), F.lit(0).cast("long"))
    rows = mixed.filter(most > 0).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    slices = F.array().cast("array<struct<first:bigint,n:bigint,draw:bigint>>")

    def grow(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["first"].alias("first"), (last["n"] + p["n"]).alias("n"), last["draw"].alias("draw"))
        own = F.struct(p["from"].alias("first"), p["n"].alias("n"), p["draw"].alias("draw"))
        follows = F.coalesce(last["first"] + last["n"] == p["from"], F.lit(False))
        return F.when(p["times"] <= F.col("repeat"), acc).when(follows, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(own)))

    rows = rows.withColumn("slice", F.explode(F.aggregate("parts", slices, grow)))
    draw = F.col("slice.draw") + F.col("repeat") * F.col("blocks")
    shard = F.size(F.filter("shard_ends", lambda e: e <= draw)).cast("long")
    return rows.select("doc_id", "repeat", F.col("slice.first").alias("first"), F.col("slice.n").alias("n_words"), "size", shard.alias("shard"), *along)


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix as documents: whole ones where all their blocks are drawn, else their slices of drawn blocks.

    Each row is a document, whether its id is null or repeated, and comes as often as it is taken. Columns are those of
    ``docs``, whatever others there are; n_chars follows a cut text.
    """
    rows = numbered(docs, "mix-rows")
    narrow = rows.select("doc_id", "text", "source", ROW_HASH, ROW_KEY)
    slices = mixed_slices(narrow, seed=seed, along=(ROW_HASH, ROW_KEY)).select(F.col(ROW_KEY).alias("_of_row"), F.struct("first", "n_words", "size").alias("_slice"))
    joined = rows.join(slices, F.col(ROW_KEY) == F.col("_of_row"))
    part, n = F.col("_slice.first"), F.col("_slice.n_words")
    cut = n < F.col("_slice.size")
    text = F.when(cut, F.array_join(F.slice(words(F.col("text")), (part + 1).cast("int"), n.cast("int")), " ")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(cut, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
    return joined.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


#: The mix by SQL: seats are dealt one by one instead of by a divisor.
ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, pos) AS r FROM sources WHERE source_size > 0),
filling AS (
  SELECT *, (SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
         (SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER before, 0) AS weights
  FROM ranked WINDOW before AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest, weights FROM filling WHERE rest * w <= 3 * source_size * weights ORDER BY r LIMIT 1),
targets AS (
  SELECT s.source, s.source_size, s.pos,
         CASE WHEN s.source_size = 0 THEN 0.0
              WHEN 3 * s.source_size * l.weights < l.rest * s.w THEN (3 * s.source_size)::DOUBLE
              ELSE (l.rest * s.w)::DOUBLE / l.weights::DOUBLE END AS target
  FROM sources s LEFT JOIN level l ON true),
size_of AS (SELECT greatest(16, (sum(source_size) + 65535) // 65536)::BIGINT AS block, sum(source_size)::BIGINT AS total FROM sources),
quotients AS (
  SELECT source, pos, k, row_number() OVER (ORDER BY round(target / total / (2 * k + 1), 14) DESC, pos) AS seat
  FROM (SELECT source, pos, target, total, unnest(range(CAST(LEAST(3 * ((source_size + block - 1) // block), CEIL(target / block) + 40) AS BIGINT))) AS k FROM targets, size_of WHERE target > 0)),
quotas AS (
  SELECT pos, count(*) AS draws FROM quotients, size_of WHERE seat <= (total + block - 1) // block GROUP BY pos),
stepping AS (
  SELECT t.*, block, (t.source_size + block - 1) // block AS blocks, coalesce(q.draws, 0) AS draws,
         ('0x' || substr(md5('42:' || (t.pos - 1)), 1, 7))::BIGINT AS a, ('0x' || substr(md5('42:' || (t.pos - 1)), 8, 7))::BIGINT AS c
  FROM targets t LEFT JOIN quotas q USING (pos), size_of),
plan AS (
  SELECT *, a % greatest(blocks, 1) + (SELECT min(i) FROM range(1000) r(i) WHERE blocks = 0 OR gcd(a % greatest(blocks, 1) + i, blocks) = 1) AS step, c % greatest(blocks, 1) AS first FROM stepping),
line AS (
  SELECT d.*, p.* EXCLUDE (source),
         coalesce(sum(d.size) OVER (PARTITION BY p.pos ORDER BY md5('42:' || d.doc_id), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
parts AS (
  SELECT doc_id, start, size, block, blocks, draws, j, (step * j + first) % blocks AS draw
  FROM (SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS j FROM line WHERE size > 0)),
taken AS (
  SELECT doc_id, start, size, sum((least((j + 1) * block, start + size) - greatest(j * block, start)) * CASE WHEN draws > draw THEN (draws - draw - 1) // blocks + 1 ELSE 0 END)::BIGINT AS taken
  FROM parts GROUP BY ALL)
SELECT l.doc_id, l.source, l.size, l.source_size, l.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM line l LEFT JOIN taken t ON t.doc_id IS NOT DISTINCT FROM l.doc_id AND t.start = l.start AND t.size = l.size
"""
