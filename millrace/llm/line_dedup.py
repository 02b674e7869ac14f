"""Line dedup: lines within an edit bound of an earlier line of the corpus are removed, by a deletion-neighbourhood join.

Edits are of words. Two lines are alike if they are equal, or if one word replaced, added or left out makes one of the
other and that is a fifth of the longer line's words at most (a similarity of 0.8). Each line emits itself and all
variants with one word deleted as hashed keys; alike lines share a key:

- one replaced by another word: both lack the same word place, so they share a variant and its place;
- one word more: the shorter line is a variant of the longer one.

All lines that share a variant and its place are alike among each other, so the earliest line of each key is all that
needs keeping: those keys are aggregated, not paired. Of the other kind a line has no more pairs than words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .words import BLANK, BLANKS

LEAST_WORDS = 5  # of the longer of two lines that are alike but not equal: one edit in five is a similarity of 0.8


def lines_of(docs: DataFrame, id_col: str, text_col: str, *along: str) -> DataFrame:
    """(doc_id, place, line, and columns taken ``along``): all lines with a word, their words joined by one space; place is the line's number."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *along, F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("place", "line"))
    bare = F.btrim("line", F.lit(BLANK))
    even = F.when(bare.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(bare, BLANKS, " ")).otherwise(bare)
    return rows.select("doc_id", *along, "place", even.alias("line")).filter("line <> ''")


def at(doc: str = "doc_id", place: str = "place") -> Column:
    """Where a line stands, to be compared: by document, then by place in it."""
    return F.struct(F.col(doc).alias("doc_id"), F.col(place).alias("place"))


def edge_keys() -> Column:
    """Keys of a line's first and last k words: of two alike lines either the first or the last k words are equal.

    k is the highest power of two that is at most half the line's words; a line that one with a word less may have
    the lower power of gives keys for both.
    """
    # spaces stand between words only
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    half = F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 2)
    edge = lambda size: F.call_function("substring_index", F.col("line"), F.lit(" "), size)
    keys = lambda k: [F.xxhash64(F.lit(0), k, edge(k)), F.xxhash64(F.lit(1), k, edge(-k))]
    none = F.array().cast("array<bigint>")
    return F.when(n < LEAST_WORDS - 1, none).when((n == 2 * half) & (n >= LEAST_WORDS), F.array(*keys(half), *keys(F.shiftright(half, 1)))).otherwise(F.array(*keys(half)))


def with_variants(rows: DataFrame) -> DataFrame:
    """Adds to lines with ``codes``: whole (key of the line), placed (keys of the line without each word, and of the place), bare (without the place).

    A line's hash is the exclusive or of hashes of its neighbouring words, so that a word is taken out at once: two
    pairs of neighbours go and one comes, whatever the length. What meets by such a hash is verified on the words.
    """
    pair = lambda a, b: F.xxhash64(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(1)))
    xor = lambda a, b: a.bitwiseXOR(b)
    word = lambda i: F.get("codes", i)
    rows = rows.select("*", F.size("codes").alias("n"), F.transform("codes", lambda c, i: pair(c, word(i + 1))).alias("pairs"))
    rows = rows.select("*", F.aggregate("pairs", pair(F.lit(None).cast("long"), word(F.lit(0))), xor).alias("all"))
    # get() gives null before the first and after the last word
    before = lambda i: F.when(i > 0, word(i - 1))
    out = F.transform("codes", lambda c, i: xor(xor(xor(F.col("all"), pair(before(i), c)), F.get("pairs", i)), pair(before(i), word(i + 1))))
    # a line too short to be the longer of two that are alike has no variants
    rows = rows.select("*", F.when(F.col("n") >= LEAST_WORDS, out).otherwise(F.array().cast("array<bigint>")).alias("less"))
    return rows.select(
        "doc_id", "place", "codes", F.xxhash64("all", "n").alias("whole"),
        F.transform("less", lambda h, i: F.xxhash64(h, F.col("n"), i)).alias("placed"),
        F.array_distinct(F.transform("less", lambda h: F.xxhash64(h, F.col("n") - 1))).alias("bare"),
    )


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays differ by one element replaced, added or left out, or not at all.

    They do if what they have in common at the start and at the end leaves at most one of either.
    """
    same = lambda x, y: F.coalesce(
        F.element_at(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.size(y))), lambda i: F.when(F.get(x, i - 1).eqNullSafe(F.get(y, i - 1)), F.lit(None).cast("int")).otherwise(i - 1)), lambda v: v.isNotNull()), 1),
        F.greatest(F.size(x), F.size(y)),
    )
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return (longer >= LEAST_WORDS) & (longer - shorter <= 1) & (same(a, b) + same(F.reverse(a), F.reverse(b)) >= longer - 1)


def near_lines(texts: DataFrame) -> DataFrame:
    """The lines at ``places`` of each text, as hashes of their words, with the keys of their variants."""
    # the text is split once, whatever the number of places
    wanted = F.flatten(F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.transform("places", lambda p: F.struct(p.alias("place"), F.get(lines, p).alias("line")))))
    rows = texts.select("doc_id", F.explode(wanted).alias("x")).select("doc_id", "x.place", F.btrim("x.line", F.lit(BLANK)).alias("line"))
    return with_variants(rows.select("doc_id", "place", F.transform(F.split("line", BLANKS, -1), lambda w: F.xxhash64(w)).alias("codes")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place) of every line that equals, or is one word edit from, a line that stands earlier in the corpus."""
    docs = docs.filter(F.col(id_col).isNotNull())
    lines = lines_of(docs, id_col, text_col)
    # equal lines: 128 bits of hash stand for a line; one row per distinct line goes on, where it stands first
    placed = lines.select(F.struct(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")).alias("line"), "doc_id", "place", edge_keys().alias("edges"))
    placed = materialize(placed, "lines")
    first = placed.groupBy("line").agg(F.min(F.struct("doc_id", "place", "edges")).alias("first"), F.count("*").alias("n"))
    first = materialize(first.select("line", "first.doc_id", "first.place", "n", "first.edges"), "first-lines")

    # lines that share neither edge with another have none alike; only for the others are words looked at again
    edges = first.select("doc_id", "place", F.explode("edges").alias("edge"))
    shared = edges.groupBy("edge").agg(F.count("*").alias("n")).filter("n > 1").select("edge")
    alive = edges.join(shared, "edge", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(alive, "doc_id")
    long = materialize(near_lines(texts), "near-lines")

    # one word more: a line without one of its words is another line
    whole = long.select(F.col("whole").alias("key"), F.col("doc_id").alias("d"), F.col("place").alias("p"))
    bare = long.select("doc_id", "place", F.explode("bare").alias("key"))
    longer = bare.join(whole, "key").select("doc_id", "place", "d", "p").filter((F.col("doc_id") != F.col("d")) | (F.col("place") != F.col("p")))
    later = at() > at("d", "p")
    pick = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
    longer = materialize(longer.select(pick("doc_id", "d").alias("doc_id"), pick("place", "p").alias("place"), pick("d", "doc_id").alias("d"), pick("p", "place").alias("p")), "one-more")
    # one replaced: all lines that share a variant and its place are alike, so the earliest of them will do
    placed_keys = long.select("doc_id", "place", F.explode("placed").alias("key"))
    best = placed_keys.groupBy("key").agg(F.min(at()).alias("best"), F.count("*").alias("n")).filter("n > 1").select("key", "best")
    replaced = placed_keys.join(best, "key").filter(F.col("best") < at()).select("doc_id", "place", F.col("best.doc_id").alias("d"), F.col("best.place").alias("p")).distinct()
    # verify: the words of both
    mine = long.select("doc_id", "place", "codes")
    theirs = long.select(F.col("doc_id").alias("d"), F.col("place").alias("p"), F.col("codes").alias("codes2"))
    replaced = materialize(replaced, "one-replaced")
    met = longer.unionByName(replaced).join(mine, ["doc_id", "place"]).join(theirs, ["d", "p"])
    near = met.filter(one_edit(F.col("codes"), F.col("codes2"))).select("doc_id", "place").distinct()

    # an equal line that stands later goes with the first; one that is near an earlier line takes all its equals along.
    # told, written, has a row for each line: its join with all places is then one that Spark can split where a line is common
    near = first.join(near, ["doc_id", "place"], "left_semi").select("line", F.lit(True).alias("near"))
    told = first.join(near, "line", "left").filter("n > 1 OR near").select("line", F.col("doc_id").alias("d"), F.col("place").alias("p"), "near")
    told = materialize(told, "told")
    discard(first, long, longer, replaced)
    gone = placed.select("line", "doc_id", "place").join(told, "line")
    return gone.filter(F.coalesce("near", F.lit(False)) | (F.col("doc_id") != F.col("d")) | (F.col("place") != F.col("p"))).select("doc_id", "place")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (without the removed lines), n_lines, n_removed, changed.

    A line goes if an earlier one of the corpus (by doc_id, then by place) equals it, or is one word edit away where the
    longer of the two has LEAST_WORDS words or more; lines are whole, however long, and are judged on the input. Words
    are runs of other than ASCII white space, compared as they are. Lines without a word stay. A text that loses nothing
    is left as it is; null stays null. Rows with a null id lose nothing; rows that repeat an id share what is removed.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    gone = repeated_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_set("place").alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(gone, "doc_id", "left")
    # split once, then read by the places that stay
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    new = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))[0]
    breaks = F.octet_length("text") - F.octet_length(F.translate("text", "\n", ""))
    return rows.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(new).alias("text"),
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.col("gone").isNotNull().alias("changed"),
    )
