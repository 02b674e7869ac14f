"""Personal data: spans by pattern, and information-theoretic sanitisation of the terms that give them away.

A protected entity is the value of a base span. A term reveals it by what the corpus shows of the two: of the documents
with the term a share holds the entity too. The lower bound of that share, at a fixed confidence and from the number of different
texts that show it, says how many bits of the entity are left to guess, at most. Where few are left, and knowing the term was a
gain at all, the term becomes a span too, in the documents that hold the entity. What a bound rests on are counts of the
term and of the entity, so a document has the same spans however large the corpus around it is.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .words import BLANK, BLANKS

# Kinds in their order, and their patterns. The patterns are written so that Java's matcher neither recurses
# nor tries a run of characters again from each of its places; they match what the plain ones match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))(?:\.|$)){4}$"
WORD = r"[^\x20\x09-\x0D]+"

LEFT = 1.0  # bits of an entity that a term may leave to guess if it is to count as giving it away
GAIN = 1.0  # bits that knowing the term has to be worth, as against the entity's share of all documents
CONFIDENCE = 1.96  # standard deviations of the lower bound of a share
SMALL_TERMS = 1_000_000  # terms, 8 bytes each, that go to all tasks


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn sum."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]+", "")).between(10, 15)
    return F.lit(True)


def matches(kind: str, text: Column) -> Column:
    """Valid matches of a kind as structs (start, rank, end, value), in code points, end exclusive.

    Matches and the stretches between them alternate, so their lengths add up to where each match starts.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    shape = "array<struct<start:int,rank:int,end:int,value:string>>"
    none = F.array().cast(shape)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(valid(kind, x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, base, text, h1, h2): base spans of each whole text by start, then kind; the text's hashes where there are any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.col(text_col).isNull().alias("blank"))
    rows = rows.select("doc_id", "text", "blank", *(matches(k, F.col("text")).alias(k) for k in KINDS))
    rows = rows.select("doc_id", F.when(~F.col("blank"), F.col("text")).alias("text"), F.array_sort(F.concat(*KINDS)).alias("base"))
    held = F.size("base") > 0
    return rows.select("doc_id", "base", "text", F.when(held, F.xxhash64("text")).alias("h1"), F.when(held, F.xxhash64(F.lit(7), "text")).alias("h2"))


def term_codes(text: Column) -> Column:
    """Hashes of the different words of a text."""
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.split(bare, BLANKS), lambda w: F.xxhash64(w))))


def distinct_texts(found: DataFrame) -> DataFrame:
    """(h1, h2, n, base, text, entities, terms): each text with a base span once, and how many documents have it."""
    held = found.filter(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("base").alias("base"), F.first("text").alias("text"))
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["rank"], F.lower(s["value"]))))
    return held.select("*", entities.alias("entities"), term_codes(F.col("text")).alias("terms"))


def lower_share(share: Column, trials: Column, z: float) -> Column:
    """The lower end of the score interval of a share that was seen in some trials."""
    return (share + z * z / (2 * trials) - z * F.sqrt(share * (1 - share) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)


def least_texts(left: float, z: float) -> int:
    """How many different texts have to show a share of one for its lower bound, n / (n + z^2), to leave ``left`` bits at most."""
    share = 2.0**-left
    return ceil(share * z * z / (1 - share) - 1e-9)


def disclosing_terms(docs: DataFrame, texts: DataFrame, text_col: str, left: float, gain: float, z: float) -> DataFrame:
    """(entity, term): terms, as hashes of words, that give an entity away.

    Of n(t) documents with a term n(e, t) hold the entity, in s different texts. Copies of a text show a share no better than
    the text does, so the share n(e, t) / n(t) counts as seen in s n(t) / n(e, t) trials. Let p be its lower bound:
    -log2 p is at most ``left``, and log2(p N / n(e)) at least ``gain``, of N documents n(e) with the entity. Both need
    ``least_texts`` of an entity and of a term beside it, and n(t) of n(e) 2^left at most; what falls short is left out before
    entities meet terms. Within that, entities and terms of any count are looked at, over the whole corpus.
    """
    total, least, share = docs.count(), least_texts(left, z), 2.0**-left
    each = texts.select("h1", "h2", "n", F.explode("entities").alias("entity"))
    known = each.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("s_e")).filter((F.col("s_e") >= least) & (F.col("n_e") * 2.0**gain <= total)).drop("s_e")
    held = materialize(each.join(known, "entity"), "known-entities")
    beside = texts.join(held.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", F.explode("terms").alias("term"))
    often = materialize(beside.groupBy("term").agg(F.count("*").alias("s_t")).filter(F.col("s_t") >= least).select("term"), "terms-beside")
    few = F.broadcast(often) if often.count() <= SMALL_TERMS else often
    words = docs.select(F.explode(term_codes(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term"))
    counts = materialize(words.join(few, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t")), "term-counts")
    met = held.join(beside.join(counts, "term"), ["h1", "h2"]).filter(F.col("n_t") * share <= F.col("n_e"))
    pairs = met.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("s_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    seen = F.col("n_et") / F.col("n_t")
    pairs = pairs.withColumn("p", lower_share(seen, F.col("s_et") / seen, z))
    return pairs.filter((F.col("p") >= share - 1e-12) & (F.col("p") * total >= F.col("n_e") * 2.0**gain)).select("entity", "term")


def term_spans(texts: DataFrame, told: DataFrame) -> DataFrame:
    """(h1, h2, terms): spans of the words of each text that give away an entity of it and touch no base span."""
    wanted = texts.select("h1", "h2", F.explode("entities").alias("entity")).join(told, "entity").select("h1", "h2", "term").distinct()
    some = texts.join(wanted.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    gaps = F.split("text", WORD, -1)
    rows = some.select("h1", "h2", "base", F.posexplode(F.zip_with(words, F.slice(gaps, 1, F.size(words)), lambda w, g: F.struct(w.alias("word"), g.alias("gap")))).alias("i", "x"))
    along = Window.partitionBy("h1", "h2").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.char_length("x.gap") + F.char_length("x.word")).over(along).cast("int")
    kind = F.when(F.col("x.word").rlike("[0-9]"), "NUMBER").when(F.col("x.word").rlike(r"^\P{L}*\p{Lu}"), "NAME").otherwise("")
    rows = rows.select("h1", "h2", "base", F.xxhash64("x.word").alias("term"), F.char_length("x.word").alias("n"), end.alias("end"), kind.alias("kind"))
    rows = rows.join(wanted, ["h1", "h2", "term"]).withColumn("start", F.col("end") - F.col("n"))
    free = ~F.exists("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.col("kind").alias("value"))
    return rows.filter(free).groupBy("h1", "h2").agg(F.array_sort(F.collect_set(span)).alias("terms"))


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """A text with its base spans generalised to their kinds in brackets, its terms to [NAME] or [NUMBER] where their form says so, other terms removed.

    Where spans overlap, the one that starts first is taken and the others add what they reach beyond it. Each stretch
    between two spans is looked up by its place in code points.
    """
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        term = F.when(s["value"] != "", F.concat(F.lit("["), s["value"], F.lit("]"))).otherwise("")
        mark = F.when(s["start"] < acc["at"], "").when(s["rank"] == len(KINDS), term).otherwise(F.element_at(marks, s["rank"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap, mark)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, new).otherwise(text)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: float = LEFT, gain: float = GAIN, z: float = CONFIDENCE) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, clean_text.

    spans lists all spans as kind:start:end by start, then kind (email, ip, card, phone, term); base_sha256 is the
    SHA-256 of the list of those found by pattern. Places are code points, ends exclusive. clean_text is the text with
    its base spans generalised to their kinds, its terms to [NAME] (a capital first), [NUMBER] (with a digit) or removed. ``left``,
    ``gain`` and ``z`` say when a term gives an entity away (``disclosing_terms``); an entity that fewer than ``least_texts``
    different texts hold has no terms, as nothing can be told of it with that confidence. A document without a base
    span has none at all, and its text as it is. A null text counts as empty and stays null. A row's spans are those of its own text, whether its
    id is null or repeated. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    found = materialize(base_spans(docs, id_col, text_col), "base-spans")
    texts = materialize(distinct_texts(found), "private-texts")
    told = materialize(disclosing_terms(docs, texts, text_col, left, gain, z), "disclosing")
    bare = found.select("doc_id", "base", "text", "h1", "h2")
    # rows without a base span need no join
    held = bare.filter("h1 IS NOT NULL").join(term_spans(texts, told), ["h1", "h2"], "left").drop("h1", "h2")
    rows = held.unionByName(bare.filter("h1 IS NULL").drop("h1", "h2"), allowMissingColumns=True)
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")))))
    rows = rows.withColumn("every", every)
    return rows.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), sanitised(F.col("text"), F.col("every")).alias("clean_text"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text): the clean texts of ``find``, one row for each row."""
    return find(docs, id_col, text_col, **options).select("doc_id", F.col("clean_text").alias("text"))
