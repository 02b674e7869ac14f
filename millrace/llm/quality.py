"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .words import BLANK, BLANKS

SYMBOLS = "#*$%&|<>"
WINDOW = 5
ROUNDS = 50
PRIOR_GOOD = 0.9  # the share of good documents that the search begins with and is smoothed towards
KEEP = 0.5

#: P(vote | bad), P(vote | good) that a rule starts from and is smoothed towards.
START = {-1: (0.3, 0.03), 1: (0.2, 0.8)}


def votes() -> dict[str, Column]:
    """Each rule's vote: -1 for a bad document, 1 for a good one, 0 to abstain."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def vote(bad: Column, good: Column = F.lit(False)) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "letters": vote(F.col("n_letters") < 0.88 * chars, F.col("n_letters") >= 0.94 * chars),
        "symbols": vote(F.col("n_symbols") > 0.1 * n),
        "upper": vote(F.col("n_upper") > 0.3 * chars),
        "marks": vote(F.col("n_marks") > 0.1 * n),
        "distinct": vote((F.col("n_words") >= 20) & (F.col("n_distinct") < 0.2 * n)),
        "runs": vote(F.col("n_runs") > 0.1 * n),
        "lines": vote(F.col("n_dup_lines") > 0.5 * F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": vote(100 * F.col("n_repeat_words") > 15 * n),
    }


def covered_words(hashes: Column, width: int) -> Column:
    """Words in windows whose hash stands twice or more in ``hashes``, one for each window start.

    Windows are sorted by hash and place; one is repeated if it equals a neighbour. The repeated starts, in order, each
    add the words that the one before has not covered.
    """
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(
        F.aggregate(
            F.array_sort(
                F.flatten(
                    F.transform(
                        F.map_values(
                            F.map_from_entries(F.array(F.struct(F.lit(0).alias("k"), F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("v"))))
                        ),
                        lambda s: F.transform(
                            F.filter(
                                F.arrays_zip(s.alias("c"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s).alias("p"), F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("n")),
                                lambda z: F.coalesce(z["c"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["c"]["h"] == z["n"]["h"], F.lit(False)),
                            ),
                            lambda z: z["c"]["i"],
                        ),
                    )
                )
            ),
            F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )
    )


def features(docs: DataFrame, id_col: str, text_col: str, *along: str) -> DataFrame:
    """Counts over each whole text, and columns taken ``along``; a null text has none of anything."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.translate(text, BLANK, "").alias("solid"), *along)
    rows = rows.withColumn("bare", F.btrim("text", F.lit(BLANK)))
    rows = rows.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", BLANKS)))
    rows = rows.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    code = lambda i, k: F.element_at("codes", i + k)
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(*(code(i, k) for k in range(WINDOW)))))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    rows = rows.withColumn("lines", lines)
    same = F.filter(F.transform("codes", lambda c, i: (i > 0) & (F.get("codes", i - 1) == c)), lambda x: x)
    long = lambda c: c.cast("long")
    return rows.select(
        "doc_id", *along,
        long(n).alias("n_words"),
        long(F.char_length("solid")).alias("word_chars"),
        long(F.char_length("solid") - F.char_length(F.translate("solid", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(covered_words(F.col("windows"), WINDOW)).alias("n_repeat_words"),
        long(F.char_length(F.regexp_replace("solid", r"\P{Lu}+", ""))).alias("n_upper"),
        long(F.char_length("solid") - F.char_length(F.regexp_replace("solid", r"[\p{L}\p{N}]+", ""))).alias("n_letters"),
        long(F.char_length("solid") - F.char_length(F.translate("solid", "!?", ""))).alias("n_marks"),
        long(F.size(F.array_distinct("codes"))).alias("n_distinct"),
        long(F.size(same)).alias("n_runs"),
    )


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """EM over counted vote patterns: the log odds that a document is good, and those that each vote of each rule adds.

    Rules are taken to be independent given the class. A rule's chances of each vote are estimated for either class,
    smoothed towards START; an abstention adds nothing, and no rule may come to vote the other way round.
    """
    total, rules = sum(c for _, c in patterns), len(patterns[0][0]) if patterns else 0
    good, smooth = PRIOR_GOOD, 1 + 0.005 * total
    odds = [{0: 0.0} | {v: log(g / b) for v, (b, g) in START.items()} for _ in range(rules)]
    for _ in range(rounds):
        base = log(good / (1 - good))
        post = [1 / (1 + exp(-max(-500.0, min(500.0, base + sum(o[v] for o, v in zip(odds, p)))))) for p, _ in patterns]
        n_good = sum(q * c for q, (_, c) in zip(post, patterns))
        good = min(max((n_good + PRIOR_GOOD * smooth) / (total + smooth), 0.05), 0.95)
        for j in range(rules):
            for v, (start_bad, start_good) in START.items():
                in_good = sum(q * c for q, (p, c) in zip(post, patterns) if p[j] == v)
                in_bad = sum((1 - q) * c for q, (p, c) in zip(post, patterns) if p[j] == v)
                ratio = log((in_good + start_good * smooth) / (n_good + smooth)) - log((in_bad + start_bad * smooth) / (total - n_good + smooth))
                odds[j][v] = max(0.0, ratio) if v > 0 else min(0.0, ratio)
    return log(good / (1 - good)), odds


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, along: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, p_good (posterior), kept, and columns taken ``along``.

    base_failed: fewer than 10 words, or over 20 in 100 words in repeated five-word windows. kept: not base_failed and
    p_good >= keep. Rules vote by the counts; how far each vote is trusted is estimated from all documents that pass the
    base rules, grouped by their votes (3 to the number of rules groups at most, whatever the input).

    A null or empty text has no words and fails. Null and repeated ids are kept as they are. Other columns of ``docs``
    are not read. An empty table gives no rows.
    """
    counts = materialize(features(docs, id_col, text_col, *along), "quality")
    rules = votes()
    voted = counts.select("*", *(v.alias(f"vote_{k}") for k, v in rules.items()))
    names = [f"vote_{k}" for k in rules]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    seen = voted.filter(~failed).groupBy(*names).count().collect()
    base, odds = fit([(tuple(r[c] for c in names), r["count"]) for r in sorted(seen, key=lambda r: tuple(r[c] for c in names))])
    score = F.lit(base)
    for name, o in zip(names, odds):
        score = score + F.when(F.col(name) == 1, o[1]).when(F.col(name) == -1, o[-1]).otherwise(0.0)
    p_good = 1 / (1 + F.exp(-score))
    rows = voted.withColumn("p_good", p_good).withColumn("base_failed", failed)
    return rows.select(
        "doc_id", *along, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("p_good") >= keep)).alias("kept"), "p_good",
    )
