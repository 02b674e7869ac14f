"""Divergences of two distributions given as arrays of logits, and learning-rate schedules, as columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    shifted = let(F.transform(logits, lambda x: x.cast("double") / temperature), lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: x - top)))
    return let(shifted, lambda v: let(F.log(total(F.transform(v, F.exp))), lambda rest: F.transform(v, lambda x: x - rest)))


def kl(p: Column, q: Column) -> Column:
    """Sum of exp(p) (p - q) over log-probabilities."""
    return total(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)))


def divergence(student: Column, teacher: Column, kind: str) -> Column:
    """reverse_kl is student against teacher, forward_kl the other way, jsd the mean of both against their mixture."""
    if kind == "reverse_kl":
        return kl(student, teacher)
    if kind == "forward_kl":
        return kl(teacher, student)
    middle = F.zip_with(student, teacher, lambda a, b: F.log((F.exp(a) + F.exp(b)) / 2))
    return (kl(student, middle) + kl(teacher, middle)) / 2


def top_with_tail(log_probs: Column, k: int) -> Column:
    """The k highest log-probabilities and that of all the rest."""
    top = F.slice(F.sort_array(log_probs, asc=False), 1, k)
    return F.concat(top, F.array(F.log(F.greatest(1 - total(F.transform(top, F.exp)), F.lit(1e-12)))))


def lr_scale(kind: str, step: Column, warmup: int, steps: int, cycles: float = 0.5, power: float = 1.0) -> Column:
    """The factor of the learning rate: linear warm-up, then constant, linear, cosine, polynomial or inverse square root."""
    s = step.cast("double")
    gone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - warmup) / float(max(1, steps - warmup))))
    after = {
        "constant": F.lit(1.0), "linear": 1 - gone, "cosine": F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(pi * 2 * cycles) * gone))),
        "cosine_restarts": F.when(gone >= 1, 0.0).otherwise(0.5 * (1 + F.cos(F.lit(pi) * ((cycles * gone) % 1.0)))), "polynomial": F.pow(1 - gone, power), "inverse_sqrt": F.sqrt(F.lit(float(max(1, warmup))) / F.greatest(s, F.lit(1.0))),
    }[kind]
    return F.when(s < warmup, s / float(max(1, warmup))).otherwise(after)


def chunk_state(student: Column, teacher: Column, temperature: float) -> Column:
    """What one chunk of two rows of logits adds to a divergence, as a struct: for either side its highest logit m, the sum of exp(x - m), and that
    sum weighted by the difference to the other side, all of logits over the temperature."""
    x, y = (F.transform(v, lambda z: z.cast("double") / temperature) for v in (student, teacher))

    def side(a: Column, b: Column) -> Column:
        return let(F.array_max(a), lambda m: F.struct(
            m.alias("m"), total(F.transform(a, lambda z: F.exp(z - m))).alias("mass"), total(F.zip_with(a, b, lambda z, w: F.exp(z - m) * (z - w))).alias("gap")))

    return let(F.struct(x.alias("x"), y.alias("y")), lambda v: F.struct(side(v["x"], v["y"]).alias("s"), side(v["y"], v["x"]).alias("t")))


def merged_side(states: Column, name: str) -> Column:
    """struct(log_sum, gap) of one side over all chunks: the logarithm of the sum of exp, and the mean difference to the other side."""
    top = F.array_max(F.transform(states, lambda c: c[name]["m"]))
    return let(top, lambda m: let(
        F.aggregate(states, F.struct(F.lit(0.0).alias("mass"), F.lit(0.0).alias("gap")), lambda a, c: F.struct((a["mass"] + c[name]["mass"] * F.exp(c[name]["m"] - m)).alias("mass"), (a["gap"] + c[name]["gap"] * F.exp(c[name]["m"] - m)).alias("gap"))),
        lambda a: F.struct((F.log(a["mass"]) + m).alias("log_sum"), (a["gap"] / a["mass"]).alias("gap"))))


def chunked_divergences(chunks: DataFrame, keys: list[str], student: str, teacher: str, temperature: float = 1.0) -> DataFrame:
    """(keys, reverse_kl, forward_kl, jsd) of positions whose logits over the vocabulary come in chunks, a row each.

    A chunk's state is six numbers, and those of a position's chunks merge in any order, so for both KL no logits are shuffled: with
    log p = x - log_sum, the sum of p (log p - log q) is the mean difference of logits less the difference of the log_sums. The middle
    distribution of jsd needs both log_sums first, and so a second look at the chunks.
    """
    states = chunks.select(*keys, chunk_state(F.col(student), F.col(teacher), temperature).alias("c")).groupBy(*keys).agg(F.collect_list("c").alias("c"))
    rows = states.select(*keys, merged_side(F.col("c"), "s").alias("s"), merged_side(F.col("c"), "t").alias("t"))
    apart = F.col("s.log_sum") - F.col("t.log_sum")
    rows = rows.select(*keys, (F.col("s.gap") - apart).alias("reverse_kl"), (F.col("t.gap") + apart).alias("forward_kl"), F.col("s.log_sum").alias("_s"), F.col("t.log_sum").alias("_t"))
    pairs = F.zip_with(student, teacher, lambda a, b: F.struct((a.cast("double") / temperature - F.col("_s")).alias("p"), (b.cast("double") / temperature - F.col("_t")).alias("q")))

    def of_pair(v: Column) -> Column:
        # the logarithm of the mean of exp(p) and exp(q), from the larger of the two
        top = F.greatest(v["p"], v["q"])
        middle = top + F.log((F.exp(v["p"] - top) + F.exp(v["q"] - top)) / 2)
        return (F.exp(v["p"]) * (v["p"] - middle) + F.exp(v["q"]) * (v["q"] - middle)) / 2

    jsd = chunks.join(rows.select(*keys, "_s", "_t"), keys).groupBy(*keys).agg(F.sum(total(F.transform(pairs, of_pair))).alias("jsd"))
    return rows.drop("_s", "_t").join(jsd, keys)


def objective_sums(divergences: DataFrame, keys: list[str], kind: str, temperature: float = 1.0) -> DataFrame:
    """(keys, numerator, denominator, loss): a divergence summed over positions, times the temperature squared, over the number of positions."""
    out = divergences.groupBy(*keys).agg((F.sum(kind) * temperature**2).alias("numerator"), F.count("*").alias("denominator"))
    return out.withColumn("loss", F.col("numerator") / F.col("denominator"))
