"""The near-duplicate stage against all pairs' Jaccard similarities."""

import numpy as np

import corpus_pipeline
from millrace.llm import simhash
from tests.llm import brute


def shingles(text, width=5):
    w = brute.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)}


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    return brute.smallest_reachable(sets, links)


def edited_texts():
    """Copies with edits on either side of the threshold, a group of near copies with a hot shingle, copies, blanks."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(30, 200)))]
        for _ in range(8):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 6))):
                copy[at] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    common = "one passage that stands in very many texts"
    texts += [" ".join([common, *(f"w{x}" for x in rng.integers(0, 5000, 8))]) for _ in range(40)]
    texts += ["", None, " \n", "too short", "Too Short", "too  short x", texts[0].upper(), texts[9]]
    return list(enumerate(texts))


def test_near_duplicates_are_all_pairs_of_the_threshold(spark):
    rows = edited_texts()
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(rows) and len(got) == len(rows)


def test_stage_drops_what_fingerprints_of_three_bits_miss(spark):
    base = [f"w{i}" for i in range(100)]
    near = [*base[:30], "x", *base[31:70], "y", *base[71:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"v{i}" for i in range(50)))]
    assert (simhash.simhash(rows[0][1]) ^ simhash.simhash(rows[1][1])).bit_count() > 3
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
