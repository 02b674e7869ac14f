"""The pipeline's rows against plain versions of its stages, one after the other."""

import math
from collections import Counter

import public_tokenizers
import regex
import sentencepiece

import corpus_pipeline
from millrace.llm import quality
from tests.llm import brute
from tests.llm.test_shingle_dedup import components

SF = "/root/testdata/sf0.001"


def votes(text):
    """The quality rules' votes by counts made here."""
    w = brute.words(text)
    n, solid = max(len(w), 1), "".join(w)
    chars = max(len(solid), 1)
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    letters, upper = len(regex.findall(r"[\p{L}\p{N}]", solid)), len(regex.findall(r"\p{Lu}", solid))
    _, _, symbols, dup_lines, repeats, _ = brute.quality_counts(text)
    bad = lambda x: -1 if x else 0
    return (
        -1 if letters < 0.88 * chars else 1 if letters >= 0.94 * chars else 0,
        bad(symbols > 0.1 * n), bad(upper > 0.3 * chars), bad(solid.count("!") + solid.count("?") > 0.1 * n),
        bad(len(w) >= 20 and len(set(w)) < 0.2 * n), bad(sum(a == b for a, b in zip(w, w[1:])) > 0.1 * n),
        bad(dup_lines > 0.5 * max(len(lines), 1)), bad(100 * repeats > 15 * n),
    )


def plain_pipeline(docs):
    passed = {i: votes(t) for i, t, _ in docs if not brute.quality_counts(t)[5]}
    base, odds = quality.fit(sorted(Counter(passed.values()).items()))
    good = {i for i, v in passed.items() if 1 / (1 + math.exp(-base - sum(o[x] for o, x in zip(odds, v)))) >= quality.KEEP}
    docs = [d for d in docs if d[0] in good]
    new = brute.dedup_lines([(i, t) for i, t, _ in docs])
    docs = [(i, new[i][0], s) for i, _, s in docs]
    groups = components([(i, t) for i, t, _ in docs])
    docs = [d for d in docs if groups[d[0]] == d[0]]
    text_of = {i: t for i, t, _ in docs}
    out, sp = [], sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, first, n, _ in brute.mix(docs):
        w = brute.words(text_of[i])
        part = text_of[i] if n == len(w) else " ".join(w[first : first + n])
        out.append((i, tuple(sp.encode(part)), sp.decode(sp.encode(part)), True))
    return out


def test_pipeline(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    want = plain_pipeline([tuple(r) for r in rows])
    got = [(r["doc_id"], tuple(r["ids"]), r["decoded"], r["round_trip"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark):
    """Nulls, an empty text, copies, repeated and null ids, columns named like those used inside; and an empty table."""
    good = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(40)).replace("1", "a").replace("2", "b").replace("3", "c")
    texts = [(1, None, "a"), (2, "", "a"), (3, good, None), (4, good, "b"), (5, "too short", "b"), (3, good + " more", "a"), (None, good, "a"), (None, None, None)]
    clash = "new_text n_words size shard repeat taken_id start block kept codes key n component_id node fp first row_key".split()
    rows = [(i, t, "en", s, len(t or ""), *(f"{i}:{c}" for c in clash)) for i, t, s in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in [*clash[:-1], "`dotted.name`"])
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, "")
            got = docs.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == before.columns, name
                assert all(r["start"] == f"{r['doc_id']}:start" for r in got)
