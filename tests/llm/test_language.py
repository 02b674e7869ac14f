"""Language identification against a plain version letter by letter, and held-out accuracy."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from millrace.llm import language, queries
from tests.llm.test_contracts import AWKWARD, SF, by_id

D = 64


def letter(c):
    digest = hashlib.shake_256(f"letter:{ord(c) if c else 0}".encode()).digest(D // 8)
    return [1 if digest[i // 8] >> (7 - i % 8) & 1 else -1 for i in range(D)]


def vector(text, n=3):
    symbols = [""]
    for c in text or "":
        low = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else ""
        if low or symbols[-1]:
            symbols.append(low)
    if symbols[-1]:
        symbols.append("")
    grams = [g for g in (symbols[i : i + n] for i in range(len(symbols) - n + 1)) if any(g)]
    out = [0] * D
    for g in grams:
        turned = [letter(c)[-(n - 1 - k) :] + letter(c)[: -(n - 1 - k)] if n - 1 - k else letter(c) for k, c in enumerate(g)]
        for i in range(D):
            p = 1
            for v in turned:
                p *= v[i]
            out[i] += p
    return out, len(grams)


def plain(rows, n=3):
    """{doc_id: (held_out, lang, score)}"""
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    profiles = defaultdict(lambda: [0] * D)
    vectors = [vector(t, n) for _, t, _ in rows]
    for (i, _, lang), (v, grams) in zip(rows, vectors):
        size = sum(x * x for x in v) ** 0.5
        if lang is not None and grams and not out(i):
            profiles[lang] = [p + round(x / (size or 1.0) * 64 * D**0.5) for p, x in zip(profiles[lang], v)]
    found = {}
    for (i, _, _), (v, grams) in zip(rows, vectors):
        size = sum(x * x for x in v) ** 0.5
        near = [(max(0.0, sum(x * y for x, y in zip(v, p)) / (size or 1.0) / (sum(y * y for y in p) ** 0.5 or 1.0)), lang) for lang, p in profiles.items()]
        best = max((s for s, _ in near), default=0.0)
        found[i] = (out(i), min(lang for s, lang in near if s > best - 1e-12), best) if grams and near else (out(i), "und", 0.0)
    return found


def same(got, want):
    assert got.keys() == want.keys()
    for i, (held_out, lang, score) in want.items():
        assert got[i][:2] == (held_out, lang), i
        assert got[i][2] == pytest.approx(score, abs=1e-9), i


ROWS = [(i, t if len(t or "") < 5000 else t[:3000], ("aa", "bb", "cc", None)[i % 4]) for i, t in AWKWARD] + [
    (101, "İSTANBUL ǅ ß", "dd"), (102, "x", "bb"), (103, "123 !!", "aa"), (104, "漢", "dd"), (105, "a-b_c", "bb"), (106, "x", None), (107, "😀é😀", "cc"), (108, "Ab aB", "aa"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", [2]) for i, t, lang in rows], "doc_id long, text string, lang string, score int, lang_pred string, profile array<int>").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_awkward_rows(spark, n):
    got = by_id(language.identify(frame(spark, ROWS), n=n, dimensions=D), "held_out", "lang_pred", "score")
    same(got, plain(ROWS, n))


def test_many_languages(spark, monkeypatch):
    """Profiles compared three at a time give what all at once give."""
    rows = [(i, "".join(chr(97 + (i * k + k) % 26) for k in range(1, 30)), f"l{i % 20:02}") for i in range(120)]
    whole = by_id(language.identify(frame(spark, rows), dimensions=D), "held_out", "lang_pred", "score")
    monkeypatch.setattr(language, "LANGUAGES", 3)
    same(by_id(language.identify(frame(spark, rows), dimensions=D), "held_out", "lang_pred", "score"), whole)


def test_nothing_learnt_and_no_rows(spark):
    docs = frame(spark, [(i, t, None) for i, t, _ in ROWS])
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, dimensions=D).collect()} == {("und", 0.0)}
    assert language.identify(docs.filter("false"), dimensions=D).count() == 0
    twice = spark.createDataFrame([(None, "abc", "aa"), (None, "abc", "aa"), (3, None, "aa")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(twice, dimensions=D).orderBy("doc_id").collect()] == ["aa", "aa", "und"]
    with pytest.raises(ValueError):
        language.bundled(["abc"], 4, D)


def test_batches_do_not_matter():
    """Texts bundled together and one by one have the same vectors."""
    texts = [t or "" for _, t, _ in ROWS]
    together, sizes = language.bundled(texts, 3, D)
    for k, text in enumerate(texts):
        alone, size = language.bundled([text], 3, D)
        assert (alone[0] == together[k]).all() and size[0] == sizes[k]


def test_held_out_accuracy(spark):
    got = by_id(queries.QUERIES["op11_language"](spark, SF), "held_out", "lang_pred", "score")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert got.keys() == {r["doc_id"] for r in docs}
    right = [got[r["doc_id"]][1] == r["lang"] for r in docs if got[r["doc_id"]][0]]
    assert len(right) > 30 and sum(right) >= 0.97 * len(right)
    assert all(0 <= score <= 1 for _, _, score in got.values())
