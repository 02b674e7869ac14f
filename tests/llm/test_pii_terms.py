"""Terms that disclose an entity, at every support."""

import random

from millrace.llm import pii


def found_terms(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in pii.find(docs, **options).collect():
        parts = [s.split(":") for s in r["spans"].split(",") if s.startswith("term:")]
        out[r["doc_id"]] = [texts[r["doc_id"]][int(a) : int(b)] for _, a, b in parts]
    return out


def test_one_text_shows_nothing(spark):
    """A word that stands in one text with an entity, copied or not, is no evidence; in four different texts it is."""
    texts = ["stock note by Quillfeather at lone@example.com"]
    texts += ["stock note by Ambrosius at copied@example.com"] * 5
    texts += [f"stock note {k} by Mirabel at often@example.com" for k in ("one", "two", "three", "four")]
    texts += [f"stock note by someone at desk {i % 50}" for i in range(3000)]
    got = found_terms(spark, texts)
    assert not any(got[i] for i in range(6))
    assert all(got[i] == ["Mirabel"] for i in range(6, 10))
    assert not any(got[i] for i in range(10, len(texts)))


def test_the_corpus_around_does_not_matter(spark):
    """The same documents have the same spans in corpora of 300, 900, 1,100 and 5,000."""
    rng = random.Random(1)
    private = [f"note {rng.randint(0, 10**9)} by Mirabel{k % 3} of Ulm{rng.randint(0, 10**9)} at m{k % 3}@example.com" for k in range(30)]
    found = []
    for n in (300, 900, 1100, 5000):
        got = found_terms(spark, private + [f"stock note by someone of the firm at desk {i}" for i in range(n - 30)])
        found.append([got[i] for i in range(30)])
    assert found[0] == [[f"Mirabel{k % 3}"] for k in range(30)]
    assert all(f == found[0] for f in found)


def planted(seed, documents=3000, entities=60):
    """(texts, {text: planted words}): names beside addresses in 5 to 9 texts each, one in eight of their texts without the address; words by Zipf's law."""
    rng = random.Random(seed)
    texts, names = [], {}
    words = [f"w{i}" for i in range(40_000)]
    filler = lambda n: [words[min(int(rng.paretovariate(0.6)) - 1, 39_999)] for _ in range(n)]
    for e in range(entities):
        for _ in range(rng.randint(5, 9)):
            alone = rng.random() < 0.125
            body = filler(60)
            body.insert(rng.randint(0, 60), f"Name{e}")
            if not alone:
                body.insert(rng.randint(0, 61), f"e{e}@example.com")
                names[len(texts)] = f"Name{e}"
            texts.append(" ".join(body))
    while len(texts) < documents:
        body = filler(60)
        if rng.random() < 0.1:
            body.insert(3, f"once{len(texts)}@example.com")
        texts.append(" ".join(body))
    return texts, names


def test_precision_and_recall_of_planted_names(spark):
    right = wrong = missed = 0
    for seed in (1, 2):
        texts, names = planted(seed)
        for i, found in found_terms(spark, texts).items():
            right += sum(w == names.get(i) for w in found)
            wrong += sum(w != names.get(i) for w in found)
            missed += names.get(i) is not None and names[i] not in found
    print("precision", right / (right + wrong), "recall", right / (right + missed))
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.6


def test_least_texts():
    assert [pii.least_texts(left, 1.96) for left in (0.5, 1.0, 2.0)] == [10, 4, 2]
    assert pii.least_texts(1.0, 0.0) == 0


def test_a_page_of_many_entities(spark):
    """Addresses that few texts hold meet no term, however many of them one page has with however many words."""
    page = " ".join(f"a{i}@example.com" for i in range(4000)) + " " + " ".join(f"word{i}" for i in range(4000))
    texts = [page] + [f"note {k} by Mirabel at often@example.com" for k in "abcd"] + [f"stock note {i} by hand at noon" for i in range(50)]
    got = found_terms(spark, texts)
    assert got[0] == [] and all(got[i] == ["Mirabel"] for i in range(1, 5))


def test_terms_of_a_common_entity(spark):
    """An address in a third of all documents, in different texts, protects the name beside it."""
    texts = [f"stock note {i} by Zorblatt at desk zed@example.com" for i in range(200)]
    texts += [f"stock note {i} by someone at desk" for i in range(200, 600)]
    got = found_terms(spark, texts)
    assert all(got[i] == ["Zorblatt"] for i in range(200))
    assert not any(got[i] for i in range(200, 600))


def test_an_entity_of_every_document_discloses_nothing(spark):
    assert not any(found_terms(spark, [f"note {w} at all@example.com" for w in ("one", "two", "three")]).values())
