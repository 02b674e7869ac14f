"""The registered queries, and the operators on awkward rows, against plain versions of what they are to return."""

import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from millrace.llm import components, embedding_dedup, line_dedup, mixing, pieces, pii, quality, queries, simhash, substring_dedup, token_counts, token_files
from tests.llm import brute

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
LINE = " ".join(WORDS[:12])
#: Nulls, empty and blank texts, one word, ties, exact and near copies, signs beyond the BMP, Unicode spaces, very long words and texts.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "two words"),
    (6, " ".join(WORDS * 4)), (7, " ".join(WORDS * 4)), (8, " ".join(WORDS * 4).upper()),
    (9, " ".join(WORDS * 4) + " psi"), (10, f"{LINE}\n\n{LINE}\nend"), (11, f"x\n{LINE.replace('delta', 'omega')}\ny"),
    (12, LINE.replace(" delta", "") + "\n" + " ".join(WORDS[:7])), (13, " ".join(WORDS[:7]) + "\n" + " ".join(WORDS[:6])),
    (14, "mail a.b+c@ex-ample.co.uk, x@y@z.org a@b..c 😀 q@r.s.t. 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 call +1 (415) 555-0100 or +49 30 1234"),
    (15, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005 0000000000000000 +4111111111111111"),
    (16, " nbsp em　wide \u0085next ▁under▁score naïve Straße İstanbul ﬁn 漢字仮名 🙂🙂"),
    (17, "a" * 70_000), (18, " ".join(f"w{i % 977}" for i in range(30_000))), (19, "the same five words here " * 10),
    (20, "<s> </s> <unk> <0x0A> <|endoftext|> <|startoftext|> tab\there\r\nnew"), (21, "one"), (22, "\n\n\n"),
    (23, "000.000.0255.1 0001.2.3.4 999999999999.1.1.1 +1234567890 +1.2.3.4.5.6.7.8.9.0 ++12345678901"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "s" if i % 3 else None, "x", 1, [1], "k", 0, "z") for i, t in AWKWARD]
    clash = "doc_id long, text string, source string, line string, n_words long, codes array<int>, key string, fp long, component_id string"
    return spark.createDataFrame(rows, clash).repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.filter("false")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df, *columns, key="doc_id"):
    rows = df.select(key, *columns).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_simhash(spark, documents, awkward, empty):
    cols = ("fingerprint", "component_id")
    assert by_id(queries.op1_simhash(spark, SF), *cols) == brute.near_fingerprints(documents)
    assert by_id(simhash.near_duplicates(awkward), *cols) == brute.near_fingerprints(AWKWARD)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_finds_every_link(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(s) for s in seeds}
    for s in seeds:
        for k in range(30):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            prints.add(int(s) ^ sum(1 << int(b) for b in flips))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(prints))]
    by = {i: f & (1 << 64) - 1 for f, i in rows}
    links = [(a, b) for a in by for b in by if a < b and (by[a] ^ by[b]).bit_count() <= 3]
    want = brute.smallest_reachable(by, links)
    distinct = spark.createDataFrame(rows, "fp long, rep long")
    for partitions in (2, 3):
        got = components.connected_components(simhash.near_fingerprints(distinct, 3, partitions)).collect()
        found = {i: i for i in by} | {r["node"]: r["component"] for r in got}
        assert found == want


def test_simhash_chains(spark):
    """A chain of fingerprints, each within three bits of the next, is one component; ends far apart hang together."""
    chain, mask = [0], 0
    for k in range(20):
        mask ^= 0b111 << (3 * k)
        chain.append(mask)
    rows = [(f - (1 << 64) if f >> 63 else f, 100 + i) for i, f in enumerate(chain)]
    got = components.connected_components(simhash.near_fingerprints(spark.createDataFrame(rows, "fp long, rep long"))).collect()
    assert {r["node"]: r["component"] for r in got} == {100 + i: 100 for i in range(1, 21)}


def test_embedding_chains(spark):
    """Vectors turned step by step: each links with its neighbours only, all are one component."""
    step = np.arccos(0.93)
    rows = [(i, [float(np.cos(i * step)), float(np.sin(i * step)), 0.0]) for i in range(7)]
    got = by_id(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "n_links", "component_id", key="vec_id")
    assert got == {i: (1 if i in (0, 6) else 2, 0) for i in range(7)}


def test_thresholds_are_the_cheapest():
    from itertools import product

    costs = [[5.0, 9.0, 30.0, 90.0], [1.0, 2.0, 80.0, 90.0], [7.0, 8.0, 9.0, 10.0]]
    price = lambda ts: sum(c[t] for c, t in zip(costs, ts) if t >= 0)
    best = min(price(ts) for ts in product(range(-1, 4), repeat=3) if sum(ts) == 1)
    got = simhash.allocate_thresholds(costs, 3)
    assert sum(got) == 1 and price(got) == best


def test_sentencepiece(spark, documents, awkward, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df, rows in ((queries.op2_sentencepiece(spark, SF), documents), (pieces.encode_decode(awkward, path), AWKWARD)):
        got = by_id(df, "ids", "decoded", "round_trip")
        for i, text in rows:
            ids = sp.encode(text or "")
            assert got[i][0] == ids, i
            assert got[i][1] == sp.decode(ids), i
            assert got[i][2], i
    assert pieces.encode_decode(empty, path).count() == 0


def test_unigram_lattice():
    """All segmentations of short texts, and the same ids from the stream as from the whole."""
    rng = np.random.default_rng(1)
    vocabulary = [("▁", -2.0), ("a", -1.5), ("b", -1.6), ("ab", -2.2), ("▁a", -2.1), ("aba", -3.9), ("bb", -2.0), ("bbab", -4.1)]
    model = pieces.PieceModel(vocabulary, kind="unigram")
    score = dict(vocabulary)

    def best(text):
        if not text:
            return 0.0
        return max(score[p] + best(text[len(p) :]) for p in score if text.startswith(p))

    for _ in range(60):
        text = "".join(rng.choice(list("ab "), 11))
        ids = model.encode(text)
        got = sum(score[model.piece_of[i]] for i in ids)
        assert abs(got - best("▁" + text.replace(" ", "▁"))) < 1e-9
        assert model.decode(ids) == text
        tokens = model.pre_tokens(" " + text)
        counts = token_counts.trie_counts(model, list(set(tokens)))
        assert sum(counts[t] for t in tokens) == len(ids)
        assert counts == {t: token_counts.streamed_count(model, t) for t in set(tokens)}
    long = "".join(rng.choice(list("ab"), 20_000))
    ids = [i for p in model.stream(long) for i in model.emits[p]]
    path = [piece for piece, _ in next(model.walk([long]))[2]]
    assert ids == [i for p in model.trace(path, len(long)) for i in model.emits[p]]


def test_stream_commits_as_it_goes():
    """Pieces come out before the text ends, as soon as all paths agree; what is held is a few of the longest piece."""
    model = pieces.PieceModel([("▁", -2.0), ("a", -1.5), ("b", -1.6), ("ab", -2.2), ("aba", -3.9)], kind="unigram")

    text, done, seen = "abaab" * 400, 0, [0]

    class Watched:
        def iter(self, text, inner=model.automaton):
            for end, i in inner.iter(text):
                seen[0] = end
                yield end, i

    model.automaton = Watched()
    for p in model.stream(text):
        done += model.size[p]
        assert seen[0] - done <= 8 * model.longest
    assert done == len(text)


def test_neighbours_that_stay_apart():
    """Going back in time says of two pieces what merging their text does."""
    model = pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    names = model.numbered[1:30_000]
    for a, b in zip(rng.choice(names, 4000), rng.choice(names, 4000)):
        a, b = str(a), str(b)
        assert model.apart(a, b) == (model.merge(a + b) == [a, b]), (a, b)
    for a in rng.choice(names, 300):
        assert model.apart("", str(a)) == (model.merge(str(a)) == [str(a)])
        k = int(rng.integers(len(a) + 1))
        for x, y in ((a[:k], a[k:]), (a[k:], a)):
            if x in model.score and y in model.score:
                assert model.apart(x, y) == (model.merge(x + y) == [x, y]), (x, y)


def test_units_and_pre_tokens(spark, documents):
    """Cutting into units first gives the pre-tokens of the whole text; decoding by bytes gives what decoding by pieces does."""
    import pyarrow as pa

    model = pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t or "" for _, t in documents + AWKWARD] + ["a  b", "▁ x", " ▁x", "x ▁ ▁▁  y", "\n \n", "end ", "\t\ta\r\n b", "▁", " "]
    coded, upto = model.units(pa.array(texts).slice(3))
    units, start = [coded.dictionary[i].as_py() for i in coded.indices.to_pylist()], 0
    for text, end in zip(texts[3:], upto):
        assert [p for u in units[start:end] for p in model.pre_tokens(u)] == model.pre_tokens(" " + text if text else "")
        start = end
    ids, ends = model.encode_texts(pa.array(texts))
    back = model.decode_texts(ids, ends).to_pylist()
    assert back == [model.decode(ids[a:b].tolist()) for a, b in zip([0, *ends], ends)]


def test_pii(spark, documents, awkward, empty):
    cols = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for df, rows in ((queries.op3_pii(spark, SF), documents), (pii.find(awkward), AWKWARD)):
        got = by_id(df, *cols)
        for i, text in rows:
            want, listed = brute.base_row(text)
            assert got[i][:5] == want, (i, got[i], listed)
            assert [s for s in got[i][5].split(",") if not s.startswith("term:")] == listed.split(","), i
    assert pii.find(empty).count() == 0


def test_pii_clean_texts(spark, documents, awkward):
    """The sanitised text by its spans, one after the other."""
    for df, rows in ((queries.op3_pii(spark, SF), documents), (pii.find(awkward), AWKWARD)):
        got = by_id(df, "spans", "clean_text")
        for i, text in rows:
            spans, clean = got[i]
            at, out = 0, ""
            for kind, start, end in (s.split(":") for s in spans.split(",") if s):
                start, end = int(start), int(end)
                out += text[at:start] if start > at else ""
                word = text[start:end]
                form = "[NUMBER]" if re.search("[0-9]", word) else "[NAME]" if next((c for c in word if c.isalpha()), "").isupper() else ""
                out += "" if start < at else form if kind == "term" else f"[{kind.upper()}]"
                at = max(at, end)
            assert clean == (text if not spans else out + text[at:]), i


def test_pii_terms(spark):
    """A name that stands only beside one address gives it away; common words and an address without a following do not."""
    rows = [(i, f"note {i} from Zorblatt at zed@example.com about stock item{i}") for i in range(4)]
    rows += [(i, f"note {i} about stock and weather item{i}") for i in range(4, 400)]
    rows += [(400, "note once from someone at lone@example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {i: s for i, (s,) in by_id(pii.find(docs), "spans").items()}
    text = rows[0][1]
    start = text.index("Zorblatt")
    assert f"term:{start}:{start + 8}" in spans[0].split(",")
    assert "stock" not in [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans[0].split(",")]
    assert spans[10] == "" and "term" not in spans[400]
    clean = by_id(pii.sanitise(docs), "text")
    assert "Zorblatt" not in clean[0][0] and "from [NAME] at [EMAIL]" in clean[0][0] and "@" not in clean[0][0]
    assert clean[10][0] == rows[10][1]


def test_mixing(spark, awkward, empty):
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE_SQL}) ORDER BY doc_id").fetchall()
    first = [tuple(r) for r in queries.op4_mixing(spark, SF).select(cols).orderBy("doc_id").collect()]
    again = [tuple(r) for r in queries.op4_mixing(spark, SF).repartition(7).select(cols).orderBy("doc_id").collect()]
    assert first == again
    assert [r[:4] + r[5:] for r in first] == [r[:4] + r[5:] for r in want]
    assert all(abs(a[4] - b[4]) < 1e-6 for a, b in zip(first, want))
    got = mixing.taken_words(awkward).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(brute.words(t)) for i, t in AWKWARD}
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source"], r["target"], r["source_size"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 4 * mixing.LEAST_BLOCK for (_, t, _), v in by.items())
    assert abs(sum(t for _, t, _ in by) - sum(n for _, _, n in by)) < 1e-6
    assert mixing.taken_words(empty).count() == 0


def test_sainte_lague_by_definition():
    from fractions import Fraction

    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        votes = [Fraction(int(v)) for v in rng.integers(0, 60, n)]
        seats = int(rng.integers(0, 80))
        most = [int(m) for m in rng.integers(0, 90, n)]
        got = [0] * n
        for _ in range(seats):
            live = [i for i in range(n) if votes[i] > 0 and got[i] < most[i]]
            if not live:
                break
            got[max(live, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, most) == got


def test_mixed_slices_and_quotas_of_shards(spark, awkward):
    """Slices, and the shards that they fill, as drawn one by one; each shard has its integer quota of each source."""
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 3 = 0")
    for df, cut in ((docs, 0), (awkward, 0)):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        want = Counter(brute.mix(rows))
        got = Counter((r["doc_id"], r["first"], r["n_words"], r["shard"]) for r in mixing.mixed_slices(df).collect())
        assert got == want
        taken = Counter()
        for i, _, n, _ in got.elements():
            taken[i] += n
        assert +taken == +Counter({r["doc_id"]: r["taken"] for r in mixing.taken_words(df).collect()})


def test_mixed_documents_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = by_id(mixing.taken_words(docs), "taken")
    out = {}
    for r in mixing.mixed_documents(docs).collect():
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + len(brute.words(r["text"]))
    assert out == {i: t for i, (t,) in taken.items() if t}


def test_token_files(spark, documents, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    cols = ("start", "n_tokens", "ids_crc32")
    assert by_id(queries.op5_token_files(spark, SF), *cols) == brute.token_rows(documents, path, 1)
    assert by_id(token_files.token_files(awkward, path, 49_408, 1), *cols) == brute.token_rows(AWKWARD, path, 1)
    assert token_files.token_files(empty, path, 49_408, 1).count() == 0


@pytest.mark.parametrize("vocabulary", [49_408, 100_000])
def test_token_files_read_one_document(spark, awkward, monkeypatch, vocabulary):
    """By its offset, without unpacking what stands before it in the block."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    blocks = token_files.token_blocks(awkward.coalesce(1), path, vocabulary, 1)
    for i, text in AWKWARD:
        assert [r["ids"] for r in token_files.read_ids(blocks, i).collect()] == [tokenizer.encode(text or "", add_special_tokens=False).ids + [1]], i
    assert token_files.read_ids(blocks, 10**6).count() == 0
    row = max(blocks.collect(), key=lambda r: len(r["doc_ids"]))
    k = len(row["doc_ids"]) - 1
    first, end = row["offsets"][k], row["offsets"][k + 1]
    size = token_files.group_bytes(row["width"])
    held = bytearray(row["packed"])
    held[: first // token_files.GROUP * size] = bytes(first // token_files.GROUP * size)  # other groups do not matter
    assert (token_files.unpack_ids(bytes(held), row["width"], first, end) == token_files.unpack_ids(row["packed"], row["width"], first, end)).all()


def test_token_files_in_small_slices_and_blocks(spark, documents, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.WordEncoder(path)
    import pyarrow as pa

    texts = [t for _, t in documents] + [t for _, t in AWKWARD]
    flat, ends = encoder.encode(pa.array(texts))
    parts = list(token_files.sliced(pa.record_batch([pa.array(texts, pa.string())], names=["t"]), 0, 1000))
    assert sum(p.num_rows for p in parts) == len(texts) and len(parts) > 20
    monkeypatch.setattr(token_files, "MEMO", 100)
    again = [encoder.encode(p.column(0)) for p in parts]
    assert (np.concatenate([f for f, _ in again]) == flat).all()
    assert (np.cumsum([n for _, e in again for n in np.diff(e, prepend=0)]) == ends).all()


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 24, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10_001, dtype=np.uint64).astype("<u4")
    packed = token_files.pack_ids(ids, width)
    for a, b in ((0, 10_001), (0, 0), (5, 6), (4095, 4097), (8192, 10_001)):
        assert (token_files.unpack_ids(packed, width, a, b) == ids[a:b]).all()
    assert len(packed) <= len(ids) * width / 8 + 4


def test_quality(spark, documents, awkward, empty):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for df, rows in ((queries.op6_quality(spark, SF), documents), (quality.judge(awkward), AWKWARD)):
        got = by_id(df, *cols)
        for i, text in rows:
            want = brute.quality_counts(text)
            assert got[i][:6] == want, (i, got[i], want)
            assert not (want[5] and got[i][6])
    assert quality.judge(empty).count() == 0


def test_quality_agrees_with_labels(spark):
    """Held-out labels: clean documents are kept, and rejects are mostly bad."""
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, True), 0) + n.get((0, False), 0)) > 0


def test_em_finds_the_accurate_rule():
    """One rule is right nine times in ten, one is a coin: their weights come out in that order."""
    rng = np.random.default_rng(0)
    from collections import Counter

    patterns = Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        right = lambda p: (1 if good else -1) if rng.random() < p else (-1 if good else 1)
        patterns[(right(0.9), right(0.9), right(0.85), (1 if rng.random() < 0.5 else -1))] += 1
    _, odds = quality.fit(sorted(patterns.items()))
    spread = [o[1] - o[-1] for o in odds]
    assert min(spread[:3]) > 2 * spread[3]


def test_line_dedup(spark, documents, awkward, empty):
    assert by_id(line_dedup.dedup_lines(awkward), "text", "n_removed") == brute.dedup_lines(AWKWARD)
    assert by_id(queries.op7_line_dedup(spark, SF), "text", "n_removed") == brute.dedup_lines(documents)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("size", [3, 4, 5, 6, 8, 11, 16, 33])
def test_line_dedup_random_edits(spark, size):
    rng = np.random.default_rng(size)
    rows, base = [], [list(rng.choice(WORDS, size)) for _ in range(6)]
    for i in range(60):
        line = list(base[rng.integers(6)])
        for _ in range(rng.integers(0, 3)):
            at, kind = rng.integers(len(line)) if line else 0, rng.integers(3)
            if kind == 0 and line:
                line[at] = str(rng.choice(WORDS))
            elif kind == 1:
                line.insert(at, str(rng.choice(WORDS)))
            elif line:
                del line[at]
        rows.append((i, " ".join(line) + "\n" + " ".join(rng.choice(WORDS, 8))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(line_dedup.dedup_lines(df), "text", "n_removed") == brute.dedup_lines(rows)


def test_line_dedup_short_and_long_lines(spark):
    """One definition whatever the length: a word in front of a long line, a word changed in a line of seven."""
    long = [f"v{i}" for i in range(3000)]
    seven = WORDS[:7]
    rows = [(1, " ".join(long)), (2, " ".join(["front", *long]) + "\nkept  as it  is"), (3, " ".join(seven)), (4, " ".join([*seven[:3], "changed", *seven[4:]])),
            (5, " ".join(long[:1500] + long[1501:])), (6, " ".join(long[:1500] + ["two", "more"] + long[1500:]))]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "text", "n_removed")
    assert got == {1: (rows[0][1], 0), 2: ("kept  as it  is", 1), 3: (rows[2][1], 0), 4: ("", 1), 5: ("", 1), 6: (rows[5][1], 0)}


def test_token_counts(spark, documents, awkward, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df, rows in ((queries.op8_token_counts(spark, SF), documents), (token_counts.count_tokens(awkward, path), AWKWARD)):
        assert {i: n for i, (n,) in by_id(df, "n_tokens").items()} == {i: len(sp.encode(t or "")) for i, t in rows}
    assert token_counts.count_tokens(empty, path).count() == 0


def test_substring_dedup(spark, documents, awkward, empty):
    cols = ("n_words", "n_removed", "kept_sha256")
    assert by_id(queries.op9_substring_dedup(spark, SF), *cols) == brute.remove_windows(documents)
    assert by_id(substring_dedup.remove_repeats(awkward), *cols) == brute.remove_windows(AWKWARD)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_text_and_buckets(spark, documents, monkeypatch):
    """The kept text is what is hashed; small portions and many buckets, a passage in each document, give the same."""
    import hashlib

    passage = " ".join(f"licence{i}" for i in range(20))
    rows = [(i, f"{t or ''} {passage}") for i, t in documents]
    monkeypatch.setattr(substring_dedup, "CHUNK_WINDOWS", 500)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 300)
    got = by_id(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "n_words", "n_removed", "kept_sha256", "kept_text")
    assert {i: v[:3] for i, v in got.items()} == brute.remove_windows(rows)
    assert all(hashlib.sha256(v[3].encode()).hexdigest() == v[2] for v in got.values())


def test_embedding_dedup(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = by_id(queries.op10_embedding_dedup(spark, SF), "n_links", "component_id", "kept", key="vec_id")
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.cosine_links(rows).items()}
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]),
           (10, [0.9, 0.43588989435]), (11, [0.0, -0.0]), (12, [1e300, 1e299]), (13, [1e-300, 1e-301]), (14, [1.0]), (15, [-1.0, 0.0]), (16, [-0.0, 3.0]), (17, [0.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in odd], "vec_id long, embedding array<double>, tile string, rep int")
    got = by_id(embedding_dedup.near_duplicates(df), "n_links", "component_id", key="vec_id")
    scaled = [(i, [x * 1e-300 for x in v] if i == 12 else [x * 1e300 for x in v] if i == 13 else v) for i, v in odd]
    assert got == brute.cosine_links(scaled)
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0


def test_embedding_tiles(spark):
    """Many tiles, with links near the threshold on either side."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.3).astype(np.float32).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_id(embedding_dedup.near_duplicates(df, tile_rows=16), "n_links", "component_id", key="vec_id")
    assert got == brute.cosine_links(rows)


def test_null_and_repeated_ids(spark):
    """Null ids stay as rows of their own; repeated rows stay repeated."""
    text = " ".join(WORDS * 2)
    docs = spark.createDataFrame([(None, text, "a"), (None, text, None), (5, text, "a"), (5, text, "a"), (6, text, "b")], "doc_id long, text string, source string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sim = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"])
    assert sim == [(5, 5), (5, 5), (6, 5)]
    for df in (simhash.near_duplicates(docs), pieces.encode_decode(docs, path), pii.find(docs), mixing.taken_words(docs), quality.judge(docs), line_dedup.dedup_lines(docs),
               token_counts.count_tokens(docs, path), substring_dedup.remove_repeats(docs), token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 49_408, 1)):
        assert sorted(r["doc_id"] or 0 for r in df.select("doc_id").collect()) == [0, 0, 5, 5, 6]


def test_tasks_at_100_tb():
    """Shuffles of a hundred terabytes ask for some thousands of tasks, those of a little text for what is set."""
    assert token_files.shard_count(10**14, 200) == substring_dedup.task_count(-(-(10**14) // substring_dedup.BUCKET_BYTES), 200) == 16_384
    assert token_files.shard_count(10**6, 200) == substring_dedup.task_count(512, 200) == 200
