"""SentencePiece encoding and decoding by a streaming Viterbi search, and the lattice that token counts share with it.

Both walk the same lattice: at each character boundary one piece survives, the last of the best segmentation of what
stands before. For a unigram model it is the piece with the highest sum of scores. For a BPE model it is the one piece
that merging would leave there: a sequence of pieces is what BPE makes of a text exactly if BPE leaves each two
neighbours apart, so the survivor is the piece that does not merge differently with its predecessor's survivor. Ids
then equal the library's for either kind.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MEMO = 400_000  # pre-tokens whose ids a worker process keeps
PAIRS = 1_000_000  # neighbours whose fit a worker process keeps
SHORT = 64  # characters of a pre-token that is remembered
SLICE_BYTES = 24_000_000  # bytes of text that share a trie, about; one document at least
ENCODE_BYTES = 6_000_000  # bytes of text encoded and decoded at a time, about; one document at least


class PieceModel:
    """The pieces of a SentencePiece model with the identity normaliser.

    ``kind`` is "bpe" or "unigram", as the model was made. As with the library, a space is put before a text, spaces
    become U+2581, and characters without a piece become byte pieces (the unknown id if the model has none).

    Pieces are numbered in their order; a character without a piece gets a number when it is first met. A path is a list
    of (number, score) of the survivors at the boundaries from ``base`` on; the first entry stands for what is before.
    """

    def __init__(self, pieces: list[tuple[str, float]], ids: list[int] | None = None, kind: str = "bpe", byte_ids: list[int] | None = None, unknown: int = 0):
        self.kind, self.byte_ids, self.unknown, self.spaced = kind, byte_ids, unknown, False
        ids = list(range(len(pieces))) if ids is None else ids
        self.id_of = {p: i for (p, _), i in zip(pieces, ids)}
        self.score = {p: s for p, s in pieces}
        self.piece_of = {i: p for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of), default=1)
        self.lowest = min(self.score.values(), default=0.0) - 10.0  # an unknown character, as the library scores it
        # all ends of pieces; those that are pieces have their number, others -1
        self.numbered = ["", *self.score]
        self.ends = dict.fromkeys((p[k:] for p in self.score for k in range(len(p))), -1) | {p: i for i, p in enumerate(self.numbered) if i}
        self.size = [len(p) for p in self.numbered]
        self.weight = [0.0, *self.score.values()]
        self.emits = [[], *([self.id_of[p]] for p in self.score)]
        self.fits: dict[int, bool] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.memo: dict[str, bytes] = {}
        self.counted: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.numbered):
            if p:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pre_token = re.compile(self.cuts(), re.S)
        #: what decoding writes for each id
        self.written = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in self.piece_of.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids or [])}

    def cuts(self) -> str:
        """A pattern for what lies between places that no piece runs over: where a space follows other characters, about
        characters that no piece holds, and between a letter and a sign that no piece has after a letter."""
        self.breaks = ""  # characters that no piece runs over, or up to
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            return ".+"
        self.breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in self.score))
        self.spaced = True
        alone = "".join(map(re.escape, self.breaks))
        after_letter = {b for p in self.score for a, b in zip(p, p[1:]) if a.isalpha()}
        signs = "".join(re.escape(c) for c in ".,;:!?|)#$%&*" if c not in after_letter)
        lone = f"[{alone}]|" if alone else ""
        word = f"{SPACE}*[^\\W\\d_]+(?=[{signs}])|" if signs else ""
        return f"{lone}{word}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"

    @staticmethod
    @lru_cache(maxsize=4)  # a worker process goes on with what its earlier tasks have learnt
    def load(path: str, kind: str = "bpe") -> "PieceModel":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        by = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        byte_ids = [by[f"<0x{b:02X}>"] for b in range(256)] if len(by) == 256 else None
        return PieceModel([(sp.id_to_piece(i), sp.get_score(i)) for i in plain], plain, kind, byte_ids, sp.unk_id())

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: join the neighbours whose joint piece scores highest, leftmost first, while there are any."""
        parts = list(text)
        while True:
            joint = [(-self.score[p], i) for i, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in self.score]
            if not joint:
                return parts
            i = min(joint)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that BPE joins last to make ``piece``; none if it makes something else of it."""
        if piece not in self.split:
            parts, held = self.merge(piece), None
            if len(parts) == 1 and len(piece) > 1:
                s = self.score.pop(piece)  # the state before the last join
                before = self.merge(piece)
                self.score[piece] = s
                held = (before[0], before[1]) if len(before) == 2 else None
            elif len(piece) == 1:
                held = ("", piece)
            self.split[piece] = held
        return self.split[piece]

    def number(self, character: str) -> int:
        """The number of a character without a piece."""
        self.ends[character] = len(self.numbered)
        self.numbered.append(character)
        self.size.append(1)
        self.weight.append(self.lowest)
        self.emits.append([self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown])
        return self.ends[character]

    def fit(self, before: int, piece: int) -> bool:
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        found = self.fits[before << 24 | piece] = self.apart(self.numbered[before], self.numbered[piece])
        return found

    def apart(self, a: str, b: str) -> bool:
        """Whether BPE makes [a, b] of a + b, or [b] if a is empty.

        Joins come in the order of scores. So it goes back in time from the finished pieces: at each state what ends at
        the boundary and what begins there would have joined, had their joint piece come before what either of them
        went into; of equal scores the left one comes first.
        """
        score, never = self.score, float("-inf")
        if self.halves(b) is None or (a and self.halves(a) is None):
            return False
        after_a = after_b = never
        while a:
            joint = score.get(a + b, never)
            if joint > after_a and joint >= after_b and joint > never:
                return False
            made_a, made_b = (score.get(x, never) if len(x) > 1 else float("inf") for x in (a, b))
            if made_a == made_b == float("inf"):
                return True
            if made_a < made_b:  # the one made last comes apart first
                a, after_a = self.halves(a)[1], made_a
            else:
                b, after_b = self.halves(b)[0], made_b
        return True

    def survivor(self, text: str, end: int, path: list) -> tuple[int, float]:
        """The number and score of the piece that survives at ``end``; ``path`` has those of the boundaries before."""
        ends, n = self.ends, end - 1
        i = ends.get(text[n:end], -1)
        if i < 0:
            i = self.number(text[n:end])
        found = [i]
        while n > 0:
            n -= 1
            i = ends.get(text[n:end])
            if i is None:
                break
            if i > 0:
                found.append(i)
        size = self.size
        if self.kind == "bpe":
            fits = self.fits
            for i in reversed(found):
                before = path[end - size[i]][0]
                fit = fits.get(before << 24 | i)
                if fit or (fit is None and self.fit(before, i)):
                    return i, 0.0
            raise ValueError(f"no piece ends at {end} of {text[max(0, end - 40) : end]!r}")
        return max(((i, path[end - size[i]][1] + self.weight[i]) for i in found), key=lambda x: x[1])

    def converged(self, back: list[int]) -> int:
        """The last boundary that the paths to all boundaries a next piece may follow have in common."""
        size, n = self.size, len(back) - 1
        open_ends = set(range(max(0, n - self.longest + 1), n + 1))
        while len(open_ends) > 1:
            end = max(open_ends)
            open_ends.remove(end)
            open_ends.add(end - size[back[end]])
        return open_ends.pop()

    def stream(self, text: str):
        """The pieces' numbers of ``text``, each as soon as all surviving paths agree on it.

        What a next boundary looks at, and the scores kept, are of the last ``longest`` boundaries. Of those before, only
        the backpointers since the last commit stay; as soon as the paths to the whole window converge on one
        boundary, all pieces up to it are committed and forgotten.
        """
        return self.stream_bpe(text) if self.kind == "bpe" else self.stream_unigram(text)

    def stream_bpe(self, text: str):
        size, fits, fit_of = self.size, self.fits, self.fit
        back, base, check, done = [0], 0, 2 * self.longest, 0
        for end, i in self.automaton.iter(text):  # pieces by where they end, longest first
            if end < done:
                continue
            if end > done:
                back += map(self.lone, text[done:end])
            before = back[end + 1 - base - size[i]]
            fit = fits.get(before << 24 | i)
            if fit or (fit is None and fit_of(before, i)):
                back.append(i)
                done = end + 1
                if done - base >= check:
                    cut = self.converged(back)
                    if cut:
                        yield from self.trace(back, cut)
                        back, base = back[cut:], base + cut
                    check = max(2 * self.longest, len(back) + max(self.longest, len(back) // 2))
            else:
                done = end
        back += map(self.lone, text[done:])
        yield from self.trace(back, len(back) - 1)

    def stream_unigram(self, text: str):
        size, weight, longest = self.size, self.weight, self.longest
        back, scores, base, check = [0], [0.0], 0, 2 * longest
        for end, found in self.endings(text):
            # boundary k's score stands at k - end, counted from the end
            score, i = max(((scores[-size[i]] + weight[i], i) for i in found), key=lambda x: x[0])
            back.append(i)
            scores.append(score)
            if len(scores) > longest:
                del scores[0]
            if end - base >= check:
                cut = self.converged(back)
                if cut:
                    yield from self.trace(back, cut)
                    back, base = back[cut:], base + cut
                check = max(2 * longest, len(back) + max(longest, len(back) // 2))
        yield from self.trace(back, len(back) - 1)

    def endings(self, text: str):
        """(boundary, numbers of the pieces that end there); a character without a piece has a number of its own."""
        done, found = 0, []
        for end, i in self.automaton.iter(text):
            if end > done:
                for c in text[done:end]:
                    done += 1
                    yield done, found or [self.lone(c)]
                    found = []
            found.append(i)
        for c in text[done:]:
            done += 1
            yield done, found or [self.lone(c)]
            found = []

    def lone(self, character: str) -> int:
        """The number of a character at whose end no piece survives but itself: one without a piece."""
        if character in self.score:
            raise ValueError(f"no piece survives after {character!r}")
        i = self.ends.get(character, -1)
        return self.number(character) if i < 0 else i

    def walk(self, tokens: list[str]):
        """(token, shared, path) for each of some texts, in order: what two neighbours share at their start is searched once."""
        path, before = [(0, 0.0)], ""
        for token in sorted(tokens):
            shared = 0
            for a, b in zip(before, token):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                path.append(self.survivor(token, end, path))
            before = token
            yield token, shared, path

    def trace(self, back: list[int], end: int) -> list[int]:
        out, size = [], self.size
        while end > 0:
            out.append(back[end])
            end -= size[back[end]]
        return out[::-1]

    def pre_tokens(self, text: str) -> list[str]:
        """Text cut where no piece can run over, its spaces written as U+2581."""
        return self.pre_token.findall(text.replace(" ", SPACE))

    def units(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The texts, a space put before each that is not empty, cut before spaces and about characters that no piece holds:
        (units in order, coded; how many stand before the end of each text). Paths converge at each of these cuts whatever the text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(space, texts, none))
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        held = texts.buffers()[2] or pa.py_buffer(b"")
        raw = np.frombuffer(held, np.uint8)[: offsets[-1]]
        starts = np.zeros(len(raw) + 1, bool)
        starts[offsets] = True
        if self.spaced and len(raw):
            blank = raw == 0x20
            # a U+2581 of the text is a space too
            mark = np.zeros(len(raw), bool)
            mark[2:] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
            starts[1:-1] |= blank[1:] & ~(blank | mark)[:-1]
            for c in self.breaks:
                lone = raw == ord(c)
                starts[:-1] |= lone
                starts[1:] |= lone
        at = np.flatnonzero(starts)
        at = at[(at >= offsets[0]) & (at <= offsets[-1])]
        if len(raw) == 0:
            return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(len(texts), np.int64)
        cut = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), held)
        return cut.dictionary_encode(), np.searchsorted(at, offsets[1:])

    def token_ids(self, token: str) -> bytes:
        """Ids of a pre-token, as 4 bytes each: objects that the collector need not visit."""
        emits = self.emits
        ids = array("i", [i for p in self.stream(token) for i in emits[p]]).tobytes()
        if len(token) <= SHORT:
            self.memo[token] = ids
        return ids

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in one, and where those of each text end. Each distinct unit is looked at once."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        coded, upto = self.units(texts)
        known, learn, raw = self.memo.get, self.token_ids, []
        for unit in coded.dictionary.to_pylist():
            tokens = self.pre_tokens(unit)
            raw.append(known(tokens[0]) or learn(tokens[0]) if len(tokens) == 1 else b"".join([known(t) or learn(t) for t in tokens]))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        which = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[which])])[upto]
        return gathered(np.frombuffer(b"".join(raw), np.int32), np.cumsum(sizes) - sizes, sizes, which), ends

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces joined to UTF-8, U+2581 as space, the space put before the text taken off."""
        of_byte = {i: b for b, i in enumerate(self.byte_ids or [])}
        out, raw = [], bytearray()
        for i in ids:
            if i in of_byte:
                raw.append(of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.piece_of.get(i, " ⁇ "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if text.startswith(SPACE) else text).replace(SPACE, " ")


    def decode_texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids that ``encode_texts`` made: the bytes of all pieces in a row are cut where texts end."""
        top = max(self.written, default=0) + 1
        table = [self.written.get(i, " ⁇ ".encode()) for i in range(max(top, self.unknown + 1))]
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        raw = gathered(np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes, ids)
        upto = np.concatenate([[0], np.cumsum(sizes[ids])])
        stops = upto[ends]
        begins = np.concatenate([[0], stops[:-1]])
        lead = stops > begins  # the space put before each text that is not empty
        kept = np.ones(len(raw), bool)
        kept[begins[lead]] = False
        offsets = np.concatenate([[0], np.cumsum(stops - begins - lead)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw[kept].tobytes()))


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of ``flat``, one after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1])]


def sliced(batch: pa.RecordBatch, column: int, size: int):
    """The rows of a batch in slices of about ``size`` bytes of a column."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def encode_decode(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, ids, decoded (text of the ids), round_trip.

    round_trip says whether the decoded text is the text, where U+2581 in a text counts as the space it stands for.
    A null text counts as empty; an empty text has no ids. Lone surrogates do not occur in Spark strings. Null and
    repeated ids are kept as they are. Other columns of ``docs`` are not read. An empty table gives no rows.
    """

    def run(batches):
        pieces = PieceModel.load(model, kind)
        for part in (s for batch in batches for s in sliced(batch, 1, ENCODE_BYTES)):
            texts = pc.fill_null(part.column(1), "")
            ids, ends = pieces.encode_texts(texts)
            back = pieces.decode_texts(ids, ends).cast(pa.string())
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
            cols = [part.column(0), pa.array(np.diff(ends, prepend=0)), found, back, pc.equal(back, pc.replace_substring(texts, SPACE, " "))]
            yield pa.record_batch(cols, names=["doc_id", "n_pieces", "ids", "decoded", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, decoded string, round_trip boolean")
