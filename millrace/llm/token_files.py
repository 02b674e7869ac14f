"""Token ids as fixed-width bit-packed blocks, written and read as a table of blocks.

Each row of the table is one block: whole documents in ascending id order, the offset of each in the block, and their ids
packed to the fewest bits the vocabulary needs. A block is cut into groups of GROUP ids that each begin on a byte of their
own, so any document is unpacked by numpy from its offset without touching what stands before. Spark's writer commits
the files, so a lost executor or a repeated task leaves no half files, and any file system that Spark writes to will do.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .pieces import gathered, sliced
from .scratch import materialize

GROUP = 4096  # ids that share one byte offset
BLOCK_IDS = 1 << 18  # ids of a block, about: it ends with the document that reaches this
SHARD_BYTES = 64_000_000  # bytes of text of a shard, about: what one task sorts and encodes
MOST_SHARDS = 16_384  # tasks that a shuffle of the texts has at most; a task streams its range in order, so a range may be large
SLICE_BYTES = 24_000_000  # bytes of text encoded at a time, about; one document at least
MEMO = 400_000  # stems whose ids a worker process keeps


def bit_width(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def group_bytes(width: int) -> int:
    return -(-GROUP * width // 8)


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, least significant bit first; each GROUP of ids starts a byte."""
    if width % 8 == 0:  # whole bytes need no bits moved
        return np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    out = []
    for lo in range(0, len(ids), GROUP):
        part = np.ascontiguousarray(ids[lo : lo + GROUP], "<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_ids(packed: bytes, width: int, first: int, end: int) -> np.ndarray:
    """Ids number ``first`` to ``end`` of a packed block; reads the groups they stand in and no others."""
    if width % 8 == 0:
        size = width // 8
        full = np.zeros((end - first, 4), np.uint8)
        full[:, :size] = np.frombuffer(packed, np.uint8, count=(end - first) * size, offset=first * size).reshape(-1, size)
        return full.ravel().view("<u4")
    out, size = [], group_bytes(width)
    for g in range(first // GROUP, -(-end // GROUP)):
        n = min(end - g * GROUP, GROUP)
        raw = np.frombuffer(packed, np.uint8, count=-(-n * width // 8), offset=g * size)
        bits = np.unpackbits(raw, bitorder="little")[: n * width].reshape(n, width)
        full = np.zeros((n, 32), np.uint8)
        full[:, :width] = bits
        out.append(np.packbits(full.ravel(), bitorder="little").view("<u4")[max(0, first - g * GROUP) :])
    return np.concatenate(out) if out else np.empty(0, "<u4")


#: Letters below U+0180, each of which has one letter as lower case, and one sign after them at most.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ"
SIGNS = ".,!?:;"
PLAIN = re.compile(f"[{LETTERS}]+").fullmatch


class WordEncoder:
    """Encodes texts by their distinct words: what is done per word is done by Arrow and numpy, for a whole batch at once.

    Good for tokenizers that never join or look across ASCII white space, and that take a run of letters and the sign
    after it apart, as the word-end BPE does. Each new stem is encoded by the library, many in a call: a run of letters
    is one pre-token, so its ids end where a piece that ends a word does.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")
        self.stems: dict[str, bytes] = {"": b""}  # ids as 4 bytes each: objects that the collector need not visit

    @staticmethod
    @lru_cache(maxsize=4)  # a worker process goes on with the stems that its earlier tasks have learnt
    def load(path: str) -> "WordEncoder":
        return WordEncoder(path)

    def learn(self, stems: list[str]) -> None:
        """What the library makes of new stems."""
        plain, other = [], []
        for p in stems:
            (plain if PLAIN(p) else other).append(p)
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            flat = np.array(found.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[flat]) + 4).tolist()
            if len(cuts) == len(group):
                raw = flat.tobytes()
                self.stems.update(zip(group, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
            else:  # not a tokenizer of that kind
                other += group
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self.stems[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in one, and where those of each text end."""
        # space, tab, line feed, vertical tab, form feed, carriage return; white space at an end leaves an empty word
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        of_text = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        apart = pc.match_substring_regex(words, f"^[{LETTERS}]+[{SIGNS}]?$")
        bare = pc.ascii_rtrim(words, characters=SIGNS)
        signed = pc.and_(apart, pc.not_equal(pc.binary_length(words), pc.binary_length(bare)))
        sign = pc.if_else(signed, pc.utf8_slice_codeunits(words, start=-1), "")
        stem = pc.if_else(apart, pc.utf8_lower(bare), words)
        parts = pa.concat_arrays([stem, sign]).dictionary_encode()
        names = parts.dictionary.to_pylist()
        if len(self.stems) > MEMO:
            self.stems = {"": b""}
        self.learn([p for p in names if p not in self.stems])
        raw = list(map(self.stems.__getitem__, names))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat = np.frombuffer(b"".join(raw), "<u4")
        starts = np.cumsum(sizes) - sizes
        # the parts of each word of the texts, in order: stem, sign
        by_word = parts.indices.to_numpy().reshape(2, -1).T
        which = by_word[coded.indices.to_numpy()].ravel()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])[2 * of_text[1:]]
        return gathered(flat, starts, sizes, which), ends


BLOCKS = "shard long, block long, in_shard long, width int, first_id long, last_id long, doc_ids array<bigint>, offsets array<bigint>, packed binary"


def shard_count(size: int, least: int) -> int:
    """Ranges of ids for ``size`` bytes of text: one for SHARD_BYTES, up to MOST_SHARDS, which hold more blocks each beyond that."""
    return max(least, min(MOST_SHARDS, -(-size // SHARD_BYTES)))


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order, the end id after each text, and write the table of blocks; returns it as read back.

    Columns: shard, block (within the shard), in_shard (ids of the shard before it), width, first_id, last_id, doc_ids,
    offsets (ids of the block before each document, and all), packed. Shards are ranges of doc_id, as many as the bytes of text ask for.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder, shard, block, before = WordEncoder.load(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs, sizes, ids, held = [], [], [], 0

        def row():
            offsets = [0, *np.cumsum(sizes).tolist()]
            named = [d for d in docs if d is not None]
            cols = [[shard], [block], [before], [width], [min(named, default=None)], [max(named, default=None)], [docs], [offsets], [pack_ids(np.concatenate(ids), width)]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["shard", "block", "in_shard", "width", "first_id", "last_id", "doc_ids", "offsets", "packed"])

        for part in (s for b in batches for s in sliced(b, 1, SLICE_BYTES)):
            flat, ends = encoder.encode(part.column(1))
            flat, ends = np.insert(flat, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
            at, names = 0, part.column(0).to_pylist()
            while at < len(names):  # whole documents up to the one that fills the block
                start = int(ends[at - 1]) if at else 0
                upto = min(len(names), int(np.searchsorted(ends, start + BLOCK_IDS - held)) + 1)
                docs += names[at:upto]
                sizes += np.diff(ends[at:upto], prepend=start).tolist()
                ids.append(flat[start : ends[upto - 1]])
                held += int(ends[upto - 1]) - start
                at = upto
                if held >= BLOCK_IDS:
                    yield row()
                    block, before = block + 1, before + held
                    docs, sizes, ids, held = [], [], [], 0
        if docs:
            yield row()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shard_count(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return materialize(ordered.mapInArrow(run, BLOCKS), "token-blocks")


def read_documents(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """From the blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (array)."""
    sizes = blocks.select("shard", F.element_at("offsets", -1).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # a row for each shard, of which there are as many as the writer had tasks
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", before.alias("shard_start"))

    def run(batches):
        for batch in batches:
            for width, docs, offsets, packed, start in zip(*(c.to_pylist() for c in batch.columns)):
                ids, at = unpack_ids(packed, width, 0, offsets[-1]), np.array(offsets)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
                cols = [pa.array(docs, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    joined = blocks.join(starts, "shard").select("width", "doc_ids", "offsets", "packed", (F.col("shard_start") + F.col("in_shard")).alias("start"))
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def read_ids(blocks: DataFrame, doc_id: int) -> DataFrame:
    """(doc_id, ids) of the documents of one id. Parquet skips blocks by first_id and last_id; of those left only the
    groups of ids that the document stands in are unpacked, from its offset."""

    def run(batches):
        for batch in batches:
            for width, docs, offsets, packed in zip(*(c.to_pylist() for c in batch.columns)):
                found = [unpack_ids(packed, width, offsets[i], offsets[i + 1]).tolist() for i, d in enumerate(docs) if d == doc_id]
                yield pa.record_batch([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    near = blocks.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return near.select("width", "doc_ids", "offsets", "packed").mapInArrow(run, "doc_id long, ids array<int>")


def token_blocks(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of blocks of ``docs``, for ``read_documents`` and ``read_ids``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return write_blocks(rows, tokenizer, end_id, bit_width(vocabulary))


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode, write as blocks in ascending id order, read back: doc_id, start, n_tokens (with the end id), ids_crc32, ids.

    A null or empty text has the end id only. Rows with a null id come first, in any order, as do rows that repeat an
    id among themselves. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    return read_documents(token_blocks(docs, tokenizer, vocabulary, end_id, id_col, text_col), with_ids)
