"""Token counts: distinct pre-tokens in a trie, one lattice step per shared prefix, counts at the terminals."""

from __future__ import annotations

from collections import ChainMap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SLICE_BYTES, PieceModel, sliced

MEMO = 600_000  # counts of pre-tokens that a worker process keeps
DEEP = 256  # characters of a pre-token in the trie; what is longer is streamed and not kept


def trie_counts(model: PieceModel, tokens: list[str]) -> dict[str, int]:
    """How many ids each of the distinct ``tokens`` has.

    Going through them in order walks their trie depth first: what two neighbours share is a path from the root, whose
    nodes' forward scores, survivors and counts stand from the one before. A node's count is that of the node its survivor
    begins at, and what the survivor adds.
    """
    counts, upto, size, emits = {}, [0], model.size, model.emits
    for token, shared, path in model.walk(tokens):
        del upto[shared + 1 :]
        for piece, _ in path[shared + 1 :]:
            upto.append(upto[len(upto) - size[piece]] + len(emits[piece]))
        counts[token] = upto[-1]
    return counts


def streamed_count(model: PieceModel, token: str) -> int:
    return sum(len(model.emits[p]) for p in model.stream(token))


class TrieCounter:
    """Counts for whole batches of texts: each distinct pre-token of a batch is looked at once."""

    def __init__(self, model: PieceModel):
        self.model, self.memo = model, model.counted

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pre-tokens) of each text."""
        model, memo = self.model, self.memo
        coded, upto = model.units(texts)
        units = [model.pre_tokens(u) for u in coded.dictionary.to_pylist()]
        if len(memo) > MEMO:
            memo.clear()
        new = {t for tokens in units for t in tokens if t not in memo}
        deep = {t: streamed_count(model, t) for t in new if len(t) > DEEP}
        memo.update(trie_counts(model, [t for t in new if t not in deep]))
        of = ChainMap(deep, memo) if deep else memo
        which = coded.indices.to_numpy(zero_copy_only=False)

        def per_text(of_unit: list[int]) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(np.array(of_unit, np.int64)[which])])[upto], prepend=0)

        return per_text([sum(map(of.__getitem__, tokens)) for tokens in units]), per_text(list(map(len, units)))


def count_tokens(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens (ids of the whole text under the model), n_pre_tokens.

    A null or empty text has none. Null and repeated ids are kept as they are. Other columns of ``docs`` are not read.
    An empty table gives no rows. A task holds the distinct pre-tokens of SLICE_BYTES of text at a time, and the counts of
    MEMO and those of one slice at most; nothing is shuffled.
    """

    def run(batches):
        counter = TrieCounter(PieceModel.load(model, kind))
        for part in (s for batch in batches for s in sliced(batch, 1, SLICE_BYTES)):
            n_tokens, n_pre = counter.count(part.column(1))
            yield pa.record_batch([part.column(0), pa.array(n_tokens), pa.array(n_pre)], names=["doc_id", "n_tokens", "n_pre_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_pre_tokens long")
