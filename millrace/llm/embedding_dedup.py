"""Embedding near-duplicates: int8 tile products with error bounds, full precision only where a bound allows a link."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize

TILE_ROWS = 8192  # vectors of a tile at most, about: what a task holds is two tiles
LEAST_TILES = 16
STRIP = 512  # rows of a tile multiplied at a time


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as scale * int8 codes: (codes, scales, lengths of scale * codes, lengths of the rest).

    For unit u = s q + e the product of two is s s' q.q' plus at most |sq||e'| + |e||s'q'| + |e||e'| (Cauchy-Schwarz).
    """
    peak = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / peak  # first by the peak, so that squares of huge or tiny components stay finite
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127.0
    codes = np.rint(unit / scale).astype(np.int8)
    kept = scale * codes
    return codes, scale[:, 0], np.sqrt((kept * kept).sum(axis=1)), np.sqrt(((unit - kept) ** 2).sum(axis=1))


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; float32 sums of up to 1000 terms of 127 * 127 are exact."""
    out = None
    for lo in range(0, a.shape[1], 1000):
        part = a[:, lo : lo + 1000].astype(np.float32) @ b[:, lo : lo + 1000].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def exact_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


class LocalForest:
    """Which of n items hang together, from links that come in portions; keeps n numbers only."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        live = a != b
        a, b = a[live], b[live]
        while len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            to = np.arange(len(self.root))
            np.minimum.at(to, high, low)
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]
            a, b = to[a], to[b]
            live = a != b
            a, b = a[live], b[live]


def tile_links(tiles: list[dict], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one tile against itself, or two: (ids, how many vectors each links with, smallest-index root of each)."""
    first, last = tiles[0], tiles[-1]
    same = len(tiles) == 1
    n = len(first["id"])
    ids = first["id"] if same else np.concatenate([first["id"], last["id"]])
    counts, forest, shift = np.zeros(len(ids), np.int64), LocalForest(len(ids)), 0 if same else n
    (ca, sa, la, ea), (cb, sb, lb, eb) = quantise(first["vector"]), quantise(last["vector"])
    for lo in range(0, n, STRIP):
        rows = slice(lo, min(lo + STRIP, n))
        bound = la[rows, None] * eb + ea[rows, None] * (lb + eb)
        upper = code_products(ca[rows], cb) * (sa[rows, None] * sb) + bound
        i, j = np.nonzero(upper >= threshold - 1e-9)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 17):
            p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            linked = exact_cosines(first["vector"][p], last["vector"][q]) >= threshold
            p, q = p[linked], q[linked]
            counts += np.bincount(p, last["copies"][q], len(ids)).astype(np.int64)
            counts += np.bincount(q + shift, first["copies"][p], len(ids)).astype(np.int64)
            forest.add(p, q + shift)
    return ids, counts, forest.root


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Links pairs with cosine >= threshold in double precision, all against all, whatever the other columns. Equal
    vectors are one node with a number of copies. The distinct vectors are dealt to tiles by a hash of their id and
    each two tiles meet in one task; the exact all-pairs product is quadratic work by its nature, but memory, and what
    a task returns (a count and one edge at most per vector), are bounded by the tile. A vector that is null, empty,
    zero, or holds null, NaN or infinite components has no links and is its own component; so are vectors of different
    lengths among each other. A null id gets a null component. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    good = rows.filter(usable)
    distinct = materialize(good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    tiles = max(LEAST_TILES, -(-distinct.count() // tile_rows))

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in batch.groupby("dim"):
            flat = np.stack(part["vector"].to_numpy()).astype(np.float64)
            small = flat.astype(np.float32)
            flat = small if (small == flat).all() else flat
            out.append((part["tile"].iloc[0], dim, flat.dtype.name, part["rep"].to_numpy(np.int64).tobytes(), part["copies"].to_numpy(np.int64).tobytes(), flat.tobytes()))
        return pd.DataFrame(out, columns=["tile", "dim", "kind", "ids", "copies", "data"])

    packed = distinct.select(F.pmod(F.xxhash64("rep"), F.lit(tiles)).alias("tile"), F.size("vector").alias("dim"), "vector", "rep", "copies")
    packed = packed.groupBy("tile").applyInPandas(pack, "tile long, dim int, kind string, ids binary, copies binary, data binary")
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    met = met.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        pair = [
            {"id": np.frombuffer(r.ids, np.int64), "copies": np.frombuffer(r.copies, np.int64), "vector": np.frombuffer(r.data, r.kind).astype(np.float64).reshape(-1, r.dim)}
            for r in group.sort_values("tile").itertuples()
        ]
        # the group of a pair of tiles holds both; either may be missing where no vector fell to it
        if group["low"].iloc[0] != group["high"].iloc[0] and len(pair) < 2:
            return pd.DataFrame({"rep": [], "n": [], "root": []}, dtype=np.int64)
        ids, counts, root = tile_links(pair, threshold)
        some = counts > 0
        return pd.DataFrame({"rep": ids[some], "n": counts[some], "root": ids[root[some]]})

    found = materialize(met.groupBy("dim", "low", "high").applyInPandas(meet, "rep long, n long, root long"), "tile-links")
    groups = connected_components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    nodes = (
        distinct.join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = good.join(nodes, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
