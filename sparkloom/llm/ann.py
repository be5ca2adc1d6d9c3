"""Approximate nearest neighbours by a forest of sorted hash strings.

Each tree gives a vector a long string of symbols, each the nearest signed
axis after a random projection, and keeps its strings in a sorted array. A
query descends in every tree to its longest matching prefix, then ascends in
all trees together, one symbol and tree at a time, until enough rows share its
prefixes; these rows are compared exactly. How many are enough is measured: a
bounded sample of the block's own rows asks for its nearest, which are known
exactly, and the ascent goes as far as ``TARGET`` of them need. Where vectors
have structure few rows are met, where they have none many.

Rows are dealt to blocks of bounded size by a hash of their id, so a common
vector spreads over all blocks; each block holds a forest of its own, and
chunks of queries visit every block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean

#: Trees, axes of a projection, symbols of a string.
TREES, AXES, SYMBOLS = 112, 8, 6
#: Rows of a block that are asked for their nearest to end the ascent, and the share of these that must be met.
SAMPLE, TARGET = 256, 0.97
BLOCK_ROWS, CHUNK_QUERIES, NEAREST, EVERY, SEED = 16384, 8192, 5, 50, 5
_BITS = (2 * AXES - 1).bit_length()


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by way of their largest component."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


class Forest:
    """``TREES`` sorted arrays of hash strings over one block of unit vectors.

    Step ``s`` of the ascent takes tree ``s % TREES`` up to the prefixes of
    ``SYMBOLS - s // TREES`` symbols.
    """

    def __init__(self, rows: np.ndarray, seed: int = SEED):
        self.rows = rows
        rng = np.random.default_rng(seed)
        self._axes = rng.normal(size=(TREES, SYMBOLS * AXES, rows.shape[1])).astype(np.float32)
        self._strings = self.strings(rows)
        self.order = np.argsort(self._strings, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(self._strings, self.order, 1)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """A string of symbols for each tree and row, packed with the first symbol highest."""
        out = np.zeros((TREES, len(rows)), np.uint64)
        narrow = rows.astype(np.float32).T
        for t in range(TREES):
            z = (self._axes[t] @ narrow).reshape(SYMBOLS, AXES, -1)
            axis = np.abs(z).argmax(1)
            side = np.take_along_axis(z, axis[:, None], 1)[:, 0] < 0
            for s in range(SYMBOLS):
                out[t] = out[t] << np.uint64(_BITS) | (2 * axis[s] + side[s]).astype(np.uint64)
        return out

    def _ranges(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each step of the ascent and query: begin and end, in the tree's sorted array, of the rows that share the prefix."""
        low = np.zeros((SYMBOLS, TREES, keys.shape[1]), np.int32)
        high = np.zeros_like(low)
        for t in range(TREES):
            for up in range(SYMBOLS):
                shift = np.uint64(_BITS * up)
                first = keys[t] >> shift << shift
                low[up, t] = np.searchsorted(self.keys[t], first, "left")
                high[up, t] = np.searchsorted(self.keys[t], first | ((np.uint64(1) << shift) - np.uint64(1)), "right")
        return low, high

    @staticmethod
    def _met(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many rows a query has met after each step, each counted in every tree that meets it."""
        many = (high - low).astype(np.int64)
        many[1:] -= many[:-1]
        return many.reshape(-1, many.shape[-1]).cumsum(0)

    def enough(self, k: int, sample: int = SAMPLE, target: float = TARGET) -> int:
        """How many rows must be met so that ``target`` of the k nearest of a sample of the rows are among them."""
        own = np.linspace(0, len(self.rows) - 1, min(sample, len(self.rows))).astype(int)
        k = min(k, len(self.rows) - 1)
        if k < 1:
            return 1
        near = self.rows[own] @ self.rows.T
        near[np.arange(len(own)), own] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        met = self._met(*self._ranges(self._strings[:, own]))
        need = np.zeros(best.shape, np.int64)
        for i, q in enumerate(own):
            apart = self._strings[:, q, None] ^ self._strings[:, best[i]]
            up = (np.frexp(apart.astype(np.float64))[1] + _BITS - 1) // _BITS  # symbols to ascend until the tree meets the row
            step = (up * TREES + np.arange(TREES)[:, None]).min(0)
            need[i] = np.where(step < len(met), met[np.minimum(step, len(met) - 1), i], np.iinfo(np.int64).max)
        return int(np.quantile(need, target, method="higher"))

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the rows that it meets until there are ``enough``; all rows, if there never are."""
        for at in range(0, len(queries), 512):
            low, high = self._ranges(self.strings(queries[at : at + 512]))
            met = self._met(low, high)
            reached = met >= enough
            last = np.where(reached.any(0), reached.argmax(0), -1)
            for q, step in enumerate(last.tolist()):
                if step < 0:
                    yield np.arange(len(self.rows))
                    continue
                up, tree = divmod(step, TREES)
                seen = np.zeros(len(self.rows), bool)
                for t in range(TREES):
                    level = up if t <= tree else up - 1
                    if level >= 0:
                        seen[self.order[t, low[level, t, q] : high[level, t, q]]] = True
                yield np.flatnonzero(seen)


def nearest(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float, int]]:
    """``(query, id, cosine, met)`` of each query's k nearest distinct ids among the ``met`` rows that it meets."""
    forest, out = Forest(rows), []
    enough = forest.enough(k)
    for query_id, q, some in zip(query_ids, queries, forest.candidates(queries, enough), strict=True):
        met = len(some)
        some = some[ids[some] != query_id]
        rough = rows[some] @ q
        found: dict[int, float] = {}
        width = 4 * k
        while len(found) < k and len(some):
            least = -np.inf if width >= len(some) else np.partition(rough, len(rough) - width)[len(rough) - width] - 1e-9
            close = some[rough >= least]
            exact = (rows[close] * q).sum(1)
            found = {}
            for j in np.lexsort((ids[close], -exact)):
                found.setdefault(int(ids[close[j]]), float(exact[j]))
                if len(found) == k:
                    break
            if width >= len(some):
                break
            width *= 8
        out += [(int(query_id), i, s, met) for i, s in found.items()]
    return out


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: vectors in double precision, without those that take no part.

    That is null ids, null or empty or zero vectors, and those with a null or
    non-finite component.
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null and size(v) > 0").where(~bad).where(F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest rows found, ties to the smaller id.

    Both inputs are as ``usable`` gives them. Vectors are compared with those
    of their own length only. Rows with the query's id are its own; an id that
    repeats counts once, with its best score. With too few rows all are
    returned; empty inputs give no rows. Scores are dot products of vectors
    scaled to length one, in double precision: cosines that are equal in
    mathematics, as those of scaled copies, may differ in their last bits, and
    are then ranked by them; only equal doubles are ties.
    """
    total = vectors.count()
    blocks = max(1, math.ceil(total / block_rows))
    chunks = max(1, math.ceil(queries.count() / CHUNK_QUERIES))
    index = vectors.select(
        F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "id", "v"
    )
    asked = queries.select(
        F.size("v").alias("d"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(F.hash("id"), F.lit(chunks)).alias("chunk"), F.col("id").alias("query"), F.col("v").alias("q")
    )

    def matrix(side: pa.Table, name: str) -> np.ndarray:
        flat = side.column(name).combine_chunks().flatten().to_numpy()
        return unit(flat.reshape(side.num_rows, -1))

    def pair(rows: pa.Table, asked: pa.Table) -> pa.Table:
        lean()
        found = []
        if rows.num_rows and asked.num_rows:
            found = nearest(rows.column("id").to_numpy(), matrix(rows, "v"), asked.column("query").to_numpy(), matrix(asked, "q"), k)
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64(), "met": pa.int64()}
        return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate(kinds.items())})

    keys = ["d", "block", "chunk"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(pair, "query_id bigint, vec_id bigint, score double, met bigint")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    """The contract's query set."""
    return vectors.where(F.col("id") % EVERY == 0)
