"""Nearest neighbours by a forest of hash prefixes.

Every tree gives each vector a long string of symbols. A symbol is the direction, out of a few
random ones and their opposites, that lies nearest to the vector; directions are taken from the
centre of the block. A tree is the sorted array of its strings. A query goes down in all trees to
the rows that share its whole string and comes up again in all trees at once: at every length the
last symbol may also be the query's second nearest, then one of its nearest four and so on, until
all symbols are allowed there and the prefix is a symbol shorter. It stops once the rows met in some
tree are enough; these are compared exactly. Forests are built per block of rows, every row is in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.blocks import against, matrices, usable
from tideline.llm.common import kept

#: A string has ``SYMBOLS`` symbols, each one of ``WAYS`` directions or an opposite of theirs.
TREES, SYMBOLS, WAYS = 512, 4, 16
SYMBOL_BITS = (2 * WAYS - 1).bit_length()
#: So many of the nearest symbols are allowed at the end of a prefix, one step after the other.
PROBES = (0, 1, 2, 4, 8, 16)
#: Candidates compared exactly: this share of a block, and at least so many.
SHARE, ENOUGH = 0.1, 256
#: Queries that share the work of building a forest, and vectors that are hashed at a time.
QUERIES_PER_FOREST, AT_A_TIME = 16384, 128
SEED = 3


class Forest:
    """Sorted arrays of hash strings over the rows of one matrix, which has a row at least."""

    def __init__(self, rows: np.ndarray, trees: int = TREES):
        self.rows, self.trees = rows, trees
        self.scale = float(np.abs(rows).max(initial=0)) or 1.0
        scaled = rows / self.scale
        self.centre = scaled.mean(0)
        length = np.linalg.norm(scaled - self.centre, axis=1)
        # Vectors of different lengths lie on one more axis, so that near ones have near directions.
        self.lift = float(length.std())
        rng, wide = np.random.default_rng(SEED), rows.shape[1] + 1
        whole = trees * SYMBOLS * WAYS
        turns = [np.linalg.qr(rng.normal(size=(wide, wide)))[0] for _ in range(-(-whole // wide))]
        columns = np.concatenate(turns, 1)[:, :whole].astype(np.float32).reshape(wide, -1, WAYS)
        # One matrix per way, so that the largest projection is a running one over whole matrices.
        self.directions = np.ascontiguousarray(columns.transpose(2, 0, 1))
        strings = np.zeros((trees, len(rows)), np.uint32)
        for start in range(0, len(rows), AT_A_TIME):
            strings[:, start : start + AT_A_TIME] = self._strings(rows[start : start + AT_A_TIME]).T
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def _lifted(self, vectors: np.ndarray) -> np.ndarray:
        lifted = np.full((len(vectors), vectors.shape[1] + 1), self.lift, np.float32)
        lifted[:, :-1] = vectors / self.scale - self.centre
        return lifted

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        """The string of every vector in every tree."""
        lifted = self._lifted(vectors)
        largest = np.full((len(vectors), self.trees * SYMBOLS), -1, np.float32)
        symbols = np.zeros(largest.shape, np.uint8)
        for way, direction in enumerate(self.directions):
            projected = lifted @ direction
            symbol = (projected > 0).view(np.uint8) + np.uint8(2 * way)
            size = np.abs(projected, out=projected)
            np.copyto(symbols, symbol, where=size > largest)
            np.maximum(largest, size, out=largest)
        return self._packed(symbols.reshape(len(vectors), self.trees, SYMBOLS))

    def _nearness(self, vectors: np.ndarray) -> np.ndarray:
        """Projections by vector, tree, position in the string and direction."""
        lifted = self._lifted(vectors)
        near = np.stack([lifted @ direction for direction in self.directions], -1)
        return near.reshape(len(vectors), self.trees, SYMBOLS, WAYS)

    @staticmethod
    def _packed(symbols: np.ndarray) -> np.ndarray:
        shifts = SYMBOL_BITS * np.arange(SYMBOLS)[::-1]
        return (symbols.astype(np.uint32) << shifts.astype(np.uint32)).sum(-1, dtype=np.uint32)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the rows that share a prefix of some length with it in a tree, at least ``enough`` or all."""
        for start in range(0, len(queries), AT_A_TIME):
            yield from self._climb(queries[start : start + AT_A_TIME], min(enough, len(self.rows)))

    def _climb(self, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        near = self._nearness(queries)
        # Symbols from the nearest to the farthest: those of the opposites are the same ones backwards.
        by_size = np.argsort(-np.abs(near), axis=3, kind="stable")
        symbols = 2 * by_size + (np.take_along_axis(near, by_size, 3) > 0)
        strings = self._packed(symbols[..., 0])
        n, count = len(self.rows), len(queries)
        seen, met = np.zeros((count, n), bool), np.zeros(count, np.int64)
        waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(count)]
        active = np.arange(count) if enough else np.arange(0)
        base = np.arange(self.trees, dtype=np.int64)[:, None] * n
        flat = self.order.ravel()
        for length in range(SYMBOLS, 0, -1):
            shift = np.uint32(SYMBOL_BITS * (SYMBOLS - length))
            above = strings >> shift >> np.uint32(SYMBOL_BITS) << np.uint32(SYMBOL_BITS)
            for first, last in zip(PROBES, PROBES[1:], strict=False):
                if not len(active):
                    break
                low = (above[active][..., None] | symbols[active, :, length - 1, first:last].astype(np.uint32)) << shift
                high = low + (np.uint32(1) << shift)
                low, high = (side.transpose(1, 0, 2).reshape(self.trees, -1) for side in (low, high))
                ends = [
                    (np.stack([np.searchsorted(self.sorted[t], side[t]) for t in range(self.trees)]) + base).reshape(
                        self.trees, len(active), last - first
                    )
                    for side in (low, high)
                ]
                met[active] += (ends[1] - ends[0]).sum((0, 2))
                for at, q in enumerate(active):
                    waiting[q].append((ends[0][:, at].ravel(), ends[1][:, at].ravel()))
                    if met[q] >= enough:
                        starts, stops = (np.concatenate(side) for side in zip(*waiting[q], strict=True))
                        seen[q, flat[_spans(starts, stops)]] = True
                        waiting[q], met[q] = [], seen[q].sum()
                active = active[met[active] < enough]
        # Up at the root every row shares the empty prefix.
        seen[active] = True
        return [np.flatnonzero(row) for row in seen] if enough else [np.arange(0)] * count


def _spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges from ``starts`` to ``stops``, one range after the other."""
    sizes = stops - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _nearest(k: int, share: float, least: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        there = {v.shape[1]: (ids, v) for _, ids, v in matrices(right)} if right.num_rows else {}
        for _, own, queries in matrices(left) if left.num_rows else ():
            if queries.shape[1] not in there:
                continue
            ids, rows = there[queries.shape[1]]
            forest = Forest(rows)
            # One more than k, as the query's own row may be among them.
            enough = max(k + 1, least, int(np.ceil(share * len(rows))))
            for i, found in enumerate(forest.candidates(queries, enough)):
                found = found[ids[found] != own[i]]
                distance = np.sqrt(((rows[found] - queries[i]) ** 2).sum(1))
                if len(found) > k:
                    bound = np.partition(distance, k - 1)[k - 1]
                    near = np.flatnonzero(distance <= bound)
                    found, distance = found[near], distance[near]
                best = np.lexsort((ids[found], distance))[:k]
                out[0] += [own[i]] * len(best)
                out[1] += ids[found[best]].tolist()
                out[2] += distance[best].tolist()
        return pa.table(
            {"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())}
        )

    return work


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    share: float = SHARE,
    least: int = ENOUGH,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` nearest found, by Euclidean distance.

    Distances are those of the original vectors in double precision; ties go to the smaller id. Queries are the
    rows that fulfil ``is_query``, an expression on ``id``; a query's own row is no candidate, nor are vectors
    of another length. Null keys and vectors that are null, zero or hold null or non-finite components take no
    part; rows that repeat a key count once, with their smallest vector. An empty table gives an empty one.

    Every block of rows compares at least ``share`` of itself, and ``least`` rows, exactly with a query: a block of
    no more than ``least`` rows is searched whole. Rows of one hash string are met together, so that equal
    vectors are all compared, however many there are.
    """
    rows = kept(usable(vectors, key, vector, zero=False))
    known = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    hits = against(
        rows.filter(is_query), rows, (known["q"], known["n"]),
        "query_id bigint, vec_id bigint, score double", _nearest(k, share, least), QUERIES_PER_FOREST,
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
