"""Queries against all rows, in blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES_PER_BLOCK, ROWS_PER_BLOCK = 1024, 4096


def usable(vectors: DataFrame, key: str, vector: str, zero: bool = True) -> DataFrame:
    """``id``, ``v``: one row per key. Null keys, null vectors and vectors with a null or non-finite component go.

    Without ``zero`` vectors of zeros go, too. Of several rows of one key the smallest vector, in the order of
    arrays, is the key's.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the vectors: their row numbers, ids and matrix, in the order of ids."""
    ids = table.column("id").to_numpy()
    lists = table.column("v").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield rows, ids[rows], values[offsets[rows][:, None] + np.arange(length)].astype(np.float64)


def against(
    queries: DataFrame,
    rows: DataFrame,
    counts: tuple[int, int],
    schema: str,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    queries_per_block: int | None = None,
) -> DataFrame:
    """Run ``work`` on every block of queries with every block of rows.

    ``counts`` are the numbers of both. Blocks are dealt by a hash of the id, so that they hold about
    ``QUERIES_PER_BLOCK`` (or as given) and ``ROWS_PER_BLOCK`` vectors at any size of the table.
    """
    sizes = (queries_per_block or QUERIES_PER_BLOCK, ROWS_PER_BLOCK)
    blocks = [max(1, -(-n // size)) for n, size in zip(counts, sizes, strict=True)]
    own = [F.pmod(F.xxhash64("id"), F.lit(n)) for n in blocks]
    every = [F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))) for n in blocks]
    # New names for the columns of both sides, which may come from one table.
    left = queries.select(*[F.col(c).alias(c) for c in queries.columns], own[0].alias("qb"), every[1].alias("rb"))
    right = rows.select(*[F.col(c).alias(c) for c in rows.columns], every[0].alias("qb"), own[1].alias("rb"))
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(work, schema)
