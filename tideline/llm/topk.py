"""Exact top-k search by selection on histograms of scores.

All rows are scored against all queries once, block by block. A block keeps its own k best of a
query, ties to the smaller id, as no other row of it can be among the query's k best. Each pass over
what was kept counts, by query, how many scores fall into the bins of the range that must hold the
k-th one, and goes on with the one bin where it lies, until a bin is a single score. Then the scores
above it are read off, and among those equal to it the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.blocks import against, matrices, usable
from tideline.llm.common import kept

BINS = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of vectors of whole numbers, exact; those beyond a long are its limits."""
    bound = np.sqrt((queries**2).sum(1).max(initial=0)) * np.sqrt((rows**2).sum(1).max(initial=0))
    if bound < 2**52:
        return (queries @ rows.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    product = exact(queries) @ exact(rows).T if queries.shape[1] else np.zeros((len(queries), len(rows)), object)
    return np.clip(product, LEAST, MOST).astype(np.int64)


def _scaled(work, scale: int):
    """The work on vectors whose components are turned into floor(scale * component)."""

    def whole(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        values = np.floor(lists.values.to_numpy(zero_copy_only=False) * scale)
        new = pa.ListArray.from_arrays(lists.offsets, pa.array(values))
        return table.set_column(table.schema.get_field_index("v"), "v", new)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(*(whole(t) if t.num_rows else t for t in (left, right)))

    return run


def _best(k: int):
    """Of a block of rows the ``k`` best of each query in a block, equal scores by ascending id."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        there = {v.shape[1]: (ids, v) for _, ids, v in matrices(right)} if right.num_rows else {}
        for _, own, queries in matrices(left) if left.num_rows else ():
            if queries.shape[1] not in there:
                continue
            ids, rows = there[queries.shape[1]]
            for query, score in zip(own, scores(queries, rows), strict=True):
                others = np.flatnonzero(ids != query)
                found = score[others]
                if len(found) > k:
                    least = np.partition(found, len(found) - k)[len(found) - k]
                    above, equal = np.flatnonzero(found > least), np.flatnonzero(found == least)
                    others = others[np.concatenate([above, equal[: k - len(above)]])]  # ids are in order
                out[0] += [query] * len(others)
                out[1] += ids[others].tolist()
                out[2] += score[others].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("id", "vec_id", "score"), out, strict=True)})

    return work


def search(
    vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` largest scores, ties to the smaller id.

    A score is the inner product of floor(``scale`` * component). Queries are the rows that fulfil
    ``is_query``, an expression on ``id``; a query's own row is no candidate, nor are vectors of another
    length. Null keys and vectors that are null or hold null or non-finite components take no part; rows
    that repeat a key count once, with their smallest vector. An empty table gives an empty one.
    """
    rows = kept(usable(vectors, key, vector))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    known = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(square).alias("bound")).first()
    counts = (known["q"], known["n"])
    bound = min(int(min(known["bound"] or 0.0, 2.0**63)) + 1, MOST)
    asked = rows.filter(is_query)
    hits = kept(against(asked, rows, counts, "id bigint, vec_id bigint, score bigint", _scaled(_best(k), scale)))
    state = kept(
        asked.select("id", F.lit(-bound).alias("low"), F.lit(bound).alias("high"), F.lit(k).cast("bigint").alias("need"))
    )
    spread = 2 * bound + 1
    width = f"(cast((cast(high as decimal(20)) - low) div {BINS} as bigint) + 1)"
    while spread > 1:
        inside = hits.join(state, "id").filter("score between low and high")
        bins = inside.select("id", F.expr(f"(cast(score as decimal(20)) - low) div {width}").alias("bin"))
        own = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        place = (
            bins.groupBy("id", "bin")
            .agg(F.count("*").alias("n"))
            .withColumn("upto", F.sum("n").over(own))
            .join(state, "id")
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        )
        found = place.select(
            "id",
            F.expr(f"cast(cast(low as decimal(38)) + cast(bin as decimal(20)) * {width} as bigint)").alias("low_"),
            F.expr(f"cast(least(cast(high as decimal(38)), low + cast(bin + 1 as decimal(20)) * {width} - 1) as bigint)").alias("high_"),
            (F.col("need") - F.col("upto") + F.col("n")).alias("need_"),
        )
        # Queries with fewer candidates than k take them all: everything lies above the least score.
        state = kept(
            state.join(found, "id", "left").select(
                "id",
                F.coalesce("low_", F.lit(LEAST)).alias("low"),
                F.coalesce("high_", F.lit(LEAST)).alias("high"),
                F.coalesce("need_", "need").alias("need"),
            )
        )
        spread = (spread - 1) // BINS + 1 if spread > BINS else 1
    hits = hits.join(state, "id").filter("score >= low").withColumnRenamed("id", "query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
