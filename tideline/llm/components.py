"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import kept


def _followed(parent: DataFrame) -> DataFrame:
    """``node``, ``root``: the end of each chain of parents. A parent is smaller than its node."""
    chain = kept(parent)
    while True:
        up = chain.select(F.col("node").alias("root"), F.col("root").alias("above"))
        chain_next = kept(chain.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), "above"))
        moved = not chain_next.filter(F.col("above").isNotNull()).isEmpty()
        chain = chain_next.select("node", "root")
        if not moved:
            return chain


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component, another than itself) for edges ``a``, ``b`` of bigint.

    Every round hangs each node under its smallest neighbour if that is smaller, follows the chains
    to their ends and moves the edges there. Nodes that are roots have no row. Nothing gathers a
    component in one task: minima are aggregated before they are shuffled, and Spark can split the joins.
    """
    left = kept(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    known: DataFrame | None = None
    while not left.isEmpty():
        both = left.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        step = _followed(both.groupBy("node").agg(F.min("other").alias("root")))
        if known is None:
            known = step
        else:
            moved = known.join(step.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            known = kept(moved.select("node", F.coalesce("above", "root").alias("root")).unionByName(step))
        a, b = (step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        left = kept(
            left.join(a, "a", "left")
            .join(b, "b", "left")
            .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
