"""A join that stays balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 5_000_000


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    rows: str,
    spread_by: str = "row_seq",
    how: str = "left",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join ``facts`` with a table of one row per key, ``left`` or ``inner``.

    ``rows`` is a column of ``lookup`` with at least the key's number of rows in
    ``facts``; it is dropped. Keys with more than ``rows_per_slice`` rows are hot: there
    are at most (all rows / ``rows_per_slice``) of them, so their lookup rows are
    broadcast. The other keys meet in a shuffle, over which the rows of hot keys are
    dealt in slices by a hash of ``spread_by``, a column that differs between rows.
    """
    is_hot = F.col(rows) > rows_per_slice
    values = [c for c in lookup.columns if c not in (key, rows)]
    value = F.struct(F.lit(True).alias("found"), *values)
    hot = lookup.filter(is_hot).select(
        F.col(key), value.alias("_hot"), F.ceil(F.col(rows) / rows_per_slice).alias("_slices")
    )
    # Always 0 here, but not a literal: the optimizer would drop a literal from the join keys.
    no_slice = F.floor(F.col(rows) / (rows_per_slice + 1))
    cold = lookup.filter(~is_hot).select(F.col(key), no_slice.alias("_slice"), value.alias("_cold"))
    dealt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread_by), F.col("_slices")))
    joined = (
        facts.join(F.broadcast(hot), key, "left")
        .select(*facts.columns, "_hot", dealt.cast("bigint").alias("_slice"))
        .join(cold, [key, "_slice"], "left")
        .select(*facts.columns, F.coalesce("_hot", "_cold").alias("_value"))
    )
    if how == "inner":
        joined = joined.filter(F.col("_value").isNotNull())
    return joined.select(*facts.columns, *[F.col(f"_value.{c}").alias(c) for c in values])
