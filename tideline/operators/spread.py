"""Expanding small tables and numbering large groups over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1000


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repeat(df: DataFrame, name: str, first: int, last: int, *keys: str) -> DataFrame:
    """Repeat every row of a large table for ``name`` = ``first`` .. ``last``.

    The rows are first dealt to a fixed number of tasks by ``keys``, which tell rows
    apart: their size before repeating says nothing about the work after it, so
    neither file splits nor adaptive merging may decide. They are dealt by a hash of
    the keys: by the keys themselves, an exchange of the same keys before would be
    taken for this one, and adaptive execution would merge it into a task.
    """
    return df.repartition(_tasks(df), F.xxhash64(*keys)).withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last))))


def explode_range(df: DataFrame, name: str, last: Column | int, block: int = BLOCK) -> DataFrame:
    """Repeat each row for ``name`` = 1 .. ``last`` (none for zero or null).

    The range is first cut into blocks that are dealt to all tasks, so a few input
    rows do not expand inside a few tasks.
    """
    last = F.lit(last) if isinstance(last, int) else last
    blocks = (
        df.withColumn("_last", last.cast("bigint"))
        .filter("_last > 0")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"(_last - 1) div {block}"))))
        .withColumn("_from", F.col("_block") * block + 1)
        .withColumn("_to", F.least("_last", F.col("_block") * block + block))
    )
    return (
        blocks.repartition(_tasks(df))
        .withColumn(name, F.explode(F.sequence("_from", "_to")))
        .drop("_last", "_block", "_from", "_to")
    )


def number_at_random(
    df: DataFrame, groups: list[str], key: Column, sizes: DataFrame, rows_per_slice: int, name: str = "position"
) -> DataFrame:
    """Number the rows of each group 1 .. n in the order of ``key``, a 60-bit random order key.

    ``sizes`` has the rows ``n`` per group, by some of the group columns, and few rows. A group of more than
    ``rows_per_slice`` rows is cut into so many slices of the key's range that they hold about that many each;
    its rows are numbered inside each slice, and the sizes of the slices before are added. Only such groups
    are counted.
    """
    by = [c for c in groups if c in sizes.columns]
    slices = sizes.select(*by, F.ceil(F.col("n") / rows_per_slice).cast("bigint").alias("_slices"))
    place = F.floor(F.col("_key") / float(1 << 60) * F.col("_slices")).cast("bigint")
    keyed = (
        df.select("*", key.alias("_key"))
        .join(F.broadcast(slices), by)
        .select(*df.columns, "_key", "_slices", F.least(place, F.col("_slices") - 1).alias("_slice"))
    )
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.filter("_slices > 1")
        .groupBy(*groups, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(*groups, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy("_key")
    return (
        keyed.select(*df.columns, "_slice", F.row_number().over(inside).alias("_rank"))
        .join(offsets, [*groups, "_slice"], "left")
        .select(*df.columns, (F.coalesce("_offset", F.lit(0)) + F.col("_rank")).alias(name))
    )
