"""Discovery curves: cumulative new individuals against cumulative sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline import fixed_values as fv
from tideline.functions import expr


def discovery(curated: DataFrame, stratum: str = "area") -> DataFrame:
    """Sighting types per stratum and year with running totals.

    A year whose sightings are all of another type stays as a row of zeros.
    """
    names = dict(zip(fv.DISCOVERY_TYPES, ["original", "within_year", "between_year"], strict=True))
    yearly = (
        curated.filter(F.col(stratum).isNotNull())
        .groupBy(stratum, "year")
        .agg(*[expr.count_true(F.col("sight_type") == label).alias(name) for label, name in names.items()])
        .withColumn("total_sight", F.expr("original + within_year + between_year"))
    )
    so_far = Window.partitionBy(stratum).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return yearly.withColumns(
        {"cum_original": F.sum("original").over(so_far), "cum_sight": F.sum("total_sight").over(so_far)}
    )


def endpoints(curves: DataFrame, stratum: str = "area") -> DataFrame:
    """The end of each curve with its label."""
    longest_first = Window.partitionBy(stratum).orderBy(F.desc("cum_sight"), "year")
    return (
        curves.withColumn("n", F.row_number().over(longest_first))
        .filter("n = 1")
        .select(stratum, "cum_sight", "cum_original", expr.display_name(F.col(stratum)).alias("label"))
    )


def small_curves(curves: DataFrame, stratum: str = "subarea") -> DataFrame:
    """Curves that never pass both size limits."""
    large = curves.filter(
        (F.col("cum_original") > fv.LARGE_CURVE_ORIGINAL) & (F.col("cum_sight") > fv.LARGE_CURVE_SIGHT)
    )
    return curves.join(large.select(stratum).distinct(), stratum, "left_anti")
