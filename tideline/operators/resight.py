"""Share of re-sightings in the subarea of the first sighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fv
from tideline.functions import expr
from tideline.operators import curate
from tideline.operators.skew import lookup_join


def sighting_subareas(stratified: DataFrame, scheme: str = "each_sighting") -> DataFrame:
    """Located rows with the subarea of the sighting and whether it is that of the individual."""
    rows = stratified.filter(curate.located())
    return rows.withColumn(
        "sight_subarea", expr.subarea(F.col("area"), F.col("lat"), F.col("lon"), scheme)
    ).withColumn("in_subarea", F.col("sight_subarea") == F.col("subarea"))


def resight_share(placed: DataFrame, drop_singletons: bool = False) -> DataFrame:
    """Per individual, the share of rows after the first (in row order) inside its subarea.

    The row of an individual with one row counts as a re-sighting unless
    ``drop_singletons``. Rows are not ordered in one place: the share is the
    individual's total without its first row.
    """
    inside = F.coalesce("in_subarea", F.lit(False)).cast("int")
    per_individual = placed.groupBy("individual_id").agg(
        F.count("*").alias("n"),
        F.sum(inside).alias("n_inside"),
        F.min_by(inside, "row_seq").alias("first_inside"),
    )
    if drop_singletons:
        per_individual = per_individual.filter("n > 1")
    share = F.when(F.col("n") == 1, F.col("n_inside")).otherwise(
        (F.col("n_inside") - F.col("first_inside")) / (F.col("n") - 1)
    )
    return per_individual.select("individual_id", expr.half_even(share.cast("double"), 2).alias("prob_subarea"))


def resight_share_mean(shares: DataFrame) -> DataFrame:
    return shares.agg(F.avg("prob_subarea").alias("mean_prob_subarea"))


def resight_elsewhere(placed: DataFrame, **skew) -> DataFrame:
    """Rows after an individual's first that lie outside its subarea."""
    firsts = placed.groupBy("individual_id").agg(F.count("*").alias("n"), F.min("row_seq").alias("first_row"))
    lookup = firsts.select("individual_id", "first_row", "n", F.col("n").alias("rows"))
    elsewhere = placed.filter(~F.col("in_subarea"))
    return (
        lookup_join(elsewhere, lookup, "individual_id", rows="rows", how="inner", **skew)
        .filter((F.col("n") == 1) | (F.col("row_seq") > F.col("first_row")))
        .drop("n", "first_row")
    )
