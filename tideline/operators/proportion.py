"""Proportion of distinctive individuals and of good photos, and their analysis of variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline import fixed_values as fv
from tideline.functions import expr, tails
from tideline.operators import curate


def encounter_counts(sightings: DataFrame, min_rows: int = fv.MIN_QUALITY_ROWS) -> DataFrame:
    """Row counts per area, year and encounter, of the encounters in ``curate.distinctiveness_base``.

    The rows are counted before the encounters are chosen, so no row is joined.
    """
    counts = (
        curate.own_survey_rows(sightings)
        .groupBy("area", "year", "encounter_id")
        .agg(
            F.count("*").alias("n_rows"),
            expr.count_true(curate.good_photo()).alias("n_good"),
            expr.count_true(curate.good_photo() & curate.distinctive()).alias("n_quality"),
        )
    )
    whole_encounter = F.sum("n_quality").over(Window.partitionBy("encounter_id"))
    return counts.withColumn("encounter_quality", whole_encounter).filter(F.col("encounter_quality") >= min_rows)


def distinctive_by_encounter(counts: DataFrame) -> DataFrame:
    """Share of distinctive individuals among the good photos of each encounter."""
    return counts.filter("n_good > 0").select(
        "area", "year", "encounter_id", (F.col("n_quality") / F.col("n_good")).alias("prop34")
    )


def good_photos_by_encounter(counts: DataFrame) -> DataFrame:
    """Share of good photos in each encounter."""
    return counts.select("area", "year", "encounter_id", (F.col("n_good") / F.col("n_rows")).alias("propgood"))


def yearly_summary(shares: DataFrame, value: str) -> DataFrame:
    """Mean, deviation, standard error and variance over encounters, per area and year."""
    return shares.groupBy("area", "year").agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"),
        F.var_samp(value).alias("var"),
    )


def theta(summary: DataFrame, stocks: list[str] = fv.STOCKS) -> DataFrame:
    """Per stock, the plain mean over years of the yearly means and variances.

    An area counts for a stock when it contains the stock's first four letters.
    """
    return (
        summary.withColumn("stock", F.explode(F.array(*[F.lit(s) for s in stocks])))
        .filter(F.col("area").contains(F.substring("stock", 1, 4)))
        .groupBy("stock")
        .agg(F.avg("mean").alias("theta"), F.avg("var").alias("theta_var"))
    )


def _sums(shares: DataFrame, value: str) -> DataFrame:
    """Regression sums of ``value`` on year: over all rows, and added up over areas."""
    x, y = F.col("year").cast("double"), F.col(value)
    per_area = (
        shares.rollup("area")
        .agg(
            F.grouping_id().alias("is_total"),
            F.regr_count(y, x).alias("n"),
            F.regr_sxx(y, x).alias("sxx"),
            F.regr_sxy(y, x).alias("sxy"),
            F.regr_syy(y, x).alias("syy"),
        )
        .withColumn("sloped", (F.col("sxx") > 0) & (F.col("is_total") == 0))
    )
    total, part = F.col("is_total") == 1, F.col("is_total") == 0

    def one(name):
        return F.max(F.when(total, F.col(name))).alias(f"{name}_total")

    def added(column, name):
        return F.sum(F.when(part, column)).alias(name)

    return per_area.agg(
        F.coalesce(one("n"), F.lit(0)).alias("n_total"),
        one("sxx"),
        one("sxy"),
        one("syy"),
        F.count_if(part).alias("areas"),
        F.count_if("sloped").alias("slopes"),
        added(F.col("sxx"), "sxx_within"),
        added(F.col("sxy"), "sxy_within"),
        added(F.col("syy"), "syy_within"),
        F.sum(F.when(F.col("sloped"), F.col("sxy") * F.col("sxy") / F.col("sxx"))).alias("slope_ss"),
    )


def _table(sums: DataFrame, terms: list[tuple[str, Column, Column]]) -> DataFrame:
    """Long table of terms (name, df, sum of squares); the last one is the residual."""
    rows = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("term"),
                df.cast("bigint").alias("df"),
                ss.alias("sum_sq"),
            )
            for position, (name, df, ss) in enumerate(terms)
        ]
    )
    _, residual_df, residual_ss = terms[-1]
    residual = F.col("term") == terms[-1][0]
    return (
        sums.select(F.explode(rows).alias("t"), residual_df.cast("double").alias("rdf"), residual_ss.alias("rss"))
        .select("t.*", "rdf", "rss")
        .withColumn("mean_sq", F.try_divide("sum_sq", F.col("df").cast("double")))
        .withColumn("f_value", F.when(~residual, F.try_divide("mean_sq", F.try_divide("rss", "rdf"))))
        .withColumn("p_value", tails.f_upper_tail(F.col("f_value"), F.col("df").cast("double"), F.col("rdf")))
        .orderBy("position")
        .select("term", "df", "sum_sq", "mean_sq", "f_value", "p_value")
    )


def anova_area_year_interaction(shares: DataFrame, value: str) -> DataFrame:
    """Sequential analysis of variance of area, then year, then a slope per area."""
    c = F.col
    common = F.try_divide(c("sxy_within") * c("sxy_within"), c("sxx_within"))
    terms = [
        ("area", F.greatest(c("areas") - 1, F.lit(0)), c("syy_total") - c("syy_within")),
        ("year", F.least(c("slopes"), F.lit(1)), common),
        ("area:year", F.greatest(c("slopes") - 1, F.lit(0)), c("slope_ss") - common),
        ("residuals", c("n_total") - c("areas") - c("slopes"), c("syy_within") - c("slope_ss")),
    ]
    return _table(_sums(shares, value), terms)


def anova_year_area(shares: DataFrame, value: str) -> DataFrame:
    """Sequential analysis of variance of year, then area."""
    c = F.col
    year_ss = F.try_divide(c("sxy_total") * c("sxy_total"), c("sxx_total"))
    residual_ss = c("syy_within") - F.try_divide(c("sxy_within") * c("sxy_within"), c("sxx_within"))
    terms = [
        ("year", F.lit(1), year_ss),
        ("area", F.greatest(c("areas") - 1, F.lit(0)), c("syy_total") - year_ss - residual_ss),
        ("residuals", c("n_total") - c("areas") - 1, residual_ss),
    ]
    return _table(_sums(shares, value), terms)
