"""Corrected abundance, growth, and Monte-Carlo intervals of trends.

Estimates tables have one row per stock and year, so arrays per stock are short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline import fixed_values as fv
from tideline.functions import draws, expr
from tideline.operators.spread import explode_range


def corrected_abundance(estimates: DataFrame, theta: DataFrame, annual: DataFrame | None = None) -> DataFrame:
    """Abundance divided by the share of distinctive individuals, with a log-normal interval.

    ``theta`` has at most one row per stock; a stock without one keeps its rows, with nulls. ``annual`` adds
    sightings and individuals.
    """
    n, se, t, tv = (F.col(c) for c in ("n_hat", "se", "theta", "theta_var"))
    c_burn = F.exp(1.96 * F.sqrt(F.log(1 + F.pow("cvcond", F.lit(2.0)))))
    result = (
        estimates.join(theta, "stock", "left")
        .withColumn("n_i", n / t)
        .withColumn("varcond", se * se / (t * t) + tv * (n * n / F.pow(t, F.lit(4.0))))
        .withColumn("second", F.sqrt("varcond"))
        .withColumn("cvcond", F.col("second") / F.col("n_i"))
        .withColumn("lcl", expr.half_even(F.col("n_i") / c_burn))
        .withColumn("ucl", expr.half_even(F.col("n_i") * c_burn))
        .drop("theta", "theta_var")
    )
    if annual is None:
        return result
    return result.join(annual.withColumnRenamed("area", "stock"), ["stock", "year"], "left")


def as_estimates(corrected: DataFrame) -> DataFrame:
    """Corrected abundance in the columns of an estimates table, to draw trends from it instead."""
    return corrected.select("stock", "year", F.col("n_i").alias("n_hat"), F.col("second").alias("se"))


def annual_growth(abundance: DataFrame, value: str = "n_i") -> DataFrame:
    """Yearly growth in percent of the current year's value."""
    by_year = Window.partitionBy("stock").orderBy("year")
    years = F.col("year") - F.lag("year").over(by_year)
    change = F.col(value) - F.lag(value).over(by_year)
    return abundance.select(
        "stock",
        "year",
        F.col(value),
        years.alias("diff_year"),
        change.alias("diff_growth"),
        F.try_divide(change / years, F.col(value)).alias("_rate"),
    ).select("stock", "year", value, "diff_year", "diff_growth", (F.col("_rate") * 100).alias("rate_percent"))


def mean_growth(growth: DataFrame) -> DataFrame:
    return growth.groupBy("stock").agg(F.avg("rate_percent").alias("mean_growth"))


def trend_slope(estimates: DataFrame) -> DataFrame:
    """Least-squares slope and intercept of abundance on year, per stock."""
    return estimates.groupBy("stock").agg(
        F.regr_slope("n_hat", "year").alias("slope"), F.regr_intercept("n_hat", "year").alias("intercept")
    )


def diagonal_factor(estimates: DataFrame) -> DataFrame:
    """Covariance factor of independent years: the standard errors on the diagonal."""
    return estimates.select("stock", F.col("year").alias("year_i"), F.col("year").alias("year_j"), F.col("se").alias("l"))


def covariance_factor(covariance: DataFrame, tolerance: float = fv.FACTOR_TOLERANCE) -> DataFrame:
    """Factor of each stock's covariance (columns year_i, year_j, cov), which may be singular.

    Cholesky with pivots: the year with the most variance left is factored next, and ``year_j`` names it. It ends
    where no year has more than ``tolerance`` times the largest variance left: what remains is rounding, or the
    negative part that covariances over different replicates can have. Years without a variance are left out;
    a covariance that is null counts as 0. One small matrix per stock.
    """

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="year_i", columns="year_j", values="cov").sort_index().sort_index(axis=1)
        known = [y for y in wide.index if pd.notna(wide.at[y, y])]
        left = wide.loc[known, known].fillna(0.0).to_numpy(copy=True)
        least = tolerance * left.diagonal().max(initial=0.0)
        columns = []
        for _ in known:
            pivot = int(np.argmax(left.diagonal()))
            if left[pivot, pivot] <= least:
                break
            column = left[:, pivot] / np.sqrt(left[pivot, pivot])
            left -= np.outer(column, column)
            columns.append(pd.DataFrame({"year_i": known, "year_j": known[pivot], "l": column}))
        out = pd.concat(columns) if columns else pd.DataFrame({"year_i": [], "year_j": [], "l": []})
        return out.assign(stock=pdf["stock"].iloc[0])[["stock", "year_i", "year_j", "l"]]

    return covariance.groupBy("stock").applyInPandas(factor, "stock string, year_i int, year_j int, l double")


def abundance_draws(
    estimates: DataFrame, factor: DataFrame, replicates: int = fv.TREND_REPLICATES, seed: int = fv.SEED
) -> DataFrame:
    """Multivariate normal draws of annual abundance, from the uncorrected estimates and their factor.

    One row per stock carries the years, means and factor rows; it is repeated over all
    tasks and each draw is a product inside the row. Years without an estimate are not drawn;
    an estimate without a row of the factor has no variance.
    """
    entry = "array<struct<year_j:int,l:double>>"
    rows = factor.groupBy("stock", F.col("year_i").alias("year")).agg(
        F.collect_list(F.struct(F.col("year_j").cast("int").alias("year_j"), "l")).alias("row")
    )
    point = F.struct("year", "n_hat", F.coalesce("row", F.array().cast(entry)).alias("row"))
    stocks = (
        estimates.filter(F.col("n_hat").isNotNull())
        .join(rows, ["stock", "year"], "left")
        .groupBy("stock")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .withColumn("axes", F.array_distinct(F.flatten(F.transform("points", lambda p: p["row"]["year_j"]))))
    )
    repeated = explode_range(stocks, "rep", replicates)
    normal = F.map_from_arrays(
        "axes", F.transform("axes", lambda y: draws.standard_normal(seed, "trend", F.col("stock"), F.col("rep"), y))
    )
    deviation = F.aggregate(
        "point.row", F.lit(0.0), lambda total, e: total + e["l"] * F.element_at("normal", e["year_j"])
    )
    return (
        repeated.withColumn("normal", normal)
        .select("stock", "rep", "normal", F.explode("points").alias("point"))
        .select("stock", "rep", F.col("point.year").alias("year"), (F.col("point.n_hat") + deviation).alias("n_hat"))
    )


def _interval(slopes: DataFrame, *groups: str) -> DataFrame:
    ends = F.array(F.lit(0.025), F.lit(0.975))
    quantiles = slopes.groupBy(*groups).agg(
        F.percentile("slope", ends).alias("slope"), F.percentile("intercept", ends).alias("intercept")
    )
    columns = [F.col(c)[i].alias(f"{c}_{end}") for c in ("slope", "intercept") for i, end in enumerate(("low", "high"))]
    return quantiles.select(*groups, *columns)


def _lines(draws_by_year: DataFrame, *groups: str) -> DataFrame:
    return draws_by_year.groupBy(*groups).agg(
        F.regr_slope("n_hat", "year").alias("slope"), F.regr_intercept("n_hat", "year").alias("intercept")
    )


def trend_interval_stock(abundance: DataFrame) -> DataFrame:
    """95 % interval of each stock's slope and intercept over the draws."""
    return _interval(_lines(abundance, "stock", "rep"), "stock")


def _years_of_all_stocks(rows: DataFrame, estimates: DataFrame, *groups: str) -> DataFrame:
    # A year without an estimate of a stock, or with a null one, is not a year of all stocks.
    n_stocks = estimates.agg(F.countDistinct(F.when(F.col("n_hat").isNotNull(), F.col("stock")))).scalar()
    return rows.groupBy(*groups, "year").agg(F.sum("n_hat").alias("n_hat"), F.count("n_hat").alias("stocks")).filter(
        F.col("stocks") == n_stocks
    )


def trend_interval_pooled(abundance: DataFrame, estimates: DataFrame) -> DataFrame:
    """95 % interval of the total's slope and intercept, over the years that have every stock."""
    return _interval(_lines(_years_of_all_stocks(abundance, estimates, "rep"), "rep"))


def common_years(estimates: DataFrame) -> DataFrame:
    """Number of years that have every stock."""
    return _years_of_all_stocks(estimates, estimates).agg(F.count("*").alias("years"))
