"""Model weights and model-averaged parameters over tables of fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fv
from tideline.functions import expr
from tideline.operators.skew import lookup_join


FIT = ["stock", "model_id", "npar", "neg2lnl", "n_eff", "chat"]


def model_weights(models: DataFrame, **skew) -> DataFrame:
    """Criterion, difference from the best and weight of each model within its stock, one row per model.

    The table may have a row per model and parameter; what describes the fit is the same in all of them.
    The criterion is corrected for over-dispersion where ``chat`` is above 1. The
    stock's best value and its weight sum come from two aggregates, so the models of
    one stock are never gathered.
    """
    k, c = F.col("npar").cast("double"), F.greatest("chat", F.lit(1.0))
    scored = models.select(*FIT).distinct().withColumn(
        "qaicc", F.col("neg2lnl") / c + 2 * k + F.try_divide(2 * k * (k + 1), F.col("n_eff") - k - 1)
    )
    best = scored.groupBy("stock").agg(F.min("qaicc").alias("best"), F.count("*").alias("rows"))
    compared = (
        lookup_join(scored, best, "stock", rows="rows", spread_by="model_id", **skew)
        .withColumn("delta", F.col("qaicc") - F.col("best"))
        .withColumn("likelihood", F.exp(-F.col("delta") / 2))
        .drop("best")
    )
    sums = compared.groupBy("stock").agg(F.sum("likelihood").alias("sum_likelihood"), F.count("*").alias("rows"))
    return (
        lookup_join(compared, sums, "stock", rows="rows", spread_by="model_id", **skew)
        .withColumn("weight", F.col("likelihood") / F.col("sum_likelihood"))
        .drop("likelihood", "sum_likelihood")
    )


def model_table(weighted: DataFrame, label_weights: bool = False) -> DataFrame:
    """Models above the smallest reported weight; weights optionally as text of four digits."""
    table = weighted.filter(F.col("weight") > fv.MIN_MODEL_WEIGHT).select(
        "stock", "model_id", "npar", "qaicc", "delta", "weight", "chat"
    )
    if not label_weights:
        return table
    shown = expr.half_even(F.col("weight"), 4).cast("decimal(5,4)").cast("string")
    return table.withColumn(
        "weight", F.when(F.col("weight") >= fv.MIN_MODEL_WEIGHT, shown).otherwise(f"< {fv.MIN_MODEL_WEIGHT:.4f}")
    )


def model_average(models: DataFrame, **skew) -> DataFrame:
    """Weighted estimate per stock and parameter, with a standard error that includes model spread.

    ``models`` has one row per stock, model and parameter; each model's weight goes to all its parameters.
    Weights are as many as models, whatever size the files suggest, so they meet their parameters in a
    shuffle and are never broadcast.
    """
    weights = model_weights(models, **skew).select("stock", "model_id", "weight")
    parameters = models.select("stock", "model_id", "parameter", "estimate", "se")
    keyed = parameters.join(weights.hint("merge"), ["stock", "model_id"]).withColumn("what", F.struct("stock", "parameter"))
    averages = keyed.groupBy("what").agg(
        F.sum(F.col("weight") * F.col("estimate")).alias("average"), F.count("*").alias("rows")
    )
    spread = F.sqrt(F.pow("se", F.lit(2.0)) + F.pow(F.col("estimate") - F.col("average"), F.lit(2.0)))
    return (
        lookup_join(keyed, averages, "what", rows="rows", spread_by="model_id", **skew)
        .groupBy("what")
        .agg(F.max("average").alias("estimate"), F.sum(F.col("weight") * spread).alias("se"))
        .select("what.stock", "what.parameter", "estimate", "se")
    )


def first_parameter(averages: DataFrame) -> DataFrame:
    """Per stock the first parameter only, as reported for survival."""
    return averages.groupBy("stock").agg(
        F.min_by("estimate", "parameter").alias("estimate"), F.min_by("se", "parameter").alias("se")
    )
