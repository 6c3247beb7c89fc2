"""The report tables, in report column order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tideline.operators import effort, models
from tideline.plans.study import Study


def encounters(study: Study) -> DataFrame:
    """Table 1: encounters by stock, subarea and contributor."""
    return effort.encounter_report(study.stratified())


def model_selection(fits: DataFrame, **skew) -> DataFrame:
    """Table 2: fitted models by weight within each stock."""
    table = models.model_table(models.model_weights(fits, **skew), label_weights=True)
    return table.orderBy("stock", "qaicc", "model_id")


def survival(fits: DataFrame, **skew) -> DataFrame:
    """Table 3: model-averaged survival per stock."""
    averages = models.model_average(fits, **skew)
    return models.first_parameter(averages).orderBy("stock")


def proportion_distinctive(study: Study) -> DataFrame:
    """Table 4: proportion of distinctive individuals per stock."""
    return study.theta().orderBy("stock")


def abundance(study: Study) -> DataFrame:
    """Table 5: corrected annual abundance with effort."""
    return study.corrected_abundance(effort.annual_sightings(study.curated())).select(
        "stock", "year", "n_hat", "se", "n_i", "varcond", "second", "cvcond", "lcl", "ucl", "sightings", "individuals"
    ).orderBy("stock", "year")
