"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline import fixed_values as fv
from tideline.functions import draws, expr
from tideline.operators import (
    curate,
    discovery,
    effort,
    models,
    movement,
    proportion,
    ranktest,
    recapture,
    resight,
    sampling,
    trend,
)
from tideline.plans import reports
from tideline.plans.study import Study
from tideline.sources import orders_as_sightings as source

FIRST_YEAR, LAST_YEAR = 1996, 2001
DECIMALS = 6

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def study(spark: SparkSession, sf_dir: str) -> Study:
    @functools.cache
    def load(types: bool) -> DataFrame:
        return source.with_sight_type(load(False)) if types else source.sightings(spark, sf_dir)

    return Study(load, FIRST_YEAR, LAST_YEAR)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of decimals, so that engines with another order of addition agree."""
    return df.select(
        *[
            (F.bround(c.name, DECIMALS) + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, T.DoubleType) else c.name
            for c in df.schema
        ]
    )


def on_study(name: str):
    """Register a function of a study."""

    def register(build: Callable[[Study], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: rounded(build(study(spark, sf_dir)))
        return build

    return register


def on_tables(name: str):
    """Register a function of (spark, sf_dir)."""

    def register(build: Query):
        _QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Reading and row-wise steps


@on_study("sightings_raw")
def _(s: Study) -> DataFrame:
    return s.sightings(types=True)


@on_study("parse_dates")
def _(s: Study) -> DataFrame:
    text = """CASE row_seq % 6 WHEN 0 THEN date_format(sight_date, 'd-MMM-yyyy')
        WHEN 1 THEN date_format(sight_date, 'dd-MMM-yyyy') WHEN 2 THEN lower(date_format(sight_date, 'dd-MMM-yyyy'))
        WHEN 3 THEN date_format(sight_date, 'dd-MMMM-yyyy') WHEN 4 THEN date_format(sight_date, 'dd-MMM-yyyy') || ' pm'
        ELSE date_format(sight_date, 'dd/MM/yyyy') END"""
    dates = s.sightings().select("row_seq", F.expr(text).alias("text"))
    parsed = dates.select("row_seq", expr.clean_date(F.col("text")).alias("sight_date"))
    return parsed.withColumn("year", F.year("sight_date"))


@on_study("parse_numbers")
def _(s: Study) -> DataFrame:
    text = """CASE row_seq % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN concat(' ', row_seq % 900, '.5 ')
        WHEN 3 THEN concat(row_seq % 900, 'd') ELSE concat('-', row_seq % 900) END"""
    return s.sightings().select("row_seq", expr.clean_number(F.expr(text)).alias("number"))


@on_study("lon_repair")
def _(s: Study) -> DataFrame:
    return curate.repair_longitude(s.sightings()).select("row_seq", "lon")


@on_study("normalize_area")
def _(s: Study) -> DataFrame:
    return curate.repair_labels(s.sightings()).select("row_seq", "area")


@on_study("normalize_sight_type")
def _(s: Study) -> DataFrame:
    return curate.repair_sight_types(s.sightings(types=True)).select("row_seq", "sight_type")


@on_study("classify_subarea")
def _(s: Study) -> DataFrame:
    rows = curate.repair_labels(s.sightings())
    return rows.select("row_seq", expr.subarea(F.col("area"), F.col("lat"), F.col("lon")).alias("subarea"))


@on_study("sight_subarea")
def _(s: Study) -> DataFrame:
    return resight.sighting_subareas(s.stratified()).select("row_seq", "sight_subarea", "subarea", "in_subarea")


@on_study("display_names")
def _(s: Study) -> DataFrame:
    return effort.area_names(s.curated())


@on_study("keyed_uniform")
def _(s: Study) -> DataFrame:
    return s.sightings().select("row_seq", draws.uniform(fv.SEED, "check", F.col("row_seq")).alias("u"))


# Curated tables


@on_study("curated_sightings")
def _(s: Study) -> DataFrame:
    return s.curated(types=True)


@on_study("first_located")
def _(s: Study) -> DataFrame:
    return curate.first_located(s.sightings(types=True))


@on_study("individual_subarea")
def _(s: Study) -> DataFrame:
    return curate.individual_subarea(s.sightings())


@on_study("stratified_sightings")
def _(s: Study) -> DataFrame:
    return s.stratified(types=True)


@on_study("first_located_map")
def _(s: Study) -> DataFrame:
    return curate.first_located_map(s.sightings())


@on_study("model_sightings")
def _(s: Study) -> DataFrame:
    return curate.model_sightings(s.stratified())


@on_study("distinctiveness_base")
def _(s: Study) -> DataFrame:
    return curate.distinctiveness_base(s.sightings())


@on_study("movement_base")
def _(s: Study) -> DataFrame:
    return curate.movement_base(s.curated())


@on_study("all_sightings_of_flagged")
def _(s: Study) -> DataFrame:
    return curate.rows_of_individuals_seen_at(s.sightings())


@on_study("source_subset")
def _(s: Study) -> DataFrame:
    return curate.rows_from_pwf(s.curated())


@on_study("seen_once")
def _(s: Study) -> DataFrame:
    return curate.seen_once(s.curated(types=True))


# Effort


@on_study("seen_once_count")
def _(s: Study) -> DataFrame:
    in_curated = effort.seen_once_count(s.curated()).scalar()
    return effort.seen_once_count(s.sightings()).withColumn("curated_seen_once", in_curated)


@on_study("period_totals")
def _(s: Study) -> DataFrame:
    return effort.period_totals(s.sightings(), FIRST_YEAR, LAST_YEAR)


@on_study("nonresident_count")
def _(s: Study) -> DataFrame:
    return effort.nonresident_count(s.sightings())


@on_study("cross_stock_individuals")
def _(s: Study) -> DataFrame:
    return effort.cross_stock_individuals(s.stratified())


@on_study("sighting_median")
def _(s: Study) -> DataFrame:
    return effort.sighting_median(s.curated())


@on_study("sighting_max")
def _(s: Study) -> DataFrame:
    return effort.sighting_max(s.curated())


@on_study("sighting_median_by_year")
def _(s: Study) -> DataFrame:
    return effort.sighting_median_by_year(s.curated())


@on_study("discovery_by_area")
def _(s: Study) -> DataFrame:
    return discovery.discovery(s.curated(types=True), "area")


@on_study("discovery_by_subarea")
def _(s: Study) -> DataFrame:
    return discovery.discovery(s.stratified(types=True), "subarea")


@on_study("discovery_endpoints")
def _(s: Study) -> DataFrame:
    return discovery.endpoints(discovery.discovery(s.curated(types=True), "area"), "area")


@on_study("discovery_small")
def _(s: Study) -> DataFrame:
    return discovery.small_curves(discovery.discovery(s.stratified(types=True), "subarea"), "subarea")


@on_study("unstratified_individuals")
def _(s: Study) -> DataFrame:
    return effort.unstratified_individuals(s.stratified())


@on_study("subarea_individuals")
def _(s: Study) -> DataFrame:
    return effort.subarea_individuals(s.stratified())


@on_study("report_encounters")
def _(s: Study) -> DataFrame:
    return reports.encounters(s)


@on_study("encounters_by_year_long")
def _(s: Study) -> DataFrame:
    return effort.encounters_by_year(s.stratified())


@on_study("effort_by_year")
def _(s: Study) -> DataFrame:
    return effort.effort_by_year(s.curated(), "Oahu")


@on_study("windward_effort")
def _(s: Study) -> DataFrame:
    return effort.windward_effort(s.curated(exclude_windward=False))


@on_study("windward_resighted")
def _(s: Study) -> DataFrame:
    return effort.windward_resighted(s.curated(exclude_windward=False))


@on_study("contributions")
def _(s: Study) -> DataFrame:
    return effort.contributions(s.curated())


@on_study("annual_sightings")
def _(s: Study) -> DataFrame:
    return effort.annual_sightings(s.curated())


@on_study("dataset_headline")
def _(s: Study) -> DataFrame:
    return effort.dataset_headline(s.curated())


@on_study("years_seen")
def _(s: Study) -> DataFrame:
    return effort.years_seen(s.curated())


@on_study("resight_share")
def _(s: Study) -> DataFrame:
    return resight.resight_share(resight.sighting_subareas(s.stratified()))


@on_study("resight_share_mean")
def _(s: Study) -> DataFrame:
    return resight.resight_share_mean(resight.resight_share(resight.sighting_subareas(s.stratified())))


@on_study("resight_elsewhere")
def _(s: Study) -> DataFrame:
    return resight.resight_elsewhere(resight.sighting_subareas(s.stratified()))


# Proportion distinctive


@on_study("prop_distinctive_encounter")
def _(s: Study) -> DataFrame:
    return proportion.distinctive_by_encounter(s.encounter_counts())


@on_study("prop_good_photo_encounter")
def _(s: Study) -> DataFrame:
    return proportion.good_photos_by_encounter(s.encounter_counts())


@on_study("prop_summary")
def _(s: Study) -> DataFrame:
    return s.proportion_summary()


@on_study("good_photo_summary")
def _(s: Study) -> DataFrame:
    return proportion.yearly_summary(proportion.good_photos_by_encounter(s.encounter_counts()), "propgood")


@on_study("theta")
def _(s: Study) -> DataFrame:
    return s.theta()


@on_study("report_theta")
def _(s: Study) -> DataFrame:
    return reports.proportion_distinctive(s)


@on_study("anova_area_year_interaction")
def _(s: Study) -> DataFrame:
    return proportion.anova_area_year_interaction(
        proportion.distinctive_by_encounter(s.encounter_counts()), "prop34"
    )


@on_study("anova_year_area")
def _(s: Study) -> DataFrame:
    return proportion.anova_year_area(proportion.good_photos_by_encounter(s.encounter_counts()), "propgood")


# Sampling null


@on_study("occasion_params")
def _(s: Study) -> DataFrame:
    return sampling.occasion_params(s.curated(types=True), "area")


@on_study("rank_sum")
def _(s: Study) -> DataFrame:
    """Sightings per individual in the earlier against the later years of each area."""
    half = F.when(F.col("year") <= 1998, "early").otherwise("late")
    counts = effort.sightings_per_individual(s.curated().withColumn("type", half), "area", "type")
    frequencies = counts.select("area", "type", F.col("sightings").alias("value"), F.col("individuals").alias("n"))
    return ranktest.rank_sum(frequencies, "area", "early", "late")


@on_study("random_sampling_test_area")
def _(s: Study) -> DataFrame:
    return sampling.random_sampling_test(sampling.resight_frequencies(s.curated(types=True), "area"), "area")


@on_study("random_sampling_test_subarea")
def _(s: Study) -> DataFrame:
    return sampling.random_sampling_test(sampling.resight_frequencies(s.stratified(types=True), "subarea"), "subarea")


@on_study("resight_density")
def _(s: Study) -> DataFrame:
    return ranktest.density(sampling.resight_frequencies(s.curated(types=True), "area"), "area")


# Movement


@on_study("sample_one_per_key")
def _(s: Study) -> DataFrame:
    return movement.sample_one_per_year(movement.positions(s.curated()), 3)


@on_study("pair_distance")
def _(s: Study) -> DataFrame:
    picks = movement.sample_one_per_year(movement.positions(s.curated()), 1)
    return movement.individual_distance(picks, ["area", "rep"])


@on_study("movement_truth")
def _(s: Study) -> DataFrame:
    return movement.observed_distances(s.curated())


@on_study("movement_null")
def _(s: Study) -> DataFrame:
    return movement.movement_distances(s.curated(), types=(movement.TEST,))


@on_study("movement_test")
def _(s: Study) -> DataFrame:
    return movement.movement_test(movement.movement_distances(s.curated()))


@on_study("movement_histogram")
def _(s: Study) -> DataFrame:
    return movement.movement_histogram(movement.movement_distances(s.curated()))


# Capture-recapture


@on_study("occasion_gaps")
def _(s: Study) -> DataFrame:
    return recapture.occasion_gaps(s.individual_years())


@on_study("capture_history")
def _(s: Study) -> DataFrame:
    return recapture.capture_histories(s.individual_years())


@on_study("history_frequency")
def _(s: Study) -> DataFrame:
    return recapture.history_frequency(recapture.capture_histories(s.individual_years()))


@on_study("occasion_statistics")
def _(s: Study) -> DataFrame:
    return recapture.occasion_statistics(s.individual_years()).drop("last", "only")


@on_study("m_array")
def _(s: Study) -> DataFrame:
    return recapture.m_array(s.individual_years())


@on_study("overdispersion")
def _(s: Study) -> DataFrame:
    return recapture.overdispersion(s.individual_years())


@on_study("jolly_seber")
def _(s: Study) -> DataFrame:
    return s.jolly_seber()


@on_study("parameter_ranges")
def _(s: Study) -> DataFrame:
    photos = proportion.yearly_summary(proportion.good_photos_by_encounter(s.encounter_counts()), "propgood")
    percent = photos.agg(F.avg("mean") * 100).scalar()
    return recapture.parameter_ranges(s.jolly_seber()).withColumn("good_photo_percent", percent)


@on_study("entry_parameters")
def _(s: Study) -> DataFrame:
    return recapture.entry_parameters(s.individual_years())


@on_study("derived_abundance")
def _(s: Study) -> DataFrame:
    return recapture.derived_abundance(recapture.entry_parameters(s.individual_years()))


@on_study("abundance_bootstrap")
def _(s: Study) -> DataFrame:
    return s.abundance_replicates()


@on_study("bootstrap_covariance")
def _(s: Study) -> DataFrame:
    return s.abundance_covariance()


# Model tables


@on_tables("model_weights")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.model_table(models.model_weights(source.model_fits(spark, sf_dir)))


@on_tables("report_models")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.model_selection(source.model_fits(spark, sf_dir))


@on_tables("model_average")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.model_average(source.model_fits(spark, sf_dir))


@on_tables("report_survival")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.survival(source.model_fits(spark, sf_dir))


# Abundance and trends


@on_study("minimum_abundance")
def _(s: Study) -> DataFrame:
    return s.minimum_abundance()


@on_study("corrected_abundance")
def _(s: Study) -> DataFrame:
    return s.corrected_abundance()


@on_study("report_abundance")
def _(s: Study) -> DataFrame:
    return reports.abundance(s)


@on_study("annual_growth")
def _(s: Study) -> DataFrame:
    return trend.annual_growth(s.corrected_abundance())


@on_study("mean_growth")
def _(s: Study) -> DataFrame:
    return trend.mean_growth(trend.annual_growth(s.corrected_abundance()))


@on_study("trend_slope")
def _(s: Study) -> DataFrame:
    return trend.trend_slope(s.jolly_seber().withColumnRenamed("area", "stock"))


@on_study("abundance_draws")
def _(s: Study) -> DataFrame:
    """To the accuracy that covariances of another order of addition leave."""
    return s.abundance_draws().withColumn("n_hat", F.bround("n_hat", 3))


@on_study("trend_interval_stock")
def _(s: Study) -> DataFrame:
    return trend.trend_interval_stock(s.abundance_draws())


@on_study("trend_interval_pooled")
def _(s: Study) -> DataFrame:
    return trend.trend_interval_pooled(s.abundance_draws(), s.jolly_seber().withColumnRenamed("area", "stock"))


@on_study("common_years")
def _(s: Study) -> DataFrame:
    return trend.common_years(s.jolly_seber().withColumnRenamed("area", "stock"))
