"""Effort summaries: counts of sightings, individuals and encounters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fv
from tideline.functions import expr
from tideline.operators import curate


def seen_once_count(sightings: DataFrame) -> DataFrame:
    """Number of individuals with exactly one row."""
    per_individual = sightings.groupBy("individual_id").agg(F.count("*").alias("n"))
    return per_individual.agg(F.count_if(F.col("n") == 1).alias("individuals_seen_once"))


def period_totals(sightings: DataFrame, first_year: int = fv.FIRST_YEAR, last_year: int = fv.LAST_YEAR) -> DataFrame:
    """Rows in the years, and individuals whose first row in file order is in the years."""
    inside = F.col("year").between(first_year, last_year)
    return (
        sightings.groupBy("individual_id")
        .agg(
            F.min_by(F.coalesce(inside, F.lit(False)), "row_seq").alias("first_inside"),
            expr.count_true(inside).alias("rows_inside"),
        )
        .agg(
            F.count_if("first_inside").alias("individuals"),
            F.coalesce(F.sum("rows_inside"), F.lit(0)).alias("observations"),
        )
    )


def nonresident_count(sightings: DataFrame) -> DataFrame:
    """Individuals with exactly one row offshore, deeper than the limit or at the excluded place."""
    outside = (
        (F.col("area") == fv.OFFSHORE_AREA)
        | (F.col("depth_m") > fv.DEPTH_LIMIT)
        | (F.col("island") == fv.EXCLUDED_PLACE)
    )
    return seen_once_count(sightings.filter(outside)).withColumnRenamed("individuals_seen_once", "nonresidents")


def sightings_per_individual(curated: DataFrame, *groups: str) -> DataFrame:
    """How many individuals have 1, 2, ... sightings, per group."""
    return (
        curated.groupBy(*groups, "individual_id")
        .agg(F.count("*").alias("sightings"))
        .groupBy(*groups, "sightings")
        .agg(F.count("*").alias("individuals"))
    )


def _median_sightings(curated: DataFrame, *groups: str) -> DataFrame:
    # The exact median is taken over the frequency table: one entry per distinct count.
    # k distinct counts need k (k + 1) / 2 rows, so a group has few entries.
    return (
        sightings_per_individual(curated, *groups)
        .groupBy(*groups)
        .agg(F.percentile("sightings", 0.5, F.col("individuals")).alias("median_sightings"))
    )


def sighting_median(curated: DataFrame) -> DataFrame:
    return _median_sightings(curated)


def sighting_median_by_year(curated: DataFrame) -> DataFrame:
    return _median_sightings(curated, "area", "year")


def sighting_max(curated: DataFrame) -> DataFrame:
    per_individual = curated.groupBy("individual_id").agg(F.count("*").alias("n"))
    return per_individual.agg(F.max("n").alias("max_sightings"))


def unstratified_individuals(stratified: DataFrame) -> DataFrame:
    """Individuals without a subarea, and how many of them have one row."""
    rows = stratified.filter(F.col("subarea").isNull())
    return (
        rows.groupBy("individual_id")
        .agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("individuals"), F.count_if(F.col("n") == 1).alias("seen_once"))
    )


def subarea_individuals(stratified: DataFrame) -> DataFrame:
    """Distinct individuals per stock and subarea."""
    return (
        stratified.filter(F.col("subarea").isNotNull())
        .groupBy(F.col("area").alias("stock"), "subarea")
        .agg(F.countDistinct("individual_id").alias("num_individuals"))
    )


CRC, PWF, OTHER = 1, 2, 3


def _first_row_of_encounters(stratified: DataFrame) -> DataFrame:
    """Per encounter the stratum, year and contributor of its first row in file order.

    All three are numbers, so that they are carried along with the least row number in one hash aggregate:
    no row meets its encounter again. ``stratum`` is a 64-bit hash of the labels, of which there are few;
    ``_with_labels`` turns it back.
    """
    crc, pwf = F.col("source") == fv.CRC_SOURCE, curate.from_pwf()
    other = ~expr.is_one_of(F.col("source"), [fv.CRC_SOURCE, *fv.PWF_SOURCES])
    rows = stratified.filter(F.col("subarea").isNotNull() & F.col("row_seq").isNotNull()).select(
        "encounter_id",
        "row_seq",
        F.xxhash64("area", "subarea").alias("stratum"),
        "year",
        F.when(crc, CRC).when(pwf, PWF).when(other, OTHER).alias("contributor"),
    )
    carried = [F.min_by(c, "row_seq").alias(c) for c in ("stratum", "year", "contributor")]
    return rows.groupBy("encounter_id").agg(*carried).drop("encounter_id")


def _source_counts() -> list:
    names = {"crc_encounters": CRC, "pwf_encounters": PWF, "other_encounters": OTHER}
    return [expr.count_true(F.col("contributor") == number).alias(name) for name, number in names.items()]


def _with_labels(counts: DataFrame, individuals: DataFrame) -> DataFrame:
    """Counts per ``stratum`` with its labels and its number of individuals."""
    return counts.join(individuals.withColumn("stratum", F.xxhash64("stock", "subarea")), "stratum").drop("stratum")


def _stock_order(stock: str = "stock"):
    order = F.lit(None).cast("int")
    for position, name in enumerate(fv.STOCKS):
        order = F.when(F.col(stock) == name, position).otherwise(order)
    return order


def encounter_report(stratified: DataFrame) -> DataFrame:
    """Encounters per stock and subarea by contributor, with individuals and a total row.

    An encounter belongs to the subarea of its first-listed individual; the total of
    individuals is the sum over subareas.
    """
    counts = ["num_individuals", "crc_encounters", "pwf_encounters", "other_encounters", "total_encounters"]
    years = F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string"))
    encounters = (
        _first_row_of_encounters(stratified)
        .groupBy("stratum")
        .agg(years.alias("span_of_years"), *_source_counts())
        .withColumn("total_encounters", F.expr("crc_encounters + pwf_encounters + other_encounters"))
    )
    body = (
        _with_labels(encounters, subarea_individuals(stratified))
        .withColumn("position", F.coalesce(_stock_order(), F.lit(len(fv.STOCKS))))
        .select("position", "stock", "subarea", "span_of_years", *counts)
    )
    # Grouping sets add the total from the same rows, so that they are made once.
    labels = ["position", "stock", "subarea", "span_of_years"]
    with_total = body.groupingSets([[F.col(c) for c in labels], []], *labels).agg(
        F.grouping("stock").alias("is_total"), *[F.sum(c).alias(c) for c in counts]
    )
    is_total = F.col("is_total") == 1
    return (
        with_total.orderBy("is_total", "position", "stock", "subarea")
        .select(
            F.when(is_total, "Total").otherwise(F.col("stock")).alias("stock"),
            *[F.when(is_total, "").otherwise(F.col(c)).alias(c) for c in ("subarea", "span_of_years")],
            *counts,
        )
    )


def encounters_by_year(stratified: DataFrame) -> DataFrame:
    """Encounters per stock, subarea, year and contributor in long form."""
    counts = _first_row_of_encounters(stratified).groupBy("stratum", "year").agg(*_source_counts())
    wide = (
        _with_labels(counts, subarea_individuals(stratified))
        .withColumnsRenamed(
            {
                "crc_encounters": "CRC encounters",
                "pwf_encounters": "PWF encounters",
                "other_encounters": "Other encounters",
            }
        )
    )
    return wide.unpivot(
        ["stock", "subarea", "year", "num_individuals"],
        ["CRC encounters", "PWF encounters", "Other encounters"],
        "enc_type",
        "num_enc",
    )


def effort_by_year(curated: DataFrame, area: str) -> DataFrame:
    """Sightings and individuals per year in one area."""
    return (
        curated.filter(F.col("area") == area)
        .groupBy("year")
        .agg(F.count("*").alias("sightings"), F.countDistinct("individual_id").alias("individuals"))
    )


def windward_rows(rows: DataFrame) -> DataFrame:
    """Rows on the windward side; needs curated rows that still hold them."""
    return rows.filter((F.col("area") == fv.WINDWARD_AREA) & (F.abs("lon") < fv.WINDWARD_EFFORT_LON))


def windward_effort(rows: DataFrame) -> DataFrame:
    return effort_by_year(windward_rows(rows), fv.WINDWARD_AREA)


def windward_resighted(rows: DataFrame) -> DataFrame:
    """Individuals seen on the windward side that have more than one row anywhere."""
    windward = (F.col("area") == fv.WINDWARD_AREA) & (F.abs("lon") < fv.WINDWARD_EFFORT_LON)
    return (
        rows.groupBy("individual_id")
        .agg(expr.count_true(windward).alias("windward"), F.count("*").alias("n"))
        .agg(F.count_if((F.col("windward") > 0) & (F.col("n") > 1)).alias("individuals"))
    )


def cross_stock_individuals(stratified: DataFrame) -> DataFrame:
    """Individuals of one stock placed in a subarea of the other."""
    crossed = F.lit(False)
    for area, subareas in fv.CROSS_STOCK_SUBAREAS.items():
        crossed = crossed | ((F.col("area") == area) & F.col("subarea").isin(subareas))
    return stratified.filter(crossed).agg(F.countDistinct("individual_id").alias("individuals"))


def contributions(curated: DataFrame) -> DataFrame:
    """Rows per contributor, largest first."""
    return curated.groupBy("source").agg(F.count("*").alias("contributions")).orderBy(F.desc("contributions"), "source")


def annual_sightings(curated: DataFrame) -> DataFrame:
    """Sightings and individuals per area and year."""
    return curated.groupBy("area", "year").agg(
        F.count("*").alias("sightings"), F.countDistinct("individual_id").alias("individuals")
    )


def dataset_headline(curated: DataFrame) -> DataFrame:
    """Rows, individuals, dates and years of the analysis rows."""
    return curated.agg(
        F.count("*").alias("sightings"),
        F.countDistinct("individual_id").alias("individuals"),
        F.countDistinct("sight_date").alias("dates"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        (F.max("year") - F.min("year")).alias("year_span"),
    )


def years_seen(curated: DataFrame) -> DataFrame:
    """Distinct years in which each individual was seen, per area."""
    return curated.groupBy("area", "individual_id").agg(F.countDistinct("year").alias("years_seen"))


def area_names(curated: DataFrame) -> DataFrame:
    """Individuals per area under the area's display name."""
    return (
        curated.groupBy("area")
        .agg(F.countDistinct("individual_id").alias("individuals"))
        .withColumn("display_name", expr.display_name(F.col("area")))
    )
