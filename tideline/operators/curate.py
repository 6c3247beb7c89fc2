"""Cleaning, filtering and stratifying sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fv
from tideline.functions import expr
from tideline.operators.skew import lookup_join


def in_stock_area(area: str = "area") -> Column:
    return ~F.col(area).isin(fv.NON_STOCK_AREAS)


def shallow() -> Column:
    """Depth below the limit or unknown; the limit itself is out."""
    return (F.col("depth_m") < fv.DEPTH_LIMIT) | F.col("depth_m").isNull()


def good_photo() -> Column:
    return F.col("photo_quality") >= fv.MIN_PHOTO_QUALITY


def distinctive() -> Column:
    return F.col("distinctiveness") >= fv.MIN_DISTINCTIVENESS


def outside_excluded_place() -> Column:
    return F.col("island") != fv.EXCLUDED_PLACE


def not_windward() -> Column:
    """Not on the windward side of the windward area; there, an unknown longitude is out."""
    windward = (F.col("area") == fv.WINDWARD_AREA) & (F.abs("lon") < fv.WINDWARD_EXCLUSION_LON)
    return ~windward


def in_years(first_year: int, last_year: int) -> Column:
    return F.col("year").between(first_year, last_year)


def located() -> Column:
    return F.col("lon").isNotNull()


def from_pwf() -> Column:
    return expr.is_one_of(F.col("source"), fv.PWF_SOURCES)


def repair_labels(sightings: DataFrame) -> DataFrame:
    """Canonical area labels."""
    return sightings.withColumn("area", expr.canonical(F.col("area"), fv.AREA_SPELLINGS))


def repair_sight_types(sightings: DataFrame) -> DataFrame:
    """Canonical labels of the sighting types."""
    return sightings.withColumn("sight_type", expr.canonical(F.col("sight_type"), fv.SIGHT_TYPE_SPELLINGS))


def repair_longitude(sightings: DataFrame) -> DataFrame:
    return sightings.withColumn("lon", expr.west_longitude(F.col("lon")))


def curated_sightings(
    sightings: DataFrame,
    first_year: int = fv.FIRST_YEAR,
    last_year: int = fv.LAST_YEAR,
    exclude_windward: bool = True,
) -> DataFrame:
    """The analysis rows: stock areas, shallow, distinctive, good photo, complete, in the years."""
    rows = sightings.filter(
        in_stock_area()
        & shallow()
        & distinctive()
        & good_photo()
        & (F.col("entry_status") == fv.COMPLETE)
        & outside_excluded_place()
        & in_years(first_year, last_year)
    )
    if exclude_windward:
        rows = rows.filter(not_windward())
    rows = repair_labels(repair_longitude(rows))
    return repair_sight_types(rows) if "sight_type" in rows.columns else rows


ROW_BITS = 47
LAST_OF_ALL = 32767


def by_year_and_order() -> Column:
    """One number in the order of (year, row order), rows without a year last.

    Row numbers above 47 bits raise an error.
    """
    fits = F.col("row_seq").between(0, (1 << ROW_BITS) - 1)
    row = F.when(fits, F.col("row_seq")).otherwise(
        F.raise_error(F.lit(f"row_seq is outside of 0 to 2 ** {ROW_BITS} - 1")).cast("bigint")
    )
    return F.coalesce(F.col("year"), F.lit(LAST_OF_ALL)).cast("bigint") * (1 << ROW_BITS) + row


def _in_scope(sightings: DataFrame) -> DataFrame:
    """Rows that can place an individual, with their order if they are located."""
    scope = repair_labels(sightings.filter(in_stock_area() & shallow() & outside_excluded_place()))
    first = F.when(located() & not_windward(), by_year_and_order())
    return scope.withColumn("first", first).withColumn("lon", expr.west_longitude(F.col("lon")))


def first_located(sightings: DataFrame) -> DataFrame:
    """The first located row of each individual, whatever its quality, completeness or year.

    The rows are found by an aggregate of numbers and joined back on their own number, so no
    task sees all rows of an individual and none is sorted for it.
    """
    scope = _in_scope(sightings)
    firsts = scope.groupBy("individual_id").agg(F.min("first").alias("first")).select("first")
    return scope.join(firsts, "first", "left_semi").select(*sightings.columns)


def individual_strata(sightings: DataFrame) -> DataFrame:
    """Subarea of each individual in scope, null where unknown, with its number of rows in scope.

    Subareas are aggregated as the places of their labels, numbers of a fixed width.
    """
    labels = F.array(*map(F.lit, [*fv.SUBAREAS, fv.NO_SUBAREA]))
    label = expr.subarea(F.col("area"), F.col("lat"), F.col("lon"))
    needed = ["row_seq", "individual_id", "year", "area", "island", "lat", "lon", "depth_m"]
    return (
        _in_scope(sightings.select(*needed))
        .withColumn("place", F.array_position(labels, label).cast("int"))
        .groupBy("individual_id")
        .agg(
            F.min_by("place", "first").alias("place"),
            F.count("first").alias("located_rows"),
            F.count("*").alias("scope_rows"),
        )
        .select(
            "individual_id",
            F.when(F.col("located_rows") > 0, F.get(labels, F.col("place") - 1)).alias("subarea"),
            (F.col("located_rows") > 0).alias("has_location"),
            "scope_rows",
        )
    )


def individual_subarea(sightings: DataFrame) -> DataFrame:
    """Individuals with a located sighting, and the subarea of the first one."""
    return individual_strata(sightings).filter("has_location").select("individual_id", "subarea")


def first_located_map(sightings: DataFrame) -> DataFrame:
    """First located rows with their subarea."""
    return first_located(sightings).withColumn("subarea", expr.subarea(F.col("area"), F.col("lat"), F.col("lon")))


def stratify(curated: DataFrame, strata: DataFrame, **skew) -> DataFrame:
    """Curated rows with the subarea of their individual (see ``individual_strata``)."""
    return lookup_join(
        curated, strata.select("individual_id", "subarea", "scope_rows"), "individual_id", rows="scope_rows", **skew
    )


def model_sightings(stratified: DataFrame) -> DataFrame:
    """Rows of the four stocks that enter the capture histories."""
    area, subarea = F.col("area"), F.col("subarea")
    keep = (
        F.when(area == "Maui Nui", subarea != "OB")
        .when(area == "Oahu", ~subarea.contains("M"))
        .when(area.isin("Hawaii", "Kauai/Niihau"), F.lit(True))
    )
    return stratified.filter(subarea.isNotNull() & keep)


def own_survey_rows(sightings: DataFrame) -> DataFrame:
    """Rows of the main contributor in stock areas, with canonical areas; no other filter."""
    return repair_labels(sightings).filter(in_stock_area() & (F.col("source") == fv.CRC_SOURCE))


def distinctiveness_base(sightings: DataFrame, min_rows: int = fv.MIN_QUALITY_ROWS, **skew) -> DataFrame:
    """Own survey rows of encounters that have at least ``min_rows`` distinctive, good-photo rows."""
    rows = own_survey_rows(sightings)
    encounters = (
        rows.groupBy("encounter_id")
        .agg(expr.count_true(distinctive() & good_photo()).alias("quality_rows"), F.count("*").alias("encounter_rows"))
        .filter(F.col("quality_rows") >= min_rows)
        .select("encounter_id", "encounter_rows")
    )
    return lookup_join(rows, encounters, "encounter_id", rows="encounter_rows", how="inner", **skew)


def movement_base(curated: DataFrame, **skew) -> DataFrame:
    """Positions with the number of years in which the area has seen the individual located."""
    rows = curated.filter(located() & F.col("lat").isNotNull()).select(
        "row_seq", "individual_id", "lat", "lon", "area", "year"
    )
    years = (
        rows.groupBy("area", "individual_id", "year")
        .agg(F.count("*").alias("year_rows"))
        .groupBy("area", "individual_id")
        .agg(F.count("*").alias("n_years"), F.sum("year_rows").alias("rows"))
        .select(F.struct("area", "individual_id").alias("who"), "n_years", "rows")
    )
    keyed = rows.withColumn("who", F.struct("area", "individual_id"))
    return lookup_join(keyed, years, "who", rows="rows", **skew).drop("who")


def rows_of_individuals_seen_at(sightings: DataFrame, place: str = fv.EXCLUDED_PLACE, **skew) -> DataFrame:
    """All rows of the individuals ever seen at a place."""
    visitors = (
        sightings.groupBy("individual_id")
        .agg(expr.count_true(F.col("island") == place).alias("visits"), F.count("*").alias("rows"))
        .filter("visits > 0")
        .select("individual_id", "rows")
    )
    return lookup_join(sightings, visitors, "individual_id", rows="rows", how="inner", **skew)


def rows_from_pwf(curated: DataFrame) -> DataFrame:
    return curated.filter(from_pwf())


def seen_once(sightings: DataFrame) -> DataFrame:
    """The rows of individuals that have exactly one row."""
    once = sightings.groupBy("individual_id").agg(F.count("*").alias("rows")).filter("rows = 1").select("individual_id")
    return sightings.join(once, "individual_id", "left_semi")
