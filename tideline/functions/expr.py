"""Column expressions for missing values, labels and distance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline import fixed_values as fv


def if_else(condition: Column, then, otherwise) -> Column:
    """Vectorised if/else whose result is null when the condition is null."""
    return F.when(condition, then).when(condition.isNull(), F.lit(None)).otherwise(otherwise)


def is_one_of(column: Column, values: Sequence[str]) -> Column:
    """Membership test that is false, not null, for a null value."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def count_true(condition: Column) -> Column:
    """Number of rows for which the condition holds; null counts as not."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def clean_number(column: Column) -> Column:
    """Text to double; null where the text is no number."""
    text = F.trim(column)
    return F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))


def clean_date(column: Column) -> Column:
    """Text such as ``1-Jan-2005`` to date; null where it is no date.

    A full month name and text after the year are tolerated.
    """
    short = F.regexp_replace(column, r"^\s*(\d{1,2}-[A-Za-z]{3})[A-Za-z]*(-\d{4}).*$", "$1$2")
    return F.to_date(F.try_to_timestamp(short, F.lit("d-MMM-yyyy")))


def west_longitude(lon: Column) -> Column:
    """Longitude with the sign repaired to the western hemisphere."""
    return -F.abs(lon)


def canonical(column: Column, spellings: Mapping[str, Sequence[str]]) -> Column:
    """Replace known spellings by their canonical label; other values stay."""
    result = column
    for label, variants in spellings.items():
        result = F.when(column.isin(list(variants)), label).otherwise(result)
    return result


def subarea(area: Column, lat: Column, lon: Column, scheme: str = "first_sighting") -> Column:
    """Subarea label of a position; null where a boundary test is null.

    ``scheme`` is ``first_sighting`` (strata of individuals) or ``each_sighting``.
    """
    abs_lon = F.abs(lon)
    middle = abs_lon < fv.KAUAI_WEST_LON
    east, south, north, west = (F.lit(label) for label in fv.KAUAI_LABELS[scheme])
    kauai = if_else(
        abs_lon < fv.KAUAI_EAST_LON,
        east,
        if_else(
            (lat < fv.KAUAI_MIDDLE_LAT) & middle,
            south,
            if_else((lat > fv.KAUAI_MIDDLE_LAT) & middle, north, west),
        ),
    )
    maui_a = ((lat >= fv.MAUI_NORTH_LAT) & (abs_lon > fv.MAUI_NORTH_LON)) | (abs_lon >= fv.MAUI_WEST_LON)
    inside = {
        "Kauai/Niihau": kauai,
        "Hawaii": if_else(lat <= fv.HAWAII_MIDDLE_LAT[scheme], F.lit("HB"), F.lit("HA")),
        "Maui Nui": if_else(maui_a, F.lit("MA"), F.lit("MB")),
        "Oahu": if_else(lat <= fv.OAHU_MIDDLE_LAT, F.lit("OB"), F.lit("OA")),
    }
    result: Column = F.when(area.isNotNull(), fv.NO_SUBAREA)
    for name, label in inside.items():
        result = F.when(area == name, label).otherwise(result)
    return result


def display_name(area: Column) -> Column:
    """Name of an area for display; areas without a special name stay."""
    result = area
    for name, shown in fv.DISPLAY_NAMES.items():
        result = F.when(area == name, shown).otherwise(result)
    return result


def p_label(p: Column) -> Column:
    """``p < 0.0001`` or ``p = x`` with at most two significant digits; null for a null ``p``."""
    digits = F.regexp_replace(F.format_string("%.2g", p), r"\.?0+$", "")
    return F.when(p < 0.0001, F.lit("p < 0.0001")).when(p.isNotNull(), F.concat(F.lit("p = "), digits))


def half_even(column: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(column, digits)


def great_circle_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float) -> Column:
    """Haversine distance of two positions in radians."""
    h = F.pow(F.sin((lat_b - lat_a) / 2), 2) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin((lon_b - lon_a) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
