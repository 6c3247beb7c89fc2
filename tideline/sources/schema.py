"""Canonical sightings schema and the headers it is read from."""

from __future__ import annotations

from pyspark.sql import types as T

# Headers of the sightings file, after and before name mangling.
HEADERS = {
    "individual_id": ["ID..", "ID #"],
    "sight_date": ["Date..dd.MMM.yyyy.", "Date (dd-MMM-yyyy)"],
    "encounter_id": ["Group"],
    "area": ["Area"],
    "island": ["Island"],
    "lat": ["Lat"],
    "lon": ["Long"],
    "depth_m": ["Depth"],
    "distinctiveness": ["Distinctiveness..4..very..3...average..2...slightly..1...not."],
    "photo_quality": ["Best.photo.quality..4...excellent..3.good..2.fair..1.poor."],
    "entry_status": ["Partially.entered.matched.encounter...Complete.Incomplete."],
    "source": ["Source"],
    "sight_type": [
        "Original..within.year..between.year..final.Note.between.island.only.used.for.between.area.matches"
    ],
}

TEXT_COLUMNS = ["encounter_id", "area", "island", "entry_status", "source", "sight_type"]
NUMBER_COLUMNS = ["lat", "lon", "depth_m"]
SCORE_COLUMNS = ["distinctiveness", "photo_quality"]

SIGHTINGS = T.StructType(
    [
        T.StructField("row_seq", T.LongType()),
        T.StructField("individual_id", T.StringType()),
        T.StructField("sight_date", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("encounter_id", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("island", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("depth_m", T.DoubleType()),
        T.StructField("distinctiveness", T.IntegerType()),
        T.StructField("photo_quality", T.IntegerType()),
        T.StructField("entry_status", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("sight_type", T.StringType()),
    ]
)
COLUMNS = SIGHTINGS.fieldNames()


def mangled(header: str) -> str:
    """A header with every character outside letters, digits, ``.`` and ``_`` turned into a dot."""
    return "".join(c if c.isalnum() or c in "._" else "." for c in header)


def source_columns(headers: list[str]) -> dict[str, str]:
    """Map each canonical column to the header that holds it. Raises on a missing column."""
    by_mangled = {mangled(h): h for h in headers}
    found = {}
    for name, accepted in HEADERS.items():
        for candidate in [name, *accepted]:
            if mangled(candidate) in by_mangled:
                found[name] = by_mangled[mangled(candidate)]
                break
        else:
            raise ValueError(f"no column for {name}: expected one of {accepted}")
    return found
