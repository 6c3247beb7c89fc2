from __future__ import annotations

import datetime as dt

import pytest

from tideline.operators import curate
from tideline.sources import schema, sightings, sinks

HEADER = [
    "ID #", "Date (dd-MMM-yyyy)", "Group", "Area", "Island", "Lat", "Long", "Depth",
    "Distinctiveness (4 = very, 3 = average, 2 = slightly, 1 = not)", "Source",
]


def write(tmp_path, rows):
    headers = [accepted[0] for accepted in schema.HEADERS.values()]
    path = tmp_path / "sightings.csv"
    lines = [",".join(headers)] + [",".join(str(r.get(c, "")) for c in schema.HEADERS) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


ROW = {
    "individual_id": "17", "sight_date": "3-Mar-2004", "encounter_id": "g1", "area": "Oahu", "island": "Oahu",
    "lat": "21.3", "lon": "158.1", "depth_m": "450", "distinctiveness": "3", "photo_quality": "4",
    "entry_status": "complete", "source": "RWB", "sight_type": "original",
}


def test_csv_to_canonical_rows(spark, tmp_path):
    rows = [
        ROW,
        ROW | {"island": ""},
        ROW | {"island": "NA"},
        ROW | {"depth_m": "3000"},
        ROW | {"depth_m": "2999.9"},
        ROW | {"depth_m": "unknown"},
        ROW | {"sight_date": "32-Mar-2004", "lat": "NA"},
    ]
    df = sightings.read_csv(spark, write(tmp_path, rows))
    assert df.schema == schema.SIGHTINGS or [f.dataType for f in df.schema] == [f.dataType for f in schema.SIGHTINGS]
    got = df.orderBy("row_seq").collect()
    assert got[0].sight_date == dt.date(2004, 3, 3) and got[0].year == 2004 and got[0].lon == 158.1
    assert [r.island for r in got[:3]] == ["Oahu", "", None]
    assert got[5].depth_m is None and got[6].sight_date is None and got[6].lat is None
    kept = curate.curated_sightings(df).orderBy("row_seq").collect()
    assert [r.row_seq for r in kept] == [got[i].row_seq for i in (0, 1, 4, 5)]
    assert kept[0].lon == -158.1 and kept[0].sight_type == "Original"


def test_headers_before_and_after_mangling():
    after = schema.source_columns([accepted[0] for accepted in schema.HEADERS.values()])
    assert after["individual_id"] == "ID.."
    assert schema.mangled("ID #") == "ID.." and schema.mangled("Date (dd-MMM-yyyy)") == "Date..dd.MMM.yyyy."
    with pytest.raises(ValueError, match="no column for"):
        schema.source_columns(HEADER)


def test_dated_csv(spark, tmp_path):
    day = dt.date(2020, 7, 1)
    assert sinks.dated_name("model.average.p.", day) == "model.average.p. 2020-07-01 .csv"
    path = sinks.write_dated_csv(spark.createDataFrame([(1, "a")], "x int, y string"), str(tmp_path), "out", day)
    assert spark.read.csv(path, header=True).collect()[0].asDict() == {"x": "1", "y": "a"}
