"""What makes the figures of large tables: joins, draws in bulk, replicates inside tasks."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline import fixed_values as fv
from tideline.functions import bulk_draws, draws, file_arrays
from tideline.operators import models, movement, recapture, sampling, trend
from tideline.plans import reports
from tideline.plans.queries import queries
from tideline.plans.study import Study


def test_weights_are_not_broadcast(spark):
    """Small files say nothing about the number of models: the join by model is a shuffle."""
    fits = spark.range(60).selectExpr(
        "concat('S', id % 2) AS stock", "id div 3 AS model_id", "1 + id div 3 AS npar", "1.0D * (id div 3) AS neg2lnl",
        "100L AS n_eff", "1.0D AS chat", "concat('p', id % 3) AS parameter", "0.5D AS estimate", "0.1D AS se",
    )
    for table in (models.model_average(fits), reports.survival(fits)):
        plan = table._jdf.queryExecution().executedPlan().toString().splitlines()
        by_model = [line for line in plan if "Join" in line and "model_id" in line]
        assert by_model and all("SortMergeJoin" in line for line in by_model)


def test_bulk_draws_are_the_keyed_draws(spark):
    """Missing, short and overlong keys, replicates of one to four digits."""
    areas = ["Oahu", None, "Kauai/Niihau", "x" * 60]
    keys = [(areas[i % 4], None if i % 7 == 0 else i**5) for i in range(60)]
    rows = spark.createDataFrame(keys, "area string, id bigint").coalesce(1)
    columns = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64())]
    many = bulk_draws.Draws(5, "check", *columns)
    for reps in bulk_draws.together(8, 11, 10**6), bulk_draws.together(95, 104, 3), [[0, 1]], [[1000]]:
        for some in reps:
            u, order = many.uniform(some), many.order_key(some)
            for i, rep in enumerate(some):
                by = (F.lit(rep), F.col("area"), F.col("id"))
                want = rows.select(draws.uniform(5, "check", *by).alias("u"), draws.order_key(5, "check", *by).alias("k")).collect()
                assert [r.u for r in want] == u[i].tolist() and [r.k for r in want] == order[i].tolist()


def sightings(spark):
    """Two areas, individuals of none to six positions a year, one without a number; each row twice."""
    rows = spark.range(900).selectExpr(
        "IF(id % 3 = 0, 'Oahu', 'Hawaii') AS area", "IF(id % 41 = 0, NULL, id * id % 37) AS individual_id",
        "CAST(1996 + id * 7 % 11 % 5 AS INT) AS year", "id div 2 AS row_seq", "19.0D + id % 13 / 10 AS lat",
        "-156.0D - id % 17 / 10 AS lon",
    )
    return rows.unionByName(rows)


@pytest.mark.parametrize("build", [movement.observed_distances, movement.movement_distances])
def test_replicates_in_tasks_equal_replicates_of_rows(spark, build):
    """The same means whether a task runs through the replicates or rows are repeated for them."""
    rows = sightings(spark)

    def means(**limits):
        return {(r.area, r.rep, r.type): r.mean_km for r in build(rows, 12, **limits).collect()}

    in_tasks, as_rows = means(), means(rows_per_task=0)
    assert in_tasks.keys() == as_rows.keys() and {k[1] for k in in_tasks} == set(range(1, 13))
    assert in_tasks == pytest.approx(as_rows, rel=1e-9)
    assert means(rows_per_task=650) == pytest.approx(as_rows, rel=1e-9)


def test_replicates_of_movement_are_made_in_tasks(spark):
    plan = movement.movement_distances(sightings(spark), 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_positions_are_packed_before_they_are_sent_for_replicates(spark):
    """What is sent once for every run of replicates are blocks, and rows are read once."""
    plan = movement.movement_distances(sightings(spark), 1000)._jdf.queryExecution().optimizedPlan().toString()
    names = [line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines()]
    assert names.index("FlatMapGroupsInArrow") < names.index("Generate") < names.index("MapInArrow")
    assert "Join" not in names


@pytest.mark.parametrize("name", ["movement_null", "movement_histogram"])
def test_tables_are_read_once_for_the_permutation(spark, sf_dir, name):
    """No pass over the tables counts an area's rows before, and only blocks are repeated."""
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    names = [line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines()]
    below = names[names.index("FlatMapGroupsInArrow") :]
    assert below.index("Generate") < below.index("MapInArrow") and "Generate" not in below[below.index("MapInArrow") :]
    assert len([n for n in names if n.startswith("Relation")]) == 3


def area(positions: list[tuple], ids: pa.DataType, rows: int) -> movement._Area:
    """Positions given as (individual, year, lat, lon), in blocks of so many rows."""
    found = movement._Area("Oahu", 5, 6000.0)
    types = {"individual_id": ids, "year": pa.int32(), "lat": pa.float64(), "lon": pa.float64()}
    for i in range(0, len(positions), rows):
        columns = zip(*positions[i : i + rows], strict=True)
        found.add(pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=[*types]))
    found.close()
    return found


def by_hand(positions: list[tuple], rep: int) -> dict[str, float]:
    """The sums of one replicate, from the drawing of single keys."""
    def draw(name, rep, *keys):
        return bulk_draws.Draws(5, name, *[pa.array([k], pa.string() if isinstance(k, str) or k is None else None) for k in keys])

    entries = {}
    for who, year, *point in positions:
        entries.setdefault((who, year), []).append(point)
    picked = {e: p[int(draw("pick", rep, "Oahu", *e).uniform([rep])[0, 0] * len(p))] for e, p in entries.items()}
    moved = {}
    for year in {y for _, y in entries}:
        of = [w for w, y in entries if y == year]
        first, now = (sorted(of, key=lambda w: draw("place", r, "Oahu", year, w).order_key([r])[0, 0]) for r in (0, rep))
        moved |= {(a, year): picked[b, year] for a, b in zip(first, now, strict=True)}
    found = {}
    for kind, held in (("truth", picked), ("test", moved)):
        total = 0.0
        for who in {w for w, _ in entries}:
            points = [[math.radians(x) for x in p] for (w, _), p in held.items() if w == who]
            apart = [
                math.acos(min(1, math.sin(a[0]) * math.sin(b[0]) + math.cos(a[0]) * math.cos(b[0]) * math.cos(a[1] - b[1])))
                for i, a in enumerate(points) for b in points[:i]
            ]
            total += 6000.0 * sum(apart) / len(apart) if apart else 0
        found[kind] = total
    return found


@pytest.mark.parametrize("kind", [int, str, lambda i: None if i == 3 else f"{i:060d}"], ids=["number", "text", "long_and_missing"])
def test_permuting_an_area_in_files(monkeypatch, kind):
    """The same sums whatever the blocks, chunks and pieces, with individuals and years that go on from block to block."""
    positions = [
        (kind(i), 1990 + y, 20 + (i * 7 + y * 3 + k) % 11 / 3, -155 - (i * 5 + y + 2 * k) % 13 / 3)
        for i in range(12) for y in range(6) if (i + y) % 4 or i == 5 for k in range(1 + i * y % 3 + 20 * (i == 5))
    ]
    ids = pa.int64() if kind is int else pa.string()
    want = by_hand(positions, 7)
    for rows, chunk, keys, small in ((1000, 32_768, 262_144, 1 << 18), (1, 5, 7, 0), (4, 1, 1, 0), (7, 20, 30, 0)):
        monkeypatch.setattr(movement, "ENTRIES_AT_ONCE", chunk)
        monkeypatch.setattr(movement, "KEYS_AT_ONCE", keys)
        monkeypatch.setattr(file_arrays, "SMALL", small)
        table = pa.Table.from_batches(area(positions, ids, rows).sums(5, 12, ["truth", "test"])).to_pylist()
        assert [(r["rep"], r["n"]) for r in table if r["type"] == "test"] == [(r, 12) for r in range(5, 13)]
        assert {r["type"]: r["km"] for r in table if r["rep"] == 7} == pytest.approx(want, rel=1e-6)


def test_memory_of_an_area_that_is_permuted(monkeypatch):
    """A few bytes of memory a position (13 here), where arrays of all of them took 124 besides the table itself."""
    monkeypatch.setattr(movement, "ENTRIES_AT_ONCE", 4096)
    monkeypatch.setattr(movement, "KEYS_AT_ONCE", 16_384)
    monkeypatch.setattr(file_arrays, "SMALL", 1 << 14)
    n = 600_000
    numbers = np.arange(n)
    tracemalloc.start()
    found = movement._Area("Oahu", 5, 6000.0)
    for i in range(0, n, 10_000):
        k = numbers[i : i + 10_000]
        found.add(pa.record_batch({
            "individual_id": pa.array(k // 12), "year": pa.array((k % 12 // 2).astype(np.int32)),
            "lat": pa.array(20.0 + k % 7), "lon": pa.array(-150.0 - k % 5),
        }))
    found.close()
    sums = [b.to_pylist()[0]["km"] for b in found.sums(999, 999, ["truth", "test"])]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sums) == 2 and all(x > 0 for x in sums) and most < 40 * n, most


def test_resamples_in_tasks_are_those_of_rows(spark):
    years = recapture.individual_years(sightings(spark).withColumn("subarea", F.lit("A")))
    reps = years.crossJoin(spark.range(1, 31).select(F.col("id").cast("int").alias("rep")))
    u = draws.uniform(7, "bootstrap", F.col("rep"), F.col("area"), F.col("individual_id"))
    statistics = recapture.occasion_statistics(reps.withColumn("times", draws.poisson_one(u)), ("area", "rep"), F.col("times"))
    want = recapture.jolly_seber(statistics, ("area", "rep")).select("area", "rep", "year", "n", "n_hat")
    got = recapture.abundance_bootstrap(years, 30, seed=7)
    assert [c[:2] for c in got.dtypes] == [c[:2] for c in want.dtypes]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


class RowsPerReplicate(Study):
    """Resamples made as rows, one per individual and replicate."""

    def abundance_replicates(self):
        years = self.individual_years()
        rep = F.explode(F.sequence(F.lit(1), F.lit(self.bootstrap_replicates))).alias("rep")
        u = draws.uniform(fv.SEED, "bootstrap", F.col("rep"), F.col("area"), F.col("individual_id"))
        statistics = recapture.occasion_statistics(years.select("*", rep), ("area", "rep"), draws.poisson_one(u))
        return recapture.jolly_seber(statistics, ("area", "rep"))


@pytest.mark.parametrize(
    "build",
    [
        Study.abundance_covariance,
        Study.corrected_abundance,
        reports.abundance,
        lambda s: trend.annual_growth(s.corrected_abundance()),
        lambda s: trend.mean_growth(trend.annual_growth(s.corrected_abundance())),
        lambda s: trend.trend_interval_stock(s.abundance_draws()),
    ],
    ids=["bootstrap_covariance", "corrected_abundance", "report_abundance", "annual_growth", "mean_growth", "trend_interval_stock"],
)
def test_one_pass_of_resamples_in_tasks(spark, build):
    """Whatever needs the covariance resamples once, inside tasks, and equals resamples made as rows."""
    rows = spark.range(3000).selectExpr(
        "id AS row_seq", "id * id % 997 + IF(id % 3 = 0, 1000, 0) AS individual_id",
        "make_date(CAST(1996 + id * 7 % 11 % 6 AS INT), 6, 1) AS sight_date", "CAST(1996 + id * 7 % 11 % 6 AS INT) AS year",
        "concat(id % 3 = 0, '-', id % 40, '-', id * 7 % 11 % 6) AS encounter_id", "IF(id % 3 = 0, 'Oahu', 'Hawaii') AS area",
        "'I' AS island", "IF(id % 3 = 0, 21.4D, 19.5D) AS lat", "IF(id % 3 = 0, -158.0D, -156.0D) AS lon",
        "100.0D AS depth_m", "CAST(IF(id % 5 = 0, 2, 3) AS INT) AS distinctiveness", "3 AS photo_quality",
        "'complete' AS entry_status", "'RWB' AS source",
    )
    some = {"first_year": 1996, "last_year": 2001, "bootstrap_replicates": 30, "trend_replicates": 40}
    got = build(Study.of(rows, **some))

    def shown(df):
        return sorted(str([f"{x:.9g}" if isinstance(x, float) else x for x in r]) for r in df.collect())

    numbers = shown(got)
    assert len(numbers) > 1 and "." in str(numbers) and numbers == shown(build(RowsPerReplicate.of(rows, **some)))
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1


def test_random_sampling_is_drawn(spark):
    """Every individual of every cohort is drawn: whole numbers that add up, near their expectation, text NA too."""
    params = spark.createDataFrame([("a", 6, 3000), ("NA", 1, 7), ("b", 3, 0)], "area string, n_occasions long, n_original long")
    drawn = {(r.area, r.value): r.n for r in sampling.random_years(params, "area").collect()}
    expected = {(r.area, r.value): r.n for r in sampling.expected_years(params, "area").collect()}
    assert drawn[("NA", 1)] == 7 and sum(n for (area, _), n in drawn.items() if area == "a") == 15000
    assert all(isinstance(n, int) for n in drawn.values()) and drawn != expected
    assert all(abs(n - expected[k]) < 5 * expected[k] ** 0.5 + 1 for k, n in drawn.items())


def test_sample_has_three_replicates(spark, sf_dir):
    assert {r.rep for r in queries()["sample_one_per_key"](spark, sf_dir).select("rep").distinct().collect()} == {1, 2, 3}
