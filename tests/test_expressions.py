from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tideline import fixed_values as fv
from tideline.functions import draws, expr, tails


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_if_else_is_null_for_a_null_condition(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean").coalesce(1)
    assert values(df, expr.if_else(F.col("c"), F.lit("a"), F.lit("b"))) == ["a", "b", None]


def test_subarea_edges(spark):
    rows = [
        ("Kauai/Niihau", None, -159.95, "KA"),
        ("Kauai/Niihau", None, -159.6, None),
        ("Kauai/Niihau", None, -159.2, "KD"),
        ("Kauai/Niihau", 22.0, -159.6, "KA"),
        ("Kauai/Niihau", 21.9, -159.6, "KC"),
        ("Kauai/Niihau", 22.1, -159.6, "KB"),
        ("Maui Nui", None, -157.6, "MA"),
        ("Maui Nui", None, -157.0, None),
        ("Maui Nui", None, -156.5, "MB"),
        ("Hawaii", 19.71, -156.0, "HB"),
        ("Hawaii", 19.72, -156.0, "HA"),
        ("Oahu", 21.5, -158.0, "OB"),
        ("Elsewhere", 21.5, -158.0, "NA"),
        (None, 21.5, -158.0, None),
    ]
    df = spark.createDataFrame(rows, "area string, lat double, lon double, want string").coalesce(1)
    got = values(df, expr.subarea(F.col("area"), F.col("lat"), F.col("lon")))
    assert got == [r[3] for r in rows]
    each = expr.subarea(F.col("area"), F.col("lat"), F.col("lon"), "each_sighting")
    by_each = dict(zip([r[:3] for r in rows], values(df, each), strict=True))
    assert by_each[("Kauai/Niihau", 21.9, -159.6)] == "KB"
    assert by_each[("Hawaii", 19.72, -156.0)] == "HB"


def test_numbers_and_dates_from_text(spark):
    texts = [("12.5",), (" 7 ",), ("1d",), ("",), (None,), ("x",)]
    df = spark.createDataFrame(texts, "t string").coalesce(1)
    assert values(df, expr.clean_number(F.col("t"))) == [12.5, 7.0, None, None, None, None]
    dates = [("1-Jan-2005",), ("01-january-2005 pm",), ("2005-01-01",), ("31-Feb-2005",), (None,)]
    df = spark.createDataFrame(dates, "t string").coalesce(1)
    assert [str(d) for d in values(df, expr.clean_date(F.col("t")))] == ["2005-01-01"] * 2 + ["None"] * 3


def test_p_label(spark):
    df = spark.createDataFrame([(0.00005,), (0.012345,), (0.5,), (1.0,), (0.000123,), (None,)], "p double").coalesce(1)
    assert values(df, expr.p_label(F.col("p"))) == [
        "p < 0.0001", "p = 0.012", "p = 0.5", "p = 1", "p = 0.00012", None,
    ]


def test_distance(spark):
    df = spark.createDataFrame([(21.0, -157.0, 21.0, -158.0)], "a double, b double, c double, d double")
    km = expr.great_circle_km(*[F.radians(c) for c in "abcd"], fv.EARTH_RADIUS_KM)
    want = 6378.137 * math.radians(1) * math.cos(math.radians(21))
    assert abs(values(df, km)[0] - want) < 0.01


def test_normal_tail(spark):
    zs = [-9.0, -4.0, -3.0, -1.96, 0.0, 0.5, 2.9, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").coalesce(1)
    want = [0.5 * math.erfc(-z / math.sqrt(2)) for z in zs]
    np.testing.assert_allclose(values(df, tails.normal_cdf(F.col("z"))), want, rtol=1e-11)


def test_f_tail(spark):
    # With two and n degrees of freedom the tail is (1 + 2 f / n) ^ (-n / 2).
    df = spark.createDataFrame([(f, 2.0, n) for f in (0.5, 3.0, 9.0) for n in (4.0, 50.0, 3000.0)], "f double, a double, b double")
    rows = df.select("f", "b", tails.f_upper_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        assert math.isclose(r.p, (1 + 2 * r.f / r.b) ** (-r.b / 2), rel_tol=1e-9)


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    u = draws.uniform(fv.SEED, "t", F.col("id"))
    one = {r.id: r.u for r in df.coalesce(1).select("id", u.alias("u")).collect()}
    many = {r.id: r.u for r in df.repartition(7).select("id", u.alias("u")).collect()}
    assert one == many
    assert 0.4 < np.mean(list(one.values())) < 0.6 and min(one.values()) >= 0 and max(one.values()) < 1


def test_poisson_and_normal_moments(spark):
    df = spark.range(20000).select(draws.uniform(1, F.col("id")).alias("u"), draws.standard_normal(1, F.col("id")).alias("z"))
    row = df.agg(
        F.avg(draws.poisson_one(F.col("u"))), F.var_samp(draws.poisson_one(F.col("u"))), F.avg("z"), F.var_samp("z")
    ).first()
    assert np.allclose([row[0], row[1], row[3]], 1, atol=0.05) and abs(row[2]) < 0.05
