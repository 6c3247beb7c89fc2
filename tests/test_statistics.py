"""Statistical operators against direct calculations."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import discovery, proportion, ranktest, recapture, resight, trend
from tideline.plans.queries import study


def frequencies(spark, x, y):
    rows = [("s", "x", float(v), 1) for v in x] + [("s", "y", float(v), 1) for v in y]
    return spark.createDataFrame(rows, "s string, type string, value double, n int")


def test_rank_sum_by_hand(spark):
    row = ranktest.rank_sum(frequencies(spark, [1, 2, 2], [2, 3]), "s", "x", "y").first()
    assert (row.w, row.n_x, row.n_y) == (1.0, 3, 2)


@pytest.mark.parametrize("alternative", ["two.sided", "less", "greater"])
def test_rank_sum_against_all_pairs(spark, alternative):
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 9, 60), rng.integers(2, 11, 45)
    row = ranktest.rank_sum(frequencies(spark, x, y), "s", "x", "y", alternative).first()
    w = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(x, y))
    ties = np.unique(np.concatenate([x, y]), return_counts=True)[1].astype(float)
    m, n = len(x), len(y)
    sigma = math.sqrt(m * n / 12 * (m + n + 1 - (ties**3 - ties).sum() / ((m + n) * (m + n - 1))))
    centred = w - m * n / 2
    z = (centred - {"two.sided": math.copysign(0.5, centred), "less": -0.5, "greater": 0.5}[alternative]) / sigma
    below = 0.5 * math.erfc(-z / math.sqrt(2))
    p = {"two.sided": 2 * min(below, 1 - below), "less": below, "greater": 1 - below}[alternative]
    assert row.w == w and row.z == pytest.approx(z) and row.p_value == pytest.approx(p)


def test_rank_sum_with_an_empty_sample(spark):
    row = ranktest.rank_sum(frequencies(spark, [1, 2], []), "s", "x", "y").first()
    assert row.n_y == 0 and row.z is None and row.p_value is None and row.label is None


def _rss(columns, y):
    design = np.column_stack(columns)
    fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    return float(((y - fit) ** 2).sum())


def test_anova_against_least_squares(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"area": rng.choice(list("abcd"), 200, p=[0.4, 0.3, 0.2, 0.1]), "year": rng.integers(2000, 2010, 200)})
    pdf["v"] = rng.random(200) + (pdf.area == "b") * 0.2 + (pdf.year - 2000) * 0.01
    shares = spark.createDataFrame(pdf)
    y, one, year = pdf.v.to_numpy(), np.ones(200), pdf.year.to_numpy() - 2005.0
    dummies = [(pdf.area == a).to_numpy(float) for a in "abcd"]
    null, areas = _rss([one], y), _rss(dummies, y)
    both, full = _rss([*dummies, year], y), _rss([*dummies, *[d * year for d in dummies]], y)
    table = {r.term: r for r in proportion.anova_area_year_interaction(shares, "v").collect()}
    want = {"area": (3, null - areas), "year": (1, areas - both), "area:year": (3, both - full), "residuals": (192, full)}
    for term, (df, ss) in want.items():
        assert table[term].df == df and table[term].sum_sq == pytest.approx(ss, rel=1e-8)
    assert table["area"].f_value == pytest.approx((null - areas) / 3 / (full / 192))
    only_year = _rss([one, year], y)
    table = {r.term: r for r in proportion.anova_year_area(shares, "v").collect()}
    want = {"year": (1, null - only_year), "area": (3, only_year - both), "residuals": (195, both)}
    for term, (df, ss) in want.items():
        assert table[term].df == df and table[term].sum_sq == pytest.approx(ss, rel=1e-8)


def test_growth_and_interval_by_hand(spark):
    grown = trend.annual_growth(spark.createDataFrame([("s", 2000, 100.0), ("s", 2002, 120.0)], "stock string, year int, n_i double"))
    assert [r.rate_percent for r in grown.orderBy("year").collect()] == [None, pytest.approx(20 / 2 / 120 * 100)]
    estimates = spark.createDataFrame([("s", 2000, 100.0, 10.0)], "stock string, year int, n_hat double, se double")
    theta = spark.createDataFrame([("s", 0.5, 0.01)], "stock string, theta double, theta_var double")
    row = trend.corrected_abundance(estimates, theta).first()
    assert row.n_i == 200 and row.varcond == pytest.approx(2000) and (row.lcl, row.ucl) == (130, 308)
    assert row.lcl <= row.n_i <= row.ucl


def test_draws_follow_the_covariance(spark):
    estimates = spark.createDataFrame([("s", 2000, 50.0, 2.0), ("s", 2001, 60.0, 3.0)], "stock string, year int, n_hat double, se double")
    rows = [("s", 2000, 2000, 4.0), ("s", 2000, 2001, 3.0), ("s", 2001, 2000, 3.0), ("s", 2001, 2001, 9.0)]
    covariance = spark.createDataFrame(rows, "stock string, year_i int, year_j int, cov double")
    drawn = trend.abundance_draws(estimates, trend.covariance_factor(covariance), 8000).toPandas()
    wide = drawn.pivot(index="rep", columns="year", values="n_hat")
    np.testing.assert_allclose(wide.mean(), [50, 60], atol=0.15)
    np.testing.assert_allclose(wide.cov(), [[4, 3], [3, 9]], atol=0.4)


def years_table(spark, histories):
    rows = [("a", k, "S", ys) for k, ys in enumerate(histories)]
    return spark.createDataFrame(rows, "area string, individual_id int, subarea string, years array<int>")


def test_capture_history_by_hand(spark):
    years = years_table(spark, [[2000, 2004], [2001]])
    got = {r.individual_id: r.history for r in recapture.capture_histories(years).collect()}
    assert got == {0: "101", 1: "010"}
    assert [(r.year, r.gap) for r in recapture.occasion_gaps(years).orderBy("year").collect()] == [(2001, 1), (2004, 3)]


def test_occasion_statistics_by_brute_force(spark):
    rng = np.random.default_rng(5)
    histories = [sorted(map(int, 2000 + np.flatnonzero(rng.random(7) < 0.35))) for _ in range(120)]
    histories = [h for h in histories if h]
    got = {r.year: r for r in recapture.occasion_statistics(years_table(spark, histories)).collect()}
    for year in range(2000, 2007):
        seen = [h for h in histories if year in h]
        want = {
            "n": len(seen),
            "m": sum(h[0] < year for h in seen),
            "u": sum(h[0] == year for h in seen),
            "r": sum(h[-1] > year for h in seen),
            "z": sum(h[0] < year < h[-1] and year not in h for h in histories),
        }
        assert {k: got[year][k] for k in want} == want


def test_jolly_seber_of_a_closed_population(spark):
    # Everyone is seen every year, so the estimate is the number seen.
    stats = recapture.occasion_statistics(years_table(spark, [[2000, 2001, 2002, 2003]] * 9))
    got = recapture.jolly_seber(stats).orderBy("year").collect()
    assert [r.n_hat for r in got] == [None, 9, 9, None] and [r.p for r in got] == [None, 1, 1, None]
    assert got[1].phi == 1 and got[1].entries == 0


def test_derived_abundance_by_hand(spark):
    rows = [("a", "S", 2000, 100.0, 0.6, 0.5), ("a", "S", 2002, 100.0, 0.4, 0.5), ("a", "T", 2000, 10.0, 1.0, 1.0), ("a", "T", 2002, 10.0, 0.0, 1.0)]
    parameters = spark.createDataFrame(rows, "area string, subarea string, year int, n_super double, entry_share double, survival double")
    got = [r.n_hat for r in recapture.derived_abundance(parameters).orderBy("year").collect()]
    assert got == pytest.approx([70.0, 60 * 0.25 + 40 + 10])


def test_resight_share_of_a_single_row(spark):
    rows = [("x", 1, True), ("y", 1, False), ("y", 2, True), ("y", 3, None), ("z", 1, True), ("z", 2, True), ("z", 3, False)]
    placed = spark.createDataFrame(rows, "individual_id string, row_seq int, in_subarea boolean")
    got = {r.individual_id: r.prob_subarea for r in resight.resight_share(placed).collect()}
    assert got == {"x": 1.0, "y": 0.5, "z": 0.5}
    assert {r.individual_id for r in resight.resight_share(placed, drop_singletons=True).collect()} == {"y", "z"}


def test_discovery_ends_at_the_totals(spark, sf_dir):
    curves = discovery.discovery(study(spark, sf_dir).curated(types=True))
    totals = {r.area: r for r in curves.groupBy("area").agg(F.sum("total_sight").alias("t"), F.sum("original").alias("o")).collect()}
    ends = discovery.endpoints(curves).collect()
    assert ends and all((r.cum_sight, r.cum_original) == (totals[r.area].t, totals[r.area].o) for r in ends)


def test_known_abundance(spark):
    got = study(spark, "/root/testdata/sf0.01").jolly_seber().filter("area = 'Hawaii'").orderBy("year").collect()
    assert [(r.n, r.m, r.r, r.z) for r in got][:3] == [(148, 0, 136, 0), (164, 90, 148, 46), (136, 113, 118, 81)]
    assert [r.n_hat and round(r.n_hat, 1) for r in got] == [None, 256.9, 248.4, 248.6, 263.1, None]


def _fits(spark):
    rows = [
        ("A", model, 3, 10.0 + model, 100, 1.0, f"p{k}", value, 0.1)
        for model in (1, 2)
        for k, value in enumerate((0.5, 0.7, 0.9))
    ]
    return spark.createDataFrame(
        rows,
        "stock string, model_id bigint, npar bigint, neg2lnl double, n_eff bigint, chat double, parameter string, "
        "estimate double, se double",
    )


def test_averages_of_models_that_agree(spark):
    from tideline.operators import models

    weights = models.model_weights(_fits(spark)).collect()
    assert len(weights) == 2
    assert abs(sum(r["weight"] for r in weights) - 1) < 1e-12
    averages = {r["parameter"]: round(r["estimate"], 9) for r in models.model_average(_fits(spark)).collect()}
    assert averages == {"p0": 0.5, "p1": 0.7, "p2": 0.9}


def test_stock_without_theta_keeps_its_rows(spark):
    from tideline.operators import trend

    estimates = spark.createDataFrame([("A", 2000, 100.0, 10.0)], "stock string, year int, n_hat double, se double")
    theta = spark.createDataFrame([], "stock string, theta double, theta_var double")
    row = trend.corrected_abundance(estimates, theta).first()
    assert (row["n_hat"], row["n_i"], row["lcl"]) == (100.0, None, None)


def test_null_estimate_is_not_present(spark):
    from tideline.operators import trend

    rows = [("A", 2000, 1.0, 1.0), ("A", 2001, 1.0, 1.0), ("B", 2000, None, None), ("B", 2001, 2.0, 1.0)]
    estimates = spark.createDataFrame(rows, "stock string, year int, n_hat double, se double")
    assert trend.common_years(estimates).first()["years"] == 1


def test_first_rows_are_hashed(spark, sf_dir):
    from tideline.plans.queries import queries

    for name in ("individual_subarea", "stratified_sightings", "seen_once", "encounters_by_year_long"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan, name


def test_encounters_count_where_their_first_row_is(spark):
    from tideline.operators import effort

    rows = [
        (3, "e1", "Oahu", "OA", 2001, "i1", "RWB"), (1, "e1", "Oahu", "OB", 2000, "i2", "PWF"), (2, "e1", "Oahu", "OA", 2001, "i1", None),
        (4, "e2", "Oahu", "OA", 2001, "i1", "RWB"), (5, "e3", "Hawaii", "HA", 2002, "i3", None), (7, "e4", "Hawaii", None, 2002, "i4", "RWB"),
        (6, "e5", "Elsewhere", "NA", 2003, "i5", "someone"), (8, None, "Hawaii", "HA", 2003, "i3", "RWB"),
    ]
    stratified = spark.createDataFrame(
        rows, "row_seq bigint, encounter_id string, area string, subarea string, year int, individual_id string, source string"
    )
    report = [tuple(r) for r in effort.encounter_report(stratified).collect()]
    assert report == [
        ("Oahu", "OA", "2001-2001", 1, 1, 0, 0, 1),
        ("Oahu", "OB", "2000-2000", 1, 0, 1, 0, 1),
        ("Hawaii", "HA", "2002-2003", 1, 1, 0, 1, 2),
        ("Elsewhere", "NA", "2003-2003", 1, 0, 0, 1, 1),
        ("Total", "", "", 4, 2, 1, 2, 5),
    ]
    long = effort.encounters_by_year(stratified)
    assert long.columns == ["stock", "subarea", "year", "num_individuals", "enc_type", "num_enc"]
    counted = {tuple(r)[:3] + (r["enc_type"],): r["num_enc"] for r in long.collect() if r["num_enc"]}
    assert counted == {
        ("Oahu", "OA", 2001, "CRC encounters"): 1,
        ("Oahu", "OB", 2000, "PWF encounters"): 1,
        ("Hawaii", "HA", 2002, "Other encounters"): 1,
        ("Hawaii", "HA", 2003, "CRC encounters"): 1,
        ("Elsewhere", "NA", 2003, "Other encounters"): 1,
    }
    plan = effort.encounters_by_year(stratified)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan
    assert "SortAggregate" not in plan


def test_files_without_order_are_refused(spark, tmp_path):
    import pytest

    from tideline.sources.sightings import read_csv

    spark.range(4).selectExpr("id", "'x' as y").repartition(2).write.csv(str(tmp_path / "many"), header=True)
    with pytest.raises(ValueError, match="row_seq"):
        read_csv(spark, str(tmp_path / "many"))


def _resampled(spark, seed=4, animals=400, occasions=7):
    rng = np.random.default_rng(seed)
    histories = []
    for _ in range(animals):
        enters, seen = int(rng.integers(0, 4)), []
        for t in range(enters, occasions):
            if t > enters and rng.random() > 0.85:
                break
            if rng.random() < 0.5:
                seen.append(2000 + t)
        if seen:
            histories.append(seen)
    return years_table(spark, histories)


def test_variances_against_the_bootstrap(spark):
    years = _resampled(spark)
    exact = {r.year: r for r in recapture.jolly_seber(recapture.occasion_statistics(years)).collect()}
    rows = recapture.abundance_bootstrap(years, 400).toPandas()
    wide = rows.pivot(index="rep", columns="year", values="n_hat")
    found = {(r.year_i, r.year_j): r for r in recapture.bootstrap_covariance(spark.createDataFrame(rows.dropna())).collect()}
    for (i, j), r in found.items():
        both = wide[[i, j]].dropna().to_numpy()
        assert r.replicates == len(both) and r["cov"] == pytest.approx(np.cov(both.T)[0, 1] if i != j else np.var(both[:, 0], ddof=1))
    inner = [y for y in exact if exact[y].n_se is not None and (y, y) in found]
    assert len(inner) >= 4
    for year in inner:
        # Resampling adds the chance of the number of individuals itself, about the abundance.
        drawn = found[year, year]["cov"]
        assert 0.5 < drawn / (exact[year].n_se ** 2 + exact[year].n_hat) < 2
    assert all(r.phi_se > 0 for r in exact.values() if r.phi_se is not None)


def test_published_variances_by_hand(spark):
    rows = [("a", 2000, 54, 0, 54, 24, 0), ("a", 2001, 146, 10, 143, 80, 14), ("a", 2002, 169, 37, 164, 70, 57), ("a", 2003, 209, 56, 202, 71, 71)]
    stats = spark.createDataFrame(rows, "area string, year int, n bigint, m bigint, released bigint, r bigint, z bigint")
    got = {r.year: r for r in recapture.jolly_seber(stats).collect()}
    # The capsid data of Jolly (1965): marked 35.02 and 170.54, abundance 511.2 and 779.0, survival 0.649 and 1.015.
    assert got[2001].marked == pytest.approx(35.02, abs=0.01) and got[2002].marked == pytest.approx(170.54, abs=0.01)
    assert got[2001].n_hat == pytest.approx(511.2, abs=0.2) and got[2002].n_hat == pytest.approx(779.0, abs=0.2)
    assert got[2000].phi == pytest.approx(0.649, abs=0.001) and got[2001].phi == pytest.approx(1.015, abs=0.001)
    n, m, released, r, marked, n_hat = 146, 10, 143, 80, got[2001].marked, got[2001].n_hat
    want = n_hat * (n_hat - n) * ((marked - m + released) / marked * (1 / r - 1 / released) + (1 - m / n) / m)
    assert got[2001].n_se == pytest.approx(math.sqrt(want))
    shares = [(marked - m) * (marked - m + released) / marked**2 * (1 / r - 1 / released), (1 - got[2000].phi) / marked]
    assert got[2000].phi_se == pytest.approx(got[2000].phi * math.sqrt(sum(shares)))


def test_factor_of_singular_and_indefinite_covariances(spark):
    base = np.array([[2.0, 1.0], [1.0, 3.0], [3.0, 4.0]])
    singular = base @ base.T
    indefinite = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    years = (2000, 2001, 2003)
    rows = [(s, years[i], years[j], float(m[i, j])) for s, m in (("s", singular), ("i", indefinite)) for i in range(3) for j in range(3)]
    rows += [("n", 2000, 2000, 4.0), ("n", 2000, 2001, None), ("n", 2001, 2000, None), ("n", 2001, 2001, None)]
    table = spark.createDataFrame(rows, "stock string, year_i int, year_j int, cov double")
    factor = trend.covariance_factor(table).toPandas()
    own = factor[factor.stock == "s"].pivot(index="year_i", columns="year_j", values="l").to_numpy()
    assert own.shape == (3, 2)
    np.testing.assert_allclose(own @ own.T, singular, atol=1e-9)
    assert np.isfinite(factor.l).all() and set(factor[factor.stock == "n"].year_i) == {2000}
    estimates = spark.createDataFrame(
        [("s", y, 10.0 * k) for k, y in enumerate(years)] + [("s", 2004, 5.0), ("s", 2005, None)], "stock string, year int, n_hat double"
    )
    drawn = trend.abundance_draws(estimates, trend.covariance_factor(table), 6000).toPandas().pivot(index="rep", columns="year", values="n_hat")
    assert list(drawn.columns) == [2000, 2001, 2003, 2004] and (drawn[2004] == 5.0).all()
    np.testing.assert_allclose(drawn[list(years)].cov(), singular, rtol=0.08)


def test_no_survival_leaves_nothing(spark):
    rows = [("a", "S", 2000, 100.0, 0.5, 0.0), ("a", "S", 2001, 100.0, 0.3, 1.0), ("a", "S", 2004, 100.0, 0.2, 0.0)]
    parameters = spark.createDataFrame(rows, "area string, subarea string, year int, n_super double, entry_share double, survival double")
    got = [r.n_hat for r in recapture.derived_abundance(parameters).orderBy("year").collect()]
    assert got == pytest.approx([50.0, 30.0, 50.0])


def test_derived_abundance_gives_back_the_estimates(spark):
    years = _resampled(spark)
    estimates = {r.year: r.n_hat for r in recapture.jolly_seber(recapture.occasion_statistics(years)).collect()}
    parameters = recapture.entry_parameters(years)
    assert parameters.agg(F.sum("entry_share")).first()[0] == pytest.approx(1.0)
    for row in recapture.derived_abundance(parameters).collect():
        assert row.n_hat == pytest.approx(estimates[row.year] or 0.0) or estimates[row.year] is None


def test_expected_years_by_drawing(spark):
    from tideline.operators import sampling

    params = spark.createDataFrame([("a", 6, 40), ("b", 1, 7), ("c", 3, None)], "area string, n_occasions bigint, n_original bigint")
    got = {(r.area, r.value): r.n for r in sampling.expected_years(params, "area").collect()}
    assert {k: n for k, n in got.items() if k[0] != "a"} == {("b", 1): 7.0}
    assert sum(n for k, n in got.items() if k[0] == "a") == pytest.approx(200)
    rng = np.random.default_rng(1)
    counts = np.zeros(7)
    for cohort in range(1, 6):
        later = 6 - cohort
        alive = np.cumprod(rng.random((80_000, later)) < 0.9, axis=1)
        values = 1 + (alive * (rng.random((80_000, later)) < 0.4)).sum(1)
        counts += np.bincount(values, minlength=7) / 2000
    for value in range(1, 7):
        assert got["a", value] == pytest.approx(counts[value], abs=0.6)


def test_fractional_frequencies(spark):
    """Weights of halves twice over are whole ones: quantiles, density and ranks agree with the sample written out."""
    values, weights = [1.0, 2.0, 4.0, 7.0], [3.0, 5.0, 2.0, 1.0]
    rows = [("s", "x", v, w / 2) for v, w in zip(values, weights, strict=True)] * 2
    rows += [("s", "y", 2.0, 1.5), ("s", "y", 3.0, 2.5)]
    table = spark.createDataFrame(rows, "s string, type string, value double, n double")
    sample = np.repeat(values, np.array(weights, int))
    spread = min(sample.std(ddof=1), (np.quantile(sample, 0.75) - np.quantile(sample, 0.25)) / 1.34)
    width = 0.9 * spread * len(sample) ** -0.2
    for r in ranktest.density(table, "s", points=20).filter("type = 'x'").collect():
        want = np.exp(-(((r.x - sample) / width) ** 2) / 2).sum() / (len(sample) * width * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want)
    row = ranktest.rank_sum(table, "s", "x", "y").first()
    w = sum(a * b * ((v > u) + 0.5 * (v == u)) for v, a in zip(values, weights, strict=True) for u, b in ((2.0, 1.5), (3.0, 2.5)))
    assert (row.n_x, row.n_y) == (11.0, 4.0) and row.w == pytest.approx(w)


def test_every_bin_of_a_histogram(spark):
    rows = [("a", 0.0), ("a", 0.05), ("a", 29.99), ("a", 31.0), ("b", 40.0)]
    got = ranktest.histogram(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    assert len(got) == 300 and sum(r.n for r in got if r.g == "a") == 3 and sum(r.n for r in got if r.g == "b") == 0
    assert {r.bin for r in got} == set(range(150))
