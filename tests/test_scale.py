"""Operators that split hot keys and large groups give the plain result."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import draws
from tideline.operators import curate, effort, models, movement, recapture, spread
from tideline.operators.skew import lookup_join
from tideline.plans.queries import study
from tideline.plans.study import Study
from tideline.sources import orders_as_sightings as source
from tideline.sources.sightings import read_table


def facts(spark):
    """One key holds more than a third of the rows; key 7 has no lookup row."""
    return spark.range(300).select(
        F.col("id").alias("row_seq"), F.when(F.col("id") % 5 < 2, 1).otherwise(F.col("id") % 8).alias("key")
    )


def test_lookup_join_equals_plain_join(spark):
    rows = facts(spark)
    lookup = rows.filter("key <> 7").groupBy("key").agg(
        F.count("*").alias("rows"), F.when(F.first("key") != 3, F.max("row_seq")).alias("top")
    )
    for how in ("left", "inner"):
        got = lookup_join(rows, lookup, "key", rows="rows", how=how, rows_per_slice=40)
        want = rows.join(lookup.drop("rows"), "key", how).select("row_seq", "key", "top")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_rows_are_dealt_over_slices(spark):
    rows = facts(spark)
    lookup = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("row_seq").alias("top"))
    # Without broadcasting by size and merging of small partitions, as with large tables.
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(rows, lookup, "key", rows="rows", rows_per_slice=10)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        parts = joined.filter("key = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert "SortMergeJoin [key" in plan and "_slice" in plan.split("SortMergeJoin", 1)[1].split("]")[0]
    assert parts > 4


def test_hot_individuals_in_curation(spark, sf_dir):
    s = study(spark, sf_dir)
    small = {"rows_per_slice": 2}
    raw, curated, strata = s.sightings(), s.curated(), s.strata()
    for build in (
        lambda **k: curate.stratify(curated, strata, **k),
        lambda **k: curate.movement_base(curated, **k),
        lambda **k: curate.rows_of_individuals_seen_at(raw, **k),
        lambda **k: curate.distinctiveness_base(raw, min_rows=2, **k),
    ):
        assert Counter(map(str, build(**small).collect())) == Counter(map(str, build().collect()))


def test_hot_stock_in_model_weights(spark, sf_dir):
    fits = source.model_fits(spark, sf_dir)
    plain, cut = models.model_weights(fits), models.model_weights(fits, rows_per_slice=2)
    key = lambda r: (r.stock, r.model_id, round(r.weight, 12))
    assert sorted(map(key, plain.collect())) == sorted(map(key, cut.collect()))
    sums = plain.groupBy("stock").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-9 for r in sums)


def test_explode_range_crosses_blocks(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", 12), ("d", None)], "k string, n int")
    got = spread.explode_range(df, "i", F.col("n"), block=4).groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("i"))
    assert {r.k: list(r.i) for r in got.collect()} == {"a": list(range(1, 6)), "c": list(range(1, 13))}


def test_number_at_random_is_row_number(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    key = draws.order_key(5, F.col("id"))
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(key)))
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    for rows_per_slice in (100, 1700, 10_000):
        got = spread.number_at_random(df, ["g"], key, sizes, rows_per_slice)
        assert sorted((r.id, r.position) for r in got.collect()) == sorted((r.id, r.position) for r in want.collect())


def test_replicates_are_dealt_after_an_aggregate_of_the_same_keys(spark):
    """The exchange that deals rows is one of its own: adaptive execution may not merge it into one task."""
    few = spark.range(200).selectExpr("id % 50 AS k").groupBy("k").count()
    repeated = spread.repeat(few, "rep", 1, 100, "k")
    assert repeated.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert repeated.count() == 5000


def test_samples_of_large_groups_are_even(spark):
    """Groups cut into slices: one row per group and replicate, each row with the same chance."""
    rows = spark.range(40).selectExpr("'a' AS area", "7 AS individual_id", "2000 AS year", "id AS row_seq", "1.0D AS lat", "2.0D AS lon")
    rows = rows.unionByName(rows.limit(1).selectExpr("area", "8 AS individual_id", "year", "row_seq + 100 AS row_seq", "lat", "lon"))
    got = movement.sample_one_per_year(rows, 4000, rows_per_slice=6)
    counts = Counter(r.row_seq for r in got.filter("individual_id = 7").collect())
    assert sum(counts.values()) == 4000 and len(counts) == 40
    assert sum((n - 100) ** 2 / 100 for n in counts.values()) < 80
    assert got.filter("individual_id = 8").count() == 4000


def test_permutation_keeps_individuals_of_each_year(spark, sf_dir):
    rows = movement.positions(study(spark, sf_dir).curated())
    sliced = movement.permute_within_year(rows, 4, rows_per_slice=5).collect()
    own, drawn = (Counter((r.area, r.rep, r.year, r[c]) for r in sliced) for c in ("individual_id", "drawn_id"))
    assert own == drawn and max(own.values()) == 1
    got = movement.permute_within_year(rows, 4).collect()
    own = Counter((r.area, r.rep, r.year, r.individual_id) for r in got)
    drawn = Counter((r.area, r.rep, r.year, r.drawn_id) for r in got)
    assert own == drawn and max(own.values()) == 1
    assert any(r.individual_id != r.drawn_id for r in got)
    by_rep = {rep: {(r.area, r.year, r.individual_id): r.drawn_id for r in got if r.rep == rep} for rep in (1, 2)}
    assert by_rep[1].keys() == by_rep[2].keys() and by_rep[1] != by_rep[2]


def test_kept_tables_give_the_same_reports(spark, sf_dir, tmp_path):
    lazy, kept = study(spark, sf_dir), study(spark, sf_dir)
    kept.keep = True
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path))
    try:
        got, again = kept.jolly_seber().collect(), kept.individual_years()
    finally:
        if before is None:
            spark.conf.unset("spark.checkpoint.dir")
    assert again.inputFiles() and sorted(map(str, got)) == sorted(map(str, lazy.jolly_seber().collect()))


def test_filters_and_columns_reach_the_scan(spark, sf_dir, tmp_path):
    raw = study(spark, sf_dir).sightings(types=True)
    raw.write.parquet(f"{tmp_path}/sightings")
    s = Study.of(read_table(spark, f"{tmp_path}/sightings"), first_year=1996, last_year=2001)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = effort.annual_sightings(s.curated())._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    for pushed in ("GreaterThanOrEqual(distinctiveness,3)", "LessThan(depth_m,3000.0)", "EqualTo(entry_status,complete)"):
        assert pushed in scan
    assert "In(area" in scan and "GreaterThanOrEqual(year,1996)" in scan
    read = scan.split("ReadSchema")[1]
    assert not any(unread in read for unread in ("sight_date", "encounter_id", "source", "sight_type", "lat:"))
    assert effort.annual_sightings(s.curated()).count() == effort.annual_sightings(study(spark, sf_dir).curated()).count()


def test_reused_exchange_of_individual_years(spark, sf_dir):
    """Goodness of fit reads the individuals once: every later use is a reused exchange."""
    df = recapture.overdispersion(study(spark, sf_dir).individual_years())
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [x for x in final.splitlines() if "Exchange hashpartitioning(area" in x and "individual_id" in x]
    assert len([x for x in made if "ReusedExchange" not in x]) == 1
    assert len([x for x in made if "ReusedExchange" in x]) >= 2
