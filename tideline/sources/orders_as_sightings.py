"""Sightings rebuilt from the order tables: the input of the registered queries.

A customer is an individual, an order a sighting, and a nation in one month an
encounter. Labels, positions and scores carry the dirt of a real sightings file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    # customer is joined without a hint: Spark broadcasts it while it is small, and
    # adaptive execution splits the partition of a customer with very many orders.
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    moved = F.expr("n_regionkey < 4 AND o_orderkey % 23 = 0")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_orderkey").cast("bigint").alias("row_seq"),
            F.col("o_custkey").cast("bigint").alias("individual_id"),
            F.col("n_nationkey").alias("nk"),
            F.when(moved, F.expr("(n_regionkey + 1) % 4")).otherwise(F.col("n_regionkey")).alias("rk"),
            F.to_date("o_orderdate").alias("sight_date"),
            F.expr("((o_custkey * 61) % 800 + (o_orderkey * 37) % 200) / 1000.0D").alias("fx"),
            F.expr("((o_custkey * 83) % 800 + (o_orderkey * 71) % 200) / 1000.0D").alias("fy"),
        )
        .withColumn("year", F.year("sight_date"))
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical sightings table, but for ``sight_type`` (see ``with_sight_type``)."""
    lat = """CASE WHEN row_seq % 53 = 0 OR row_seq % 17 = 0 THEN NULL
        WHEN rk = 0 THEN 21.7D + 0.7D * fx WHEN rk = 1 THEN 21.1D + 0.7D * fx
        WHEN rk = 2 THEN 20.4D + 0.9D * fx ELSE 18.9D + 1.4D * fx END"""
    lon = """CASE WHEN row_seq % 17 = 0 THEN NULL ELSE (CASE WHEN row_seq % 10 = 0 THEN 1.0D ELSE -1.0D END) *
        (CASE rk WHEN 0 THEN 160.3D - 1.2D * fy WHEN 1 THEN 158.3D - 0.7D * fy
                 WHEN 2 THEN 157.6D - 1.2D * fy ELSE 156.4D - 0.7D * fy END) END"""
    area = """CASE rk WHEN 0 THEN 'Kauai/Niihau' WHEN 1 THEN 'Oahu' WHEN 3 THEN 'Hawaii'
        WHEN 2 THEN element_at(array('4-island', '4-island ', '4-Island', 'Maui'), CAST(row_seq % 4 + 1 AS INT))
        ELSE element_at(array('Offshore', 'Unknown', 'NWHI'), CAST(row_seq % 3 + 1 AS INT)) END"""
    island = """CASE WHEN rk = 0 AND row_seq % 37 = 0 THEN 'Kaula Rock' WHEN row_seq % 43 = 0 THEN ''
        ELSE concat('ISL_', nk) END"""
    depth = """CASE WHEN row_seq % 13 = 0 THEN NULL WHEN row_seq % 29 = 0 THEN 3500
        WHEN row_seq % 31 = 0 THEN 3000 ELSE (row_seq * 7) % 2900 END"""
    source = """CASE WHEN row_seq % 101 = 0 THEN NULL WHEN row_seq % 10 < 6 THEN 'RWB' WHEN row_seq % 10 = 6 THEN 'PWF'
        WHEN row_seq % 10 = 7 THEN 'PWF ' WHEN row_seq % 10 = 8 THEN 'PWF Line Transect' ELSE 'Citizen' END"""
    return _base(spark, sf_dir).select(
        "row_seq",
        "individual_id",
        "sight_date",
        "year",
        F.expr("concat(nk, '-', date_format(sight_date, 'yyyyMM'))").alias("encounter_id"),
        F.expr(area).alias("area"),
        F.expr(island).alias("island"),
        F.expr(lat).alias("lat"),
        F.expr(lon).alias("lon"),
        F.expr(depth).cast("double").alias("depth_m"),
        F.expr("CAST(CASE WHEN individual_id % 5 = 0 THEN 2 ELSE 3 + individual_id % 2 END AS INT)").alias(
            "distinctiveness"
        ),
        F.expr("CAST(CASE WHEN row_seq % 6 = 0 THEN 2 ELSE 3 + row_seq % 2 END AS INT)").alias("photo_quality"),
        F.expr("CASE WHEN row_seq % 41 = 0 THEN 'incomplete' ELSE 'complete' END").alias("entry_status"),
        F.expr(source).alias("source"),
    )


def with_sight_type(rows: DataFrame) -> DataFrame:
    """Add ``sight_type``: first of its individual, first of its year, or later in it.

    The first rows are found by an aggregate and joined back on the unique row number,
    so an individual with very many rows is spread over all tasks.
    """
    first_rows = (
        rows.groupBy("individual_id", "year")
        # Days and row numbers as one number: order keys are far below 2 ** 40, days below 2 ** 20.
        .agg(F.min(F.unix_date("sight_date").cast("bigint") * (1 << 40) + F.col("row_seq")).alias("first"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("individual_id").orderBy("first")))
        .select(F.col("first").bitwiseAND((1 << 40) - 1).alias("row_seq"), (F.col("rank") == 1).alias("is_original"))
    )
    sight_type = """CASE WHEN is_original
            THEN element_at(array('Original', 'Original ', 'original'), CAST(row_seq % 3 + 1 AS INT))
        WHEN is_original IS NOT NULL THEN 'Between-year'
        WHEN row_seq % 19 = 0 THEN 'within-day'
        WHEN row_seq % 2 = 0 THEN 'within-year' ELSE 'Within-year' END"""
    return rows.join(first_rows, "row_seq", "left").withColumn("sight_type", F.expr(sight_type)).drop("is_original")


def model_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fitted model and parameter, three to a model, from the parts table."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    return parts.select(
        F.expr("concat('S', p_partkey % 40)").alias("stock"),
        F.col("p_partkey").cast("bigint").alias("model_id"),
        F.expr("CAST(1 + p_size % 30 AS BIGINT)").alias("npar"),
        F.expr("p_retailprice / 50.0D").alias("neg2lnl"),
        F.expr("CAST(150 + p_partkey % 100 AS BIGINT)").alias("n_eff"),
        F.expr("1.0D + (p_partkey % 40) / 20.0D").alias("chat"),
        F.expr("concat('p', k)").alias("parameter"),
        F.expr("0.3D + 0.2D * k + ((p_partkey * 31 + 7 * k) % 150) / 1000.0D").alias("estimate"),
        F.expr("(1 + (p_partkey + k) % 50) / 1000.0D").alias("se"),
    )
