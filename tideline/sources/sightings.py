"""Reading sightings into the canonical schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import expr
from tideline.sources import schema


def read_csv(spark: SparkSession, path: str, row_seq: str | None = None, multi_line: bool = False) -> DataFrame:
    """Scan a CSV file of sightings.

    ``row_seq`` names a column holding the file order; without it the order of a
    single file's records is used. ``multi_line`` allows line breaks inside quotes
    (such a file is read by one task). The file order decides ties, so tables of
    many files have to carry it as a column.
    """
    text = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multi_line)
    if row_seq is None and len(text.inputFiles()) > 1:
        raise ValueError("several files have no order of their own: name the column that holds it in row_seq")
    return typed(text, row_seq)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Scan a Parquet table that already has the canonical columns."""
    return spark.read.parquet(path).select(*schema.COLUMNS)


def typed(text: DataFrame, row_seq: str | None = None) -> DataFrame:
    """All-text rows to the canonical schema; unreadable numbers and dates become null.

    In text columns an empty field is the empty text and ``NA`` is null. A missing
    identifier stands for one individual called ``NA``.
    """
    columns = {name: F.col(f"`{header}`") for name, header in schema.source_columns(text.columns).items()}

    def plain(name):
        return F.when(columns[name] == "NA", None).otherwise(F.coalesce(columns[name], F.lit("")))

    order = F.monotonically_increasing_id() if row_seq is None else F.col(f"`{row_seq}`")
    values = {name: plain(name) for name in schema.TEXT_COLUMNS}
    values |= {name: expr.clean_number(columns[name]) for name in schema.NUMBER_COLUMNS}
    values |= {name: expr.clean_number(columns[name]).cast("int") for name in schema.SCORE_COLUMNS}
    values["individual_id"] = F.coalesce(columns["individual_id"], F.lit("NA"))
    values["sight_date"] = expr.clean_date(columns["sight_date"])
    values["row_seq"] = order.cast("bigint")
    values["year"] = F.year("sight_date")
    dated = text.select(*[values[name].alias(name) for name in schema.COLUMNS if name != "year"])
    return dated.withColumn("year", values["year"]).select(*schema.COLUMNS)
