"""Writing result tables."""

from __future__ import annotations

import datetime as dt
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame


def dated_name(prefix: str, day: dt.date | None = None) -> str:
    """File name carrying the date: ``<prefix> <yyyy-mm-dd> .csv``."""
    return f"{prefix} {(day or dt.date.today()).isoformat()} .csv"


def write_dated_csv(df: DataFrame, folder: str, prefix: str, day: dt.date | None = None) -> str:
    """Write a table as CSV parts with header under a dated name, and return the path."""
    path = f"{folder}/{dated_name(prefix, day)}"
    df.write.mode("overwrite").csv(path, header=True)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write a table under the shared folder of ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage of a table that several jobs read; a lost executor then costs
    a read, not a recomputation. The folder has to be set on the session.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = spark.sparkContext.master.startswith("local")
    if not local and urlsplit(folder).scheme in ("", "file"):
        raise ValueError(f"{folder} is a folder of one machine; executors on others cannot see it")
    path = f"{folder}/tideline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
