"""Compare a registered query with its SQL on the same tables, column by column."""

from __future__ import annotations

import datetime as dt
import pathlib

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else value
    return value.isoformat() if isinstance(value, dt.date | dt.datetime) else value


def _rows(rows, order):
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, con, sql: str, tolerance: float = 0.0) -> str | None:
    """A description of the first difference, or None."""
    rel = con.sql(sql)
    names, types = list(rel.columns), [str(t) for t in rel.types]
    spark_types = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    for name, kind in zip(names, types, strict=True):
        if spark_types[name] != kind:
            return f"type of {name}: {spark_types[name]} against {kind}"
    wanted = sorted(names)
    left = _rows([tuple(r) for r in spark_df.collect()], [spark_df.columns.index(n) for n in wanted])
    right = _rows(rel.fetchall(), [names.index(n) for n in wanted])
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right, strict=True):
        for name, x, y in zip(wanted, a, b, strict=True):
            close = isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance
            if x != y and not close:
                return f"{name}: {x!r} against {y!r} in {dict(zip(wanted, a, strict=True))}"
    return None
