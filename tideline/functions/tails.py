"""Tail probabilities of test statistics, for result-sized tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 80
NEAR = 3.0


def normal_cdf(z: Column) -> Column:
    """P(Z <= z) of the standard normal.

    Near zero the power series of the integral is used, further out the continued
    fraction of the tail, evaluated from the inside.
    """
    size = F.abs(z)
    bell = F.exp(-size * size / 2) / F.sqrt(2 * F.pi())
    start = F.struct(size.alias("term"), size.alias("total"))

    def step(state, k):
        term = state["term"] * size * size / (2 * k + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda state: state["total"])
    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1)), size, lambda inner, k: size + k / inner)
    upper = F.when(size < NEAR, 0.5 - bell * series).otherwise(bell / fraction)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def f_upper_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F >= f) of the F distribution."""

    def beta_share(x: float, a: float, b: float) -> float:
        """Regularised incomplete beta function by its continued fraction."""
        if x <= 0.0 or x >= 1.0:
            return 0.0 if x <= 0.0 else 1.0
        if x > (a + 1.0) / (a + b + 2.0):
            return 1.0 - beta_share(1.0 - x, b, a)
        scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
        terms = 400
        inner = 1.0
        for m in range(terms, 0, -1):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            inner = 1.0 + even / (1.0 + odd / inner)
        first = -(a + b) * x / (a + 1.0)
        return math.exp(scale) / (a * (1.0 + first / inner))

    @F.pandas_udf("double")
    def tail(fs: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        rows = zip(fs, n1, n2, strict=True)
        return pd.Series(
            [
                None if pd.isna(v) or not (d1 > 0 and d2 > 0) else beta_share(d2 / (d2 + d1 * v), d2 / 2, d1 / 2)
                for v, d1, d2 in rows
            ],
            dtype="float64",
        )

    return tail(f, df1, df2)
