"""Two-sample rank-sum test and the data behind its figures, for all strata at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline import fixed_values as fv
from tideline.functions import expr, tails


def rank_sum(
    frequencies: DataFrame, stratum: str, x: str, y: str, alternative: str = "two.sided", value: str = "value"
) -> DataFrame:
    """Rank-sum test of sample ``x`` against ``y`` per stratum, by the normal approximation.

    ``frequencies`` has columns stratum, ``type``, value and ``n``: rows are added up per
    distinct value before ranking, and only distinct values are sorted. These are few: years
    seen, or one mean per replicate. Ties get mid-ranks; the variance is corrected for ties
    and the statistic for continuity. ``n`` may be a weight that is no whole number, such as an
    expected frequency: a value of weight t then takes the ranks from the weight below it on, t of them.
    ``n_x`` and ``n_y`` have the type of ``n``, long or double.
    """
    in_x, in_y = F.col("type") == x, F.col("type") == y
    size = "double" if frequencies.schema["n"].dataType.typeName() in ("double", "float") else "bigint"
    values = (
        frequencies.filter(in_x | in_y)
        .groupBy(stratum, value)
        .agg(
            F.coalesce(F.sum(F.when(in_x, F.col("n"))), F.lit(0)).alias("n_x"),
            F.sum("n").alias("ties"),
        )
    )
    lower = Window.partitionBy(stratum).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn(
        "mid_rank", F.coalesce(F.sum("ties").over(lower), F.lit(0)) + (F.col("ties") + 1) / 2.0
    )
    m, n, total = F.col("m"), F.col("n"), F.col("m") + F.col("n")
    shift = {"two.sided": F.signum(F.col("centred")) * 0.5, "less": F.lit(-0.5), "greater": F.lit(0.5)}[alternative]
    tested = (
        ranked.groupBy(stratum)
        .agg(
            F.sum("n_x").cast("double").alias("m"),
            (F.sum("ties") - F.sum("n_x")).cast("double").alias("n"),
            F.sum(F.col("n_x") * F.col("mid_rank")).alias("rank_x"),
            F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("tie_sum"),
        )
        .withColumn("w", F.col("rank_x") - m * (m + 1) / 2)
        .withColumn("centred", F.col("w") - m * n / 2)
        .withColumn("variance", m * n / 12 * (total + 1 - F.try_divide(F.col("tie_sum"), total * (total - 1))))
        .withColumn("z", F.try_divide(F.col("centred") - shift, F.sqrt("variance")))
        .withColumn("lower_tail", tails.normal_cdf(F.col("z")))
    )
    below, above = F.col("lower_tail"), 1 - F.col("lower_tail")
    both = F.when(below.isNotNull(), F.least(F.lit(1.0), 2 * F.least(below, above)))
    p = {"two.sided": both, "less": below, "greater": above}[alternative]
    return tested.select(
        stratum,
        m.cast(size).alias("n_x"),
        n.cast(size).alias("n_y"),
        "w",
        "z",
        p.alias("p_value"),
        expr.p_label(p).alias("label"),
    )


def histogram(
    values: DataFrame,
    groups: list[str],
    value: str,
    upper: float = fv.HISTOGRAM_MAX_KM,
    bins: int = fv.HISTOGRAM_BINS,
) -> DataFrame:
    """Counts in all bins over 0 .. ``upper``, centred on multiples of the width; values outside are left out.

    Every distribution has every bin, empty ones with 0. The counts of one distribution are a short map, from which
    the range of bins is read, so nothing is joined.
    """
    width = upper / (bins - 1)
    bin_index = F.greatest(F.ceil(F.col(value) / width - 0.5), F.lit(0)).cast("int")
    inside = F.when(F.col(value).between(0, upper), bin_index)
    counted = values.groupBy(*groups, inside.alias("bin")).agg(F.count("*").alias("n"))
    entries = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))
    return (
        counted.groupBy(*groups)
        .agg(F.map_from_entries(entries).alias("counts"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .select(
            *groups,
            "bin",
            F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0).cast("bigint")).alias("n"),
            (F.col("bin") * width).alias("centre"),
        )
    )


def density(
    frequencies: DataFrame, stratum: str, value: str = "value", points: int = fv.DENSITY_POINTS
) -> DataFrame:
    """Gaussian kernel density of each sample, on an even grid over the range of the stratum.

    Few distinct values (years seen) are expected, so each sample is one row with an array of values.
    ``n`` may be a weight that is no whole number; variance and quartiles count with it.
    """
    v, n = F.col(value).cast("double"), F.col("n").cast("double")

    def quantile(q: float) -> Column:
        """Between the values at ranks k and k + 1 around 1 + q (size - 1); that at a rank is the first whose weight
        and those below add up to it. With whole weights this is the linear rule on the sample written out."""
        rank = 1 + q * (F.col("size") - 1)

        def at(k: Column) -> Column:
            reached = F.filter("values", lambda e: e["upto"] >= k - 1e-9)
            return F.coalesce(F.get(reached, F.lit(0))["v"], F.col("most"))

        low = at(F.floor(rank))
        return low + (at(F.floor(rank) + 1) - low) * (rank - F.floor(rank))

    samples = (
        frequencies.filter(F.col("n") > 0)
        .groupBy(stratum, "type", v.alias("v"))
        .agg(F.sum(n).alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy(stratum, "type").orderBy("v")))
        .groupBy(stratum, "type")
        .agg(
            F.sum("n").alias("size"),
            F.sum(F.col("n") * F.col("v")).alias("sum_v"),
            F.sum(F.col("n") * F.col("v") * F.col("v")).alias("sum_v2"),
            F.min("v").alias("least"),
            F.max("v").alias("most"),
            F.array_sort(F.collect_list(F.struct("v", "n", "upto"))).alias("values"),
        )
        .withColumn("sd", F.sqrt((F.col("sum_v2") - F.col("sum_v") * F.col("sum_v") / F.col("size")) / F.expr("nullif(size - 1, 0)")))
        .withColumn("spread", F.least("sd", (quantile(0.75) - quantile(0.25)) / 1.34))
        .withColumn("scale", F.expr("coalesce(nullif(spread, 0), nullif(sd, 0), nullif(abs(least), 0), 1)"))
        .withColumn("bandwidth", F.when(F.col("size") > 1, 0.9 * F.col("scale") * F.pow("size", F.lit(-0.2))))
    )
    whole = Window.partitionBy(stratum)
    step = (F.col("upper") - F.col("lower")) / (points - 1)
    gridded = (
        samples.withColumns({"lower": F.min("least").over(whole), "upper": F.max("most").over(whole)})
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.col("lower") + F.col("point") * step)
    )
    kernel = F.aggregate(
        "values",
        F.lit(0.0),
        lambda total, e: total + e["n"] * F.exp(-F.pow((F.col("x") - e["v"]) / F.col("bandwidth"), F.lit(2.0)) / 2),
    )
    return gridded.select(
        stratum, "type", "point", "x", (kernel / (F.col("size") * F.col("bandwidth") * F.sqrt(2 * F.pi()))).alias("density")
    )
