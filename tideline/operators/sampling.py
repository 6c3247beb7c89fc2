"""Do individuals turn up in more or fewer years than random sampling would give?

Individuals under random sampling are drawn one by one; their expected frequencies can be computed as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fv
from tideline.functions import draws, expr
from tideline.operators import ranktest
from tideline.operators.spread import explode_range

OBSERVED, RANDOM = "annual.sight", "random.sample"


def occasion_params(curated: DataFrame, stratum: str) -> DataFrame:
    """Number of sampling years and mean yearly number of new individuals, per stratum."""
    yearly = (
        curated.filter(F.col(stratum).isNotNull())
        .groupBy(stratum, "year")
        .agg(expr.count_true(F.col("sight_type") == "Original").alias("originals"))
    )
    return yearly.groupBy(stratum).agg(
        F.count("*").alias("n_occasions"),
        expr.half_even(F.avg(F.when(F.col("originals") > 0, F.col("originals")))).cast("bigint").alias("n_original"),
    )


def observed_years(curated: DataFrame, stratum: str) -> DataFrame:
    """How many individuals were seen in 1, 2, ... years, per stratum."""
    return (
        curated.filter(F.col(stratum).isNotNull())
        .groupBy(stratum, "individual_id")
        .agg(F.countDistinct("year").alias("value"))
        .groupBy(stratum, "value")
        .agg(F.count("*").alias("n"))
    )


def expected_years(
    params: DataFrame,
    stratum: str,
    survival: float = fv.NULL_SURVIVAL,
    detection: float = fv.NULL_DETECTION,
) -> DataFrame:
    """The same under random sampling, in expectation: equal cohorts enter in every year but the last.

    Each later year an individual survives and, alive, is detected with fixed probabilities; its first failure
    to survive ends its detections. A cohort with L years to come is alive for exactly s of them with probability
    survival^s (1 - survival), or survival^L for all; of s years it is detected in d with the binomial
    probability. ``n`` is the expected number of individuals seen in ``value`` = 1 + d years, not a whole number.
    """
    years_left = F.when(F.col("n_occasions") > 1, F.sequence(F.lit(1), F.col("n_occasions") - 1)).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    cohorts = params.filter("n_original > 0").select(stratum, "n_original", F.explode(years_left).alias("later"))
    alive = cohorts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("later"))).alias("s"))
    stays = F.when(F.col("s") < F.col("later"), F.lit(1.0 - survival)).otherwise(1.0)
    lived = alive.withColumn("share", F.pow(F.lit(survival), F.col("s").cast("double")) * stays)
    # C(s, d) p^d q^(s - d) for d = 0 .. s, each from the one before.
    odds = detection / (1 - detection)
    start = F.struct(
        F.pow(F.lit(1.0 - detection), F.col("s").cast("double")).alias("last"),
        F.array(F.pow(F.lit(1.0 - detection), F.col("s").cast("double"))).alias("all"),
    )

    def step(state, d):
        following = state["last"] * (F.col("s") - d + 1) / d * odds
        return F.struct(following.alias("last"), F.concat(state["all"], F.array(following)).alias("all"))

    steps = F.when(F.col("s") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("s"))).otherwise(F.array().cast("array<bigint>"))
    binomial = F.aggregate(steps, start, step, lambda state: state["all"])
    return (
        lived.select(stratum, "n_original", "share", F.posexplode(binomial).alias("d", "chance"))
        .groupBy(stratum, (F.col("d") + 1).cast("bigint").alias("value"))
        .agg(F.sum(F.col("n_original") * F.col("share") * F.col("chance")).alias("n"))
    )


def random_years(
    params: DataFrame,
    stratum: str,
    survival: float = fv.NULL_SURVIVAL,
    detection: float = fv.NULL_DETECTION,
    seed: int = fv.SEED,
) -> DataFrame:
    """The same under random sampling, drawn: equal cohorts enter in every year but the last.

    Each later year an individual survives and, alive, is detected with fixed probabilities. Its first failure to
    survive ends its detections. ``expected_years`` gives the expectation of the draw.
    """
    cohorts = params.withColumn("cohort", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n_occasions") - 1, F.lit(1)))))
    individuals = explode_range(cohorts, "individual", F.col("n_original"))

    def draw(what, occasion):
        return draws.uniform(seed, what, F.col(stratum), F.col("cohort"), F.col("individual"), occasion)

    later = F.when(
        F.col("n_occasions") > F.col("cohort"), F.sequence(F.col("cohort") + 1, F.col("n_occasions"))
    ).otherwise(F.array().cast("array<bigint>"))
    deaths = F.filter(later, lambda t: draw("survive", t) >= survival)
    death = F.col("death")
    years_alive = F.when(death.isNull(), F.col("n_occasions") - F.col("cohort")).otherwise(death - F.col("cohort") - 1)
    detected = F.filter(F.slice(later, F.lit(1), years_alive.cast("int")), lambda t: draw("detect", t) < detection)
    return (
        individuals.withColumn("death", F.try_element_at(deaths, F.lit(1)))
        .groupBy(stratum, (F.size(detected) + 1).cast("bigint").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def resight_frequencies(curated: DataFrame, stratum: str, **null_model) -> DataFrame:
    """Observed and random numbers of individuals by years seen, per stratum and type."""
    observed = observed_years(curated, stratum).withColumn("type", F.lit(OBSERVED))
    null = random_years(occasion_params(curated, stratum), stratum, **null_model).withColumn("type", F.lit(RANDOM))
    return observed.unionByName(null)


def random_sampling_test(frequencies: DataFrame, stratum: str) -> DataFrame:
    """Rank-sum test of the observed years seen against the drawn ones."""
    return ranktest.rank_sum(frequencies, stratum, OBSERVED, RANDOM)
