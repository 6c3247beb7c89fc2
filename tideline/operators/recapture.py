"""Capture histories and closed-form estimates of annual abundance.

The rows are reduced once to one array of years per individual; everything else
is counted from that. Model fitting by an external program is replaced by the
closed-form Jolly-Seber estimators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline import fixed_values as fv
from tideline.functions import draws
from tideline.functions.bulk_draws import Draws, together
from tideline.operators.spread import _tasks


def individual_years(model_rows: DataFrame) -> DataFrame:
    """Per area and individual, its sorted years and its subarea."""
    return model_rows.groupBy("area", "individual_id").agg(
        F.min("subarea").alias("subarea"), F.array_sort(F.collect_set("year")).alias("years")
    )


def occasions(years: DataFrame) -> DataFrame:
    """Per area the sorted years with a sighting. ``model_sightings`` holds four areas, so this has four rows."""
    return years.select("area", F.explode("years").alias("year")).groupBy("area").agg(
        F.array_sort(F.collect_set("year")).alias("occasions")
    )


def occasion_gaps(years: DataFrame) -> DataFrame:
    """Years between successive occasions."""
    return occasions(years).select(
        "area",
        F.inline(
            F.transform(
                F.slice("occasions", 2, F.size("occasions")),
                lambda year, i: F.struct(year.alias("year"), (year - F.get("occasions", i)).alias("gap")),
            )
        ),
    )


def capture_histories(years: DataFrame) -> DataFrame:
    """One text of 0s and 1s per individual, in the order of its area's occasions."""
    with_occasions = years.join(occasions(years), "area")
    marks = F.transform("occasions", lambda y: F.when(F.array_contains("years", y), "1").otherwise("0"))
    return with_occasions.select("area", "individual_id", "subarea", F.array_join(marks, "").alias("history"))


def history_frequency(histories: DataFrame) -> DataFrame:
    return histories.groupBy("area", "subarea", "history").agg(F.count("*").alias("individuals"))


def _occasion_counts(years: DataFrame, groups: list[str], weight: Column) -> DataFrame:
    """Individuals seen, seen first, seen last and seen only at each occasion."""
    seen = years.select(
        *groups,
        weight.alias("w"),
        F.get("years", F.lit(0)).alias("first"),
        F.element_at("years", -1).alias("last"),
        F.explode("years").alias("year"),
    )
    is_first, is_last = F.col("year") == F.col("first"), F.col("year") == F.col("last")

    def total(condition):
        return F.sum(F.when(condition, F.col("w")).otherwise(0))

    return seen.groupBy(*groups, "year").agg(
        F.sum("w").alias("n"),
        total(is_first).alias("u"),
        total(is_last).alias("last"),
        total(is_first & is_last).alias("only"),
    ).filter("n > 0")


def occasion_statistics(
    years: DataFrame, groups: tuple[str, ...] = ("area",), weight: Column | None = None
) -> DataFrame:
    """Counts per occasion: seen n, marked m, new u, released, seen again r, missed z.

    z (seen before and after but not at the occasion) follows from the running
    numbers of first and last sightings, without a row per missed occasion.
    """
    return _statistics(_occasion_counts(years, list(groups), F.lit(1) if weight is None else weight), groups)


def _statistics(counts: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    until = Window.partitionBy(*groups).orderBy("year")
    before = until.rowsBetween(Window.unboundedPreceding, -1)
    through = until.rowsBetween(Window.unboundedPreceding, 0)
    between = F.col("n") - F.col("u") - F.col("last") + F.col("only")
    around = F.coalesce(F.sum("u").over(before), F.lit(0)) - F.sum("last").over(through) + F.col("only")
    return counts.withColumn("z", around - between).select(
        *groups,
        "year",
        "n",
        (F.col("n") - F.col("u")).alias("m"),
        "u",
        F.col("n").alias("released"),
        (F.col("n") - F.col("last")).alias("r"),
        "z",
        "last",
        "only",
    )


def m_array(years: DataFrame) -> DataFrame:
    """Individuals released in one year and next seen in another."""
    steps = F.transform(
        F.slice("years", 2, F.size("years")),
        lambda year, i: F.struct(F.get("years", i).alias("release_year"), year.alias("next_year")),
    )
    return (
        years.select("area", F.inline(steps))
        .groupBy("area", "release_year", "next_year")
        .agg(F.count("*").alias("individuals"))
    )


def _two_by_two(tables: DataFrame) -> DataFrame:
    """Chi-square of 2x2 tables with counts a, b, c, d; null where an expected count is below 2."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    smallest = F.least(a + b, c + d) * F.least(a + c, b + d)
    chi = n * F.pow(a * d - b * c, F.lit(2.0)) / ((a + b) * (c + d) * (a + c) * (b + d))
    return tables.withColumn("chi_square", F.when((n > 0) & (smallest >= 2 * n), chi))


def overdispersion(years: DataFrame) -> DataFrame:
    """Goodness of fit per area: total chi-square over degrees of freedom.

    Two contingency tests per occasion: new against known individuals by seen again or
    never; and seen against missed individuals by next seen at once or later.
    """
    known = occasions(years)
    in_area = known.select("area", "occasions", F.size("occasions").alias("t"))

    def index(year):
        return F.array_position("occasions", F.col(year))

    fates = (
        occasion_statistics(years)
        .join(in_area, "area")
        .filter(index("year").between(2, F.col("t") - 1))
        .select(
            "area",
            (F.col("u") - F.col("only")).alias("a"),
            F.col("only").alias("b"),
            (F.col("n") - F.col("u") - F.col("last") + F.col("only")).alias("c"),
            (F.col("last") - F.col("only")).alias("d"),
        )
    )
    spans = (
        m_array(years)
        .join(in_area, "area")
        .select("area", "t", "individuals", index("release_year").alias("k"), index("next_year").alias("j"))
        .withColumn("i", F.explode(F.sequence("k", F.col("j") - 1)))
        .filter(F.col("i").between(2, F.col("t") - 2))
    )
    seen, at_once = F.col("i") == F.col("k"), F.col("j") == F.col("i") + 1

    def total(condition):
        return F.sum(F.when(condition, F.col("individuals")).otherwise(0))

    returns = (
        spans.groupBy("area", "i")
        .agg(
            total(seen & at_once).alias("a"),
            total(seen & ~at_once).alias("b"),
            total(~seen & at_once).alias("c"),
            total(~seen & ~at_once).alias("d"),
        )
        .drop("i")
    )
    tested = _two_by_two(fates.unionByName(returns)).groupBy("area").agg(
        F.sum("chi_square").alias("chi_square"), F.count("chi_square").alias("df")
    )
    return known.select("area").join(tested, "area", "left").select(
        "area",
        F.coalesce("chi_square", F.lit(0.0)).alias("chi_square"),
        F.coalesce("df", F.lit(0)).cast("bigint").alias("df"),
        F.try_divide("chi_square", F.col("df").cast("double")).alias("c_hat"),
    )


def jolly_seber(statistics: DataFrame, groups: tuple[str, ...] = ("area",)) -> DataFrame:
    """Marked population, abundance, detection, survival and entries per occasion; null where undefined.

    ``n_se`` and ``phi_se`` are the published large-sample standard errors: of abundance given the population
    (Jolly 1965), of survival with its binomial part (Seber 1982), which is left out where survival is above 1.
    """
    following = Window.partitionBy(*groups).orderBy("year")
    n, m, r, z, released = (F.col(c).cast("double") for c in ("n", "m", "r", "z", "released"))
    marked = F.when(r > 0, m + released * z / r)
    usable = (m > 0) & (F.col("marked") > 0)
    alive = F.col("marked") - m + released
    unseen = 1 / r - 1 / released

    def following_value(column: Column) -> Column:
        return F.lead(column).over(following)

    n_var = F.col("n_hat") * (F.col("n_hat") - n) * (alive / F.col("marked") * unseen + (1 - m / n) / m)
    at_next = (F.col("marked") - m) * alive / (F.col("marked") * F.col("marked")) * unseen
    phi_share = (
        following_value(F.when(usable, at_next))
        + F.try_divide(F.col("marked") - m, alive) * unseen
        + F.greatest(1 - F.col("phi"), F.lit(0.0)) / following_value(F.when(usable, F.col("marked")))
    )
    return (
        statistics.withColumn("marked", marked)
        .withColumn("n_hat", F.when(usable, n * F.col("marked") / m))
        .withColumn("p", F.when(usable, m / F.col("marked")))
        .withColumn("phi", F.try_divide(F.lead("marked").over(following), alive))
        .withColumn("entries", F.lead("n_hat").over(following) - F.col("phi") * (F.col("n_hat") - n + released))
        .withColumn("n_se", F.when(usable, F.sqrt(n_var)))
        .withColumn("phi_se", F.when(r > 0, F.col("phi") * F.sqrt(phi_share)))
        .select(*groups, "year", "n", "m", "r", "z", "marked", "n_hat", "p", "phi", "entries", "n_se", "phi_se")
    )


def parameter_ranges(estimates: DataFrame) -> DataFrame:
    """Range of survival, and mean and range of detection, per area."""
    return estimates.groupBy("area").agg(
        F.min("phi").alias("phi_min"),
        F.max("phi").alias("phi_max"),
        F.avg("p").alias("p_mean"),
        F.min("p").alias("p_min"),
        F.max("p").alias("p_max"),
    )


def abundance_bootstrap(
    years: DataFrame, replicates: int = fv.BOOTSTRAP_REPLICATES, seed: int = fv.SEED
) -> DataFrame:
    """Annual abundance in resamples of the individuals.

    Each individual counts a Poisson(1) number of times per replicate, so a resample needs no shuffle of
    individuals. A task draws the replicates of a batch of individuals as arrays, and only counts per occasion
    leave it.
    """
    groups = ("area", "rep")
    dealt = years.select("area", "individual_id", "years").repartition(_tasks(years), F.xxhash64("area", "individual_id"))
    counts = (
        dealt.mapInArrow(_resampled_counts(replicates, seed), "area string, rep int, year int, n long, u long, last long, only long")
        .groupBy(*groups, "year")
        .agg(*[F.sum(c).alias(c) for c in ("n", "u", "last", "only")])
        .filter("n > 0")
    )
    return jolly_seber(_statistics(counts, groups), groups).select("area", "rep", "year", "n", "n_hat")


def _resampled_counts(replicates: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts per area, replicate and occasion of the individuals of a task: seen, first, last and only there."""
    # A draw is a number of 32 bits, below a cumulative probability or not.
    limits = [math.ceil(c * draws.TWO_POW_32) for c in fv.POISSON_ONE_CUMULATIVE]

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            # Individuals of the same area and years are counted together.
            alike: dict[tuple, int] = {}
            areas, years = batch.column("area").to_pylist(), batch.column("years").to_pylist()
            code = np.array([alike.setdefault((a, *(y or ())), len(alike)) for a, y in zip(areas, years, strict=True)], np.int64)
            cells: dict[tuple, int] = {}
            found = []
            for (area, *seen), k in alike.items():
                for y in seen:
                    first, last = y == seen[0], y == seen[-1]
                    found += [(k, 4 * cells.setdefault((area, y), len(cells)) + j)
                              for j, holds in enumerate((True, first, last, first and last)) if holds]
            counted = np.zeros((len(alike), 4 * len(cells)))
            if found:
                counted[tuple(np.array(found).T)] = 1.0
            each = Draws(seed, "bootstrap", batch.column("area"), batch.column("individual_id"))
            for cell in cells:
                totals.setdefault(cell, np.zeros((replicates, 4), np.int64))
            for reps in together(1, replicates, batch.num_rows) if found else ():
                drawn = each.heads(reps)[0]
                times = np.zeros(drawn.shape, np.uint8)
                for limit in limits:
                    if limit < 1 << 32:
                        times += drawn >= np.uint32(limit)
                groups = np.stack([np.bincount(code, row, len(alike)) for row in times])
                sums = (groups @ counted).astype(np.int64)
                for cell, i in cells.items():
                    totals[cell][reps[0] - 1 : reps[-1]] += sums[:, 4 * i : 4 * i + 4]
        for (area, year), sums in totals.items():
            reps = np.flatnonzero(sums[:, 0] > 0)
            n = len(reps)
            columns = [pa.array([area] * n, pa.string()), pa.array(reps + 1, pa.int32()), pa.array([year] * n, pa.int32())]
            columns += [pa.array(sums[reps, j], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["area", "rep", "year", "n", "u", "last", "only"])

    return resample


def bootstrap_covariance(resampled: DataFrame) -> DataFrame:
    """Covariance of annual abundance between every two occasions of an area, over the replicates.

    A pair of occasions counts the replicates in which both are defined; ``replicates`` says how many these are.
    With fewer than two the covariance is null. An area and replicate is one short array of occasions, so pairs
    are made inside a row and leave the task as sums.
    """
    points = (
        resampled.filter(F.col("n_hat").isNotNull())
        .groupBy("area", "rep")
        .agg(F.collect_list(F.struct("year", "n_hat")).alias("points"))
    )
    pairs = points.select("area", F.inline("points").alias("year_i", "n_i"), "points").select(
        "area", "year_i", "n_i", F.inline("points").alias("year_j", "n_j")
    )
    return pairs.groupBy("area", "year_i", "year_j").agg(
        F.covar_samp("n_i", "n_j").alias("cov"), F.count("*").alias("replicates")
    )


def entry_parameters(years: DataFrame) -> DataFrame:
    """Superpopulation, entry shares and survival per area, subarea and occasion, from its Jolly-Seber estimates.

    At the first occasion with an estimate, and at every one that follows a gap in the estimates, all of its
    abundance enters; elsewhere the estimated entries since the occasion before. ``survival`` is that of a year,
    from the occasion to the next one; it is 0 before a new start. ``estimated`` is false where the subarea
    has no estimate: nothing enters there. Subareas without any estimate are left out.
    """
    groups = ("area", "subarea")
    by_year = Window.partitionBy(*groups).orderBy("year")
    estimates = jolly_seber(occasion_statistics(years, groups), groups)
    known = F.col("n_hat").isNotNull()
    goes_on = known & F.lead("n_hat").over(by_year).isNotNull() & F.col("phi").isNotNull()
    steps = estimates.select(
        *groups,
        "year",
        known.alias("estimated"),
        "n_hat",
        F.when(goes_on, F.col("entries")).alias("entries"),
        F.when(goes_on, F.pow("phi", 1.0 / (F.lead("year").over(by_year) - F.col("year")))).otherwise(0.0).alias("survival"),
    )
    entering = F.coalesce(F.lag("entries").over(by_year), F.col("n_hat"), F.lit(0.0))
    whole = F.sum("entering").over(Window.partitionBy(*groups))
    return (
        steps.withColumn("entering", entering)
        .withColumn("n_super", whole)
        .filter("n_super <> 0")
        .select(*groups, "year", "n_super", (F.col("entering") / F.col("n_super")).alias("entry_share"), "survival", "estimated")
    )


def derived_abundance(parameters: DataFrame) -> DataFrame:
    """Abundance per area and occasion: entries so far times their survival since, over subareas.

    N(t) = sum over j <= t of n_super * entry_share(j) * the survival of the years from j to t. It is followed from
    occasion to occasion inside one array per subarea, as what was there before survives together: no power is
    ever divided by, and a survival of 0 leaves nothing. ``survival`` of a row is that of each year until the next row.
    """
    point = F.struct("year", (F.col("n_super") * F.col("entry_share")).alias("entering"), "survival")
    start = F.struct(
        F.lit(None).cast("int").alias("year"), F.lit(0.0).alias("n"), F.lit(0.0).alias("survival"),
        F.array().cast("array<struct<year:int,n:double>>").alias("done"),
    )

    def step(state, p):
        kept = F.when(state["year"].isNull(), F.lit(0.0)).otherwise(
            state["n"] * F.pow(state["survival"], (p["year"] - state["year"]).cast("double"))
        )
        n = kept + p["entering"]
        row = F.struct(p["year"].cast("int").alias("year"), n.alias("n"))
        return F.struct(
            p["year"].cast("int").alias("year"), n.alias("n"), p["survival"].alias("survival"),
            F.concat(state["done"], F.array(row)).alias("done"),
        )

    return (
        parameters.groupBy("area", "subarea")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .select("area", F.inline(F.aggregate("points", start, step, lambda state: state["done"])))
        .groupBy("area", "year")
        .agg(F.sum("n").alias("n_hat"))
    )
