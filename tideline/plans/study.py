"""The analysis tables of one study, each built on request from one sightings table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fv
from tideline.operators import curate, effort, proportion, recapture, trend
from tideline.sources.sinks import written


@dataclass
class Study:
    """``load`` returns the sightings; its argument says whether ``sight_type`` is needed.

    Every method returns a lazy table over all strata. With ``keep``, the tables that
    several reports need are written once to the folder of ``spark.checkpoint.dir`` and
    read from there.
    """

    load: Callable[[bool], DataFrame]
    first_year: int = fv.FIRST_YEAR
    last_year: int = fv.LAST_YEAR
    skew: dict = field(default_factory=dict)
    keep: bool = False
    bootstrap_replicates: int = fv.BOOTSTRAP_REPLICATES
    trend_replicates: int = fv.TREND_REPLICATES
    _kept: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, sightings: DataFrame, **options) -> Study:
        return cls(lambda _types: sightings, **options)

    def sightings(self, types: bool = False) -> DataFrame:
        return self.load(types)

    def curated(self, types: bool = False, exclude_windward: bool = True) -> DataFrame:
        return curate.curated_sightings(self.load(types), self.first_year, self.last_year, exclude_windward)

    def strata(self) -> DataFrame:
        return curate.individual_strata(self.load(False))

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.keep:
            return build()
        if name not in self._kept:
            self._kept[name] = written(build())
        return self._kept[name]

    def stratified(self, types: bool = False) -> DataFrame:
        types = types or self.keep
        return self._once("stratified", lambda: curate.stratify(self.curated(types), self.strata(), **self.skew))

    def individual_years(self) -> DataFrame:
        return self._once(
            "individual_years", lambda: recapture.individual_years(curate.model_sightings(self.stratified()))
        )

    def encounter_counts(self) -> DataFrame:
        return proportion.encounter_counts(self.load(False))

    def proportion_summary(self) -> DataFrame:
        """Yearly proportion of distinctive individuals, within the years of the study."""
        shares = proportion.distinctive_by_encounter(self.encounter_counts())
        return proportion.yearly_summary(shares, "prop34").filter(curate.in_years(self.first_year, self.last_year))

    def theta(self) -> DataFrame:
        return proportion.theta(self.proportion_summary())

    def jolly_seber(self) -> DataFrame:
        return recapture.jolly_seber(recapture.occasion_statistics(self.individual_years()))

    def abundance_replicates(self) -> DataFrame:
        return recapture.abundance_bootstrap(self.individual_years(), self.bootstrap_replicates)

    def abundance_covariance(self) -> DataFrame:
        """Covariance of each stock's annual abundance between occasions, from resampled individuals."""
        return self._once(
            "abundance_covariance", lambda: recapture.bootstrap_covariance(self.abundance_replicates())
        ).withColumnRenamed("area", "stock")

    def abundance_estimates(self, covariance: DataFrame | None = None) -> DataFrame:
        """Annual abundance per stock with its standard error; occasions without an estimate have nulls."""
        covariance = self.abundance_covariance() if covariance is None else covariance
        errors = covariance.filter("year_i = year_j").select(
            "stock", F.col("year_i").alias("year"), F.sqrt("cov").alias("se")
        )
        estimates = self.jolly_seber().select(F.col("area").alias("stock"), "year", "n_hat")
        return estimates.join(errors, ["stock", "year"], "left")

    def corrected_abundance(self, annual: DataFrame | None = None) -> DataFrame:
        return trend.corrected_abundance(self.abundance_estimates(), self.theta(), annual)

    def abundance_draws(self) -> DataFrame:
        """Draws of annual abundance under the covariance of the estimates."""
        covariance = self.abundance_covariance()
        factor = trend.covariance_factor(covariance.drop("replicates"))
        # The draws need the estimates only, not their errors, which are in the factor.
        estimates = self.jolly_seber().select(F.col("area").alias("stock"), "year", "n_hat")
        return trend.abundance_draws(estimates, factor, self.trend_replicates)

    def minimum_abundance(self) -> DataFrame:
        """Individuals seen per stock and year with a counting error: estimates that need no model."""
        seen = effort.annual_sightings(self.curated()).filter(F.col("area").isin(fv.STOCKS))
        n = F.col("individuals").cast("double")
        return seen.select(F.col("area").alias("stock"), "year", n.alias("n_hat"), F.sqrt(n).alias("se"))
