"""The whole assessment: from records to yield.

The flagged table feeds most results, so it is landed once. One-row results that others build on
are evaluated when first asked for; every other result is a lazy DataFrame that reads only the
columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.functions.rows import hold_row, land, land_bucketed, with_scalars
from windrow.operators import (curve, energy, flags, layout as lay, longterm as lt, powercurve as pc,
                               resource, timeseries as ts, wake, yaw, yieldcalc as yc)
from windrow.params import FarmParams


@dataclass
class Assessment:
    """Results over a landed flagged table.

    `reference` (d, ws[, dir][, temp_c]) and `positions` (turbine, x, y) are optional. The daily series
    and the record length come from the flagged table unless given. `records`, the flagged table, and `positions` may be
    functions: results that don't need the table then don't wait for it. `for_sums` may give the flagged table in fewer rows
    (`flags.land_counted`).
    """
    records: DataFrame | Callable[[], DataFrame]
    nodes: DataFrame
    params: FarmParams
    reference: DataFrame | None = None
    positions: DataFrame | Callable[[], DataFrame] | None = None
    site_series: DataFrame | None = None
    energy_series: DataFrame | None = None
    months: DataFrame | None = None
    has_direction: bool = True
    for_sums: DataFrame | Callable[[], DataFrame] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @cached_property
    def flagged(self) -> DataFrame:
        return self.records() if callable(self.records) else self.records

    @cached_property
    def layout(self) -> DataFrame | None:
        return self.positions() if callable(self.positions) else self.positions

    @cached_property
    def grid(self) -> DataFrame:
        return curve.curve_grid(self.nodes, self.params)

    # energies
    @cached_property
    def base(self) -> DataFrame:
        counted = self.for_sums() if callable(self.for_sums) else self.for_sums
        return land(energy.energy_base(self.flagged if counted is None else counted), "base")

    @cached_property
    def account(self) -> DataFrame:
        return hold_row(energy.energy_accounting(self.base))

    @cached_property
    def per_turbine(self) -> DataFrame:
        return energy.availability_turbine(self.base, self.params)

    # wake
    @cached_property
    def wake_rows(self) -> DataFrame:
        parts = wake.slot_parts(self.base)
        rows = wake.sectored(self.flagged, self.base, self.params, self.has_direction, parts)
        return land_bucketed(rows, "wake-rows", "slot", parts=parts)

    @cached_property
    def reference_set(self) -> DataFrame:
        return land(wake.reference_set(self.wake_rows), "reference-set")

    @cached_property
    def deficits(self) -> DataFrame:
        return wake.deficits(self.wake_rows, self.reference_set, self.grid, self.params)

    @cached_property
    def wake_base(self) -> DataFrame:
        return land(wake.wake_base(self.deficits, self.params, self.has_direction), "wake-base")

    @cached_property
    def curve_base(self) -> DataFrame:
        return land(pc.curve_base(self.flagged, self.params), "curve-base")

    @cached_property
    def yaw_rows(self) -> DataFrame:
        return yaw.yaw_rows(self.flagged, land(yaw.bin_means(self.flagged, self.params), "yaw-bins"), self.params)

    @cached_property
    def wake_loss(self) -> DataFrame:
        return hold_row(wake.wake_loss(self.wake_base, self.account, self.params))

    @cached_property
    def wake_turbine(self) -> DataFrame:
        return wake.wake_turbine_table(self.wake_base, self.params)

    @cached_property
    def rose(self) -> DataFrame:
        return land(resource.rose_freq(resource.wind_rose(self.flagged)), "rose")

    @cached_property
    def layout_deficits(self) -> DataFrame:
        terms = land(lay.directional_terms(self.layout, self.rose, self.params), "layout-terms")
        return land(lay.turbine_deficits(terms, self.rose, self.params), "layout-deficits")

    @cached_property
    def layout_energy(self) -> DataFrame:
        return lay.turbine_energy(self.layout_deficits, self.grid)

    # long term
    @cached_property
    def site_daily(self) -> DataFrame:
        return self.site_series if self.site_series is not None else lt.site_daily(self.flagged)

    @cached_property
    def daily_energy(self) -> DataFrame:
        return self.energy_series if self.energy_series is not None else energy.daily_gross(self.flagged)

    @cached_property
    def ref_has_dir(self) -> bool:
        return self.reference is not None and "dir" in self.reference.columns

    @cached_property
    def pairs(self) -> DataFrame:
        return lt.mcp_pairs(self.site_daily, self.reference, self.params.sector_width_deg, self.ref_has_dir)

    @cached_property
    def fits(self) -> DataFrame:
        return lt.mcp_fit(self.pairs)

    @cached_property
    def lt_daily(self) -> DataFrame:
        if self.reference is None:
            return self.site_daily.select("d", "ws", F.lit("measured").alias("origin"))
        predicted = lt.mcp_predict(self.reference, self.fits, self.params.sector_width_deg, self.ref_has_dir)
        return land(lt.lt_series(predicted, self.site_daily), "lt-daily")

    @cached_property
    def mcp_quality(self) -> DataFrame:
        if self.reference is None:
            return self.spark.range(1).select(F.lit(None).cast("double").alias("mcp_r2"),
                                              F.lit(0).cast("bigint").alias("mcp_days"))
        return hold_row(lt.mcp_r2(self.fits))

    @cached_property
    def metrics(self) -> DataFrame:
        months = self.months if self.months is not None else lt.record_months(self.flagged)
        return hold_row(lt.record_metrics(months, self.site_daily, self.lt_daily))

    @cached_property
    def weibull(self) -> DataFrame:
        fit = resource.weibull_fit(resource.wind_moments(self.flagged))
        return hold_row(lt.weibull_lt(fit.select("weibull_a", "weibull_k"), self.metrics))

    @cached_property
    def aep(self) -> DataFrame:
        """One row: Weibull, number of turbines and gross energy of the farm by method A."""
        row = self.weibull.select("lt_a", "lt_k")
        row = with_scalars(row, self.base.agg(F.countDistinct("turbine").alias("n_turbines")))
        row = with_scalars(row, lt.aep_weibull(self.weibull.select("lt_a", "lt_k"), self.grid))
        return hold_row(row.withColumn("method_a_mwh", F.col("aep_mwh") * F.col("n_turbines")))

    @cached_property
    def daily_method(self) -> DataFrame:
        return hold_row(lt.lt_daily_energy(self.daily_energy, self.site_daily, self.lt_daily, self.metrics))

    def _no_reference(self, *names: str) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])

    @cached_property
    def monthly_method(self) -> DataFrame:
        if self.reference is None:
            return self._no_reference("monthly_slope", "monthly_intercept", "monthly_r2", "monthly_n", "monthly_mwh")
        return hold_row(lt.lt_monthly_energy(energy.monthly_gross(self.daily_energy), self.reference,
                                             self.metrics))

    @cached_property
    def normalised_month(self) -> DataFrame:
        if self.reference is None:
            return self._no_reference("nm_slope", "nm_intercept", "nm_r2", "nm_n", "nm_mwh")
        return hold_row(lt.normalised_month(self.daily_energy, self.reference, self.metrics, self.params))

    @cached_property
    def choice(self) -> DataFrame:
        return lt.method_choice(self.daily_method, self.monthly_method, self.metrics, self.aep)

    @cached_property
    def gross(self) -> DataFrame:
        return lt.gross_aep(self.choice, self.normalised_month, self.params)

    # yield
    @cached_property
    def net(self) -> DataFrame:
        """One row with all sums the yield tables start from."""
        farm = lay.layout_farm(self.layout_energy) if self.positions is not None else None
        row = yc.site_row(self.account, self.wake_loss, self.gross, self.params, farm)
        return hold_row(yc.with_net(row, self.params))

    @cached_property
    def tree(self) -> DataFrame:
        return yc.loss_tree(self.net, self.params)

    @cached_property
    def sigma(self) -> DataFrame:
        return lt.sigma_wind(self.metrics, self.mcp_quality)

    @cached_property
    def components(self) -> DataFrame:
        return yc.uncertainty_components(self.net, self.sigma, self.params)

    @cached_property
    def net_sigma(self) -> DataFrame:
        return hold_row(yc.with_sigma(self.net, self.components))

    @cached_property
    def kpis(self) -> DataFrame:
        """One row with everything the summary and the findings need."""
        row = self.net_sigma.drop("n_turbines")
        row = with_scalars(row, flags.coverage(self.flagged))
        row = with_scalars(row, energy.availability_farm(self.per_turbine).select("time_avail_pct", "prod_avail_pct"))
        row = with_scalars(row, pc.farm_deviation(self.curve_base, self.nodes, self.params))
        dev = pc.curve_deviation(self.curve_base, self.nodes, self.params)
        row = with_scalars(row, dev.agg(F.min("deviation_pct").alias("worst_deviation_pct")))
        row = with_scalars(row, self.mcp_quality)
        period = self.flagged.agg(F.min("timestamp").cast("string").alias("record_start"),
                                  F.max("timestamp").cast("string").alias("record_end"))
        return hold_row(with_scalars(row, period))

    def tables(self) -> dict[str, DataFrame]:
        """The named result tables of a run."""
        p = self.params
        out = {
            "summary": yc.kpi_summary(self.kpis, p),
            "availability": self.per_turbine,
            "monthly": energy.availability_monthly(self.base, p),
            "yearly": energy.yearly_production(self.base, p),
            "downtime_monthly": energy.downtime_monthly(self.base, p),
            "performance_monthly": energy.performance_monthly(self.base),
            "power_curve": pc.power_curve_farm(self.curve_base, p),
            "power_curve_turbine": pc.power_curve_turbine(self.curve_base, p),
            "turbine_deviation": pc.curve_deviation(self.curve_base, self.nodes, p),
            "wake_sectors": wake.wake_sector_table(self.wake_base),
            "wake_turbines": self.wake_turbine,
            "loss_matrix": energy.loss_matrix(self.base, self.wake_turbine),
            "wind_rose": resource.wind_rose(self.flagged),
            "wind_monthly": resource.wind_monthly(self.flagged),
            "wind_diurnal": resource.wind_diurnal(self.flagged),
            "wind_histogram": resource.wind_histogram(self.flagged),
            "yaw": yaw.yaw_screening(yaw.yaw_fit(self.yaw_rows)),
            "lt_daily": self.lt_daily,
            "loss_tree": self.tree,
            "loss_reconciliation": yc.loss_reconciliation(self.net),
            "uncertainty": self.components,
            "p_values": yc.p_values(self.net_sigma),
            "sensitivity": yc.sensitivity(self.net, self.grid, p),
            "findings": yc.findings(self.kpis),
            "flag_summary": flags.flag_summary(self.flagged),
            "warnings": flags.qc_warnings(self.flagged),
        }
        if self.reference is not None:
            out["mcp"] = self.fits
        if self.positions is not None:
            out["layout_turbines"] = lay.layout_turbine(self.layout_energy)
        if p.preconstruction_p50_gwh:
            out["benchmark"] = yc.benchmark(self.net_sigma, p)
        return out


def assess(records: DataFrame, params: FarmParams, nodes: DataFrame | None = None,
           reference: DataFrame | None = None, layout: DataFrame | None = None,
           measure_interval: bool = True, has_direction: bool = True) -> Assessment:
    """Resamples, flags and lands `records`; returns the lazy results.

    `measure_interval` takes the sampling interval from the data (one number to the driver, because
    it sets the length of the rolling rules).
    """
    spark = records.sparkSession
    rows = ts.resample_10min(records)
    if measure_interval:
        rows = land(rows, "resampled")
        params = replace(params, interval_h=ts.sampling_interval(rows).first()["interval_h"])
    rows = flags.flag_blocks(rows, params, most=rows.count() if measure_interval else 0)
    nodes = nodes if nodes is not None else curve.generic_curve(spark, params)
    flagged = flags.land_counted(rows, curve.curve_grid(nodes, params), params, "flagged", "month")
    return Assessment(flagged.rows, nodes, params, reference, layout, has_direction=has_direction, for_sums=flagged.counted)
