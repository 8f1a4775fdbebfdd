"""Loss tree, net energy, uncertainty, exceedance values and report tables.

The input is one row per farm that gathers the results of the other operators; each table here is
an expression over that row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from windrow.functions.num import clip, normal_cdf
from windrow.functions.rows import unpivot_row, with_scalars
from windrow.operators.longterm import aep_weibull
from windrow.params import FarmParams

# fixed values: quantiles of the standard normal distribution
Z = {"P50": 0.0, "P75": 0.6744897501960817, "P90": 1.2815515655446004, "P95": 1.6448536269514722,
     "P99": 2.3263478740408408}

MEASURED = (("Availability (downtime)", "downtime_mwh"), ("Curtailment", "curtailment_mwh"),
            ("Derating / partial load", "derating_mwh"), ("Environmental", "environmental_mwh"),
            ("Wake", "wake_used_mwh"), ("Turbine performance", "performance_mwh"))


def site_row(account: DataFrame, wake: DataFrame, gross: DataFrame, p: FarmParams,
             layout: DataFrame | None = None) -> DataFrame:
    """Gathers energy sums, wake energy and long-term gross energy into one row."""
    df = with_scalars(with_scalars(account, wake.select("wake_energy_mwh", "wake_loss_pct")), gross)
    if layout is not None and p.wake_model == "layout":
        df = with_scalars(df, layout.select("farm_loss_pct"))
        used = F.col("farm_loss_pct") / 100.0 * F.col("gross_mwh")
    else:
        used = F.col("wake_energy_mwh")
    return df.withColumns({
        "wake_used_mwh": used,
        "performance_mwh": F.col("shortfall_mwh") - F.col("wake_energy_mwh")})


def pct_of_gross(c: str) -> Column:
    return F.when(F.col("gross_mwh") > 0, 100.0 * F.col(c) / F.col("gross_mwh")).otherwise(0.0)


def with_net(site: DataFrame, p: FarmParams) -> DataFrame:
    """Adds total losses, net energy, capacity factor and full-load hours."""
    pcts = [pct_of_gross(c) for _, c in MEASURED]
    inputs = [F.lit(p.electrical_loss_pct), F.lit(p.other_loss_pct)]
    measured = sum(pcts[1:], pcts[0])
    total = measured + p.electrical_loss_pct + p.other_loss_pct
    df = site.withColumns({"measured_loss_pct": measured, "total_loss_pct": total})
    if p.future_losses.any():
        f = p.future_losses
        left = math.prod(1.0 - x / 100.0 for x in (
            f.availability_pct, f.curtailment_pct, f.electrical_pct, f.blade_degradation_pct))
        net = F.col("gross_lt_mwh") * left
    elif p.loss_mode == "product":
        left = F.lit(1.0)
        for x in pcts + inputs:
            left = left * (1.0 - x / 100.0)
        net = F.col("gross_lt_mwh") * left
    else:
        net = F.col("gross_lt_mwh") * (1.0 - F.col("total_loss_pct") / 100.0)
    df = df.withColumn("net_mwh", net)
    capacity = p.rated_power_kw * F.col("n_turbines")
    return df.withColumns({"capacity_factor_pct": 100.0 * F.col("net_mwh") * 1000.0 / (capacity * 8760.0),
                           "full_load_hours": F.col("net_mwh") * 1000.0 / capacity})


def loss_tree(net: DataFrame, p: FarmParams) -> DataFrame:
    none = F.lit(None).cast("double")
    rows = [(i, n, F.col(c), pct_of_gross(c)) for i, (n, c) in enumerate(MEASURED)]
    rows += [(6, "Electrical", none, F.lit(p.electrical_loss_pct)),
             (7, "Other", none, F.lit(p.other_loss_pct))]
    return unpivot_row(net, rows, ("ord", "loss", "energy_mwh", "pct_of_gross"))


def loss_reconciliation(net: DataFrame) -> DataFrame:
    """One row: modelled against measured energy of the record."""
    modelled = F.col("gross_mwh") * (1.0 - F.col("measured_loss_pct") / 100.0)
    gap = F.when(F.col("gross_mwh") != 0, 100.0 * (modelled - F.col("actual_mwh")) / F.col("gross_mwh"))
    return net.select(F.col("gross_mwh").alias("gross_period_mwh"), F.col("actual_mwh").alias("measured_mwh"),
                      modelled.alias("modelled_net_period_mwh"), "measured_loss_pct", "total_loss_pct",
                      F.coalesce(gap, F.lit(0.0)).alias("gap_pct"))


def future_losses(net: DataFrame, p: FarmParams) -> DataFrame:
    """The stack of expected future losses and the net energy it leaves."""
    f = p.future_losses
    items = [(0, "availability", f.availability_pct), (1, "curtailment", f.curtailment_pct),
             (2, "electrical", f.electrical_pct), (3, "blade degradation", f.blade_degradation_pct)]
    rows = unpivot_row(net, [(o, n, F.lit(float(v)), F.col("gross_lt_mwh")) for o, n, v in items],
                       ("ord", "loss", "loss_pct", "gross_lt_mwh"))
    upto = W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0)         # four rows
    kept = F.exp(F.sum(F.log(1.0 - F.col("loss_pct") / 100.0)).over(upto))
    return rows.select("ord", "loss", "loss_pct", (F.col("gross_lt_mwh") * kept).alias("net_after_mwh"),
                       (100.0 * (1.0 - kept)).alias("total_pct"))


def loss_waterfall(tree: DataFrame, net: DataFrame) -> DataFrame:
    """Running balance from gross energy through the losses."""
    df = with_scalars(tree, net.select("gross_lt_mwh"))
    df = df.withColumn("step_mwh", -F.col("pct_of_gross") / 100.0 * F.col("gross_lt_mwh"))
    upto = W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0)         # eight rows
    return df.select("ord", "loss", "step_mwh",
                     (F.col("gross_lt_mwh") + F.sum("step_mwh").over(upto)).alias("balance_mwh"))


# ---- uncertainty ---------------------------------------------------------------------------


def uncertainty_components(net: DataFrame, sigma: DataFrame, p: FarmParams) -> DataFrame:
    """1-sigma components (percent of net energy) and their share of the variance."""
    df = with_scalars(net, sigma.select("sigma_wind_pct"))
    avail = clip(0.15 * pct_of_gross("downtime_mwh"), 0.3, 1.5)
    wake = clip(0.25 * pct_of_gross("wake_used_mwh"), 0.5, 3.0)
    # fixed values: default component sizes in percent
    parts = [("wind_resource", "Wind resource (long-term)", F.col("sigma_wind_pct")),
             ("power_curve", "Power curve measurement", F.lit(2.0)),
             ("availability", "Availability losses", avail),
             ("curtailment", "Curtailment losses", F.lit(0.5)),
             ("wake", "Wake losses", wake),
             ("performance", "Turbine performance", F.lit(1.0)),
             ("electrical", "Electrical losses", F.lit(0.4)),
             ("environmental", "Environmental losses", F.lit(0.4)),
             ("other", "Other", F.lit(0.5))]
    over = p.uncertainty_overrides_pct
    rows = unpivot_row(df, [(i, label, F.lit(float(over[key])) if key in over else value)
                            for i, (key, label, value) in enumerate(parts)],
                       ("ord", "component", "sigma_pct"))
    var = F.col("sigma_pct") * F.col("sigma_pct")
    return rows.withColumn("contribution_pct", 100.0 * var / F.sum(var).over(W.partitionBy(F.lit(1))))


def with_sigma(net: DataFrame, components: DataFrame) -> DataFrame:
    """Adds the combined sigma (as a fraction) and mean / standard deviation of net energy."""
    df = with_scalars(net, _sigma(components))
    mean = F.col("net_mwh") * F.exp(F.col("sigma") * F.col("sigma") / 2.0)
    return df.withColumns({"mean_mwh": mean,
                           "sd_mwh": mean * F.sqrt(F.exp(F.col("sigma") * F.col("sigma")) - 1.0)})


def exceedance(z: float) -> Column:
    return F.col("net_mwh") * F.exp(-z * F.col("sigma"))


def p_values(net_sigma: DataFrame) -> DataFrame:
    """Energy exceeded with 50, 75, 90 and 99 % probability, intervals, mean and spread.

    The product of lognormal factors is lognormal, so the quantiles are exact.
    """
    rows = [(k, exceedance(Z[k])) for k in ("P50", "P75", "P90", "P99")]
    rows += [("P50 80% CI low", exceedance(Z["P90"])), ("P50 80% CI high", exceedance(-Z["P90"])),
             ("P90 90% CI low", exceedance(Z["P95"])), ("P90 90% CI high", exceedance(-Z["P95"])),
             ("mean", F.col("mean_mwh")), ("sd", F.col("sd_mwh"))]
    return unpivot_row(net_sigma, [(k, v, 100.0 * v / F.col("net_mwh")) for k, v in rows],
                       ("p_value", "net_aep_mwh", "pct_of_deterministic"))


def yield_quantiles(df: DataFrame, components: DataFrame, keys: tuple[str, ...], net: str) -> DataFrame:
    """Exceedance values per row of `df`, whose energy is multiplied by one lognormal factor per component."""
    rows = with_scalars(df, _sigma(components))
    return rows.select(*keys, *[(F.col(net) * F.exp(-Z[k] * F.col("sigma"))).alias(k.lower())
                                for k in ("P50", "P75", "P90", "P99")])


def yield_density(df: DataFrame, components: DataFrame, net: str, bins: int = 80, reach: float = 4.0) -> DataFrame:
    """Density of the yield over all rows of `df` in equal bins, `reach` sigmas beyond the lowest and highest energy.

    Every row has a lognormal law; a bin's share is the mean of the rows' shares, which is exact. Rows without energy
    have no law and are left out.
    """
    known = df.filter(F.col(net) > 0).select(F.col(net).alias("_net"))
    rows = with_scalars(known, _sigma(components))
    span = rows.agg(F.min(F.col("_net") * F.exp(-reach * F.col("sigma"))).alias("lo"),
                    F.max(F.col("_net") * F.exp(reach * F.col("sigma"))).alias("hi"), F.count(F.lit(1)).alias("n"))
    placed = with_scalars(rows, span).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins

    def below(edge: Column) -> Column:
        return normal_cdf(F.log(edge / F.col("_net")) / F.col("sigma"))

    low = F.col("lo") + F.col("bin") * width
    share = (below(low + width) - below(low)) / (F.col("n") * width)
    return placed.groupBy("bin", low.alias("from_mwh"), width.alias("width_mwh")).agg(F.sum(share).alias("density"))


def _sigma(components: DataFrame) -> DataFrame:
    return components.agg((F.sqrt(F.sum(F.col("sigma_pct") * F.col("sigma_pct"))) / 100.0).alias("sigma"))


# ---- report tables -------------------------------------------------------------------------


def benchmark(net_sigma: DataFrame, p: FarmParams) -> DataFrame:
    """One row: assessed P50 against the pre-construction P50 (empty without one)."""
    if not p.preconstruction_p50_gwh:
        return net_sigma.filter(F.lit(False)).select(
            *[F.lit(0.0).alias(c) for c in ("preconstruction_p50_mwh", "assessment_p50_mwh", "ratio", "delta_pct")])
    pre = p.preconstruction_p50_gwh * 1000.0
    p50 = exceedance(0.0)
    return net_sigma.select(F.lit(pre).alias("preconstruction_p50_mwh"), p50.alias("assessment_p50_mwh"),
                            (p50 / pre).alias("ratio"), (100.0 * (p50 - pre) / pre).alias("delta_pct"))


def sensitivity(net: DataFrame, grid: DataFrame, p: FarmParams) -> DataFrame:
    """One-at-a-time changes of the P50: each loss +1 pp, wind +-0.1 m/s, production regression +-25 %."""
    names = [n for n, _ in MEASURED] + ["Electrical", "Other"]
    pcts = [pct_of_gross(c) for _, c in MEASURED] + [F.lit(p.electrical_loss_pct), F.lit(p.other_loss_pct)]
    n = F.col("net_mwh")
    left = 1.0 - F.col("total_loss_pct") / 100.0

    def wind(delta: float, out: str) -> DataFrame:
        shifted = net.select((F.col("lt_a") + delta).alias("a"), F.col("lt_k").alias("k"))
        return aep_weibull(shifted, grid, "a", "k", (), out)

    df = with_scalars(with_scalars(net, wind(0.1, "aep_hi")), wind(-0.1, "aep_lo"))
    rows = [(f"Loss: {name} +1 pp", "+1 pp", F.when(1.0 - x / 100.0 > 1e-6, -n * 0.01 / (1.0 - x / 100.0)))
            for name, x in zip(names, pcts)]
    rows += [("Long-term mean wind speed +0.1 m/s", "+0.1 m/s",
              F.col("aep_hi") * F.col("n_turbines") * left - n),
             ("Long-term mean wind speed -0.1 m/s", "-0.1 m/s",
              F.col("aep_lo") * F.col("n_turbines") * left - n)]
    rows += [(f"Production-regression gross {label}", label, F.col("method_b_mwh") * s * left - n)
             for s, label in ((1.25, "+25%"), (0.75, "-25%"))]
    out = unpivot_row(df, [(a, b, d, 100.0 * d / n) for a, b, d in rows],
                      ("parameter", "change", "delta_p50_mwh", "delta_p50_pct"))
    return out.filter("delta_p50_mwh is not null")


def findings(kpis: DataFrame) -> DataFrame:
    """Recommendations whose threshold is met; one line of all-clear if none is.

    Needs time_avail_pct, worst_deviation_pct, curtailment_mwh, actual_mwh, wake_loss_pct, mcp_r2,
    has_mcp and coverage_raw_pct in the one row.
    """
    curt = 100.0 * F.col("curtailment_mwh") / F.greatest(F.lit(1.0), F.col("actual_mwh"))
    rules = [
        ("availability", F.col("time_avail_pct") < 97.0, F.col("time_avail_pct")),
        ("power curve deviation", F.col("worst_deviation_pct") < -2.0, F.col("worst_deviation_pct")),
        ("curtailment", curt > 2.0, curt),
        ("wake losses", F.col("wake_loss_pct") > 4.0, F.col("wake_loss_pct")),
        ("long-term correlation", F.col("has_mcp") & (F.col("mcp_r2") < 0.8), F.col("mcp_r2")),
        ("data coverage", F.col("coverage_raw_pct") < 90.0, F.col("coverage_raw_pct")),
    ]
    hit = F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("finding"), v.alias("value")))
                             for t, c, v in rules]), lambda r: r.isNotNull())
    clear = F.array(F.struct(F.lit("no material issue").alias("finding"), F.lit(None).cast("double").alias("value")))
    return kpis.select(F.inline(F.when(F.size(hit) > 0, hit).otherwise(clear)))


def kpi_summary(kpis: DataFrame, p: FarmParams) -> DataFrame:
    """Summary table: parameter, number, text."""
    def num(name, c):
        return (name, c.cast("double"), F.lit(None).cast("string"))

    def text(name, c):
        return (name, F.lit(None).cast("double"), c)

    col = F.col
    rows = [
        text("Farm", F.lit(p.farm_name)), num("Turbines", col("n_turbines")),
        num("Rated power (kW)", F.lit(p.rated_power_kw)),
        text("SCADA period", F.concat_ws(" - ", "record_start", "record_end")),
        num("Data coverage (%)", F.round("coverage_filled_pct", 1)),
        num("Time-based availability (%)", F.round("time_avail_pct", 2)),
        num("Production-based availability (%)", F.round("prod_avail_pct", 2)),
        num("Energy-weighted power curve deviation (%)", F.round("deviation_pct", 2)),
        num("Wake loss (% of gross)", F.round("wake_loss_pct", 2)),
        num("Total losses (% of gross)", F.round("total_loss_pct", 2)),
        num("Gross AEP (MWh/yr)", F.round("gross_lt_mwh", 0)),
        num("Net AEP deterministic (MWh/yr)", F.round("net_mwh", 0)),
        *[num(f"Net AEP {k} (MWh/yr)", F.round(exceedance(Z[k]), 0)) for k in ("P50", "P75", "P90", "P99")],
        num("Uncertainty 1 sigma (MWh/yr)", F.round("sd_mwh", 0)),
        num("Capacity factor (%)", F.round("capacity_factor_pct", 1)),
        num("Full-load hours (h/yr)", F.round("full_load_hours", 0)),
        text("Long-term correction method", F.when(col("has_mcp"), "MCP on reference series")
             .otherwise("measured record only")),
        num("Long-term mean wind speed (m/s)", F.round("lt_mean_ws", 2)),
        num("Long-term Weibull A (m/s)", F.round("lt_a", 2)), num("Long-term Weibull k", F.round("lt_k", 2)),
        num("Gross AEP - Method A (MWh/yr)", F.round("method_a_mwh", 0)),
        num("Gross AEP - Method B (MWh/yr)", F.round("method_b_mwh", 0)),
        text("LT method used", col("lt_method")),
    ]
    if p.preconstruction_p50_gwh:
        pre = p.preconstruction_p50_gwh * 1000.0
        rows += [num("Pre-construction P50 (MWh/yr)", F.lit(float(round(pre)))),
                 num("Assessment / pre-construction ratio", F.round(exceedance(0.0) / pre, 3))]
    return unpivot_row(kpis, [(i, *r) for i, r in enumerate(rows)], ("ord", "parameter", "value", "text"))
