"""Long-term correction: regression on a reference series, climate, gross annual energy.

Daily and monthly series are bounded by the calendar (some ten thousand days), however many
records they were made from. One-row results are handed on as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from windrow.functions.num import clip, density_correct, sector, site_density_ratio, weibull_pdf
from windrow.functions.rows import with_scalars
from windrow.operators.blocks import block_context, with_history
from windrow.operators.curve import power_at
from windrow.params import FarmParams

MIN_PAIRS = 30
MIN_LT_DAYS = 365


def site_daily(flagged: DataFrame) -> DataFrame:
    """Daily mean wind speed over all records that have one."""
    from windrow.functions.timegrid import date_of
    return flagged.filter("ws is not null").groupBy(date_of().alias("d")).agg(F.avg("ws").alias("ws"))


def mcp_pairs(site: DataFrame, ref: DataFrame, width: int = 30, has_dir: bool = True) -> DataFrame:
    key = sector(F.col("dir"), width) if has_dir else F.lit(0)
    r = ref.select("d", F.col("ws").alias("ref_ws"), key.alias("sector"))
    return (site.select("d", F.col("ws").alias("site_ws")).join(r, "d")
            .dropna(subset=["site_ws", "ref_ws", "sector"]))


def linear_fit(df: DataFrame, y: str, x: str, keys: tuple[str, ...] = (), min_n: int = 0) -> DataFrame:
    return (df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")).filter(F.col("n") >= min_n))


def mcp_fit(pairs: DataFrame) -> DataFrame:
    """Regression of the site on the reference per sector with at least 30 days."""
    return linear_fit(pairs, "site_ws", "ref_ws", ("sector",), MIN_PAIRS)


def mcp_pooled_fit(pairs: DataFrame) -> DataFrame:
    return linear_fit(pairs, "site_ws", "ref_ws", (), 2)


def mcp_predict(ref: DataFrame, fits: DataFrame, width: int = 30, has_dir: bool = True) -> DataFrame:
    """Site wind speed for every day of the reference whose sector has a fit; positive values only."""
    key = sector(F.col("dir"), width) if has_dir else F.lit(0)
    return (ref.withColumn("sector", key).join(fits, "sector")
            .select("d", (F.col("intercept") + F.col("slope") * F.col("ws")).alias("ws"))
            .filter("ws > 0"))


def mcp_r2(fits: DataFrame) -> DataFrame:
    """One row: mean r2 weighted by days."""
    return fits.agg((F.sum(F.col("r2") * F.col("n")) / F.sum("n")).alias("mcp_r2"),
                    F.sum("n").alias("mcp_days"))


def lt_series(predicted: DataFrame, site: DataFrame) -> DataFrame:
    """The predicted series, or the measured one if fewer than 365 days could be predicted."""
    n = predicted.agg(F.count(F.lit(1)).alias("n_pred"))
    a = with_scalars(predicted.select("d", "ws", F.lit("predicted").alias("origin")), n)
    b = with_scalars(site.select("d", "ws", F.lit("measured").alias("origin")), n)
    return (a.filter(F.col("n_pred") >= MIN_LT_DAYS)
            .unionByName(b.filter(F.col("n_pred") < MIN_LT_DAYS)).drop("n_pred"))


def record_months(flagged: DataFrame) -> DataFrame:
    """One row: whole days between first and last record, in months."""
    days = F.floor((F.max("slot") - F.min("slot")) / 144)
    return flagged.agg((days / 30.44).alias("record_months"))


def record_metrics(months: DataFrame, site: DataFrame, lt: DataFrame) -> DataFrame:
    """One row: long-term years and mean, measured mean, months of record."""
    one = lt.agg((F.count(F.lit(1)) / 365.25).alias("lt_n_years"), F.avg("ws").alias("lt_mean_ws"),
                 F.max(F.col("origin") == "predicted").alias("has_mcp"))
    one = with_scalars(one, months)
    return with_scalars(one, site.agg(F.avg("ws").alias("site_mean_ws")))


def weibull_lt(fit: DataFrame, metrics: DataFrame) -> DataFrame:
    """Measured shape, scale moved to the long-term mean."""
    df = with_scalars(fit, metrics)
    a = F.col("weibull_a") * F.col("lt_mean_ws") / F.greatest(F.col("site_mean_ws"), F.lit(0.5))
    ok = a.isNotNull() & (a > 0)
    return df.withColumns({"lt_a": F.when(ok, a).otherwise(7.0),
                           "lt_k": F.when(ok, F.col("weibull_k")).otherwise(2.0)})


def lt_rolling(series: DataFrame, days: int = 30) -> DataFrame:
    """Centred 30-row mean of a daily series; NULL where the frame is not full.

    The series is cut into blocks of 128 days with exact history, so its length does not matter.
    """
    ahead = days // 2 - 1
    keyed = series.select(F.lit("lt").alias("turbine"),
                          F.unix_date("d").cast("bigint").alias("slot"), "ws")
    keyed = keyed.withColumn("block", F.expr("slot div 128"))
    ctx = block_context(keyed, history=days - 1).select("turbine", "block", "first_slot", "prev")
    rows = with_history(keyed, ctx)
    w = W.partitionBy("turbine", "block").orderBy("slot")
    trailing = w.rowsBetween(-(days - 1), 0)
    # the trailing mean of a row belongs to the row `ahead` places before it
    out = rows.withColumns({
        "_n": F.count("ws").over(trailing), "_m": F.avg("ws").over(trailing),
        "_at": F.lag("slot", ahead).over(w)}).filter("not is_halo")
    means = out.filter(F.col("_n") == days).select(F.col("_at").alias("slot"), F.col("_m").alias("rolling"))
    return keyed.join(means, "slot", "left").select(
        F.date_from_unix_date(F.col("slot").cast("int")).alias("d"), "ws", "rolling")


# ---- production regression ---------------------------------------------------------------


def cubic_fit(energy: DataFrame, wind: DataFrame, min_n: int = 6) -> DataFrame:
    """E = c v^3 with c from the mean in log space; one row (c NULL with too few days)."""
    j = (energy.select("d", "e_mwh").join(wind.select("d", "ws"), "d")
         .filter("e_mwh > 0 and ws > 0.5"))
    c = F.exp(F.avg(F.log("e_mwh") - 3.0 * F.log("ws")))
    v3 = F.pow("ws", 3)
    one = j.agg(c.alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("e_mwh") * F.col("e_mwh")).alias("ee"),
                F.sum(F.col("e_mwh") * v3).alias("ev"), F.sum(v3 * v3).alias("vv"),
                F.var_pop("e_mwh").alias("var_e"))
    res = F.col("ee") - 2.0 * F.col("c") * F.col("ev") + F.col("c") * F.col("c") * F.col("vv")
    tot = F.col("var_e") * F.col("n")
    return one.select(F.when(F.col("n") >= min_n, F.col("c")).alias("c"), "n",
                      F.when(tot > 0, 1.0 - res / tot).otherwise(0.0).alias("r2"))


def monthly_wind(ref: DataFrame) -> DataFrame:
    has_temp = "temp_c" in ref.columns
    temp = F.avg("temp_c") if has_temp else F.lit(None).cast("double")
    return ref.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(
        F.avg("ws").alias("ws"), temp.alias("temp_c"), F.first(F.dayofmonth(F.last_day("d"))).alias("days"))


def lt_daily_energy(daily: DataFrame, site: DataFrame, lt: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: annual energy of the cubic relation over the long-term days, r2 on the measured ones."""
    fit_lt = cubic_fit(daily, lt).select(F.col("c").alias("c_lt"))
    fit = cubic_fit(daily, site).select(F.col("r2").alias("daily_r2"), F.col("n").alias("daily_n"),
                                        F.col("c").alias("daily_c"))
    cube = lt.agg(F.sum(F.pow(F.greatest("ws", F.lit(0.5)), 3)).alias("cube_sum"))
    df = with_scalars(with_scalars(fit, fit_lt), cube)
    df = with_scalars(df, metrics.select("lt_n_years"))
    annual = F.col("c_lt") * F.col("cube_sum") / F.col("lt_n_years")
    return df.select("daily_c", "daily_n", "daily_r2",
                     F.when(F.col("daily_c").isNotNull(), annual).alias("daily_mwh"))


def lt_monthly_energy(monthly: DataFrame, ref: DataFrame, metrics: DataFrame, min_n: int = 6) -> DataFrame:
    """One row: annual energy of the linear relation over the reference months."""
    rm = monthly_wind(ref)
    pairs = monthly.join(rm.select("month", "ws"), "month")
    fit = linear_fit(pairs, "gross_mwh", "ws")
    rows = with_scalars(rm.select("ws"), fit)
    total = rows.agg(F.sum(F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col("ws")))
                     .alias("total"))
    n_ref = ref.agg(F.count(F.lit(1)).alias("n_ref"))
    df = with_scalars(with_scalars(with_scalars(fit, total), n_ref), metrics.select("lt_n_years"))
    ok = (F.col("n") >= min_n) & (F.col("n_ref") >= 12)
    return df.select(F.col("slope").alias("monthly_slope"), F.col("intercept").alias("monthly_intercept"),
                     F.col("r2").alias("monthly_r2"), F.col("n").alias("monthly_n"),
                     F.when(ok, F.col("total") / F.col("lt_n_years")).alias("monthly_mwh"))


def normalised_month(daily: DataFrame, ref: DataFrame, metrics: DataFrame, p: FarmParams,
                     min_n: int = 6) -> DataFrame:
    """One row: normalised monthly energy against density-corrected reference wind, applied to the
    whole reference and brought back to calendar months."""
    from windrow.operators.energy import monthly_gross
    energy = monthly_gross(daily, p.normalize_days, 20, p.excluded_months)
    rm = monthly_wind(ref).withColumn(
        "rho", site_density_ratio(p.site_elevation_m, F.coalesce("temp_c", F.lit(15.0))))
    train = energy.join(rm, "month")
    rho0 = train.agg(F.avg("rho").alias("rho0"))

    def corrected(df):
        df = with_scalars(df, rho0)
        ws = density_correct(F.col("ws"), F.col("rho") / F.col("rho0")) \
            if p.lt_density_correction else F.col("ws")
        return df.withColumn("wsn", ws)

    fit = linear_fit(corrected(train), "gross_mwh", "wsn")
    norm = F.greatest(F.lit(0.0), F.col("slope") * F.col("wsn") + F.col("intercept"))
    total = with_scalars(corrected(rm), fit).agg(
        F.sum(norm * F.col("days") / p.normalize_days).alias("total"))
    n_ref = ref.agg(F.count(F.lit(1)).alias("n_ref"))
    df = with_scalars(with_scalars(with_scalars(fit, total), n_ref), metrics.select("lt_n_years"))
    ok = (F.col("n") >= min_n) & (F.col("n_ref") >= 12)
    return df.select(F.col("slope").alias("nm_slope"), F.col("intercept").alias("nm_intercept"),
                     F.col("r2").alias("nm_r2"), F.col("n").alias("nm_n"),
                     F.when(ok, F.col("total") / F.col("lt_n_years")).alias("nm_mwh"))


# ---- gross annual energy ------------------------------------------------------------------

AEP_POINTS = 2000


def aep_weibull(df: DataFrame, grid: DataFrame, a: str = "lt_a", k: str = "lt_k",
                keys: tuple[str, ...] = (), out: str = "aep_mwh") -> DataFrame:
    """Annual energy (MWh) of one turbine from Weibull scale and shape per row of `df`."""
    lo, hi = 0.05, 44.95
    step = (hi - lo) / (AEP_POINTS - 1)
    pts = df.select(*keys, F.col(a).alias("_a"), F.col(k).alias("_k"),
                    F.explode(F.sequence(F.lit(0), F.lit(AEP_POINTS - 1))).alias("_i"))
    pts = power_at(pts.withColumn("_v", lo + F.col("_i") * step), grid, "_v", "_p")
    # trapezoids on equal steps: the two end points count half
    weight = F.when(F.col("_i").isin(0, AEP_POINTS - 1), 0.5).otherwise(1.0)
    f = weibull_pdf(F.col("_v"), F.col("_a"), F.col("_k")) * F.col("_p")
    return pts.groupBy(*keys).agg((F.sum(f * weight) * (step * 8760.0 / 1000.0)).alias(out))


def method_choice(daily_e: DataFrame, monthly_e: DataFrame, metrics: DataFrame, aep: DataFrame) -> DataFrame:
    """One row: which production regression is primary, and its annual energy.

    `aep` holds the Weibull-based gross energy `method_a_mwh` of the farm.
    """
    df = with_scalars(with_scalars(with_scalars(aep, daily_e), monthly_e), metrics)

    def plausible(c: str) -> Column:
        ratio = F.col(c) / F.greatest(F.lit(1.0), F.col("method_a_mwh"))
        return F.coalesce(ratio.between(0.3, 2.0) & (F.col(c) > 0), F.lit(False))

    m_ok, d_ok = plausible("monthly_mwh"), plausible("daily_mwh")
    first = (F.when(F.col("record_months") < 9.0, None)
             .when(F.col("monthly_mwh").isNotNull() & (F.col("monthly_r2") >= 0.5), "monthly")
             .when(F.col("daily_mwh").isNotNull() & (F.col("daily_r2") >= 0.5), "daily"))
    df = df.withColumn("_first", first)
    chosen = (F.when(F.col("_first").isNull(), None)
              .when((F.col("_first") == "monthly") & m_ok, "monthly")
              .when((F.col("_first") == "daily") & d_ok, "daily")
              .when(d_ok, "daily").when(m_ok, "monthly"))
    df = df.withColumn("primary_method", chosen).drop("_first")
    return df.withColumns({
        "method_b_mwh": F.when(F.col("primary_method") == "monthly", F.col("monthly_mwh"))
                         .when(F.col("primary_method") == "daily", F.col("daily_mwh")),
        "method_b_r2": F.when(F.col("primary_method") == "monthly", F.col("monthly_r2"))
                        .when(F.col("primary_method") == "daily", F.col("daily_r2"))})


def gross_aep(choice: DataFrame, nm: DataFrame, p: FarmParams) -> DataFrame:
    """One row: the long-term gross energy of the farm and the method used."""
    df = with_scalars(choice, nm)
    has_b = F.coalesce(F.col("method_b_mwh") > 0, F.lit(False))
    use_nm, use_b = F.lit(False), F.lit(False)
    if p.lt_primary_method == "normalised_month":
        use_nm = F.col("nm_mwh").isNotNull()
    elif p.lt_primary_method == "method_b":
        use_b = has_b
    elif p.lt_primary_method == "method_b_auto":
        diff = F.abs(100.0 * (F.col("method_b_mwh") - F.col("method_a_mwh")) / F.col("method_a_mwh"))
        use_b = has_b & (F.col("record_months") >= 12) & (F.col("method_b_r2") >= 0.5) & (diff <= 15.0)
    use_b = F.coalesce(use_b, F.lit(False))
    return df.withColumns({
        "gross_lt_mwh": F.when(use_nm, F.col("nm_mwh")).when(use_b, F.col("method_b_mwh"))
                         .otherwise(F.col("method_a_mwh")),
        "lt_method": F.when(use_nm, "normalised month").when(
            use_b, F.concat(F.lit("production regression, "), F.col("primary_method")))
            .otherwise("Weibull and warranted curve")})


def sigma_wind(metrics: DataFrame, r2: DataFrame) -> DataFrame:
    """One row: wind-resource uncertainty (1 sigma, percent)."""
    df = with_scalars(metrics, r2)
    s = (3.0 + 5.0 * (1.0 - F.col("mcp_r2"))
         + 1.5 * F.least(F.lit(3.0), 24.0 / F.greatest(F.lit(6.0), F.col("record_months")))
         + F.greatest(F.lit(0.0), 5.0 - 0.5 * F.col("lt_n_years")))
    known = F.coalesce(F.col("has_mcp"), F.lit(False)) & F.col("mcp_r2").isNotNull()
    return df.withColumn("sigma_wind_pct", F.when(known, clip(s, 2.5, 12.0)).otherwise(10.0))
