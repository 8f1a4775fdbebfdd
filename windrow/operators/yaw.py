"""Yaw screening: power against the difference of wind and nacelle direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from windrow.functions.num import clip, det3, wrap180
from windrow.functions.rows import with_scalars
from windrow.params import FarmParams

FLAG_THRESHOLD_DEG = 5.0
MIN_FARM, MIN_TURBINE, MIN_USED = 200, 100, 80
SCALE = 10.0        # the fit runs on degrees / 10, which keeps the power sums well conditioned


def _usable(flagged: DataFrame, p: FarmParams) -> DataFrame:
    in_range = (F.col("ws") >= max(3.0, p.cut_in_mps)) & (F.col("ws") <= 12.0)
    return (flagged.filter("flag = 0 and ws is not null and power_kw is not null"
                           " and wind_dir_deg is not null and dir_deg is not null")
            .select("turbine", "slot", "ws", "power_kw",
                    wrap180(F.col("wind_dir_deg") - F.col("dir_deg")).alias("yaw_err"),
                    F.when(in_range, F.floor(F.col("ws") * 2).cast("int")).alias("bin")))


def bin_means(flagged: DataFrame, p: FarmParams) -> DataFrame:
    """Mean power per turbine and 0.5 m/s bin, for turbines with enough records.

    One row per turbine and bin, whatever the number of records.
    """
    usable = _usable(flagged, p)
    bins = usable.groupBy("turbine", "bin").agg(F.count(F.lit(1)).alias("n"),
                                                F.avg("power_kw").alias("bin_mean"))
    turbine = W.partitionBy("turbine")
    bins = (bins.withColumn("n_op", F.sum("n").over(turbine))
            .withColumn("n_used", F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).over(turbine)))
    bins = with_scalars(bins, usable.agg(F.count(F.lit(1)).alias("n_farm")))
    good = bins.filter((F.col("n_farm") >= MIN_FARM) & (F.col("n_op") >= MIN_TURBINE)
                       & (F.col("n_used") >= MIN_USED) & F.col("bin").isNotNull())
    return good.select("turbine", "bin", "bin_mean")


def yaw_rows(flagged: DataFrame, means: DataFrame, p: FarmParams) -> DataFrame:
    """Usable records with yaw error and power relative to the mean of turbine and bin.

    `means` is the landed result of bin_means, so that the records need not move for the join.
    """
    ratio = F.col("power_kw") / F.greatest(F.col("bin_mean"), F.lit(1.0))
    return (_usable(flagged, p).join(means, ["turbine", "bin"])
            .select("turbine", "slot", "ws", "power_kw", "yaw_err", clip(ratio, 0.3, 1.7).alias("pr")))


def yaw_fit(rows: DataFrame) -> DataFrame:
    """Per turbine: least-squares parabola of power ratio over yaw error, from sums of powers."""
    x, y = F.col("yaw_err") / SCALE, F.col("pr")
    w = F.greatest(F.col("power_kw"), F.lit(0.0)) + 1.0
    s = rows.groupBy("turbine").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("x1"), F.sum(x * x).alias("x2"),
        F.sum(x * x * x).alias("x3"), F.sum(x * x * x * x).alias("x4"), F.sum(y).alias("y1"),
        F.sum(x * y).alias("xy"), F.sum(x * x * y).alias("x2y"), F.sum(y * y).alias("yy"),
        (F.sum(w * F.col("yaw_err")) / F.sum(w)).alias("mean_yaw_error_deg"),
        F.stddev_pop("yaw_err").alias("yaw_spread_deg"), F.avg("pr").alias("mean_power_ratio"))
    n, x1, x2, x3, x4 = (F.col(c) for c in ("n", "x1", "x2", "x3", "x4"))
    rhs = [F.col("x2y"), F.col("xy"), F.col("y1")]
    m = [[x4, x3, x2], [x3, x2, x1], [x2, x1, n]]
    det = det3(m)

    def solve(col):
        swapped = [[rhs[r] if c == col else m[r][c] for c in range(3)] for r in range(3)]
        return F.when(det > 1e-9 * F.pow(n, 3), det3(swapped) / det)

    fit = s.withColumns({"a": solve(0), "b": solve(1), "c": solve(2)})
    res = F.col("yy") - F.col("a") * rhs[0] - F.col("b") * rhs[1] - F.col("c") * rhs[2]
    tot = F.col("yy") - F.col("y1") * F.col("y1") / n
    return fit.withColumn("r2_all", F.when(tot > 0, 1.0 - res / tot).otherwise(0.0)).select(
        "turbine", "n", "mean_yaw_error_deg", "yaw_spread_deg", "mean_power_ratio",
        (F.col("a") / (SCALE * SCALE)).alias("a"), (F.col("b") / SCALE).alias("b"), "c", "r2_all")


def yaw_screening(fit: DataFrame) -> DataFrame:
    """Misalignment per turbine: the vertex of the parabola where it is credible, else the mean error."""
    vertex = -F.col("b") / (2.0 * F.col("a"))
    resolvable = ((F.col("a") < 0) & (F.col("yaw_spread_deg") > 2.0) & (F.abs(vertex) <= 40))
    df = fit.withColumn("fit_r2", F.when(resolvable, F.col("r2_all")).otherwise(0.0))
    df = df.withColumn("_v", F.when(resolvable & (F.col("fit_r2") >= 0.02), vertex))
    est = F.coalesce("_v", "mean_yaw_error_deg")
    best = F.col("a") * F.col("_v") * F.col("_v") + F.col("b") * F.col("_v") + F.col("c")
    gain = 100.0 * (F.coalesce(best, "c") - F.col("c")) / F.greatest(F.col("c"), F.lit(1e-9))
    return df.select(
        "turbine", "mean_yaw_error_deg", est.alias("yaw_misalignment_deg"), "fit_r2", "yaw_spread_deg",
        "n", F.coalesce(F.greatest(F.lit(0.0), gain), F.lit(0.0)).alias("loss_pct"), "mean_power_ratio",
        (F.abs(est) > FLAG_THRESHOLD_DEG).alias("flagged"))


def yaw_bins(rows: DataFrame) -> DataFrame:
    """Mean power ratio per 2 degrees of yaw error, for errors within 40 degrees."""
    return (rows.filter("yaw_err >= -40 and yaw_err < 40")
            .groupBy((F.floor(F.col("yaw_err") / 2) * 2 + 1).cast("int").alias("yaw_center"))
            .agg(F.avg("pr").alias("mean_power_ratio"), F.count(F.lit(1)).alias("n")))
