"""Wake losses from the turbine layout with a Gaussian wake, weighted by the wind rose.

The rose is aggregated first, so the model's size does not depend on the number of records. What depends on the wind
direction only, the place of each turbine in the wakes of those in front of it, is computed once per direction and landed;
the speeds of a direction are joined to it and summed per (bin, turbine) in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from windrow.functions.num import clip, piecewise_linear
from windrow.operators.curve import power_at
from windrow.params import FarmParams

# fixed values: default thrust coefficient curve (m/s, CT)
THRUST = (
    (3.0, 0.90), (4.0, 0.90), (5.0, 0.89), (6.0, 0.87), (7.0, 0.84), (8.0, 0.80),
    (9.0, 0.74), (10.0, 0.67), (11.0, 0.60), (12.0, 0.53), (13.0, 0.47), (14.0, 0.42),
    (16.0, 0.33), (18.0, 0.27), (20.0, 0.22), (22.0, 0.19), (24.0, 0.16), (25.0, 0.15),
)


def thrust(ws: Column, curve=THRUST) -> Column:
    return piecewise_linear(ws, curve)


def wake_shape(along: Column, across: Column, p: FarmParams) -> tuple[Column, Column]:
    """What the geometry alone decides: (8 (sigma / D)^2, share of the centre deficit that the rotor sees)."""
    d = p.rotor_diameter_m
    sigma0 = 0.2 * d * math.sqrt(1 + 2 * p.wake_ti)
    growth = 0.3837 * p.wake_ti + 0.003678
    sigma = growth * (along - 0.5 * d) + sigma0
    t2 = F.pow(F.lit(d / 2.0) / sigma, 2) / 2.0            # (R / (sqrt(2) sigma))^2
    return 8.0 * F.pow(sigma / d, 2), F.exp(-F.pow(across / sigma, 2) / 2.0) * (1.0 - F.exp(-t2)) / t2


def directional_terms(layout: DataFrame, directions: DataFrame, p: FarmParams) -> DataFrame:
    """dir_deg, turbine, x, y and the wake shape of each turbine upstream of it (null where there is none).

    The turbines are sorted along each wind direction, so each meets only those in front of it. The array of all
    positions has a row per turbine of the farm; directions are spread over the cluster before they grow.
    """
    arr = layout.agg(F.collect_list(F.struct("turbine", "x", "y"))).scalar()
    sign = -1.0 if p.wake_bearing == "from" else 1.0
    rad = F.radians("dir_deg")
    spread = directions.select("dir_deg").distinct().repartition(
        directions.sparkSession.sparkContext.defaultParallelism, "dir_deg")
    placed = spread.withColumn("_layout", arr).select("dir_deg", F.array_sort(F.transform("_layout", lambda t: F.struct(
        (t["x"] * sign * F.sin(rad) + t["y"] * sign * F.cos(rad)).alias("along"),
        (t["y"] * sign * F.sin(rad) - t["x"] * sign * F.cos(rad)).alias("across"),
        t["turbine"].alias("turbine"), t["x"].alias("x"), t["y"].alias("y")))).alias("_all"))
    rows = placed.select("dir_deg", "_all", F.posexplode("_all").alias("_i", "t"))
    pairs = rows.select("dir_deg", "t", F.explode_outer(F.slice("_all", F.lit(1), F.col("_i"))).alias("u"))
    along = F.col("t.along") - F.col("u.along")
    near = along > 0.5 * p.rotor_diameter_m
    spread8, seen = wake_shape(along, F.col("t.across") - F.col("u.across"), p)
    return pairs.select("dir_deg", F.col("t.turbine").alias("turbine"), F.col("t.x").alias("x"), F.col("t.y").alias("y"),
                        F.when(near, spread8).alias("spread8"), F.when(near, seen).alias("seen"))


def turbine_deficits(terms: DataFrame, rose: DataFrame, p: FarmParams) -> DataFrame:
    """Effective deficit at each turbine for each rose bin: root of the sum of squared deficits.

    `terms` are the landed directional terms; the speeds of a direction meet them by an equi-join.
    """
    bins = rose.filter((F.col("freq") > 0) & (F.col("ws_bin") >= p.cut_in_mps)
                       & (F.col("ws_bin") < p.cut_out_mps)).select(
        "dir_deg", "ws_bin", "freq", thrust(F.col("ws_bin"), p.ct_curve or THRUST).alias("ct"))
    inner = 1.0 - F.col("ct") / F.col("spread8")
    centre = F.when(inner <= 0, 1.0).otherwise(1.0 - F.sqrt(F.greatest(inner, F.lit(0.0))))
    return (terms.join(bins, "dir_deg").groupBy("dir_deg", "ws_bin", "freq", "turbine", "x", "y")
            .agg(F.sqrt(F.coalesce(F.sum(F.pow(centre * F.col("seen"), 2)), F.lit(0.0))).alias("deficit")))


def turbine_energy(deficit_rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Free and waked mean power, weighted by the bin's frequency."""
    veff = F.greatest(F.lit(0.5), F.col("ws_bin") * (1.0 - clip(F.col("deficit"), 0.0, 0.95)))
    df = power_at(deficit_rows.withColumn("v_eff", veff), grid, "ws_bin", "_pf")
    df = power_at(df, grid, "v_eff", "_pw")
    return df.withColumns({"e_free": F.col("_pf") * F.col("freq"),
                           "e_waked": F.col("_pw") * F.col("freq")}).drop("_pf", "_pw")


def _loss_pct(free: Column, waked: Column) -> Column:
    return 100.0 * (free - waked) / F.greatest(free, F.lit(1e-9))


def layout_turbine(energy: DataFrame) -> DataFrame:
    df = energy.groupBy("turbine", "x", "y").agg(F.sum("e_free").alias("energy_free_mwh"),
                                                 F.sum("e_waked").alias("energy_waked_mwh"))
    return df.withColumns({
        "wake_loss_mwh": F.col("energy_free_mwh") - F.col("energy_waked_mwh"),
        "wake_loss_pct": _loss_pct(F.col("energy_free_mwh"), F.col("energy_waked_mwh"))})


def layout_sector(energy: DataFrame) -> DataFrame:
    return energy.groupBy("dir_deg", "ws_bin", "freq").agg(
        F.avg("deficit").alias("mean_deficit"),
        _loss_pct(F.sum("e_free"), F.sum("e_waked")).alias("loss_pct"))


def layout_farm(energy: DataFrame) -> DataFrame:
    """One row: free and waked energy and the farm's wake loss."""
    one = energy.agg(F.coalesce(F.sum("e_free"), F.lit(0.0)).alias("energy_free_mwh"),
                     F.coalesce(F.sum("e_waked"), F.lit(0.0)).alias("energy_waked_mwh"))
    return one.withColumn("farm_loss_pct",
                          _loss_pct(F.col("energy_free_mwh"), F.col("energy_waked_mwh")))
