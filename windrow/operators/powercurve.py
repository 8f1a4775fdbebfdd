"""Binned power curves and their deviation from the warranted curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from windrow.functions.num import clip
from windrow.operators.curve import node_lookup
from windrow.params import FarmParams

V_MAX = 45.0


def curve_base(flagged: DataFrame, p: FarmParams) -> DataFrame:
    """Sums per turbine and speed bin over the operating records, of which every curve table is a read-out.

    `m2` is the sum of squared distances from the bin's mean, which merges without loss of digits. Records that are in
    no bin (no speed or power) have a null bin; they count for the energies only.
    """
    power = F.col("power_kw")
    if p.air_density_correction:
        power = power / clip(F.col("density_ratio"), 0.3, 1.5)
    inside = F.col("ws").isNotNull() & (F.col("ws") < V_MAX) & power.isNotNull()
    ops = flagged.filter("flag = 0").select(
        "turbine", "ws", power.alias("pw"), "energy_kwh", "expected_energy_kwh",
        F.when(inside, F.floor(F.col("ws") / p.bin_width_mps).cast("int")).alias("bin"))
    return ops.groupBy("turbine", "bin").agg(
        F.count(F.lit(1)).alias("count"), F.sum("ws").alias("ws_sum"), F.sum("pw").alias("pw_sum"),
        (F.var_pop("pw") * F.count("pw")).alias("m2"), F.max("pw").alias("max_power"),
        F.sum("energy_kwh").alias("energy_kwh"), F.sum("expected_energy_kwh").alias("expected_energy_kwh"))


def _bins(base: DataFrame, p: FarmParams, keys: list[str]) -> DataFrame:
    """Curve bins of the groups; variances within turbines and between their means add up."""
    binned = base.filter("bin is not null")
    mean = F.col("pw_sum") / F.col("count")
    middle = F.sum("pw_sum").over(W.partitionBy(*keys, "bin")) / F.sum("count").over(W.partitionBy(*keys, "bin"))
    agg = (binned.withColumn("m2", F.col("m2") + F.col("count") * F.pow(mean - middle, 2))
           .groupBy(*keys, "bin").agg(
        F.sum("count").alias("count"), (F.sum("ws_sum") / F.sum("count")).alias("mean_ws"),
        (F.sum("pw_sum") / F.sum("count")).alias("mean_power"),
        F.sqrt(F.sum("m2") / F.sum("count")).alias("sd"), F.max("max_power").alias("max_power")))
    enough = F.col("count") >= p.min_bin_count
    return agg.select(*keys, "bin", "count", F.when(enough, F.col("mean_ws")).alias("mean_ws"),
                      F.when(enough, F.col("mean_power")).alias("mean_power"),
                      F.when(F.col("count") > 1, F.col("sd")).alias("std_power"), "max_power")


def _with_spine(binned: DataFrame, p: FarmParams, keys: list[str]) -> DataFrame:
    """Adds the empty bins (90 bins of the default width)."""
    n_bins = int(V_MAX / p.bin_width_mps)
    spark = binned.sparkSession
    if keys:
        spine = binned.select(*keys).distinct().select(
            *keys, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    else:
        spine = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return _centred(spine.join(binned, [*keys, "bin"], "left").na.fill(0, ["count"]), p)


def _centred(binned: DataFrame, p: FarmParams) -> DataFrame:
    return binned.withColumn("bin_center", (F.col("bin") + 0.5) * p.bin_width_mps).drop("bin")


def power_curve_farm(base: DataFrame, p: FarmParams) -> DataFrame:
    return _with_spine(_bins(base, p, []), p, [])


def power_curve_turbine(base: DataFrame, p: FarmParams) -> DataFrame:
    return _with_spine(_bins(base, p, ["turbine"]), p, ["turbine"])


def _deviation(curve: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    m = node_lookup(curve.filter("mean_power is not null and count > 0"), nodes, "bin_center", "pw")
    num, den = F.sum(F.col("count") * (F.col("mean_power") - F.col("pw"))), F.sum(F.col("count") * F.col("pw"))
    return m.groupBy(*keys).agg(F.when(den > 0, 100.0 * num / den).otherwise(0.0).alias("deviation_pct"))


def farm_deviation(base: DataFrame, nodes: DataFrame, p: FarmParams) -> DataFrame:
    """One row: energy-weighted deviation of the farm curve (percent)."""
    return _deviation(power_curve_farm(base, p), nodes, [])


def curve_deviation(base: DataFrame, nodes: DataFrame, p: FarmParams) -> DataFrame:
    """Per turbine: deviation, performance ratio, operating records."""
    dev = _deviation(_centred(_bins(base, p, ["turbine"]), p), nodes, ["turbine"])
    ratio = (base.groupBy("turbine").agg(
        (F.sum("energy_kwh") / F.greatest(F.sum("expected_energy_kwh"), F.lit(1e-6)))
        .alias("performance_ratio"), F.sum("count").alias("n_operating_rows")))
    return ratio.join(dev, "turbine", "left").na.fill(0.0, ["deviation_pct"])


def curve_delta(base: DataFrame, nodes: DataFrame, p: FarmParams) -> DataFrame:
    """Measured against warranted power per bin with records."""
    bt = node_lookup(power_curve_farm(base, p), nodes, "bin_center", "warranted_kw")
    delta = F.col("mean_power") - F.col("warranted_kw")
    return (bt.filter((F.col("bin_center") >= p.cut_in_mps) & (F.col("bin_center") <= p.cut_out_mps + 0.5)
                      & (F.col("count") > 0))
            .select("bin_center", F.col("count").alias("records"),
                    F.col("mean_power").alias("measured_kw"), "warranted_kw",
                    delta.alias("delta_kw"),
                    (100.0 * delta / F.greatest("warranted_kw", F.lit(1.0))).alias("delta_pct")))
