"""Wake losses from nacelle wind speeds: free stream, deficits, lost energy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from windrow.functions.num import clip, sector
from windrow.functions.rows import buckets_of, with_scalars
from windrow.operators.curve import power_at
from windrow.operators.flags import at_slot
from windrow.params import FarmParams

REFERENCE_BAND = 0.015      # turbines within 1.5 % of the sector's best mean
MIN_FREE_WS = 5.0
MIN_WAKE_WS = 6.0


def bad_anemometers(base: DataFrame) -> DataFrame:
    """Turbines with more than 2 % of their records flagged as anemometer fault, from the base table."""
    faulty = F.sum(F.when(F.col("flag") == 7, F.col("n")).otherwise(0))
    return (base.groupBy("turbine").agg((faulty / F.sum("n")).alias("fault_share"))
            .filter("fault_share > 0.02"))


def slot_parts(base: DataFrame) -> int:
    """Into how many parts the operating records are spread by slot; their number is known from the landed base table."""
    return buckets_of(base.sparkSession, base.filter("flag = 0").agg(F.sum("n")).first()[0] or 0)


def sectored(flagged: DataFrame, base: DataFrame, p: FarmParams, has_direction: bool = True,
             parts: int | None = None) -> DataFrame:
    """Operating records with `pool` (may serve as reference) and the sector of their time.

    The sector is the median direction of the pool; a time holds one record per turbine. `base` is
    the landed base table: Spark knows its size and decides about the join from it. The rows come out spread by slot,
    to be landed in buckets: all windows over a slot that follow need no further exchange.
    """
    bad = bad_anemometers(base).select("turbine", F.lit(True).alias("_bad"))
    op = (flagged.filter("flag = 0 and ws is not null")
          .select("turbine", "slot", "ws", "dir_deg", "density_ratio")
          .join(bad, "turbine", "left").withColumn("pool", F.col("_bad").isNull()).drop("_bad")
          .repartition(parts or buckets_of(flagged.sparkSession), "slot"))
    if not has_direction:
        return op.withColumn("sector", F.lit(0))
    med = F.median(F.when(F.col("pool"), F.col("dir_deg"))).over(at_slot())
    return op.withColumn("sector", sector(med, p.sector_width_deg))


def wake_sector(rows: DataFrame) -> DataFrame:
    return rows.filter("pool").groupBy("slot").agg(F.max("sector").alias("sector"))


def reference_set(rows: DataFrame) -> DataFrame:
    """Per sector the turbines whose mean wind speed is close to the best one."""
    means = (rows.filter("pool and sector is not null").groupBy("sector", "turbine")
             .agg(F.avg("ws").alias("mean_ws")))
    best = F.max("mean_ws").over(W.partitionBy("sector"))
    return (means.withColumn("best", best)
            .filter(F.col("mean_ws") >= F.col("best") * (1.0 - REFERENCE_BAND)).drop("best"))


def with_free_stream(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds the free-stream wind speed of each time: mean of its reference turbines, else the maximum.

    `reference` is the landed reference set (a few rows per sector). As its size is known, it joins
    without moving the rows, which stay spread by slot from the sector step.
    """
    ref = reference.select("sector", "turbine", F.lit(True).alias("is_ref"))
    df = rows.join(ref, ["sector", "turbine"], "left")
    mean_ref = F.avg(F.when(F.col("is_ref"), F.col("ws"))).over(at_slot())
    highest = F.max(F.when(F.col("pool"), F.col("ws"))).over(at_slot())
    df = df.withColumn("_free", F.coalesce(mean_ref, highest)).filter("_free is not null")
    return (df.withColumn("ws_free", F.when(F.col("_free") >= MIN_FREE_WS, F.col("_free")))
            .drop("_free", "is_ref"))


def free_stream(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per time with its free-stream wind speed."""
    return (with_free_stream(rows, reference).groupBy("slot", "sector").agg(F.max("ws_free").alias("ws_free")))


def deficits(rows: DataFrame, reference: DataFrame, grid: DataFrame, p: FarmParams) -> DataFrame:
    """Wake deficit and lost power per operating record."""
    df = power_at(power_at(with_free_stream(rows, reference), grid, "ws_free", "_pf"), grid, "ws", "_pw")
    waked = F.coalesce((F.col("ws_free") - F.col("ws") > 0.1) & (F.col("ws_free") > MIN_WAKE_WS),
                       F.lit(False))
    lost = F.greatest(F.lit(0.0), F.col("_pf") - F.col("_pw"))
    if p.air_density_correction:
        lost = lost * clip(F.col("density_ratio"), 0.5, 1.15)
    return df.select("turbine", "slot", "ws", "dir_deg", "ws_free", waked.alias("waked"),
                     F.when(waked, 1.0 - F.col("ws") / F.col("ws_free")).otherwise(0.0).alias("deficit"),
                     F.when(waked, lost).otherwise(0.0).alias("wake_power_loss_kw"))


def wake_base(d: DataFrame, p: FarmParams, has_direction: bool = True) -> DataFrame:
    """Sums per turbine and its own sector, of which every wake table is a read-out."""
    key = sector(F.col("dir_deg"), p.sector_width_deg) if has_direction else F.lit(0)
    free = F.col("ws_free") > MIN_WAKE_WS
    return d.groupBy("turbine", key.alias("sector_deg")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("deficit").alias("deficit"),
        F.count(F.when(free, True)).alias("n_free"), F.sum(F.when(free, F.col("deficit"))).alias("deficit_free"),
        F.sum(F.col("waked").cast("int")).alias("n_waked"), F.sum("wake_power_loss_kw").alias("lost_kw"))


def wake_sector_table(base: DataFrame) -> DataFrame:
    return (base.filter("n_free > 0").groupBy("sector_deg")
            .agg((F.sum("deficit_free") / F.sum("n_free")).alias("mean_deficit"), F.sum("n_free").alias("n_samples")))


def wake_turbine_table(base: DataFrame, p: FarmParams) -> DataFrame:
    return base.groupBy("turbine").agg(
        (F.sum("deficit") / F.sum("n")).alias("mean_deficit"), F.sum("n").alias("n_samples"),
        (F.sum("lost_kw") * p.interval_h / 1000.0).alias("wake_energy_mwh"))


def wake_loss(base: DataFrame, account: DataFrame, p: FarmParams) -> DataFrame:
    """One row: wake energy, its share of the gross energy, records with a wake."""
    one = base.agg(
        (F.coalesce(F.sum("lost_kw"), F.lit(0.0)) * p.interval_h / 1000.0).alias("wake_energy_mwh"),
        F.coalesce(F.sum("n_waked"), F.lit(0)).alias("n_intervals"))
    df = with_scalars(one, account.select("gross_mwh"))
    share = F.when(F.col("gross_mwh") > 0, 100.0 * F.col("wake_energy_mwh") / F.col("gross_mwh"))
    return df.withColumn("wake_loss_pct", F.coalesce(share, F.lit(0.0)))
