"""Power curves: generic curve, dense grid, interpolating lookup, expected energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from windrow.functions.num import clip
from windrow.params import FarmParams

GRID_CELLS = 451          # 0.0, 0.1 .. 45.0 m/s


def generic_curve(spark: SparkSession, p: FarmParams) -> DataFrame:
    """Curve nodes every 0.5 m/s from rated power, cut-in and cut-out."""
    v = F.col("id") * 0.5
    rise = p.rated_power_kw * (1 - F.exp(-F.pow(F.greatest(v - p.cut_in_mps, F.lit(0.0)) / 5.5, 3)))
    power = (F.when((v < p.cut_in_mps) | (v >= p.cut_out_mps), 0.0)
             .otherwise(F.least(rise, F.lit(p.rated_power_kw))))
    return spark.range(91).select(v.alias("bin_center"), power.alias("mean_power"))


def node_lookup(df: DataFrame, nodes: DataFrame, x: str, out: str) -> DataFrame:
    """Piecewise-linear value of the curve nodes at `x`, held at both ends.

    For short tables (bins, grid cells). The nodes, at most a few hundred, travel as one array.
    """
    arr = nodes.agg(F.sort_array(F.collect_list(F.struct(
        F.col("bin_center").alias("v"), F.coalesce("mean_power", F.lit(0.0)).alias("p"))))
        .alias("a")).scalar()
    df = df.withColumn("_nodes", arr)
    lo = F.array_max(F.filter("_nodes", lambda n: n["v"] <= F.col(x)))
    hi = F.array_min(F.filter("_nodes", lambda n: n["v"] > F.col(x)))
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    inside = F.col("_lo.p") + (F.col("_hi.p") - F.col("_lo.p")) * (F.col(x) - F.col("_lo.v")) / (
        F.col("_hi.v") - F.col("_lo.v"))
    value = (F.when(F.col("_lo").isNull(), F.col("_hi.p"))
             .when(F.col("_hi").isNull(), F.col("_lo.p")).otherwise(inside))
    return df.withColumn(out, value).drop("_nodes", "_lo", "_hi")


def curve_grid(nodes: DataFrame, p: FarmParams) -> DataFrame:
    """The curve on a 0.1 m/s grid, capped at rated power, zero from cut-out on.

    One row per cell with the power at both ends of the cell.
    """
    spark = nodes.sparkSession
    cells = spark.range(GRID_CELLS).select(F.col("id").cast("int").alias("cell"),
                                           (F.col("id") * 0.1).alias("v"))
    dense = node_lookup(cells, nodes, "v", "base")
    p0 = F.when(F.col("v") >= p.cut_out_mps, 0.0).otherwise(
        F.least("base", F.lit(p.rated_power_kw)))
    dense = dense.select("cell", "v", p0.alias("p0"))
    # 451 rows: a single small window
    nxt = F.lead("p0").over(W.orderBy("cell"))
    return dense.select("cell", "v", "p0", F.coalesce(nxt, "p0").alias("p1"))


def power_at(df: DataFrame, grid: DataFrame, ws: str, out: str) -> DataFrame:
    """Curve power at a wind speed, by an equi-join on the grid cell (the grid has 451 rows)."""
    x = F.col(ws) * 10.0
    cell = F.least(F.floor(F.greatest(x, F.lit(0.0))), F.lit(GRID_CELLS - 1)).cast("int")
    cells = F.broadcast(grid.select(F.col("cell").alias("_cell"), F.col("p0").alias("_p0"),
                                    F.col("p1").alias("_p1")))
    keyed = df.withColumn("_cell", F.when(F.col(ws).isNotNull(), cell))
    frac = clip(x - F.col("_cell"), 0.0, 1.0)
    return (keyed.join(cells, "_cell", "left")
            .withColumn(out, F.col("_p0") + (F.col("_p1") - F.col("_p0")) * frac)
            .drop("_cell", "_p0", "_p1"))


def energy_from_series(df: DataFrame, grid: DataFrame, interval_h: float, keys=("turbine",)) -> DataFrame:
    """Energy (MWh) implied by a wind series through the curve."""
    return (power_at(df, grid, "ws", "_p").groupBy(*keys)
            .agg((F.sum(F.col("_p") * interval_h) / 1000.0).alias("energy_mwh")))


def expected_power(p: FarmParams) -> Column:
    """Expected power scaled by the density ratio, held within 0.5..1.15.

    Without a temperature column the correction must be off (`air_density_correction`); a single
    missing temperature leaves no expectation for its record.
    """
    power = F.col("expected_power_kw")
    return power * clip(F.col("density_ratio"), 0.5, 1.15) if p.air_density_correction else power
