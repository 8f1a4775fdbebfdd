"""Projections of the provided tables that stand in for SCADA records and reference series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.functions.rows import land
from windrow.operators.curve import curve_grid, generic_curve
from windrow.operators.blocks import Blocks
from windrow.operators.flags import Flagged, land_counted, record_blocks
from windrow.operators.timeseries import resample_10min
from windrow.params import FarmParams, FutureLosses
from windrow.plans.assessment import Assessment

PARAMS = FarmParams(air_pressure_kpa=99.2, preconstruction_p50_gwh=60.0)
FUTURE = replace(PARAMS, future_losses=FutureLosses(3.0, 1.4, 2.0, 1.5))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scada(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCADA-like records from lineitem, with planted outages, curtailment and spikes.

    The odd offsets keep values off the edges of bins, where the last digit of a mean would decide.
    """
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 3 as slot_no", "cast((l_partkey + l_linenumber) % 12 as int) as tno",
        "l_linenumber as minute", "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    li = li.selectExpr("*", "slot_no div 36 as b", "slot_no div 144 as dd")
    li = li.selectExpr(
        "*", "2.00131713D + 0.00013711D * tno + 0.5D * cast((b*7) % 23 as double)"
        " + (l_quantity - 25.0D) * 0.02D as ws",
        "cast((dd*11 + cast(l_quantity as bigint)) % 45 as double) - 2.0D as temp_c",
        "cast((b*41 + cast(l_quantity as bigint)) % 359 as double) + 0.37113D as dir_deg",
        "case (tno*13 + b*7) % 40 when 0 then 200 when 1 then 300 when 2 then 400"
        " when 3 then 500 when 4 then 600 else 100 end as status")
    li = li.selectExpr(
        "*", "case when ws < 3.0D then 0.0D"
        " else 2500.0D * (1 - exp(-pow((ws - 3.0D) / 5.5D, 3))) end as p")
    return li.selectExpr(
        "concat('T', lpad(cast(tno + 1 as string), 2, '0')) as turbine",
        "TIMESTAMP_NTZ'1996-01-01 00:00:00' + make_dt_interval(cast(slot_no div 144 as int), 0,"
        " cast(slot_no % 144 * 10 as int) + minute) as timestamp",
        "(case when status in (200, 300, 400) then 0.0D when status = 500 then least(750.0D, p)"
        " else p * (case when tno = 6 then 0.94D when tno = 11 then 0.97D else 1.0D end)"
        " * (1 - 0.2D * l_discount) end)"
        " * (case when l_extendedprice > 104000 then 4.0D else 1.0D end) as power_kw",
        "ws", "dir_deg", "(dir_deg + round(l_tax*100) - 3.7583D + 360) % 360 as wind_dir_deg",
        "temp_c", "status", "cast(null as int) as curt_flag")


def scada_nostatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scada(spark, sf_dir).withColumn("status", F.lit(None).cast("int"))


def scada_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with turbines at distinct wind levels and T05's anemometer stuck at times."""
    df = scada(spark, sf_dir)
    tno = F.substring("turbine", 2, 2).cast("int") - 1
    stuck = (tno == 4) & (F.expr("datediff(to_date(timestamp), date'1996-01-01')") % 3 == 1)
    return df.withColumn("ws", F.when(stuck, 6.2).otherwise(F.col("ws") + 0.35 * tno))


def grid(spark: SparkSession, p: FarmParams = PARAMS) -> DataFrame:
    return curve_grid(generic_curve(spark, p), p)


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_10min(scada(spark, sf_dir))


_landed: dict = {}


def landed(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Lands a shared stage once per session; later results read only their columns of it."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _landed:
        _landed[key] = land(build(), "-".join(str(k).rsplit("/", 1)[-1] for k in key[1:]))
    return _landed[key]


def forget_landed() -> None:
    _landed.clear()


def counted(spark: SparkSession, sf_dir: str) -> Flagged:
    """The flagged table of the test bed, and the same for sums, landed once."""
    key = (spark.sparkContext.applicationId, "flagged", sf_dir)
    if key not in _landed:
        _landed[key] = land_counted(blocks(spark, sf_dir), grid(spark), PARAMS, "flagged")
    return _landed[key]


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).rows


def blocks(spark: SparkSession, sf_dir: str) -> Blocks:
    """The resampled rows and their context, landed once."""
    key = (spark.sparkContext.applicationId, "blocks", sf_dir)
    if key not in _landed:
        _landed[key] = record_blocks(scada(spark, sf_dir), PARAMS)
    return _landed[key]


def reference_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    doy = F.dayofyear("d")
    return (table(spark, sf_dir, "orders").groupBy(day.alias("d"))
            .agg((2.0 + F.avg("o_totalprice") / 50021.7).alias("ws"))
            .select("d", "ws", ((doy * 37) % 360).cast("double").alias("dir"),
                    (15.0 + (doy % 20).cast("double") - 10.0).alias("temp_c")))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the turbines that occur in the records, on a grid four turbines wide."""
    t = counted(spark, sf_dir).counted.select("turbine").distinct()
    tno = F.substring("turbine", 2, 2).cast("int") - 1
    return t.select("turbine", (tno % 4 * 680).cast("double").alias("x"),
                    (F.floor(tno / 4) * 544).cast("double").alias("y"))


def assessment(spark: SparkSession, sf_dir: str, params: FarmParams = PARAMS) -> Assessment:
    """Results of the test bed. The daily series come from ship dates, because the records of the
    small scale factors cover weeks only."""
    key = (spark.sparkContext.applicationId, "assessment", sf_dir, repr(params))
    if key not in _landed:
        site = landed(spark, ("site", sf_dir), lambda: site_daily(spark, sf_dir))
        ref = landed(spark, ("reference", sf_dir), lambda: reference_daily(spark, sf_dir))
        months = site.agg((F.datediff(F.max("d"), F.min("d")) / 30.44).alias("record_months"))
        _landed[key] = Assessment(
            lambda: flagged(spark, sf_dir), generic_curve(spark, params), params, ref, lambda: layout(spark, sf_dir),
            site.select("d", "ws"), site.select("d", "e_mwh"), months,
            for_sums=lambda: counted(spark, sf_dir).counted)
    return _landed[key]


def site_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d"))
            .agg((3.0 + F.avg("l_quantity") / 6.0137).alias("ws"),
                 (F.sum("l_quantity") / 10.0).alias("e_mwh")))
