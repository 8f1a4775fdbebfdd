"""Queries over the test bed, one per operator. Results are rounded and named for comparison."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow import sinks
from windrow.functions import num
from windrow.functions.rows import scratch_dir, with_scalars
from windrow.functions.timegrid import slot_of, timestamp_of
from windrow.operators import (curve, energy, flags, layout as lay, longterm as lt, powercurve as pc,
                               resource, timeseries as ts, wake, yaw, yieldcalc as yc)
from windrow.plans import testbed as tb
from windrow.sources import auxiliary, files
from windrow.sources.columns import plan_columns, plan_from_map
from windrow.sources.readers import load_scada
from windrow.sources.standardise import number, comma_decision, standardise, status_code

P = tb.PARAMS


def out(df: DataFrame, default: int = 4, **digits: int) -> DataFrame:
    """Rounded doubles, 64-bit integers, times as text."""
    cols = []
    for name, t in df.dtypes:
        c = F.col(name)
        if name == "slot":
            c, name = timestamp_of().cast("string"), "ts"
        elif t == "double":
            c = F.round(c, digits.get(name, default))
        elif t in ("int", "smallint", "tinyint", "boolean"):
            c = c.cast("bigint")
        elif t.startswith("timestamp") or t == "date":
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


def flagged(s, d):
    return tb.flagged(s, d)


def a(s, d, params=P):
    return tb.assessment(s, d, params)


# ---- sources ---------------------------------------------------------------------------------


def _export(s: SparkSession, d: str, **cols: str) -> DataFrame:
    """Records as a vendor export: text columns with the given names."""
    src = tb.scada(s, d)
    return src.select(*[F.expr(e).alias(n) for n, e in cols.items()])


def scan_scada(s, d):
    raw = _export(s, d, PCTimeSt="cast(timestamp as string)", AssetNam="concat(' ', turbine)",
                  Amb_Tems="cast(temp_c as string)", Amb_Wind="cast(ws as string)",
                  Grd_Prod_="cast(power_kw as string)", Nac_Direc="cast(dir_deg as string)",
                  Sys_Stats_="cast(status as string)", Counter_001="'17'")
    df = standardise(raw, plan_columns(raw.columns))
    return out(df.groupBy("turbine", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("power_kw").alias("power"), F.avg("ws").alias("ws"),
        F.avg("temp_c").alias("temp"), F.avg("dir_deg").alias("dir"), F.min("timestamp").alias("first_ts")))


def scan_column_map(s, d):
    raw = _export(s, d, a="timestamp", b="turbine", c="power_kw", x="ws", y="status", z="dir_deg")
    plan = plan_from_map(raw.columns, {"timestamp": "a", "turbine": "b", "power": "c", "ws": "x", "status": "y"})
    df = standardise(raw, plan)
    return out(df.groupBy("turbine").agg(
        F.count(F.lit(1)).alias("n"), F.sum("power_kw").alias("power"), F.max("ws").alias("ws"),
        F.count("dir_deg").alias("n_dir"), F.sum("status").alias("status_sum")))


def _filed(s, d):
    """Records in files whose periods overlap their neighbours'."""
    li = tb.scada(s, d)
    seq = F.expr("cast(unix_date(to_date(timestamp)) - 9496 as int)")
    ordinal = F.floor(seq / 7).cast("int") + F.pmod(F.hour("timestamp"), F.lit(2))
    return li.withColumn("ordinal", ordinal.cast("int")).withColumn(
        "file", F.concat(F.lit("part_"), F.lpad(F.col("ordinal").cast("string"), 4, "0"), F.lit(".csv")))


def multi_file_union(s, d):
    # neighbouring slots of an hour go to different files; shift one of them onto the other
    df = _filed(s, d).withColumn("timestamp", F.expr(
        "timestamp - make_dt_interval(0, cast(hour(timestamp) % 2 as int))"))
    return out(files.merge_files(df).select("turbine", "slot", "power_kw", "ws", "status"), 6)


def file_profile(s, d):
    return out(files.file_profile(_filed(s, d)))


def file_overlap(s, d):
    return out(files.file_overlap(files.file_profile(_filed(s, d))))


def file_overlap_groups(s, d):
    return out(files.overlap_groups(files.file_profile(_filed(s, d))))


def file_overlaps_of(s, d):
    return out(files.overlaps_of(files.file_profile(_filed(s, d)), "part_0001.csv"))


def months_rewritten(s, d):
    """All months written, then the first one again with half its power; read back by month."""
    path = os.path.join(scratch_dir(s), f"months-{uuid.uuid4().hex}")
    df = flagged(s, d)
    sinks.rewrite_months(df, path, f"{path}-audit", "first")
    first = df.agg(F.min("month").alias("m")).scalar()
    again = df.filter(F.col("month") == first).withColumn("power_kw", F.col("power_kw") / 2)
    sinks.rewrite_months(again, path, f"{path}-audit", "second")
    runs = s.read.schema("month string, run string, rows long").parquet(f"{path}-audit").groupBy("month").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows_written"))
    held = sinks.read_months(s, path, df).groupBy("month").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("power_kw").alias("power"), F.min("flag").alias("least_flag"))
    return out(held.join(runs, "month"))


def _fresh(s, name):
    return os.path.join(scratch_dir(s), f"{name}-{uuid.uuid4().hex}")


def scan_export_files(s, d):
    """Records written as compressed exports with semicolons, then read by their headers."""
    path = _fresh(s, "exports")
    _export(s, d, PCTimeSt="cast(timestamp as string)", AssetNam="turbine", Amb_Tems="cast(temp_c as string)",
            Amb_Wind="cast(ws as string)", Grd_Prod_="cast(power_kw as string)", Nac_Direc="cast(dir_deg as string)",
            Sys_Stats_="cast(status as string)").write.option("header", True).option("sep", ";").option(
        "compression", "gzip").csv(path)
    df, _ = load_scada(s, path)
    return out(df.groupBy("turbine", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("power_kw").alias("power"), F.avg("ws").alias("ws"),
        F.avg("temp_c").alias("temp"), F.avg("dir_deg").alias("dir"), F.min("timestamp").alias("first_ts")))


def split_months(s, d):
    """Records as exports by month, and in files of few rows; both read back."""
    path = _fresh(s, "split")
    df = tb.scada(s, d).select("timestamp", "turbine", "power_kw", "ws", "status")
    kinds = "timestamp timestamp_ntz, turbine string, power_kw double, ws double, status int"
    sinks.split_by_month(df, f"{path}/months")
    sinks.split_by_rows(df, f"{path}/rows", 1000)
    month = F.date_format("timestamp", "yyyy-MM")
    by_rows = s.read.schema(kinds).option("header", True).csv(f"{path}/rows").groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("rows_by_number"))
    held = s.read.schema(f"{kinds}, month string").option("header", True).csv(f"{path}/months")
    held = held.groupBy("month").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("power_kw").alias("power"), F.sum("ws").alias("ws"),
        F.sum("status").alias("status_sum"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    return out(held.join(by_rows, "month"), 3)


def tables_written(s, d):
    """Result tables written, and one of them read back."""
    run, path = a(s, d), _fresh(s, "tables")
    sinks.write_tables({"availability": run.per_turbine, "fits": run.fits}, path)
    return out(s.read.schema(run.per_turbine.schema).parquet(f"{path}/availability"))


def reference_export(s, d):
    """A reference series written and read by its header."""
    path = _fresh(s, "reference")
    sinks.write_reference(tb.reference_daily(s, d), path)
    return out(auxiliary.read_reference_daily(s, path), 6)


def input_extent(s, d):
    return out(files.input_extent(tb.scada(s, d)))


def time_window_filter(s, d):
    ev = tb.table(s, d, "events").withColumnRenamed("ts", "timestamp")
    span = files.time_window(ev, "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return out(span.groupBy(F.to_date("timestamp").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")))


def warranted_curve(s, d):
    """A curve table taken from the records: highest power per 0.5 m/s."""
    bins = tb.resampled(s, d).groupBy(
        (F.floor(F.col("ws") * 2) / 2).alias("Wind Speed (m/s)")).agg(F.max("power_kw").alias("Power (kW)"))
    raw = bins.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in bins.columns])
    return out(auxiliary.warranted_curve(raw), 6)


def generic_curve(s, d):
    n = tb.resampled(s, d).groupBy((F.floor(F.col("ws") * 2) / 2).alias("bin_center")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("power_kw").alias("observed_kw"))
    return out(n.join(F.broadcast(curve.generic_curve(s, P)), "bin_center"), 6)


def layout_scan(s, d):
    raw = tb.layout(s, d).select(F.concat(F.lit(" "), "turbine").alias("WTG"),
                                 F.col("x").cast("string").alias("Easting"),
                                 F.col("y").cast("string").alias("Northing"))
    return out(auxiliary.layout(raw))


def reference_daily(s, d):
    o = tb.table(s, d, "orders")
    raw = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
                   (2.0 + F.col("o_totalprice") / 50021.7).cast("string").alias("ws_mps"),
                   (F.col("o_custkey") % 720).cast("string").alias("dir_deg"))
    return out(auxiliary.reference_daily(raw), 6)


# ---- standardisation -------------------------------------------------------------------------


def wide_to_long(s, d):
    rows = tb.resampled(s, d)
    wide = rows.groupBy(timestamp_of().cast("string").alias("Timestamp")).agg(
        *[F.max(F.when(F.col("turbine") == f"T{i:02d}", F.col(c))).alias(f"T{i:02d} {label}")
          for i in range(1, 13)
          for c, label in (("power_kw", "Active Power (kW)"), ("ws", "Wind Speed (m/s)"))])
    df = standardise(wide, plan_columns(wide.columns)).filter("ws is not null")
    return out(df.select("turbine", "timestamp", "power_kw", "ws"), 6)


def coerce_decimal_comma(s, d):
    text = F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(","))
    plain = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_tax").cast("string"))
    raw = tb.table(s, d, "lineitem").select("l_orderkey", text.alias("comma"), plain.alias("plain"))
    decided = with_scalars(raw, raw.agg(comma_decision(F.col("comma")).alias("c1"),
                                        comma_decision(F.col("plain")).alias("c2")))
    vals = decided.select("l_orderkey", number(F.col("comma"), F.col("c1")).alias("v1"),
                          number(F.col("plain"), F.col("c2")).alias("v2"))
    return out(vals.groupBy((F.col("l_orderkey") % 100).alias("k")).agg(
        F.sum("v1").alias("price"), F.sum("v2").alias("tax"), F.count("v2").alias("n_tax")), 3)


def parse_dayfirst(s, d):
    # moved to the middle of the month, where only one reading of a date is possible
    raw = _export(s, d, Date="date_format(timestamp + interval 14 days, 'dd.MM.yyyy')", Time="date_format(timestamp, 'HH:mm')",
                  WEC="turbine", P_avg="power_kw", V_avg="ws")
    df = standardise(raw, plan_columns(raw.columns))
    return out(df.groupBy("turbine", F.to_date("timestamp").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_ts"), F.sum("power_kw").alias("power")))


def status_text_map(s, d):
    word = F.expr("case status when 100 then ' Running ' when 200 then 'FAULT' when 300 then '维护'"
                  " when 400 then 'Grid_Loss' when 500 then '限电' when 600 then"
                  " (case when temp_c > 20 then '600' else 'unheard of' end) end")
    df = tb.scada(s, d).select(word.alias("word"), status_code(word).alias("code"))
    return out(df.groupBy("word", "code").agg(F.count(F.lit(1)).alias("n")))


def unit_scale(s, d):
    raw = tb.scada(s, d).select(F.col("timestamp").alias("Timestamp"), F.col("turbine").alias("WTG"),
                                (F.col("power_kw") / 1000.0).alias("Active Power (MW)"),
                                (F.col("ws") * 3.6).alias("Wind Speed (km/h)"))
    df = standardise(raw, plan_columns(raw.columns))
    return out(df.groupBy("turbine").agg(F.sum("power_kw").alias("power"), F.avg("ws").alias("ws")))


def mw_autodetect(s, d):
    raw = tb.scada(s, d).select(F.col("timestamp").alias("Timestamp"), F.col("turbine").alias("WTG"),
                                (F.col("power_kw") / 1000.0).alias("Active Power"),
                                F.col("ws").alias("Wind Speed"))
    df = standardise(raw, plan_columns(raw.columns))
    return out(df.groupBy("turbine").agg(F.sum("power_kw").alias("power"), F.max("power_kw").alias("top")))


def clean_ranges(s, d):
    raw = tb.scada(s, d).select(
        F.col("timestamp").alias("Timestamp"), F.col("turbine").alias("WTG"),
        (F.col("power_kw") - 500.0).alias("Power"), (F.col("ws") * 7.0 - 12.0).alias("Wind Speed"),
        (F.col("dir_deg") - 400.0).alias("Nacelle Position"),
        (F.col("status") - 500).alias("Power Limit"))
    df = standardise(raw, plan_columns(raw.columns, "vestas"))
    return out(df.groupBy("turbine", "curt_flag").agg(
        F.count(F.lit(1)).alias("n"), F.min("power_kw").alias("p_min"), F.min("ws").alias("ws_min"),
        F.max("ws").alias("ws_max"), F.sum("dir_deg").alias("dir_sum"), F.sum("ws").alias("ws_sum")))


# ---- time series -----------------------------------------------------------------------------


def resample_10min(s, d):
    return out(tb.resampled(s, d).drop("curt_flag"), 6)


def sampling_interval(s, d):
    return out(ts.sampling_interval(tb.resampled(s, d)), 6)


def dedup_last_wins(s, d):
    ev = tb.table(s, d, "events").select(
        F.concat(F.lit("T"), (F.col("user_id") % 12).cast("string")).alias("turbine"),
        slot_of("ts").alias("slot"), F.col("event_id").alias("ordinal"), "value")
    return out(ts.dedup_last_wins(ev, ("turbine", "slot")))


def time_spine(s, d):
    return out(ts.time_spine(tb.resampled(s, d)))


def gap_fill_linear(s, d):
    return out(ts.gap_fill(tb.blocks(s, d)).select("turbine", "slot", "ws", "temp_c", "power_kw", "gap_filled"), 6)


def gap_fill_circular(s, d):
    df = ts.gap_fill(tb.blocks(s, d)).filter("gap_filled = 1")
    return out(df.select("turbine", "slot", "dir_deg", "wind_dir_deg"))


def gap_stats(s, d):
    return out(ts.gap_stats(flagged(s, d)))


def _tiered(s, d):
    """All records with their own gaps; every 31st slot has no power, so that the curve's estimate occurs."""
    rows = tb.resampled(s, d).withColumn("power_kw", F.when(F.col("slot") % 31 != 0, F.col("power_kw")))
    return ts.gap_fill_tiered(rows, tb.grid(s))


def gap_fill_tiered(s, d):
    return out(_tiered(s, d).select("turbine", "slot", "ws", "power_kw", "filled", "fill_method"), 6)


def gap_fill_summary(s, d):
    return out(ts.gap_fill_summary(_tiered(s, d)))


def wind_shear(s, d):
    return out(tb.reference_daily(s, d).select("d", num.shear(F.col("ws"), 100.0, 50.0).alias("ws_hub")), 6)


def daily_mean(s, d):
    ev = tb.table(s, d, "events").select(F.col("ts").alias("timestamp"), "value")
    return out(ts.daily_mean(ev, "value"))


def air_density(s, d):
    return out(tb.resampled(s, d).groupBy("temp_c").agg(F.count(F.lit(1)).alias("n")).select(
        F.round("temp_c", 6).alias("temp_c"), "n", num.air_density_ratio(F.col("temp_c"), 99.2).alias("ratio")), 8)


def density_correct_ws(s, d):
    rho = num.site_density_ratio(500.0, F.col("temp_c"))
    return out(tb.reference_daily(s, d).select("d", num.density_correct(F.col("ws"), rho).alias("ws_n")), 6)


# ---- curve -----------------------------------------------------------------------------------


def curve_grid(s, d):
    n = tb.resampled(s, d).groupBy(F.floor(F.col("ws") * 10).cast("int").alias("cell")).agg(
        F.count(F.lit(1)).alias("n"))
    return out(tb.grid(s).join(n, "cell", "left").na.fill(0, ["n"]).select("cell", "p0", "p1", "n"), 6)


def expected_power(s, d):
    return out(curve.power_at(tb.resampled(s, d).select("turbine", "slot", "ws"), tb.grid(s), "ws", "p"))


def ct_lookup(s, d):
    bins = tb.resampled(s, d).groupBy((F.floor(F.col("ws") * 5) / 5 + 0.05).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return out(bins.select("v", "n", lay.thrust(F.col("v")).alias("ct")), 6)


def energy_from_series(s, d):
    return out(curve.energy_from_series(tb.resampled(s, d), tb.grid(s), P.interval_h))


def expected_energy(s, d):
    return out(flagged(s, d).filter("recorded = 1").groupBy("turbine").agg(
        F.avg("density_ratio").alias("density"), F.sum("expected_power_kw").alias("power_sum"),
        (F.sum("expected_energy_kwh") / 1000.0).alias("expected_mwh")))


# ---- flags -----------------------------------------------------------------------------------


def qc_flags(s, d):
    df = flags.flag_records(tb.blocks(s, d), tb.grid(s), P, fill=False)
    return out(df.select("turbine", "slot", "flag", "flag_reason"))


def qc_status_map(s, d):
    return out(flagged(s, d).filter("recorded = 1").groupBy("status", "flag").agg(F.count(F.lit(1)).alias("n")))


def _nostatus(s, d):
    return tb.landed(s, ("nostatus", d), lambda: flags.flag_records(
        flags.record_blocks(tb.scada_nostatus(s, d), P, "nostatus"), tb.grid(s), P))


def qc_sustained_low(s, d):
    df = _nostatus(s, d).filter(F.col("flag_reason") == flags.R_LOW)
    return out(df.select("turbine", "slot", "flag"))


def qc_curtail_derate(s, d):
    df = _nostatus(s, d).filter(F.col("flag_reason").isin(flags.R_CURT, flags.R_DERATED))
    return out(df.select("turbine", "slot", "flag", "flag_reason"))


def qc_curtail_flag(s, d):
    """Records without status codes that carry a curtailment flag on every fourth day."""
    marked = F.expr("cast(datediff(to_date(timestamp), date'1996-01-01') % 4 = 1 and hour(timestamp) between 8 and 15 as int)")
    df = tb.landed(s, ("curtailed", d), lambda: flags.flag_records(flags.record_blocks(
        tb.scada_nostatus(s, d).withColumn("curt_flag", marked), P, "curtailed"), tb.grid(s), P))
    df = df.filter(F.col("flag_reason").isin(flags.R_CURT_FLAG, flags.R_CURT, flags.R_DERATED))
    return out(df.select("turbine", "slot", "flag", "flag_reason"))


def qc_environment(s, d):
    df = _nostatus(s, d).filter(F.col("flag_reason").isin(flags.R_HOT, flags.R_ICE))
    return out(df.select("turbine", "slot", "flag_reason"))


def _frozen(s, d):
    return tb.landed(s, ("frozen", d), lambda: flags.flag_records(
        flags.record_blocks(tb.scada_frozen(s, d), P, "frozen"), tb.grid(s), P))


def qc_frozen_anemometer(s, d):
    return out(_frozen(s, d).filter("recorded = 1").groupBy("turbine", "flag").agg(
        F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot"), F.sum("slot").alias("slot_sum")))


def impute_anemometer(s, d):
    return out(_frozen(s, d).filter("flag = 7").select("turbine", "slot", "expected_power_kw", "expected_energy_kwh"))


def bad_anemometers(s, d):
    return out(wake.bad_anemometers(energy.energy_base(_frozen(s, d))), 6)


def flag_summary(s, d):
    return out(flags.flag_summary(flagged(s, d)))


def coverage(s, d):
    return out(flags.coverage(flagged(s, d)))


def qc_warnings(s, d):
    """Warnings for the records with all power lost but on every fifth day."""
    df = flagged(s, d).withColumn("flag", F.when(F.expr("slot div 144 % 5 = 0"), F.col("flag")).otherwise(2))
    return out(flags.qc_warnings(df))


# ---- energy ----------------------------------------------------------------------------------


def energy_accounting(s, d):
    return out(a(s, d).account)


def downtime_split(s, d):
    return out(energy.downtime_split(a(s, d).base, P))


def availability_turbine(s, d):
    return out(energy.availability_turbine(energy.energy_base(tb.counted(s, d).counted), P))


def availability_farm(s, d):
    return out(energy.availability_farm(a(s, d).per_turbine))


def availability_monthly(s, d):
    return out(energy.availability_monthly(a(s, d).base, P))


def downtime_monthly(s, d):
    return out(energy.downtime_monthly(a(s, d).base, P))


def downtime_pivot(s, d):
    return out(energy.downtime_pivot(energy.downtime_monthly(a(s, d).base, P)))


def performance_monthly(s, d):
    return out(energy.performance_monthly(a(s, d).base), 6)


def yearly_production(s, d):
    return out(energy.yearly_production(a(s, d).base, P))


def loss_matrix(s, d):
    return out(energy.loss_matrix(a(s, d).base, a(s, d).wake_turbine))


def energy_balance(s, d):
    return out(energy.energy_balance(a(s, d).account))


def loss_calculation(s, d):
    row = with_scalars(a(s, d).account, a(s, d).wake_loss.select("wake_energy_mwh"))
    return out(energy.loss_calculation(row))


def performance_energy(s, d):
    row = with_scalars(a(s, d).account, a(s, d).wake_loss.select("wake_energy_mwh"))
    return out(energy.performance_energy(row))


def daily_gross(s, d):
    return out(energy.daily_gross(flagged(s, d)))


def monthly_gross(s, d):
    return out(energy.monthly_gross(a(s, d).daily_energy, 30.0, 20, ("1996-02", "1997-07")))


def worst_turbines(s, d):
    return out(energy.worst_turbines(a(s, d).per_turbine))


def worst_deviation(s, d):
    dev = pc.curve_deviation(a(s, d).curve_base, a(s, d).nodes, P)
    return out(energy.worst_turbines(dev, by="deviation_pct"))


# ---- power curve -----------------------------------------------------------------------------


def power_curve_farm(s, d):
    return out(pc.power_curve_farm(a(s, d).curve_base, P))


def power_curve_turbine(s, d):
    return out(pc.power_curve_turbine(a(s, d).curve_base, P))


def curve_deviation(s, d):
    return out(pc.curve_deviation(a(s, d).curve_base, a(s, d).nodes, P), 6)


def curve_delta(s, d):
    return out(pc.curve_delta(a(s, d).curve_base, a(s, d).nodes, P))


# ---- resource --------------------------------------------------------------------------------


def wind_rose(s, d):
    return out(resource.wind_rose(flagged(s, d)))


def rose_freq(s, d):
    return out(resource.rose_freq(resource.wind_rose(flagged(s, d))), 8)


def wind_rose_classes(s, d):
    return out(resource.wind_rose_classes(flagged(s, d)), 6)


def wind_summary(s, d):
    return out(resource.wind_summary(flagged(s, d)), 6)


def wind_monthly(s, d):
    return out(resource.wind_monthly(flagged(s, d)), 6)


def wind_diurnal(s, d):
    return out(resource.wind_diurnal(flagged(s, d)), 6)


def wind_histogram(s, d):
    return out(resource.wind_histogram(flagged(s, d)))


def daily_histogram(s, d):
    return out(resource.density_histogram(tb.site_daily(s, d).select("ws"), "ws", 40), 6)


def pp_sample(s, d):
    return out(resource.pp_sample(flagged(s, d)))


def pp_density(s, d):
    return out(resource.pp_density(flagged(s, d)), 6)


def weibull_fit(s, d):
    fit = resource.weibull_fit(resource.wind_moments(flagged(s, d), ("turbine",)))
    return out(fit, 5)


def weibull_pdf(s, d):
    return out(resource.weibull_density(flagged(s, d)), 6)


# ---- wake ------------------------------------------------------------------------------------


def wake_sector(s, d):
    return out(wake.wake_sector(a(s, d).wake_rows))


def wake_reference_set(s, d):
    return out(a(s, d).reference_set, 6)


def wake_free_stream(s, d):
    return out(wake.free_stream(a(s, d).wake_rows, a(s, d).reference_set), 6)


def wake_deficit(s, d):
    return out(a(s, d).deficits.select("turbine", "slot", "ws_free", "deficit", "wake_power_loss_kw"))


def wake_sector_table(s, d):
    return out(wake.wake_sector_table(a(s, d).wake_base), 8)


def wake_turbine_table(s, d):
    return out(a(s, d).wake_turbine, 6)


def wake_loss(s, d):
    return out(a(s, d).wake_loss)


def wake_layout_pairs(s, d):
    return out(a(s, d).layout_deficits.select("dir_deg", "ws_bin", "turbine", "deficit"), 8)


def wake_layout_turbine(s, d):
    return out(lay.layout_turbine(a(s, d).layout_energy), 6)


def wake_layout_sector(s, d):
    return out(lay.layout_sector(a(s, d).layout_energy).drop("freq"), 6)


def wake_layout_farm(s, d):
    return out(lay.layout_farm(a(s, d).layout_energy), 6)


# ---- long term -------------------------------------------------------------------------------


def site_daily(s, d):
    return out(lt.site_daily(flagged(s, d)), 6)


def mcp_pairs(s, d):
    return out(a(s, d).pairs, 6)


def mcp_fit(s, d):
    return out(a(s, d).fits, 8)


def mcp_predict(s, d):
    x = a(s, d)
    return out(lt.mcp_predict(x.reference, x.fits), 6)


def mcp_r2(s, d):
    return out(a(s, d).mcp_quality, 10)


def mcp_pooled_fit(s, d):
    return out(lt.mcp_pooled_fit(a(s, d).pairs), 8)


def lt_series(s, d):
    return out(a(s, d).lt_daily, 6)


def lt_rolling(s, d):
    return out(lt.lt_rolling(a(s, d).lt_daily.select("d", "ws")), 6)


def record_metrics(s, d):
    return out(a(s, d).metrics, 6)


def weibull_lt(s, d):
    return out(a(s, d).weibull.select("weibull_a", "weibull_k", "lt_a", "lt_k"), 5)


def aep_weibull(s, d):
    """Annual energy per turbine from the turbine's own Weibull fit."""
    fit = resource.weibull_fit(resource.wind_moments(flagged(s, d), ("turbine",)))
    return out(lt.aep_weibull(fit, a(s, d).grid, "weibull_a", "weibull_k", ("turbine",)), 3)


def fit_cubic(s, d):
    x = a(s, d)
    return out(lt.cubic_fit(x.daily_energy, x.site_daily), 8)


def fit_linear(s, d):
    x = a(s, d)
    j = x.daily_energy.join(x.site_daily, "d")
    return out(lt.linear_fit(j, "e_mwh", "ws", (), 6), 6)


def lt_daily_energy(s, d):
    return out(a(s, d).daily_method, 5)


def lt_monthly_energy(s, d):
    return out(a(s, d).monthly_method, 5)


def lt_normalised_month(s, d):
    return out(a(s, d).normalised_month, 5)


def lt_method_choice(s, d):
    c = a(s, d).choice
    return out(c.select("method_a_mwh", "daily_mwh", "monthly_mwh", "record_months", "primary_method",
                        "method_b_mwh"), 2)


def gross_aep(s, d):
    return out(a(s, d).gross.select("gross_lt_mwh", "lt_method", "lt_a", "lt_k", "n_turbines"), 3)


def sigma_wind(s, d):
    return out(a(s, d).sigma.select("sigma_wind_pct"), 6)


# ---- yaw -------------------------------------------------------------------------------------


def yaw_rows(s, d):
    return out(a(s, d).yaw_rows.select("turbine", "slot", "yaw_err", "pr"), 6)


def yaw_fit(s, d):
    return out(yaw.yaw_fit(a(s, d).yaw_rows), 7)


def yaw_screening(s, d):
    return out(yaw.yaw_screening(yaw.yaw_fit(a(s, d).yaw_rows)), 5)


def yaw_bins(s, d):
    return out(yaw.yaw_bins(a(s, d).yaw_rows), 6)


# ---- yield -----------------------------------------------------------------------------------


def loss_tree(s, d):
    return out(a(s, d).tree)


def loss_reconciliation(s, d):
    return out(yc.loss_reconciliation(a(s, d).net))


def loss_waterfall(s, d):
    return out(yc.loss_waterfall(a(s, d).tree, a(s, d).net), 2)


def future_losses(s, d):
    return out(yc.future_losses(a(s, d).net, tb.FUTURE), 2)


def uncertainty_components(s, d):
    return out(a(s, d).components, 6)


def p_values(s, d):
    return out(yc.p_values(a(s, d).net_sigma), 2)


def p_values_draws(s, d):
    """Exceedance values per turbine, from each turbine's produced energy; exact where draws would scatter."""
    x = a(s, d)
    return out(yc.yield_quantiles(x.per_turbine, x.components, ("turbine",), "energy_mwh"), 3)


def yield_histogram(s, d):
    """Density of all turbines' energies in 80 bins."""
    x = a(s, d)
    return out(yc.yield_density(x.per_turbine, x.components, "energy_mwh"), 6)


def benchmark(s, d):
    return out(yc.benchmark(a(s, d).net_sigma, P), 3)


def sensitivity(s, d):
    return out(yc.sensitivity(a(s, d).net, a(s, d).grid, P), 2)


def findings(s, d):
    return out(yc.findings(a(s, d).kpis))


def kpi_summary(s, d):
    return out(yc.kpi_summary(a(s, d).kpis, P), 3)


SOURCES = (scan_scada, scan_column_map, multi_file_union, file_profile, file_overlap,
           file_overlap_groups, file_overlaps_of, months_rewritten,
           scan_export_files, split_months, tables_written, reference_export, input_extent, time_window_filter, warranted_curve, generic_curve, layout_scan, reference_daily,
           wide_to_long, coerce_decimal_comma, parse_dayfirst, status_text_map, unit_scale,
           mw_autodetect, clean_ranges)
SERIES = (resample_10min, sampling_interval, dedup_last_wins, time_spine, gap_fill_linear,
          gap_fill_circular, gap_stats, gap_fill_tiered, gap_fill_summary, wind_shear, daily_mean,
          air_density, density_correct_ws, curve_grid, expected_power, ct_lookup, energy_from_series,
          expected_energy)
FLAGS = (qc_flags, qc_status_map, qc_sustained_low, qc_curtail_derate, qc_curtail_flag, qc_environment,
         qc_frozen_anemometer, impute_anemometer, bad_anemometers, flag_summary, coverage, qc_warnings)
ENERGY = (energy_accounting, downtime_split, availability_turbine, availability_farm,
          availability_monthly, downtime_monthly, downtime_pivot, performance_monthly,
          yearly_production, loss_matrix, energy_balance, loss_calculation, performance_energy,
          daily_gross, monthly_gross, worst_turbines, worst_deviation, power_curve_farm, power_curve_turbine,
          curve_deviation, curve_delta)
RESOURCE = (wind_rose, rose_freq, wind_rose_classes, wind_summary, wind_monthly, wind_diurnal,
            wind_histogram, daily_histogram, pp_sample, pp_density, weibull_fit, weibull_pdf)
WAKE = (wake_sector, wake_reference_set, wake_free_stream, wake_deficit, wake_sector_table,
        wake_turbine_table, wake_loss, wake_layout_pairs, wake_layout_turbine, wake_layout_sector,
        wake_layout_farm)
LONG_TERM = (site_daily, mcp_pairs, mcp_fit, mcp_predict, mcp_r2, mcp_pooled_fit, lt_series, lt_rolling,
             record_metrics, weibull_lt, aep_weibull, fit_cubic, fit_linear, lt_daily_energy,
             lt_monthly_energy, lt_normalised_month, lt_method_choice, gross_aep, sigma_wind)
YIELD = (yaw_rows, yaw_fit, yaw_screening, yaw_bins, loss_tree, loss_reconciliation, loss_waterfall,
         future_losses, uncertainty_components, p_values, p_values_draws, yield_histogram, benchmark,
         sensitivity, findings, kpi_summary)

QUERIES = {f.__name__: f for group in (SOURCES, SERIES, FLAGS, ENERGY, RESOURCE, WAKE, LONG_TERM, YIELD)
           for f in group}
