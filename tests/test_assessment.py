"""The whole chain, its sinks, degenerate inputs and the streaming form."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from windrow import FarmParams
from windrow.functions.timegrid import slot_of
from windrow.operators import flags, timeseries as ts, yieldcalc as yc
from windrow.plans import testbed as tb
from windrow.plans.assessment import assess
from windrow.schema import SCADA
from windrow import sinks
from windrow.streaming.grid import resample_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def full(spark):
    p = replace(tb.PARAMS, preconstruction_p50_gwh=50.0)
    return assess(tb.scada(spark, SF), p, reference=tb.reference_daily(spark, SF), layout=tb.layout(spark, SF))


def test_every_table_of_a_run(full, tmp_path):
    tables = full.tables()
    sinks.write_tables(tables, str(tmp_path / "tables"))
    spark = full.spark
    for name in tables:
        df = spark.read.parquet(str(tmp_path / "tables" / name))
        assert df.columns == tables[name].columns
        if name != "warnings" and name != "mcp":
            assert df.count() > 0, name
    tree = {r["loss"]: r for r in tables["loss_tree"].collect()}
    net = full.net.first()
    assert abs(net["net_mwh"] - net["gross_lt_mwh"] * (1 - sum(r["pct_of_gross"] for r in tree.values()) / 100)) < 1e-6
    assert abs(full.params.interval_h - 1 / 6) < 1e-9


def test_flagged_sinks(full, tmp_path):
    spark = full.spark
    sinks.write_flagged(full.flagged, str(tmp_path / "f"), float32=True)
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == full.flagged.count() and dict(back.dtypes)["ws"] == "float"
    sinks.split_by_rows(full.flagged.select("turbine", "ws"), str(tmp_path / "r"), 500)
    files = list((tmp_path / "r").glob("*.csv"))
    assert len(files) > 1 and all(len(f.read_text().splitlines()) <= 501 for f in files)
    sinks.split_by_month(full.flagged.drop("month"), str(tmp_path / "m"))
    assert [p.name for p in (tmp_path / "m").glob("month=*")] == ["month=1996-01"]
    sinks.write_reference(full.reference, str(tmp_path / "ref"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ref")).columns == ["date", "ws_mps"]
    rec = sinks.audit_record(full.flagged, ts.gap_stats(full.flagged), flags.coverage(full.flagged), full.params, "lineitem")
    sinks.append_audit(rec, str(tmp_path / "audit"))
    sinks.append_audit(rec, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def records(spark, turbines, n, **over):
    rnd = random.Random(9)
    rows = []
    for t in range(turbines):
        for i in range(n):
            ws = 5 + 4 * rnd.random()
            row = dict(turbine=f"T{t}", power_kw=2500 * (1 - 2.718 ** -(((ws - 3) / 5.5) ** 3)), ws=ws, dir_deg=rnd.uniform(0, 359),
                       wind_dir_deg=None, temp_c=15.0, status=100 if i % 50 else 300, curt_flag=None, minutes=10 * i)
            row.update({k: v(i) if callable(v) else v for k, v in over.items()})
            rows.append(tuple(row[k] for k in ("turbine", "minutes", "power_kw", "ws", "dir_deg", "wind_dir_deg", "temp_c",
                                               "status", "curt_flag")))
    df = spark.createDataFrame(rows, "turbine string, minutes int, power_kw double, ws double, dir_deg double,"
                                     " wind_dir_deg double, temp_c double, status int, curt_flag int")
    return df.withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, minutes)")) \
        .select(*SCADA.fieldNames())


CASES = {
    "all_downtime": dict(status=lambda i: 200 + i % 2),
    "no_direction": dict(dir_deg=None),
    "zero_power": dict(power_kw=0.0, status=None),
    "no_wind": dict(ws=None),
    "unknown_status": dict(status=lambda i: 7000 + i % 3),
}


@pytest.mark.parametrize("case", [*CASES, "one_turbine", "no_temperature"])
def test_degenerate_input_runs_through(spark, case):
    p = FarmParams(air_density_correction=case != "no_temperature")
    over = CASES.get(case, dict(temp_c=None) if case == "no_temperature" else {})
    df = records(spark, 1 if case == "one_turbine" else 2, 150, **over)
    a = assess(df, p, measure_interval=False, has_direction=case != "no_direction")
    assert len(yc.kpi_summary(a.kpis, p).collect()) == 26
    assert len(yc.p_values(a.net_sigma).collect()) == 10
    assert {"turbine", "n_samples"} <= set(a.wake_turbine.columns)
    flags_seen = {r["flag"] for r in a.flagged.select("flag").distinct().collect()}
    if case in ("all_downtime", "unknown_status", "zero_power"):
        assert flags_seen <= {0, 1, 2, 3} and 2 in flags_seen
    if case == "no_wind":
        assert flags_seen == {8}
    if case == "no_temperature":
        assert a.flagged.filter("expected_power_kw > 0").count() > 0


def test_stream_gives_the_batch_slots(spark, tmp_path):
    src = records(spark, 2, 60)
    src.write.parquet(str(tmp_path / "in"))
    src.limit(20).write.mode("append").parquet(str(tmp_path / "in"))          # repeats
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = (resample_stream(stream, once=True).writeStream.format("memory").queryName("slots")
         .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {(r["turbine"], r["slot"]): r["ws"] for r in spark.table("slots").collect()}
    want = {(r["turbine"], r["slot"]): r["ws"] for r in ts.resample_10min(src).collect()}
    assert got and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    assert src.select(slot_of("timestamp").alias("s")).distinct().count() * 2 == len(want)


def test_daily_results_dont_wait_for_the_flagged_table(spark, monkeypatch):
    from windrow.plans import catalog

    def fail(*_):
        raise AssertionError("asked for the flagged table")

    tb.forget_landed()
    monkeypatch.setattr(tb, "flagged", fail)
    try:
        for name in ("lt_series", "lt_daily_energy", "lt_monthly_energy", "lt_normalised_month", "monthly_gross"):
            catalog.QUERIES[name](spark, SF).count()
    finally:
        tb.forget_landed()
