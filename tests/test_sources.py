"""Vendor layouts, text quirks and several files."""

import datetime as dt
import gzip
import random

import pytest

from windrow.operators.timeseries import resample_10min
from windrow.sources import load_many, load_scada
from windrow.sources.auxiliary import read_layout, read_reference_daily, read_warranted_curve
from windrow.sources.columns import detect_profile, normalise, plan_columns
from windrow.sources.files import file_overlap, file_profile, merge_files

T0 = dt.datetime(2024, 1, 1)
WORDS = {100: "Running", 200: "Fault", 300: "Maintenance", 400: "Grid", 500: "Curtailment", 600: "Icing"}
CN = {100: "运行", 200: "故障", 300: "维护", 400: "停机", 500: "限电", 600: "结冰"}


def base(turbines=3, slots=60):
    rnd = random.Random(7)
    return [dict(t=T0 + dt.timedelta(days=12 * (i % 2), minutes=10 * i), id=f"T{k + 1:02d}", p=round(rnd.uniform(50, 2400), 2),
                 w=round(rnd.uniform(3, 14), 2), d=round(rnd.uniform(0, 359), 1), c=round(rnd.uniform(-3, 30), 1),
                 s=rnd.choice(list(WORDS))) for k in range(turbines) for i in range(slots)]


def write(tmp_path, name, header, rows, sep=",", lead=()):
    text = "\n".join([*lead, sep.join(header), *[sep.join(map(str, r)) for r in rows]]) + "\n"
    path = tmp_path / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def de(x):
    return str(x).replace(".", ",")


LAYOUTS = {
    "vestas": (["Timestamp", "Turbine Name", "Active Power (kW)", "Wind Speed (m/s)", "Nacelle Position (deg)",
                "Ambient Temperature (degC)", "Turbine State Code"],
               lambda r: [r["t"], r["id"], r["p"], r["w"], r["d"], r["c"], WORDS[r["s"]]], ",", "vestas"),
    "sgre": (["Timestamp", "WTG Name", "ActivePower(kW)", "WindSpeed(m/s)", "NacellePosition(deg)",
              "AmbientTemp(degC)", "TurbineState"],
             lambda r: [r["t"], r["id"], r["p"], r["w"], r["d"], r["c"], r["s"]], ",", None),
    "suzlon": (["Date Time", "WTG No", "Gen Active Power (kW)", "Wind Speed (m/s)", "Nacelle Direction (deg)",
                "Turbine Status"],
               lambda r: [r["t"].strftime("%d/%m/%Y %H:%M"), r["id"], r["p"], r["w"], r["d"], WORDS[r["s"]]], ",", None),
    "envision": (["Date", "Device Name", "Active Power (kW)", "Wind Speed (m/s)", "Wind Direction (deg)", "Status Code"],
                 lambda r: [r["t"].strftime("%d.%m.%Y %H:%M:%S"), r["id"], de(r["p"]), de(r["w"]), de(r["d"]), r["s"]],
                 ";", "envision"),
    "nordex": (["Date", "Time", "WEC", "P-avg (kW)", "V-avg (m/s)", "D-avg (deg)", "T-avg (degC)", "Status"],
               lambda r: [r["t"].date(), r["t"].time(), r["id"], r["p"], r["w"], r["d"], r["c"], r["s"]], "\t", "nordex"),
    "goldwind": (["时间", "机组号", "有功功率(kW)", "风速(m/s)", "机舱位置(°)", "环境温度(℃)", "机组状态"],
                 lambda r: [r["t"], r["id"], r["p"], r["w"], r["d"], r["c"], CN[r["s"]]], ",", "goldwind"),
    "inox": (["Date Time", "Turbine ID", "Active Power (MW)", "Wind Speed (m/s)", "Nacelle Direction (deg)",
              "Turbine Status"],
             lambda r: [r["t"], r["id"], r["p"] / 1000, r["w"], r["d"], r["s"]], "|", None),
    "truncated": (["PCTimeSt", "AssetNam", "Amb_Tems", "Amb_Wind", "Grd_Prod_", "Nac_Direc", "Nac_Temp", "Sys_Stats_"],
                  lambda r: [r["t"], r["id"], r["c"], r["w"], r["p"], r["d"], 40, r["s"]], ",", "envision"),
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_vendor_layout(spark, tmp_path, name):
    header, row, sep, profile = LAYOUTS[name]
    data = base()
    df, used = load_scada(spark, write(tmp_path, f"{name}.csv", header, [row(r) for r in data], sep))
    got = {(r["turbine"], r["timestamp"]): r for r in df.collect()}
    assert profile in (None, used) and len(got) == len(data)
    for r in data:
        g = got[r["id"], r["t"]]
        assert abs(g["power_kw"] - r["p"]) < 1e-6 and abs(g["ws"] - r["w"]) < 1e-9 and abs(g["dir_deg"] - r["d"]) < 1e-9
        want = r["s"] if name != "goldwind" or r["s"] != 400 else 300
        assert g["status"] == want
        if any("emp" in h.lower() or "T-avg" in h or "温度" in h for h in header):
            assert g["temp_c"] == r["c"]


def test_preamble_and_gzip(spark, tmp_path):
    header, row, sep, _ = LAYOUTS["vestas"]
    data = base()
    for name in ("lead.csv", "lead.csv.gz"):
        path = write(tmp_path, name, header, [row(r) for r in data], sep,
                     ("Wind farm: Demo", "Export time: 2025-01-01 00:00", "Created by test"))
        assert load_scada(spark, path)[0].count() == len(data)


def test_wide_with_junk_columns(spark, tmp_path):
    data = base(2, 40)
    by = {(r["id"], r["t"]): r for r in data}
    times = sorted({r["t"] for r in data})
    header = ["Timestamp"] + [f"{t} {x}" for t in ("T01", "T02") for x in
                              ("Active Power (kW)", "Wind Speed (m/s)", "Nacelle Direction (deg)")]
    header += [f"Counter_{i:03d}" for i in range(100)]
    rows = [[t] + [by[i, t][k] for i in ("T01", "T02") for k in "pwd"] + [1] * 100 for t in times]
    df, _ = load_scada(spark, write(tmp_path, "wide.csv", header, rows))
    got = df.collect()
    assert {r["turbine"] for r in got} == {"t01", "t02"} and len(got) == len(data)
    assert abs(sum(r["power_kw"] for r in got) - sum(r["p"] for r in data)) < 1e-6


def test_parquet_map_and_missing_power(spark, tmp_path):
    rows = [(r["t"], r["id"], r["p"], r["w"]) for r in base()]
    path = str(tmp_path / "x.parquet")
    spark.createDataFrame(rows, "a timestamp_ntz, b string, c double, d double").write.parquet(path)
    df, _ = load_scada(spark, path, column_map={"timestamp": "a", "turbine": "b", "power": "c", "ws": "d"})
    assert df.count() == len(rows)
    p = write(tmp_path, "bad.csv", ["Timestamp", "WTG", "Wind Speed"], [["2024-01-01 00:00:00", "T1", 5]])
    with pytest.raises(ValueError, match="Wind Speed"):
        load_scada(spark, p)


def test_single_letter_power_and_names(spark, tmp_path):
    p = write(tmp_path, "p.csv", ["timestamp", "turbine", "P", "ws"], [["2024-01-01 00:00:00", "T1", 500, 5]])
    assert load_scada(spark, p)[0].first()["power_kw"] == 500.0
    assert normalise(" Active  Power (kW) [avg]") == "activepower"
    assert detect_profile(["foo", "bar"]) == "generic"
    assert plan_columns(["Zeit timestamp", "WTG", "Power", "ws", "TurbineState"]).fields["status"] == "TurbineState"


def test_nacelle_before_ambient_direction():
    shared = ["Timestamp", "WTG", "Power", "Wind Speed"]
    found = plan_columns([*shared, "Wind Direction", "Nacelle Position"], "generic").fields
    assert (found["dir"], found["wind_dir"]) == ("Nacelle Position", "Wind Direction")
    found = plan_columns([*shared, "WindDir", "Nacelle"], "nordex").fields
    assert (found["dir"], found["wind_dir"]) == ("Nacelle", "WindDir")


def test_several_files_later_wins(spark, tmp_path):
    h = ["Timestamp", "WTG", "Active Power (kW)", "Wind Speed (m/s)"]
    stamps = [(T0 + dt.timedelta(minutes=10 * i)) for i in range(30)]
    a = write(tmp_path, "a.csv", h, [[t, "T1", 500 + i, 6] for i, t in enumerate(stamps[:20])])
    b = write(tmp_path, "b.csv", h, [[t, "T1", 900 + i, 7] for i, t in enumerate(stamps[10:])])
    df = load_many(spark, [a, b])
    merged = {r["slot"]: r for r in merge_files(df).collect()}
    assert len(merged) == 30
    assert sum(r["ws"] == 7 for r in merged.values()) == 20
    prof = file_profile(df)
    assert {(r["file"].rsplit("/", 1)[-1], r["rows"]) for r in prof.collect()} == {("a.csv", 20), ("b.csv", 20)}
    o = file_overlap(prof).collect()
    assert len(o) == 1 and o[0]["overlap_start"] == stamps[10] and o[0]["overlap_end"] == stamps[19]


HEADER = ["Timestamp", "WTG", "Active Power (kW)", "Wind Speed (m/s)"]


def test_files_are_known_by_their_paths(spark, tmp_path):
    for folder, n in (("a", 1), ("b c", 2)):
        (tmp_path / folder).mkdir()
        write(tmp_path, f"{folder}/my file[1].csv", HEADER, [[T0 + dt.timedelta(hours=i), "T1", 500, 6] for i in range(n)])
    paths = [str(tmp_path / x / "my file[1].csv") for x in ("b c", "a")]
    df = load_many(spark, paths)
    assert sorted((r["ordinal"], r["file"].endswith(paths[r["ordinal"]])) for r in df.collect()) == [(0, True), (0, True), (1, True)]
    assert load_many(spark, [str(tmp_path)]).count() == 3  # a folder
    assert load_many(spark, [str(tmp_path / "*" / "*.csv")]).count() == 3


def test_column_orders_and_long_preambles(spark, tmp_path):
    a = write(tmp_path, "a.csv", HEADER, [[T0, "T1", 500, 6]], ",", [f"remark {i}" for i in range(100)])
    b = write(tmp_path, "b.csv", HEADER[::-1], [[7, 900, "T2", T0]], ";")
    got = {r["turbine"]: (r["power_kw"], r["ws"]) for r in load_many(spark, [a, b]).collect()}
    assert got == {"T1": (500.0, 6.0), "T2": (900.0, 7.0)}
    c = tmp_path / "c.csv"
    c.write_text("1;2;3\n")
    with pytest.raises(ValueError, match="c.csv"):
        load_many(spark, [a, str(c)])
    with pytest.raises(FileNotFoundError):
        load_many(spark, [a, str(tmp_path / "none.csv")])


def test_one_decision_for_files_of_one_header(spark, tmp_path):
    a = write(tmp_path, "d05.csv", HEADER, [["05.01.2024 00:00", "T1", 40, 4], ["05.01.2024 00:10", "T1", 60, 4]])
    b = write(tmp_path, "d25.csv", HEADER, [["25.01.2024 00:00", "T1", 1800, 11]])
    got = sorted((r["timestamp"], r["power_kw"]) for r in load_many(spark, [a, b]).collect())
    assert got == [(dt.datetime(2024, 1, 5), 40.0), (dt.datetime(2024, 1, 5, 0, 10), 60.0), (dt.datetime(2024, 1, 25), 1800.0)]


def test_parquet_folder_without_suffix(spark, tmp_path):
    rows = [(r["t"], r["id"], r["p"], r["w"]) for r in base()]
    path = str(tmp_path / "x")
    spark.createDataFrame(rows, "timestamp timestamp_ntz, wtg string, power double, ws double").write.parquet(path)
    assert load_scada(spark, path)[0].count() == len(rows)


def test_auxiliary_tables(spark, tmp_path):
    c = write(tmp_path, "curve.csv", ["wind_speed_mps", "power_kw"], [[0, 0], [5, 300], ["x", 1]])
    assert read_warranted_curve(spark, c).count() == 2
    lay = write(tmp_path, "lay.csv", ["WTG", "Easting", "Northing"], [["A", 0, 0], ["B", 500, 1]])
    assert {r["turbine"] for r in read_layout(spark, lay).collect()} == {"A", "B"}
    r = write(tmp_path, "ref.csv", ["date", "ws_mps", "dir_deg"], [["2020-01-01", 7, 370], ["2020-01-01", 8, 20], ["x", 1, 1]])
    got = read_reference_daily(spark, r).collect()
    assert len(got) == 1 and got[0]["ws"] == 7.0 and got[0]["dir"] == 10.0


def test_auxiliary_tables_with_decimal_commas(spark, tmp_path):
    c = write(tmp_path, "curve.csv", ["wind_speed_mps", "power_kw"], [["0,5", "1,25"], ["5", "300"]], ";")
    assert sorted(map(tuple, read_warranted_curve(spark, c).collect())) == [(0.5, 1.25), (5.0, 300.0)]
    lay = write(tmp_path, "lay.csv", ["WTG", "Easting", "Northing"], [["A", "0,5", "1.5"]], "\t")
    assert [(r.x, r.y) for r in read_layout(spark, lay).collect()] == [(0.5, 1.5)]
    r = write(tmp_path, "ref.csv", ["date", "ws_mps"], [["2020-01-01", "7,5"]], ";")
    assert read_reference_daily(spark, r).first()["ws"] == 7.5


def test_regular_data_resample_to_themselves(spark, tmp_path):
    header, row, sep, _ = LAYOUTS["sgre"]
    data = base()
    df, _ = load_scada(spark, write(tmp_path, "s.csv", header, [row(r) for r in data], sep))
    res = resample_10min(df)
    assert res.count() == len(data)
    assert abs(res.groupBy().sum("power_kw").first()[0] - sum(r["p"] for r in data)) < 1e-6
