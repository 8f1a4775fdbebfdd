"""Properties of single operators on small tables."""

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from windrow import FarmParams
from windrow.functions import num
from windrow.functions.rows import hold_row
from windrow.sources import files
from windrow.operators import curve, energy, flags, layout as lay, longterm as lt, powercurve as pc, resource, yaw, yieldcalc as yc

P = FarmParams(rotor_diameter_m=126.0, rated_power_kw=3450.0)
D = P.rotor_diameter_m


def one(df):
    return df.first().asDict()


def layout_loss(spark, positions, directions, p, ws=9.0):
    lay_df = spark.createDataFrame(positions, "turbine string, x double, y double")
    rose = spark.createDataFrame([(float(d), ws, 1.0 / len(directions)) for d in directions],
                                 "dir_deg double, ws_bin double, freq double")
    grid = curve.curve_grid(curve.generic_curve(spark, p), p)
    e = lay.turbine_energy(lay.turbine_deficits(lay.directional_terms(lay_df, rose, p), rose, p), grid)
    per = {r["turbine"]: r["wake_loss_pct"] for r in lay.layout_turbine(e).collect()}
    return per, one(lay.layout_farm(e))["farm_loss_pct"]


def test_layout_direction_symmetry_spacing_turbulence(spark):
    pair = [("A", 0.0, 0.0), ("B", 0.0, 5 * D)]
    per, south = layout_loss(spark, pair, [180.0], P)
    assert per["A"] < 0.5 and per["B"] > 5             # wind from the south wakes the northern turbine
    per, _ = layout_loss(spark, pair, [180.0], replace(P, wake_bearing="toward"))
    assert per["B"] < 0.5 and per["A"] > 5             # the other reading of a direction
    _, north = layout_loss(spark, pair, [0.0], P)
    assert abs(north - south) < 1e-6
    assert layout_loss(spark, pair, [180.0], replace(P, wake_ti=0.05))[1] > layout_loss(
        spark, pair, [180.0], replace(P, wake_ti=0.20))[1]
    assert layout_loss(spark, [("A", 0.0, 0.0), ("B", 0.0, 3 * D)], [180.0], P)[1] > south
    gentle = replace(P, ct_curve=((3.0, 0.4), (25.0, 0.1)))
    assert 0 < layout_loss(spark, pair, [180.0], gentle)[1] < south


def test_layout_grid(spark):
    grid = [(f"T{i}", float(i % 4) * 5 * D, float(i // 4) * 4 * D) for i in range(12)]
    per, farm = layout_loss(spark, grid, list(range(5, 360, 10)), P)
    assert 2 < farm < 25 and len(per) == 12


def test_layout_as_pairs(spark):
    """Against the sum over all pairs, in plain Python."""
    r = random.Random(3)
    spots = [(f"T{i}", r.uniform(0, 4000), r.uniform(0, 4000)) for i in range(25)] + [("far", 1e6, 0.0)]
    bins = [(d, v, 0.01) for d in (2.5, 92.5, 200.0, 357.5) for v in (2.0, 6.0, 12.0)]
    rose = spark.createDataFrame(bins, "dir_deg double, ws_bin double, freq double")
    terms = lay.directional_terms(spark.createDataFrame(spots, "turbine string, x double, y double"), rose, P)
    got = {(x.dir_deg, x.ws_bin, x.turbine): x.deficit for x in lay.turbine_deficits(terms, rose, P).collect()}
    ct = {6.0: 0.87, 12.0: 0.53}
    want = {}
    for d, v, _ in bins:
        for t, x, y in spots if v in ct else ():
            ux, uy, total = -math.sin(math.radians(d)), -math.cos(math.radians(d)), 0.0
            for _, a, b in spots:
                along, across = (x - a) * ux + (y - b) * uy, -(x - a) * uy + (y - b) * ux
                if along > 0.5 * D:
                    sigma = (0.3837 * P.wake_ti + 0.003678) * (along - 0.5 * D) + 0.2 * D * math.sqrt(1 + 2 * P.wake_ti)
                    inner, t2 = 1 - ct[v] / (8 * (sigma / D) ** 2), (D / 2 / sigma) ** 2 / 2
                    centre = 1.0 if inner <= 0 else 1 - math.sqrt(inner)
                    total += (centre * math.exp(-(across / sigma) ** 2 / 2) * (1 - math.exp(-t2)) / t2) ** 2
            want[d, v, t] = math.sqrt(total)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_curve_of_the_farm_from_its_turbines(spark):
    r = random.Random(4)
    rows = [(r.choice("ABC"), r.choice([5.1, 5.2, 8.3, 45.0, None]), r.choice([None, 1e6 + r.random(), 1e6]), r.choice([0, 0, 2]),
             1.0, 1.0, 1.0) for _ in range(400)]
    df = spark.createDataFrame(rows, "turbine string, ws double, power_kw double, flag int, density_ratio double,"
                                     " energy_kwh double, expected_energy_kwh double")
    base = pc.curve_base(df, P)
    farm = {x.bin_center: x for x in pc.power_curve_farm(base, P).collect()}
    for centre, lo in ((5.25, 5.0), (8.25, 8.0)):
        own = [x[2] for x in rows if x[3] == 0 and x[1] is not None and lo <= x[1] < lo + 0.5 and x[2] is not None]
        mean = sum(own) / len(own)
        assert farm[centre]["count"] == len(own) and abs(farm[centre].mean_power - mean) < 1e-6
        assert abs(farm[centre].std_power - math.sqrt(sum((v - mean) ** 2 for v in own) / len(own))) < 1e-6
    assert len(farm) == 90 and pc.power_curve_turbine(base, P).count() == 3 * 90
    kept = pc.curve_deviation(base, curve.generic_curve(spark, P), P).agg(F.sum("n_operating_rows")).first()[0]
    assert kept == sum(x[3] == 0 for x in rows)


def test_normal_law(spark):
    from statistics import NormalDist
    zs = [x / 8 for x in range(-96, 97)] + [-30.0, 30.0, 700.0, -700.0]
    for x in spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", num.normal_cdf(F.col("z"))).collect():
        assert abs(x.p - NormalDist().cdf(x.z)) < 1e-14
        if -12 <= x.z < -1:
            assert abs(x.p / (math.erfc(-x.z / math.sqrt(2)) / 2) - 1) < 1e-6


def test_yield_density(spark):
    energies = spark.createDataFrame([("A", 100.0), ("B", 180.0), ("C", 0.0), ("D", None)], "turbine string, e double")
    parts = spark.createDataFrame([(3.0,), (4.0,)], "sigma_pct double")
    rows = yc.yield_density(energies, parts, "e").orderBy("bin").collect()
    assert len(rows) == 80 and abs(sum(x.density * x.width_mwh for x in rows) - 1) < 1e-4

    def law(x, e, s=0.05):
        return math.exp(-(math.log(x / e) / s) ** 2 / 2) / (x * s * math.sqrt(2 * math.pi))

    for x in rows:
        points = [x.from_mwh + x.width_mwh * (i + 0.5) / 200 for i in range(200)]
        assert abs(x.density - sum((law(v, 100.0) + law(v, 180.0)) / 2 for v in points) / 200) < 1e-6


def test_overlap_groups(spark):
    r = random.Random(2)
    files_ = [(f"f{i:03d}", a, a + r.choice([0, 1, 3])) for i, a in enumerate(r.sample(range(400), 150))] + [("whole", 0, 30), ("n", None, None)]
    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([(f, at(a), at(b)) for f, a, b in files_], "file string, start timestamp_ntz, end timestamp_ntz")
    known = sorted((a, f, b) for f, a, b in files_ if a is not None)
    groups = []
    for a, f, b in known:
        if groups and a <= groups[-1]["end"]:
            groups[-1]["files"].append(f)
            groups[-1]["end"] = max(groups[-1]["end"], b)
        else:
            groups.append({"start": a, "end": b, "files": [f]})
    want = sorted((f, at(g["start"]), at(g["end"]), len(g["files"])) for g in groups for f in g["files"])
    for parts in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = files.overlap_groups(df).select("file", "group_start", "group_end", "n_files").collect()
        assert sorted(map(tuple, got)) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {x.file for x in files.overlaps_of(df, "whole").collect()} == {f for a, f, b in known if a <= 30 and f != "whole"}
    assert files.overlap_groups(df.limit(0)).collect() == []


def test_gamma_and_weibull_moments(spark):
    rows = [(m, s) for m in (4.0, 7.5, 10.0) for s in (0.8, 2.0, 4.5)]
    df = spark.createDataFrame(rows, "mean_ws double, sd_ws double").withColumn("n", F.lit(100))
    for r in resource.weibull_fit(df).collect():
        a, k = r["weibull_a"], r["weibull_k"]
        if 0.36 < k < 5.99:
            assert abs(a * math.gamma(1 + 1 / k) - r["mean_ws"]) < 1e-9
            sd = a * math.sqrt(math.gamma(1 + 2 / k) - math.gamma(1 + 1 / k) ** 2)
            assert abs(sd - r["sd_ws"]) < 1e-8
        else:
            assert k == pytest.approx((r["sd_ws"] / r["mean_ws"]) ** -1.086)
    few = resource.weibull_fit(df.withColumn("n", F.lit(4))).first()
    assert (few["weibull_a"], few["weibull_k"]) == (7.0, 2.0)
    g = spark.createDataFrame([(x / 10,) for x in range(10, 60)], "x double").select("x", num.gamma(F.col("x")).alias("g"))
    assert all(abs(r["g"] / math.gamma(r["x"]) - 1) < 1e-12 for r in g.collect())


def daily(spark, start, n, value):
    d0 = dt.date.fromisoformat(start)
    return spark.createDataFrame([(d0 + dt.timedelta(days=i), float(value(i))) for i in range(n)], "d date, e_mwh double")


def test_month_normalisation(spark):
    got = energy.monthly_gross(daily(spark, "2024-01-01", 31, lambda i: 1.0), 30.0).collect()
    assert len(got) == 1 and abs(got[0]["gross_mwh"] - 30.0) < 1e-9
    assert energy.monthly_gross(daily(spark, "2024-01-01", 19, lambda i: 1.0)).count() == 0
    assert energy.monthly_gross(daily(spark, "2024-01-01", 240, lambda i: 1.0), 30.0, 20, ("2024-02",)).count() == 7


def test_density(spark):
    r = spark.range(1).select(num.site_density_ratio(0.0, F.lit(15.0)).alias("rho"),
                              num.density_correct(F.lit(10.0), F.lit(0.8)).alias("v"),
                              num.density_correct(F.lit(10.0), F.lit(1.1)).alias("w")).first()
    assert abs(r["rho"] - 1.0) < 0.02 and abs(r["v"] - 10 * 0.8 ** (1 / 3)) < 1e-9 and r["w"] > 10


def linear_case(spark, months=40, noise=0.2):
    """Daily wind and energy with a known relation, over `months` of 30 days."""
    rnd = random.Random(1)
    d0 = dt.date(2019, 1, 1)
    wind, rows = {}, []
    for i in range(months * 30):
        d = d0 + dt.timedelta(days=i)
        m = wind.setdefault((d.year, d.month), 6 + 2 * math.sin(len(wind) / 40 * 2 * math.pi))
        rows.append((d, m + rnd.gauss(0, noise)))
    ref = spark.createDataFrame(rows, "d date, ws double")
    return ref, ref.select("d", ((300 * F.col("ws") + 500) * 24 / 1000).alias("e_mwh"))


def metrics_row(spark, years, months=40.0):
    return spark.range(1).select(F.lit(years).alias("lt_n_years"), F.lit(7.0).alias("lt_mean_ws"), F.lit(True).alias("has_mcp"),
                                 F.lit(months).alias("record_months"), F.lit(7.0).alias("site_mean_ws"))


def test_production_regression_recovers_the_relation(spark):
    ref, e = linear_case(spark)
    m = metrics_row(spark, 40 * 30 / 365.25)
    nm = one(lt.normalised_month(e, ref, m, replace(P, lt_density_correction=False)))
    assert abs(nm["nm_slope"] / (300 * 0.72) - 1) < 0.02 and abs(nm["nm_intercept"] / (500 * 0.72) - 1) < 0.05
    assert nm["nm_r2"] > 0.95
    mo = one(lt.lt_monthly_energy(energy.monthly_gross(e), ref, m))
    assert abs(mo["monthly_slope"] / (300 * 0.024 * 30.44) - 1) < 0.02 and mo["monthly_r2"] > 0.95
    warm = ref.withColumn("temp_c", F.lit(20.0))
    same = one(lt.normalised_month(e, warm, m, P))
    assert abs(same["nm_mwh"] - nm["nm_mwh"]) < 1e-6          # a constant temperature changes nothing
    short = one(lt.normalised_month(e.limit(90), ref, m, P))
    assert short["nm_mwh"] is None


def test_method_choice_and_gross(spark):
    ref, e = linear_case(spark)
    years = 40 * 30 / 365.25
    m = hold_row(metrics_row(spark, years))
    lt_series = ref.select("d", "ws", F.lit("predicted").alias("origin"))
    d = hold_row(lt.lt_daily_energy(e, ref, lt_series, m))
    mo = hold_row(lt.lt_monthly_energy(energy.monthly_gross(e), ref, m))
    nm = hold_row(lt.normalised_month(e, ref, m, replace(P, lt_density_correction=False)))
    near = mo.select((F.col("monthly_mwh") * 1.05).alias("method_a_mwh"))

    def gross(aep, metrics, method):
        c = lt.method_choice(d, mo, metrics, aep)
        return one(lt.gross_aep(c, nm, replace(P, lt_primary_method=method)))

    a = gross(near, m, "method_a")
    assert a["primary_method"] == "monthly" and a["gross_lt_mwh"] == a["method_a_mwh"]
    assert gross(near, m, "method_b")["gross_lt_mwh"] == a["monthly_mwh"]
    assert gross(near, m, "method_b_auto")["gross_lt_mwh"] == a["monthly_mwh"]
    assert gross(near, m, "normalised_month")["gross_lt_mwh"] == a["nm_mwh"]
    far = mo.select((F.col("monthly_mwh") * 1.5).alias("method_a_mwh"))
    assert gross(far, m, "method_b_auto")["lt_method"] == "Weibull and warranted curve"
    absurd = mo.select((F.col("monthly_mwh") * 9).alias("method_a_mwh"))
    assert gross(absurd, m, "method_b")["primary_method"] is None
    assert gross(near, hold_row(metrics_row(spark, years, 5.0)), "method_b")["primary_method"] is None


def test_mcp_without_direction_and_fallback(spark):
    ref, _ = linear_case(spark)
    site = ref.filter("d < '2019-03-01'").select("d", (0.5 + 0.9 * F.col("ws")).alias("ws"))
    fits = lt.mcp_fit(lt.mcp_pairs(site, ref, 30, False))
    f = fits.collect()
    assert len(f) == 1 and abs(f[0]["slope"] - 0.9) < 1e-9 and abs(f[0]["intercept"] - 0.5) < 1e-9
    pred = lt.mcp_predict(ref, fits, 30, False)
    assert pred.count() == ref.count()
    assert lt.lt_series(pred, site).select("origin").distinct().first()[0] == "predicted"
    assert lt.lt_series(pred.limit(100), site).select("origin").distinct().first()[0] == "measured"
    assert lt.mcp_fit(lt.mcp_pairs(site.limit(29), ref, 30, False)).count() == 0


def test_yaw_finds_the_planted_offset(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(4000):
        ws, err = rnd.uniform(4, 11), rnd.gauss(7, 6)
        power = 20 * ws ** 3 / 6 * max(0.2, 1 - ((err - 7) / 30) ** 2) * rnd.gauss(1, 0.02)
        rows.append(("T1", i, ws, power, (100 + err) % 360, 100.0, 0))
    df = spark.createDataFrame(rows, "turbine string, slot bigint, ws double, power_kw double, wind_dir_deg double,"
                                     " dir_deg double, flag int")
    r = one(yaw.yaw_screening(yaw.yaw_fit(yaw.yaw_rows(df, yaw.bin_means(df, P), P))))
    assert abs(r["yaw_misalignment_deg"] - 7) < 1 and r["flagged"] and r["loss_pct"] > 1
    assert yaw.bin_means(df.limit(150), P).count() == 0


def test_frozen_anemometer_is_imputed_from_the_farm(spark):
    rnd = random.Random(4)
    rows = []
    for s in range(60):
        for i, t in enumerate(("A", "B", "C")):
            ws = 6.0 if t == "B" and 20 <= s < 50 else 6 + 2 * i + rnd.uniform(-1.5, 1.5)
            rows.append((t, s, 1500.0, ws, 90.0, 90.0, 15.0, 100 if s else 300, None))
    df = spark.createDataFrame(rows, "turbine string, slot bigint, power_kw double, ws double, dir_deg double,"
                                     " wind_dir_deg double, temp_c double, status int, curt_flag int")
    p = FarmParams()
    out = flags.flag_records(df, curve.curve_grid(curve.generic_curve(spark, p), p), p)
    frozen = {r["slot"]: r for r in out.filter("flag = 7").collect()}
    assert set(frozen) == set(range(31, 50)) and all(r["turbine"] == "B" for r in frozen.values())
    others = out.filter("slot = 40 and flag = 0").groupBy().avg("expected_power_kw").first()[0]
    assert abs(frozen[40]["expected_power_kw"] - others) < 1e-9


def test_strict_flags_and_curtailment_flag(spark):
    rows = [("A", s, 2300.0, 11.0, 1.0, 1.0, 15.0, None, 1 if s == 5 else 0) for s in range(12)]
    df = spark.createDataFrame(rows, "turbine string, slot bigint, power_kw double, ws double, dir_deg double,"
                                     " wind_dir_deg double, temp_c double, status int, curt_flag int")
    p = FarmParams()
    g = curve.curve_grid(curve.generic_curve(spark, p), p)
    got = {r["slot"]: r["flag"] for r in flags.flag_records(df, g, p).collect()}
    assert got[5] == 3 and got[4] == 0
    strict = flags.flag_records(df, g, replace(p, strict_flags=True))
    assert {r["flag"] for r in strict.collect()} == {8}


def test_loss_modes_and_overrides(spark):
    site = spark.range(1).select(
        F.lit(1000.0).alias("gross_mwh"), F.lit(880.0).alias("actual_mwh"), F.lit(50.0).alias("downtime_mwh"),
        F.lit(20.0).alias("curtailment_mwh"), F.lit(0.0).alias("derating_mwh"), F.lit(0.0).alias("environmental_mwh"),
        F.lit(40.0).alias("wake_used_mwh"), F.lit(10.0).alias("performance_mwh"), F.lit(5000.0).alias("gross_lt_mwh"),
        F.lit(2).alias("n_turbines"))
    s = one(yc.with_net(site, P))
    assert abs(s["net_mwh"] - 5000 * (1 - 0.145)) < 1e-9
    prod = one(yc.with_net(site, replace(P, loss_mode="product")))
    assert abs(prod["net_mwh"] - 5000 * 0.95 * 0.98 * 0.96 * 0.99 * 0.98 * 0.995) < 1e-9
    from windrow.params import FutureLosses
    fut = one(yc.with_net(site, replace(P, future_losses=FutureLosses(3, 0, 2, 0))))
    assert abs(fut["net_mwh"] - 5000 * 0.97 * 0.98) < 1e-9
    sig = spark.range(1).select(F.lit(5.0).alias("sigma_wind_pct"))
    comp = yc.uncertainty_components(yc.with_net(site, P), sig, replace(P, uncertainty_overrides_pct={"wake": 2.5}))
    got = {r["component"]: r["sigma_pct"] for r in comp.collect()}
    assert got["Wake losses"] == 2.5 and got["Availability losses"] == 0.75
    assert abs(sum(r["contribution_pct"] for r in comp.collect()) - 100) < 1e-9
