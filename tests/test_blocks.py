"""Block context, history and gap handling against plain Python."""

import random

from pyspark.sql import functions as F

from windrow.operators import timeseries as ts
from windrow.operators.blocks import block_context, brackets, with_history

SCHEMA = "turbine string, block bigint, slot bigint, ws double"


def series(seed, n, sparse):
    rnd = random.Random(seed)
    rows = []
    for t in ("A", "B", "C"):
        slots = sorted(rnd.sample(range(n * 3 if sparse else n), n // 2))
        rows += [(t, s // 5, s, None if rnd.random() < 0.3 else round(rnd.uniform(0, 9), 3)) for s in slots]
    return rows


def test_history_reaches_back_any_number_of_blocks(spark):
    for sparse in (False, True):
        data = series(3, 60, sparse)
        df = spark.createDataFrame(data, SCHEMA)
        got = with_history(df, block_context(df, history=4)).collect()
        for t in ("A", "B", "C"):
            mine = sorted((r for r in data if r[0] == t), key=lambda r: r[2])
            for b in {r[1] for r in mine}:
                first = next(i for i, r in enumerate(mine) if r[1] == b)
                halo = sorted(r["slot"] for r in got if r["turbine"] == t and r["block"] == b and r["is_halo"])
                own = sorted(r["slot"] for r in got if r["turbine"] == t and r["block"] == b and not r["is_halo"])
                assert halo == [r[2] for r in mine[max(0, first - 4):first]]
                assert own == [r[2] for r in mine if r[1] == b]


def test_brackets_find_neighbours_across_blocks(spark):
    data = series(5, 80, True)
    df = spark.createDataFrame(data, SCHEMA)
    ctx = block_context(df, carry=("ws",))
    got = {(r["turbine"], r["slot"]): r for r in
           brackets(df.join(ctx, ["turbine", "block"], "left"), ("ws",)).collect()}
    for t in ("A", "B", "C"):
        mine = sorted((r for r in data if r[0] == t), key=lambda r: r[2])
        for i, r in enumerate(mine):
            prev = next(((x[2], x[3]) for x in reversed(mine[:i + 1]) if x[3] is not None), None)
            nxt = next(((x[2], x[3]) for x in mine[i + 1:] if x[3] is not None), None)
            row = got[t, r[2]]
            assert (tuple(row["a_ws"]) if row["a_ws"] else None) == prev
            assert (tuple(row["b_ws"]) if row["b_ws"] else None) == nxt
            assert row["n_turbine"] == len(mine)


def rows_of(spark, points, turbine="T1"):
    return spark.createDataFrame(
        [(turbine, s, p, w, d, d, 10.0, 100, None) for s, p, w, d in points],
        "turbine string, slot bigint, power_kw double, ws double, dir_deg double, wind_dir_deg double,"
        " temp_c double, status int, curt_flag int")


def test_gap_limit_and_circular_fill(spark):
    points = [(s, 100.0, 5.0, 350.0) for s in range(10)] + [(s, 100.0, 9.0, 10.0) for s in range(50, 60)]
    got = {r["slot"]: r for r in ts.gap_fill(rows_of(spark, points)).collect()}
    assert len(got) == 60
    filled = [s for s, r in got.items() if r["gap_filled"] == 1]
    assert filled == list(range(10, 46)) or sorted(filled) == list(range(10, 46))      # 36 of 40
    assert abs(got[10]["ws"] - (5 + 4 / 41)) < 1e-9 and got[46]["ws"] is None
    assert got[10]["power_kw"] is None
    # the direction turns through north, not through south
    assert all(r["dir_deg"] > 340 or r["dir_deg"] < 20 for s, r in got.items() if s in filled)


def test_gap_at_the_end_holds_last_value_and_keeps_power(spark):
    points = [(s, 100.0, 5.0, 90.0) for s in range(12)] + [(s, 70.0, None, None) for s in range(12, 60)]
    got = {r["slot"]: r for r in ts.gap_fill(rows_of(spark, points)).collect()}
    assert got[47]["ws"] == 5.0 and got[48]["ws"] is None
    assert got[20]["power_kw"] == 70.0 and got[20]["gap_filled"] == 1 and got[50]["gap_filled"] == 0


def test_short_series_is_left_alone(spark):
    got = ts.gap_fill(rows_of(spark, [(s, 1.0, 5.0, 0.0) for s in (0, 1, 2, 9)])).collect()
    assert len(got) == 4 and all(r["gap_filled"] == 0 for r in got)


def test_circular_mean(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:01:00", 350.0), ("a", "2024-01-01 00:03:00", 20.0)],
                               "turbine string, t string, dir_deg double").selectExpr(
        "turbine", "cast(t as timestamp_ntz) as timestamp", "dir_deg")
    assert abs(ts.circular_mean_10min(df, "dir_deg").first()["dir_deg"] - 5.0) < 1e-9


def test_exact_median(spark):
    rnd = random.Random(1)
    data = [("a", rnd.choice([0.5, 0.5, 0.7, rnd.random()])) for _ in range(501)]
    data += [("b", rnd.gauss(1, 0.1)) for _ in range(200)] + [("c", 2.0), ("c", None)]
    got = {r["k"]: r["x"] for r in ts.exact_median(
        spark.createDataFrame(data, "k string, x double"), ["k"], "x", 1 / 64).collect()}
    from statistics import median
    for k in "abc":
        assert abs(got[k] - median([x for kk, x in data if kk == k and x is not None])) < 1e-12


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 2, 3.0), ("a", 2, 1, 2.0)],
                               "turbine string, slot bigint, ordinal int, ws double")
    once = ts.dedup_last_wins(df, ("turbine", "slot"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ts.dedup_last_wins(once, ("turbine", "slot")).collect()))
    assert sorted(r["ws"] for r in once.collect()) == [2.0, 3.0]


def test_landed_blocks_give_the_same_and_are_read_once(spark, small_blocks):
    import re

    from windrow.operators import flags
    from windrow.plans import testbed as tb
    rows = tb.resampled(spark, "/root/testdata/sf0.001")
    blocks = flags.flag_blocks(rows, tb.PARAMS)
    for fill in (True, False):
        plain = flags.flag_records(rows, tb.grid(spark), tb.PARAMS, fill=fill)
        landed = flags.flag_records(blocks, tb.grid(spark), tb.PARAMS, fill=fill)
        assert plain.count() == landed.count() and plain.exceptAll(landed).isEmpty()
    plan = landed._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet [^\n]*blocks_rows", plan)) == 1
    assert "hashpartitioning(turbine" not in plan and "SortAggregate" not in plan


def test_long_gaps_are_cut_at_block_borders(spark, small_blocks):
    rows = [("A", s) for s in (3, 4, 20, 21, 100)] + [("B", 6), ("B", 7), ("B", 8), ("C", 50)]
    got = ts.time_spine(spark.createDataFrame(rows, "turbine string, slot bigint")).collect()
    want = [(t, s, int((t, s) in rows)) for t, a, b in (("A", 3, 100), ("B", 6, 8), ("C", 50, 50)) for s in range(a, b + 1)]
    assert sorted(map(tuple, got)) == want


def test_a_record_of_2099(spark):
    rows = [("A", 24 * 6 * 9000 + i) for i in range(12)] + [("A", 24 * 6 * 47450)]
    df = ts.time_spine(spark.createDataFrame(rows, "turbine string, slot bigint"))
    n = df.groupBy().agg({"present": "sum", "slot": "count"}).first()
    assert n["sum(present)"] == 13 and n["count(slot)"] == 24 * 6 * (47450 - 9000) + 1


def test_long_gaps_are_not_landed(spark, monkeypatch):
    from windrow.functions import rows as helpers
    from windrow.operators import flags
    from windrow.plans import testbed as tb
    # months apart, over the year's end and before 1970; one turbine too short to be filled
    spans = [("A", -9000), ("A", 52_500), ("A", 90_000), ("B", 52_560), ("B", 52_610)]
    data = [(t, s + i, 500.0 + i, 8.0 + i % 3, 100.0 + i, None if i % 5 else 90.0, 10.0, 100 + i % 2, None)
            for t, s in spans for i in range(0, 12, 2)] + [("C", 10, 1.0, 8.0, 1.0, 1.0, 1.0, 100, None), ("C", 9000, 1.0, 8.0, 1.0, 1.0, 1.0, 100, None)]
    df = spark.createDataFrame(data, "turbine string, slot bigint, power_kw double, ws double, dir_deg double,"
                               " wind_dir_deg double, temp_c double, status int, curt_flag int")
    monkeypatch.setattr(helpers, "ROWS_OF_TASK", 8)
    blocks = flags.flag_blocks(df, tb.PARAMS, most=len(data))
    assert blocks.parts == max(helpers.buckets_of(spark), 4)
    want = flags.flag_records(df, tb.grid(spark), tb.PARAMS)
    for by in (None, "month"):
        got = flags.land_flagged(blocks, tb.grid(spark), tb.PARAMS, "flagged", by)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert got.count() == want.count() > 90_000
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        near = flags.flag_records(blocks, tb.grid(spark), tb.PARAMS, far=False)
        assert near.count() < 500
        plan = got.filter("flag = 0 and ws is not null")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan


def test_sums_take_long_gaps_without_making_their_rows(spark):
    from windrow.operators import energy, flags
    from windrow.plans import testbed as tb
    # a gap over months, one from before 1970 and a short one
    data = [(t, s + i, 500.0 + i, 8.0 + i % 3, 100.0, 90.0, 10.0, 100 + i % 2, None)
            for t, s in (("A", -9000), ("A", 52_500), ("A", 90_000), ("B", 52_560), ("B", 52_610)) for i in range(0, 12, 2)]
    df = spark.createDataFrame(data, "turbine string, slot bigint, power_kw double, ws double, dir_deg double,"
                               " wind_dir_deg double, temp_c double, status int, curt_flag int")
    landed = flags.land_counted(flags.flag_blocks(df, tb.PARAMS), tb.grid(spark), tb.PARAMS, "flagged")
    want, got = energy.energy_base(landed.rows), energy.energy_base(landed.counted)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert landed.rows.count() > 90_000 > 20_000 > landed.counted.count()


def test_block_rules_sort_once_and_gap_filling_once_more(spark):
    from windrow.operators import flags
    from windrow.plans import testbed as tb
    blocks = flags.flag_blocks(tb.resampled(spark, "/root/testdata/sf0.001"), tb.PARAMS)
    df = ts.fill_gaps(flags.record_rules(blocks, tb.grid(spark), tb.PARAMS), tb.PARAMS.max_gap_slots, far=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("slot#") and sum("Sort [" in x and "slot#" in x for x in plan.splitlines()) == 2
    rules = [x for x in plan.splitlines() if "Window [" in x and "stddev_samp" in x]
    assert len(rules) == 1 and "lv_ws" not in rules[0]


def test_turbines_of_the_layout_are_found_without_the_rows_of_gaps(spark):
    from windrow.plans import testbed as tb
    sf = "/root/testdata/sf0.001"
    df = tb.layout(spark, sf)
    # near rows, spans by their number, and spans of several months, as only occur before 1970
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    assert {r.turbine for r in df.collect()} == {r.turbine for r in tb.flagged(spark, sf).select("turbine").distinct().collect()}


def test_records_are_added_up_in_the_blocks_they_are_landed_in(spark, monkeypatch):
    import re

    from windrow.functions import rows as helpers
    from windrow.operators import flags
    from windrow.plans import testbed as tb
    # two records of a slot, a slot without power and wind, no turbine, no time
    data = [(t, f"2024-0{m}-01 00:{10 * k + j:02d}:00", float(k + j), 8.0, 1.0, 2.0, None, 100 + j if k else None, j)
            for t in ("A", "B", None) for m in (1, 2, 3, 5) for k in range(3) for j in (0, 7)]
    data += [("A", "2024-01-01 03:00:00", None, None, 1.0, 1.0, 1.0, 100, None), ("B", None, 1.0, 8.0, 1.0, 1.0, 1.0, 100, None)]
    df = spark.createDataFrame(data, "turbine string, timestamp string, power_kw double, ws double, dir_deg double, wind_dir_deg"
                               " double, temp_c double, status int, curt_flag int").withColumn("timestamp", F.expr("cast(timestamp as timestamp_ntz)"))
    monkeypatch.setattr(helpers, "ROWS_OF_TASK", 4)
    parts = helpers.buckets_of(spark, len(data))
    assert parts > helpers.buckets_of(spark)
    want = ts.resample_10min(df).filter("turbine is not null")
    got = ts.resample_spread(df, parts)
    assert sorted(map(str, got.drop("block").collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange \w+\(.*?, (\d+)\)", plan) == [str(parts)]
    blocks = flags.record_blocks(df, tb.PARAMS)
    assert blocks.parts == parts and blocks.rows.exceptAll(got).isEmpty() and got.exceptAll(blocks.rows).isEmpty()
