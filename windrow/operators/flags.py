"""Operating-state classification. Each rule reads the flag that the rule before it left."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from windrow.functions.num import air_density_ratio
from windrow.functions.rows import buckets_of, land, land_as_is
from windrow.functions.timegrid import month_of, timestamp_of
from windrow.operators import timeseries as ts
from windrow.operators.blocks import OF_BLOCK, Blocks, add_block, in_block, land_blocks, with_history
from windrow.operators.curve import expected_power, power_at
from windrow.params import FarmParams
from windrow.schema import FLAG_LABELS

FROZEN_ROWS = 12

# fixed values: reason texts
R_MISSING = "Missing / NaN"
R_BAD = "Bad data / spike"
R_STATUS = "SCADA status code"
R_BELOW = "Below cut-in"
R_LOW = "Downtime (low power at usable wind)"
R_CURT_FLAG = "Curtailment (SCADA flag)"
R_CURT = "Curtailment (low output at usable wind)"
R_DERATED = "Derated / partial load"
R_HOT = "Environmental (high temperature)"
R_ICE = "Environmental (icing)"
R_FROZEN = "Anemometer fault (frozen)"
R_OPERATING = "Operating"


def run_lengths(p: FarmParams) -> tuple[int, int]:
    """Rows a condition must hold: one hour for low power, half an hour for curtailment."""
    return (max(3, math.ceil(round(1.0 / p.interval_h, 9))),
            max(3, math.ceil(round(0.5 / p.interval_h, 9))))


def history_rows(p: FarmParams) -> int:
    """Rows before a record that any rolling rule can reach back to."""
    n_low, n_curt = run_lengths(p)
    return max(n_low + n_curt - 2, FROZEN_ROWS - 1)


def usable_status(ctx: DataFrame) -> DataFrame:
    """One row: does the status column hold at least two different codes, over all blocks?"""
    return ctx.agg(F.coalesce(F.min("least_status") < F.max("greatest_status"), F.lit(False)).alias("has_status"))


def status_flag(status: Column, p: FarmParams) -> Column:
    """Flag of a status code; unknown codes count as downtime, operating wins over the rest."""
    c = p.status_codes
    return (F.when(status.isin(*c.operating), 0)
            .when(status.isin(*c.environmental), 5).when(status.isin(*c.curtailment), 3)
            .otherwise(2))


def base_flags(df: DataFrame, p: FarmParams) -> DataFrame:
    """Rules on a single record: missing, bad data, status code, below cut-in.

    Needs `expected_power_kw` and `has_status`.
    """
    power, ws, status = F.col("power_kw"), F.col("ws"), F.col("status")
    missing = power.isNull() | ws.isNull()
    bad = (power > 1.15 * p.rated_power_kw) | (power < 0) | (ws < 0) | (ws > 45)
    coded = F.col("has_status") & status.isNotNull()
    if p.strict_flags:
        flag = (F.when(bad & ~missing, 6).when(coded, status_flag(status, p)).otherwise(8))
        reason = (F.when(bad & ~missing, R_BAD).when(coded, R_STATUS).otherwise(R_MISSING))
    else:
        flag = (F.when(missing, 8).when(bad, 6).when(coded, status_flag(status, p)).otherwise(0))
        reason = (F.when(missing, R_MISSING).when(bad, R_BAD).when(coded, R_STATUS)
                  .otherwise(R_OPERATING))
    df = df.withColumns({"flag": flag, "flag_reason": reason})
    return _apply(df, ws < p.cut_in_mps, 1, R_BELOW)


def _apply(df: DataFrame, cond: Column, flag: int, reason: str) -> DataFrame:
    """Sets flag and reason on operating records that meet the condition."""
    hit = F.coalesce((F.col("flag") == 0) & cond, F.lit(False))
    return df.withColumns({"flag": F.when(hit, flag).otherwise(F.col("flag")),
                           "flag_reason": F.when(hit, reason).otherwise(F.col("flag_reason"))})


def _run(cond: Column, n: int) -> Column:
    """1 for each record that ends a run of n consecutive records meeting the condition."""
    held = F.coalesce(cond.cast("int"), F.lit(0))
    return F.sum(held).over(in_block().rowsBetween(-(n - 1), 0)) == n


def rolling_flags(df: DataFrame, p: FarmParams) -> DataFrame:
    """Rules over consecutive records of a turbine, then the temperature rules.

    `df` holds the halo rows of each block, so every window sees the records before the block.
    """
    rated = p.rated_power_kw
    n_low, n_curt = run_lengths(p)
    operating = F.col("flag") == 0
    power, ws, exp = F.col("power_kw"), F.col("ws"), F.col("expected_power_kw")

    low = operating & (ws > p.cut_in_mps + 1.0) & (power < 0.005 * rated)
    last12 = in_block().rowsBetween(-(FROZEN_ROWS - 1), 0)
    steady = ((F.count("ws").over(last12) == FROZEN_ROWS)
              & (F.stddev_samp("ws").over(last12) < 0.02 * ws) & (ws > 4.0))
    df = df.withColumns({"_low": _run(low, n_low), "_steady": steady})  # no flag enters the second: one window for both
    df = _apply(df, F.col("_low"), 2, R_LOW)
    df = _apply(df, F.col("curt_flag") == 1, 3, R_CURT_FLAG)

    df = df.withColumn("_ratio", power / F.greatest(exp, F.lit(1.0)))
    ratio = F.col("_ratio")
    usable = (operating & (ws >= p.cut_in_mps) & (ws < p.cut_out_mps - 1.0) & (exp > 0.15 * rated))
    df = df.withColumns({"_c3": _run(usable & (ratio < 0.30), n_curt),
                         "_c4": _run(usable & (ratio >= 0.30) & (ratio < 0.85), n_curt)})
    df = _apply(df, F.col("_c3"), 3, R_CURT)
    df = _apply(df, F.col("_c4"), 4, R_DERATED)
    df = _apply(df, (F.col("temp_c") > 39.0) & (ratio < 0.85), 5, R_HOT)
    df = _apply(df, (F.col("temp_c") < 1.0) & (ratio < 0.5), 5, R_ICE)

    df = df.withColumn("frozen_candidate",
                       F.coalesce(F.col("_steady") & (F.col("flag") == 0), F.lit(False)))
    return df.drop("_low", "_steady", "_ratio", "_c3", "_c4")


def at_slot():
    return W.partitionBy("slot")


def farm_rules(df: DataFrame, p: FarmParams) -> DataFrame:
    """Rules that compare the turbines at one time: frozen anemometer and its expected power.

    A slot holds at most one record per turbine, so its group is bounded by the farm size.
    """
    recorded = F.col("recorded") == 1
    spread = F.stddev_samp(F.when(recorded, F.col("ws"))).over(at_slot())
    df = _apply(df.withColumn("_spread", spread),
                F.col("frozen_candidate") & (F.col("_spread") > 0.5), 7, R_FROZEN)
    farm = F.avg(F.when(F.col("flag") == 0, F.col("expected_power_kw"))).over(at_slot())
    return (df.withColumn("_farm", farm)
            .withColumn("expected_power_kw", F.when(F.col("flag") == 7, F.coalesce("_farm", F.lit(0.0)))
                        .otherwise(F.col("expected_power_kw")))
            .drop("_spread", "_farm", "frozen_candidate"))


def flag_blocks(rows: DataFrame, p: FarmParams, name: str = "blocks", most: int = 0) -> Blocks:
    """Lands resampled rows and the context that flags and gap filling need.

    `most`: a number that the rows don't exceed, if known; there are buckets enough for it.
    """
    return land_blocks(rows, name, history_rows(p), ts.FILLED, most)


def record_blocks(records: DataFrame, p: FarmParams, name: str = "blocks") -> Blocks:
    """Resamples records at about the rate of the slots and lands them for `flag_blocks`; no task grows with their number."""
    n = records.count()
    return flag_blocks(ts.resample_spread(records, buckets_of(records.sparkSession, n)), p, name, n)


def record_rules(rows: DataFrame | Blocks, grid: DataFrame, p: FarmParams, has_status=None) -> DataFrame:
    """Resampled rows with expected power and all flags that need only the turbine's own series.

    `has_status` may be given; otherwise it is decided from the whole input. Landed blocks are read once; rows that are
    not landed are read for the rules, for the context and for the status.
    """
    blocked, ctx = (rows.rows, rows.context) if isinstance(rows, Blocks) else (None, None)
    if blocked is None:
        blocked = add_block(rows)
        ctx = ts.gap_context(blocked, history=history_rows(p))
    # the rules need the rows before a block only: what gap filling needs of a landed context joins behind their windows
    keys = ["turbine", "block"]
    late = [c for c in ctx.columns if c not in (*keys, "prev", *OF_BLOCK)] if isinstance(rows, Blocks) else []
    df = with_history(blocked, ctx.drop(*late))
    df = power_at(df, grid, "ws", "expected_power_kw")
    if has_status is None:
        df = df.withColumn("has_status", usable_status(ctx).scalar())
    else:
        df = df.withColumn("has_status", F.lit(bool(has_status)))
    df = rolling_flags(base_flags(df, p), p)
    df = df.filter(~F.col("is_halo")).drop("is_halo", "has_status")
    if late:
        df = df.join(ctx.select(*keys, *late), keys, "left")
    df = df.withColumn("density_ratio", air_density_ratio(F.col("temp_c"), p.air_pressure_kpa)
                       if p.air_density_correction else F.lit(None).cast("double"))
    return df.withColumn("expected_power_kw", expected_power(p))


def flag_records(rows: DataFrame | Blocks, grid: DataFrame, p: FarmParams, has_status=None,
                 fill: bool = True, far: bool = True) -> DataFrame:
    """The flagged ten-minute table: flags, gap filling, imputation and energies.

    Landed blocks move once more, by slot; rows that are not landed by (turbine, block) before. Without `far` the rows
    of gaps that no value reaches are left out.
    """
    df = record_rules(rows, grid, p, has_status)
    if fill:
        df = ts.fill_gaps(df, p.max_gap_slots, far)
    else:
        df = df.select(*[c for c in df.columns
                         if not c.startswith(("lv_", "nv_")) and c not in ("n_turbine", "next_slot")],
                       F.lit(0).alias("gap_filled"), F.lit(1).alias("recorded"))
    if isinstance(rows, Blocks) and rows.parts > buckets_of(df.sparkSession):
        df = df.repartition(rows.parts, "slot")
    df = farm_rules(df, p)
    return df.select(
        "turbine", "slot", timestamp_of().alias("timestamp"), month_of().alias("month"),
        "power_kw", "ws", "dir_deg", "wind_dir_deg", "temp_c", "status", "curt_flag",
        "density_ratio", "expected_power_kw",
        (F.col("power_kw") * p.interval_h).alias("energy_kwh"),
        (F.col("expected_power_kw") * p.interval_h).alias("expected_energy_kwh"),
        "flag", "flag_reason", "gap_filled", "recorded")


def land_flagged(blocks: Blocks, grid: DataFrame, p: FarmParams, name: str, partition_by: str | None = None) -> DataFrame:
    """The flagged table, landed; see `land_counted`."""
    return land_counted(blocks, grid, p, name, partition_by).rows


class Flagged(NamedTuple):
    """The flagged table, and the same for sums: columns of the base table, a row standing for `n` equal ones."""
    rows: DataFrame
    counted: DataFrame


def land_counted(blocks: Blocks, grid: DataFrame, p: FarmParams, name: str, partition_by: str | None = None) -> Flagged:
    """The flagged table, landed. Of a long gap only the ends are, as its rows beyond the fill limit are all alike.

    Those rows are made when they are read; a reader that asks for records or winds drops them in its plan. So what is
    moved and written grows with the records, not with the time between them. Sums take them from their number without
    making them.
    """
    rows = flag_records(blocks, grid, p, far=False)  # spread by slot, so files are of equal size without another move
    near = land(rows, name, partition_by) if partition_by else land_as_is(rows, name)
    spans = land_as_is(ts.empty_spans(blocks, p.max_gap_slots).repartition(blocks.parts), f"{name}-spans")
    known = {"expected_power_kw": 0.0, "expected_energy_kwh": 0.0, "flag": 8, "flag_reason": R_MISSING,
             "gap_filled": 0, "recorded": 0}
    month = F.coalesce("month", month_of())
    made = {"turbine": F.col("turbine"), "slot": F.col("slot"), "month": month, "timestamp": timestamp_of()}
    same = month_of("a") == month_of("b")  # days before 1970 are not counted as the calendar does
    spans = spans.withColumn("month", F.when(same, month_of("a")))
    each = F.explode(F.sequence("a", "b"))

    def as_near(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
        return df.select(*[made.get(c, F.lit(known.get(c))).cast(near.schema[c].dataType).alias(c) for c in names], *more)

    far = as_near(spans.withColumn("slot", each), near.columns)
    summed = ["turbine", "month", "flag", "status", "energy_kwh", "expected_energy_kwh"]
    one = F.lit(1).cast("bigint").alias("n")
    counted = (near.select(*summed, one)
               .unionByName(as_near(spans.filter(same).withColumn("slot", F.col("a")), summed, (F.col("b") - F.col("a") + 1).alias("n")))
               .unionByName(as_near(spans.filter(~same).withColumn("slot", each), summed, one)))
    return Flagged(near.unionByName(far), counted)


def flag_summary(flagged: DataFrame) -> DataFrame:
    """Records per flag with label and share."""
    label = F.create_map(*[F.lit(x) for kv in FLAG_LABELS.items() for x in kv])
    counts = flagged.groupBy("flag").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy(F.lit(1)))       # nine rows at most
    return counts.select("flag", label[F.col("flag")].alias("label"), "count",
                         (100.0 * F.col("count") / total).alias("pct_of_records"))


def coverage(flagged: DataFrame) -> DataFrame:
    """Rows against the rows expected from the period, with and without filled ones."""
    one = flagged.agg(
        F.count(F.lit(1)).alias("n"), F.sum("recorded").alias("n_raw"),
        F.countDistinct("turbine").alias("n_turbines"),
        (F.max("slot") - F.min("slot")).alias("expected_rows_per_turbine"))
    full = F.greatest(F.lit(1.0), F.col("n_turbines") * F.col("expected_rows_per_turbine"))
    return one.select("n_turbines", "expected_rows_per_turbine",
                      (100.0 * F.col("n_raw") / full).alias("coverage_raw_pct"),
                      (100.0 * F.col("n") / full).alias("coverage_filled_pct"))


def qc_warnings(flagged: DataFrame) -> DataFrame:
    """Warnings on implausible results, one row each; empty when all is well."""
    one = flagged.agg(
        F.avg((F.col("flag") == 0).cast("double")).alias("op"),
        F.avg((F.col("flag") == 2).cast("double")).alias("down"),
        (F.count("status") > 0).alias("has_status"))
    few = F.col("op") < 0.10
    rules = [
        (few & F.col("has_status"), "operating share below 10 %: check the status codes", F.col("op")),
        (few & ~F.col("has_status"), "operating share below 10 %: check the units", F.col("op")),
        (~few & F.col("has_status") & (F.col("down") > 0.5),
         "downtime share above 50 %: check the status codes", F.col("down")),
    ]
    rows = F.array(*[F.when(c, F.struct(F.lit(t).alias("warning"), (100.0 * v).alias("share_pct")))
                     for c, t, v in rules])
    return one.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))
