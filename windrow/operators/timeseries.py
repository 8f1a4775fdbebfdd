"""Ten-minute resampling, sampling interval, de-duplication, time spine and gap filling."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W, functions as F

from windrow.functions.num import angle
from windrow.functions.rows import land
from windrow.functions import timegrid
from windrow.functions.timegrid import slot_of
from windrow.operators.blocks import OF_BLOCK, Blocks, add_block, block_context, brackets, next_slot_in_series
from windrow.schema import PHYSICALS

MIN_ROWS_TO_FILL = 10


def resample_10min(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the physicals, last known status, highest curtailment flag per turbine and slot.

    Adding up happens before the shuffle, so records at a higher rate collapse on the map side.
    """
    known = F.col("status").isNotNull()
    return (df.withColumn("slot", slot_of("timestamp"))
            .groupBy(*keys, "turbine", "slot")
            .agg(*[F.avg(c).alias(c) for c in PHYSICALS],
                 F.max_by("status", F.when(known, F.col("timestamp"))).alias("status"),
                 F.max("curt_flag").alias("curt_flag"))
            .filter(F.col("power_kw").isNotNull() | F.col("ws").isNotNull()))


def resample_spread(df: DataFrame, parts: int) -> DataFrame:
    """Resampled rows with their block, spread by (turbine, block), for records at about the rate of the slots.

    Records move once, as they are, so that a task adds up its blocks alone, however many records there are. Denser ones
    had better collapse before they move, as `resample_10min` has them. Records without a turbine belong to no series.
    """
    placed = add_block(df.withColumn("slot", slot_of("timestamp"))).drop("slot").repartition(parts, "turbine", "block")
    rows = resample_10min(placed, ("block",))
    return rows.select(*[c for c in rows.columns if c != "block"], "block")


def circular_mean_10min(df: DataFrame, column: str) -> DataFrame:
    """Vector mean of a direction per turbine and slot (the plain mean is the default above)."""
    rad = F.radians(column)
    return (df.withColumn("slot", slot_of("timestamp")).groupBy("turbine", "slot")
            .agg(angle(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))).alias(column)))


def dedup_last_wins(df: DataFrame, keys: tuple[str, ...] = ("turbine", "timestamp"),
                    order: str = "ordinal") -> DataFrame:
    """Keeps, per turbine and time, the record of the last source.

    Written as an aggregate: copies collapse before the shuffle and no group is ever sorted.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    return (df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r"))
            .select(*keys, "r.*"))


def step_counts(rows: DataFrame) -> DataFrame:
    """How often each step (in slots) to the next record of the turbine occurs."""
    blocked = add_block(rows.select("turbine", "slot"))
    ctx = block_context(blocked).select("turbine", "block", "next_slot")
    return (blocked.join(ctx, ["turbine", "block"], "left")
            .select((next_slot_in_series() - F.col("slot")).alias("step"))
            .filter("step is not null").groupBy("step").agg(F.count(F.lit(1)).alias("n")))


def weighted_median(freq: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Exact median from value counts: the mean of the two middle values."""
    order = W.partitionBy(*keys).orderBy(value)
    upto = F.sum(n).over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(n).over(W.partitionBy(*keys))
    ranked = freq.select(*keys, value, n, upto.alias("_hi"), total.alias("_t"))
    lo_rank, hi_rank = F.expr("(_t + 1) div 2"), F.expr("_t div 2 + 1")

    def holds(rank):
        return (F.col("_hi") >= rank) & (F.col("_hi") - F.col(n) < rank)

    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(lo_rank), F.col(value)))
          + F.max(F.when(holds(hi_rank), F.col(value)))) / 2.0).alias(value))


def exact_median(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Exact median per key for groups of any size.

    Equal values are counted first; a histogram of bins of `width` finds the bins that hold the
    two middle ranks, and only the values of those bins are ranked.
    """
    freq = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin", F.floor(F.col(value) / width)))
    order = W.partitionBy(*keys).orderBy("bin")
    bins = (freq.groupBy(*keys, "bin").agg(F.sum("n").alias("bn"))
            .withColumn("hi", F.sum("bn").over(order.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("total", F.sum("bn").over(W.partitionBy(*keys)))
            .withColumn("below", F.col("hi") - F.col("bn")))
    lo_rank, hi_rank = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    middle = bins.filter((F.col("hi") >= lo_rank) & (F.col("below") < hi_rank))
    inside = W.partitionBy(*keys, "bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = (freq.join(middle, [*keys, "bin"])
              .withColumn("upto", F.col("below") + F.sum("n").over(inside)))

    def holds(rank):
        return (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)

    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(lo_rank), F.col(value)))
          + F.max(F.when(holds(hi_rank), F.col(value)))) / 2.0).alias(value))


def sampling_interval(rows: DataFrame) -> DataFrame:
    """Median step between consecutive records of a turbine, in hours (one row; 1/6 if unknown)."""
    # the counts have one row per distinct step length
    med = weighted_median(step_counts(rows).withColumn("k", F.lit(1)), ["k"], "step", "n")
    return med.agg(F.coalesce(F.max("step") / 6.0, F.lit(1.0 / 6.0)).alias("interval_h"))


def with_missing(placed: DataFrame, wanted: Column | None = None, most: int | None = None) -> DataFrame:
    """Adds a row (`is_new`) for every slot between a record and `_next`, where `wanted` holds; the first `most` if given.

    A gap is cut at the borders of blocks before its slots are made, so no row ever holds more than a block of them,
    however long the gap.
    """
    size = timegrid.SLOTS_PER_BLOCK
    first, last = F.col("slot") + 1, F.col("_next") - 1
    gap = first <= last if wanted is None else (first <= last) & wanted
    if most is not None and most < size:
        gap = gap & F.lit(most > 0)
        last = F.when(gap, F.least(last, F.col("slot") + most)).otherwise(F.col("slot"))
        return (placed.withColumn("_at", F.explode(F.sequence("slot", last)))
                .withColumns({"is_new": F.col("_at") > F.col("slot"), "slot": F.col("_at")}).drop("_at", "_next"))
    if most is not None:
        last = F.least(last, F.col("slot") + most)
    own = F.array(F.struct(F.col("slot").alias("a"), F.col("slot").alias("b"), F.lit(False).alias("new")))
    cut = F.transform(F.sequence(F.floor(first / size), F.floor(last / size)), lambda k: F.struct(
        F.greatest(first, k * size).alias("a"), F.least(last, (k + 1) * size - 1).alias("b"), F.lit(True).alias("new")))
    pieces = placed.withColumn("_piece", F.explode(F.when(gap, F.concat(own, cut)).otherwise(own)))
    return (pieces.withColumn("slot", F.explode(F.sequence("_piece.a", "_piece.b")))
            .withColumn("is_new", F.col("_piece.new")).drop("_piece", "_next"))


def time_spine(rows: DataFrame) -> DataFrame:
    """Every slot between a turbine's first and last record; `present` marks recorded ones."""
    blocked = add_block(rows.select("turbine", "slot"))
    ctx = block_context(blocked).select("turbine", "block", "next_slot")
    steps = (blocked.join(ctx, ["turbine", "block"], "left")
             .withColumn("_next", next_slot_in_series()))
    return with_missing(steps).select("turbine", "slot", (~F.col("is_new")).cast("int").alias("present"))


def _linear(c: str, limit: int, transform=None) -> Column:
    """Value at `slot` between the bracketing points; the last value is held after the end."""
    f = transform or (lambda x: x)
    a, b, s = F.col(f"a_{c}"), F.col(f"b_{c}"), F.col("slot")
    va, vb = f(a["v"]), f(b["v"])
    inside = va + (vb - va) * (s - a["slot"]) / (b["slot"] - a["slot"])
    return F.when(a.isNull() | (s - a["slot"] > limit), None).when(b.isNull(), va).otherwise(inside)


def _circular(c: str, limit: int) -> Column:
    x = _linear(c, limit, lambda d: F.cos(F.radians(d)))
    y = _linear(c, limit, lambda d: F.sin(F.radians(d)))
    return angle(F.degrees(F.atan2(y, x)))


FILLED = ("ws", "temp_c", "dir_deg", "wind_dir_deg")


def open_gaps(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Adds one row per missing slot (`is_new`) next to the records, with brackets attached.

    `rows` carries the context columns; each record emits the slots up to its successor, so no
    spine table is built and nothing is joined.
    """
    placed = brackets(rows.withColumn("_next", next_slot_in_series()), FILLED)  # before the rows are turned round
    return with_missing(placed, F.col("n_turbine") >= MIN_ROWS_TO_FILL, most).drop("next_slot")


def empty_spans(blocks: Blocks, limit: int) -> DataFrame:
    """turbine, a, b: the slots of gaps that are further than `limit` behind a record, cut at the ends of months.

    No value reaches them, so all that is known of their rows is that they are missing.
    """
    rows = blocks.rows.select("turbine", "block", "slot")
    ctx = blocks.context.select("turbine", "block", "next_slot", "n_turbine")
    found = (rows.join(ctx, ["turbine", "block"], "left").withColumn("_next", next_slot_in_series())
             .filter((F.col("_next") - F.col("slot") - 1 > limit) & (F.col("n_turbine") >= MIN_ROWS_TO_FILL))
             .select("turbine", (F.col("slot") + (limit + 1)).alias("first"), (F.col("_next") - 1).alias("last")))
    day = timegrid.SLOTS_PER_DAY
    dates = [F.date_from_unix_date(F.floor(F.col(c) / day).cast("int")) for c in ("first", "last")]
    months = F.sequence(F.trunc(dates[0], "MM"), dates[1], F.expr("interval 1 month"))
    return found.select("turbine", "first", "last", F.explode(months).alias("m")).select(
        "turbine", F.greatest("first", F.unix_date("m").cast("long") * day).alias("a"),
        F.least("last", F.unix_date(F.add_months("m", 1)).cast("long") * day - 1).alias("b"))


def fill_gaps(rows: DataFrame, limit: int, far: bool = True) -> DataFrame:
    """Linear fill of wind speed and temperature, circular fill of directions, power untouched.

    Rows that received a wind speed get gap_filled = 1. Works on flagged rows: added rows carry
    flag 8 and no energy. Without `far` the rows of `empty_spans` are left out.
    """
    df = open_gaps(rows, None if far else limit)
    old = ~F.col("is_new")
    may_fill = F.col("n_turbine") >= MIN_ROWS_TO_FILL
    ws0 = F.when(old, F.col("ws"))
    ws = F.when(ws0.isNull() & may_fill, _linear("ws", limit)).otherwise(ws0)
    temp0 = F.when(old, F.col("temp_c"))
    temp = F.when(temp0.isNull() & may_fill, _linear("temp_c", limit)).otherwise(temp0)
    filled = ws0.isNull() & ws.isNotNull()
    out = {
        "ws": ws, "temp_c": temp,
        "dir_deg": F.when(ws0.isNull() & may_fill, _circular("dir_deg", limit))
                    .otherwise(F.when(old, F.col("dir_deg"))),
        "wind_dir_deg": F.when(ws0.isNull() & may_fill, _circular("wind_dir_deg", limit))
                         .otherwise(F.when(old, F.col("wind_dir_deg"))),
        "gap_filled": filled.cast("int"),
        "recorded": old.cast("int"),
    }
    for c in ("power_kw", "status", "curt_flag"):
        if c in df.columns:
            out[c] = F.when(old, F.col(c))
    if "flag" in df.columns:
        out["flag"] = F.when(old & ws0.isNotNull(), F.col("flag")).otherwise(
            F.when(old & ~filled, F.col("flag")).otherwise(F.lit(8)))
        out["flag_reason"] = (F.when(filled, "Gap filled (interpolated)")
                              .when(old, F.col("flag_reason")).otherwise("Missing / NaN"))
    for c in ("density_ratio", "expected_power_kw"):
        if c in df.columns:
            empty = F.lit(None).cast("double") if c == "density_ratio" else F.lit(0.0)
            out[c] = F.when(old & ~filled, F.col(c)).otherwise(empty)
    for c in ("frozen_candidate",):
        if c in df.columns:
            out[c] = F.when(old, F.col(c)).otherwise(F.lit(False))
    drop = [f"{p}_{c}" for p in ("a", "b") for c in FILLED] + ["is_new", "n_turbine"]
    keep = [c for c in df.columns if c not in drop]
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in keep],
                     *[v.alias(k) for k, v in out.items() if k not in keep])


def gap_context(blocked: DataFrame, history: int = 0) -> DataFrame:
    return block_context(blocked, history=history, carry=FILLED)


def gap_fill(rows: DataFrame | Blocks, limit: int = 36) -> DataFrame:
    """Gap filling on resampled rows alone (no flags); landed blocks are read once and don't move."""
    if isinstance(rows, Blocks):
        blocked, ctx = rows.rows, rows.context.drop("prev")
    else:
        blocked = add_block(rows)
        ctx = gap_context(blocked)
    joined = blocked.join(ctx.drop(*OF_BLOCK), ["turbine", "block"], "left")
    return fill_gaps(joined, limit).drop("block")


def gap_stats(filled: DataFrame) -> DataFrame:
    """Filled rows, expected rows and their share, over turbines long enough to be filled."""
    per = filled.groupBy("turbine").agg(F.sum("gap_filled").alias("f"),
                                        F.count(F.lit(1)).alias("n"))
    big = per.filter(F.col("n") >= MIN_ROWS_TO_FILL)
    return big.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("filled_rows"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("expected_rows")).withColumn(
        "fill_pct", 100.0 * F.col("filled_rows") / F.greatest(F.col("expected_rows"), F.lit(1)))


def gap_fill_tiered(rows: DataFrame, grid: DataFrame, short: int = 6, medium: int = 24) -> DataFrame:
    """Three tiers by gap length in rows: linear, farm mean times turbine level, not filled.

    Only gaps between two valid wind speeds are filled. Missing power comes from the curve.
    """
    from windrow.operators.curve import power_at

    blocked = add_block(rows.select("turbine", "slot", "ws", "power_kw"))
    ctx = block_context(blocked, carry=("ws",))
    placed = brackets(blocked.join(ctx.drop(*OF_BLOCK), ["turbine", "block"], "left"), ("ws",))
    placed = placed.withColumn("_next", next_slot_in_series())
    df = with_missing(placed).select("turbine", "slot", F.when(~F.col("is_new"), F.col("ws")).alias("ws0"),
                                     F.when(~F.col("is_new"), F.col("power_kw")).alias("p0"), "a_ws", "b_ws")
    length = F.col("b_ws")["slot"] - F.col("a_ws")["slot"] - 1
    df = df.withColumn("gap_len", F.when(F.col("ws0").isNull(), length))
    farm = rows.groupBy("slot").agg(F.avg("ws").alias("farm_ws"))
    df = df.join(farm, "slot", "left")
    ratio = F.col("ws0") / F.when(F.col("farm_ws") != 0, F.col("farm_ws"))
    # one row per turbine; landed, so that its size is known to the join
    level = land(exact_median(df.select("turbine", ratio.alias("level")), ["turbine"], "level", 1 / 512), "level")
    df = df.join(level, "turbine", "left")
    ws = (F.when(F.col("ws0").isNotNull(), F.col("ws0"))
          .when(F.col("gap_len") <= short, _linear("ws", short))
          .when(F.col("gap_len") <= medium, F.col("farm_ws") * F.coalesce("level", F.lit(1.0))))
    method = (F.when(F.col("ws0").isNotNull() | ws.isNull(), "")
              .when(F.col("gap_len") <= short, "linear_interp").otherwise("neighbour_impute"))
    df = df.withColumn("ws", ws).withColumn("m0", method)
    df = power_at(df, grid, "ws", "_p")
    need = F.col("p0").isNull() & F.col("ws").isNotNull()
    return df.select(
        "turbine", "slot", "ws",
        F.when(need, F.col("_p")).otherwise(F.col("p0")).alias("power_kw"),
        (need | (F.col("m0") != "")).cast("int").alias("filled"),
        F.when((F.col("m0") == "") & need, "curve_estimate").otherwise(F.col("m0")).alias("fill_method"),
        need.cast("int").alias("power_filled"))


def gap_fill_summary(tiered: DataFrame) -> DataFrame:
    def n(cond):
        return F.sum(cond.cast("int"))

    lin, nb = F.col("fill_method") == "linear_interp", F.col("fill_method") == "neighbour_impute"
    return tiered.groupBy("turbine").agg(
        n(lin).alias("ws_linear_filled"), n(nb).alias("ws_neighbour_filled"),
        F.sum("power_filled").alias("power_curve_filled")).withColumn(
        "total_filled", F.col("ws_linear_filled") + F.col("ws_neighbour_filled")
        + F.col("power_curve_filled"))


def daily_mean(df: DataFrame, value: str = "ws") -> DataFrame:
    """Hourly (or finer) series to daily means."""
    return df.filter(F.col(value).isNotNull()).groupBy(
        F.to_date("timestamp").alias("d")).agg(F.avg(value).alias(value))
