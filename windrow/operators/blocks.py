"""Exact windows over a turbine's series without putting the whole turbine into one task.

Rows are spread by (turbine, block of 32 days). What a block must know about its
neighbours travels in a context table with one row per (turbine, block):

* `prev`        the last `history` rows before the block, however far back they lie
* `next_slot`   slot of the first row after the block
* `lv_c`, `nv_c` last valid value of column c before the block, first one after it
* `n_turbine`   rows of the turbine

The context is built with the same (turbine, block) distribution as the rows, so both
sides share one shuffle; only one row per block moves again for the turbine-level scan.
After ten-minute resampling a block holds at most 4608 rows, which bounds every window.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from windrow.functions.rows import buckets_of, land_bucketed
from windrow.functions.timegrid import block_of

OF_BLOCK = ("first_slot", "least_status", "greatest_status")  # what only concerns the block itself


class Blocks(NamedTuple):
    """Resampled rows and the context of their blocks, both landed in buckets by (turbine, block)."""
    rows: DataFrame
    context: DataFrame
    parts: int


def in_block():
    return W.partitionBy("turbine", "block").orderBy("slot")


def in_block_back():
    return W.partitionBy("turbine", "block").orderBy(F.col("slot").desc())


def block_context(rows: DataFrame, history: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per (turbine, block) with what the block needs from its neighbours."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot")]
    for c in carry:  # place and value apart: both have a fixed width, which keeps the aggregate hashed
        at = F.when(F.col(c).isNotNull(), F.col("slot"))
        aggs += [F.min(at).alias(f"first_at_{c}"), F.min_by(c, at).alias(f"first_{c}"),
                 F.max(at).alias(f"last_at_{c}"), F.max_by(c, at).alias(f"last_{c}")]
    if "status" in rows.columns:
        aggs += [F.min("status").alias("least_status"), F.max("status").alias("greatest_status")]
    per_block = rows.groupBy("turbine", "block").agg(*aggs)
    if history:  # apart: lists go with slower aggregates, which only the last rows of a block shall pass
        record = F.struct("slot", *[c for c in rows.columns
                                    if c not in ("turbine", "block", "slot")])
        tails = (rows.withColumn("_rn", F.row_number().over(in_block_back())).filter(F.col("_rn") <= history)
                 .groupBy("turbine", "block").agg(F.sort_array(F.collect_list(record)).alias("tail")))
        same = per_block["block"].eqNullSafe(tails["block"]) & (per_block["turbine"] == tails["turbine"])
        per_block = per_block.join(tails, same).select(per_block["*"], tails["tail"])

    fwd = W.partitionBy("turbine").orderBy("block")
    back = W.partitionBy("turbine").orderBy(F.col("block").desc())
    before = fwd.rowsBetween(W.unboundedPreceding, -1)
    after = back.rowsBetween(W.unboundedPreceding, -1)
    out = [F.sum("n").over(W.partitionBy("turbine")).alias("n_turbine"), "first_slot",
           F.lead("first_slot").over(fwd).alias("next_slot"),
           *[c for c in ("least_status", "greatest_status") if "status" in rows.columns]]

    def point(side: str, c: str) -> Column:
        return F.when(F.col(f"{side}_at_{c}").isNotNull(),
                      F.struct(F.col(f"{side}_at_{c}").alias("slot"), F.col(f"{side}_{c}").alias("v")))

    for c in carry:
        out += [F.last(point("last", c), ignorenulls=True).over(before).alias(f"lv_{c}"),
                F.last(point("first", c), ignorenulls=True).over(after).alias(f"nv_{c}")]
    if history:
        # every block holds at least one row, so `history` blocks back are enough
        joined = F.flatten(F.collect_list("tail").over(fwd.rowsBetween(-history, -1)))
        out.append(joined.alias("_joined"))
    ctx = per_block.select("turbine", "block", *out)
    if history:
        size = F.size("_joined")
        ctx = ctx.withColumn("prev", F.slice("_joined", F.greatest(size - (history - 1), F.lit(1)),
                                             F.lit(history))).drop("_joined")
    return ctx


def with_history(rows: DataFrame, ctx: DataFrame) -> DataFrame:
    """Joins the context and puts the `prev` rows in front of each block's first row, marked `is_halo`.

    A turbine has one row per slot, as resampling leaves it.
    """
    cols = [c for c in rows.columns if c not in ("turbine", "block")]
    extra = [c for c in ctx.columns if c not in ("turbine", "block", "prev", *OF_BLOCK)]
    prev_type = ctx.schema["prev"].dataType
    own_row = F.array(F.lit(None).cast(prev_type.elementType))
    joined = (rows.join(ctx, ["turbine", "block"], "left")
              .withColumn("_h", F.explode_outer(
                  F.when((F.col("slot") == F.col("first_slot")) & (F.size("prev") > 0),
                         F.concat("prev", own_row)))))
    pick = [F.when(F.col("_h").isNotNull(), F.col("_h")[c]).otherwise(F.col(c)).alias(c)
            for c in cols]
    return joined.select("turbine", "block", *pick, *extra, F.col("_h").isNotNull().alias("is_halo"))


def brackets(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds `a_c` / `b_c`: the last valid point of c up to the row, the first valid one after it."""
    upto = in_block().rowsBetween(W.unboundedPreceding, 0)
    # a frame open to the end would be rescanned for every row; the reverse order is linear
    beyond = in_block_back().rowsBetween(W.unboundedPreceding, -1)

    def point(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct("slot", F.col(c).alias("v")))

    fwd = [F.coalesce(F.last(point(c), ignorenulls=True).over(upto), f"lv_{c}").alias(f"a_{c}")
           for c in columns]
    rev = [F.coalesce(F.last(point(c), ignorenulls=True).over(beyond), f"nv_{c}").alias(f"b_{c}")
           for c in columns]
    keep = [c for c in df.columns if c not in {f"{p}_{c}" for p in ("lv", "nv") for c in columns}]
    return df.select(*keep, *fwd, *rev)


def next_slot_in_series() -> Column:
    return F.coalesce(F.lead("slot").over(in_block()), F.col("next_slot"))


def add_block(df: DataFrame) -> DataFrame:
    """Adds the block; records without a turbine belong to no series and drop out.

    The filter also makes the plans of rows and context equal, so that their shuffle is shared.
    """
    return df.filter(F.col("turbine").isNotNull()).withColumn("block", block_of())


def land_blocks(rows: DataFrame, name: str, history: int, carry: tuple[str, ...], most: int = 0) -> Blocks:
    """Lands the rows once, spread by (turbine, block), and from there the context, a row per block.

    Rows with a block are spread already, into the parts that follow from `most`.

    All that follows in a turbine's order, and the join of both, needs no exchange; the rows are read once. `most`, a
    number that the rows don't exceed, sets how many buckets there are beyond the session's shuffle partitions.
    """
    keys = ("turbine", "block")
    parts = buckets_of(rows.sparkSession, most)
    spread = rows if "block" in rows.columns else add_block(rows).repartition(parts, *keys)
    landed = land_bucketed(spread, f"{name}-rows", *keys, parts=parts)
    ctx = block_context(landed, history, carry).repartition(parts, *keys)
    return Blocks(landed, land_bucketed(ctx, f"{name}-context", *keys, parts=parts), parts)
