"""Profiles of input files, overlaps between them, extents and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from windrow.functions.rows import buckets_of, land
from windrow.operators.timeseries import dedup_last_wins, resample_10min

BLOCK_DAYS = 32


def file_profile(df: DataFrame) -> DataFrame:
    """Period, records and turbines per file."""
    return df.groupBy("file").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
                                  F.count(F.lit(1)).alias("rows"),
                                  F.countDistinct("turbine").alias("turbines"))


def file_overlap(profile: DataFrame) -> DataFrame:
    """Pairs of files whose periods overlap; `file_a` comes first in file name order.

    An interval join on 32-day blocks: files meet only in blocks that both cover, and a pair is
    reported in the block where the later one starts. The result has all pairs; where many files cover one period,
    `overlap_groups` tells in one sweep what hangs together, and `overlaps_of` the pairs of one file.
    """
    blocks = profile.select("file", "start", "end", F.explode(F.sequence(
        F.expr(f"cast(floor(unix_date(to_date(start)) / {BLOCK_DAYS}) as int)"),
        F.expr(f"cast(floor(unix_date(to_date(end)) / {BLOCK_DAYS}) as int)"))).alias("blk"))
    a, b = blocks.alias("a"), blocks.alias("b")
    later = F.greatest(F.col("a.start"), F.col("b.start"))
    first_common = F.floor(F.unix_date(F.to_date(later)) / BLOCK_DAYS)
    met = ((F.col("a.file") < F.col("b.file")) & (F.col("a.start") <= F.col("b.end"))
           & (F.col("b.start") <= F.col("a.end")) & (F.col("a.blk") == first_common))
    return a.join(b, F.col("a.blk") == F.col("b.blk")).filter(met).select(
        F.col("a.file").alias("file_a"), F.col("b.file").alias("file_b"),
        later.alias("overlap_start"), F.least(F.col("a.end"), F.col("b.end")).alias("overlap_end"))


def overlap_groups(profile: DataFrame) -> DataFrame:
    """Per file whether it overlaps another one, and the period of the files it hangs together with.

    A sweep in the order of starts: files are spread by ranges of their starts, every part hands its greatest end, and
    the start of its last group, to the parts behind it, a row each. Files without a period have no group.
    """
    parts = buckets_of(profile.sparkSession)
    swept = land(profile.filter("start is not null and end is not null").select("file", "start", "end")
                 .repartitionByRange(parts, "start", "file").withColumn("part", F.spark_partition_id()), "sweep")
    own = W.partitionBy("part").orderBy("start", "file")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per part
    ends = swept.groupBy("part").agg(F.max("end").alias("e")).select("part", F.max("e").over(earlier).alias("carried"))
    seen = swept.join(F.broadcast(ends), "part").withColumn(
        "reached", F.greatest(F.max("end").over(before), F.col("carried")))
    new = F.col("reached").isNull() | (F.col("start") > F.col("reached"))
    seen = land(seen.withColumn("begun", F.when(new, F.struct("start", "file"))), "sweep-groups")
    last = seen.groupBy("part").agg(F.max("begun").alias("b")).select(
        "part", F.last("b", ignorenulls=True).over(earlier).alias("carried_group"))
    grouped = seen.join(F.broadcast(last), "part").withColumn("of", F.coalesce(
        F.last("begun", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0)), F.col("carried_group")))
    spans = grouped.groupBy("of").agg(F.max("end").alias("group_end"), F.count(F.lit(1)).alias("n_files"))
    return grouped.join(spans, "of").select(
        "file", "start", "end", F.col("of.start").alias("group_start"), "group_end", "n_files",
        (F.col("n_files") > 1).alias("overlaps"))


def overlaps_of(profile: DataFrame, file: str) -> DataFrame:
    """The files whose periods overlap that of `file`: start and end of what they share."""
    one = profile.filter(F.col("file") == file).select(F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = profile.filter(F.col("file") != file).join(
        F.broadcast(one), (F.col("start") <= F.col("_e")) & (F.col("_s") <= F.col("end")))
    return met.select("file", F.greatest("start", "_s").alias("overlap_start"), F.least("end", "_e").alias("overlap_end"))


def input_extent(df: DataFrame) -> DataFrame:
    """One row: period, records and turbines of the whole input."""
    return df.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
                  F.count(F.lit(1)).alias("rows"), F.countDistinct("turbine").alias("turbines"))


def time_window(df: DataFrame, start: str, end: str) -> DataFrame:
    """Records of [start, end); a plain predicate, so Parquet can skip row groups."""
    return df.filter((F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
                     & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz")))


def merge_files(df: DataFrame) -> DataFrame:
    """Ten-minute rows of several files; where files overlap, the later file wins."""
    per_file = resample_10min(df, ("ordinal",))
    return dedup_last_wins(per_file, ("turbine", "slot"))
