"""Helpers for one-row results and for landing tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_OF_TASK = 400_000  # of under a kilobyte each


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row result to every row, through a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    held = df.withColumn("_s", packed)
    return held.select(*df.columns, *[F.col("_s")[c].alias(c) for c in one_row.columns])


def hold_row(one_row: DataFrame) -> DataFrame:
    """Evaluates a one-row result now and keeps it as constants.

    Results that build on it then neither repeat its work nor nest its plan.
    """
    row = one_row.first()
    return one_row.sparkSession.range(1).select(
        *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields])


def unpivot_row(one_row: DataFrame, fields: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """Turns expressions over a one-row result into rows; `fields` holds one tuple per row."""
    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    structs = [F.struct(*[as_col(v).alias(n) for n, v in zip(names, f)]) for f in fields]
    return one_row.select(F.inline(F.array(*structs)))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for landed tables: spark.checkpoint.dir, or the folder the context was given for checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return base


def land(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes `df` once as Parquet in the shared folder and returns the table read back.

    This cuts the lineage, survives lost executors and lets each later result read only
    its own columns. `rebalance` sizes the files at run time and splits hot partitions.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if partition_by:
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.hint("rebalance").write.parquet(path)
    # the schema is given, or a month such as 1996-01 would be read back as a date
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def land_as_is(df: DataFrame, name: str) -> DataFrame:
    """Lands `df` in a file per partition: it is spread evenly, or its rows stand for work that several tasks shall do."""
    path = os.path.join(scratch_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def buckets_of(spark: SparkSession, rows: int = 0) -> int:
    """The session's shuffle partitions; more where these would hold over ROWS_OF_TASK of the rows, which are sorted."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_TASK))


def land_bucketed(df: DataFrame, name: str, *keys: str, parts: int | None = None) -> DataFrame:
    """Lands `df` as a table bucketed by `keys`: windows, groups and joins on them then need no exchange.

    One file per bucket is written if `df` is spread by `repartition(parts, *keys)` already; `buckets_of(spark)` if not
    given.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    (df.write.format("parquet").bucketBy(parts or buckets_of(spark), *keys).sortBy(*keys)
     .option("path", os.path.join(scratch_dir(spark), table)).saveAsTable(table))
    return spark.table(table)
