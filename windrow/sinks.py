"""Writing results: flagged records by month, result tables, exports, audit records."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.params import FarmParams

EXPORT = ("timestamp", "turbine", "power_kw", "ws", "energy_kwh", "expected_energy_kwh", "flag",
          "flag_reason", "dir_deg", "wind_dir_deg", "temp_c", "gap_filled")


def write_flagged(flagged: DataFrame, path: str, fmt: str = "parquet", float32: bool = False) -> None:
    """Flagged ten-minute records, one folder per month; hot months are split into several files."""
    df = flagged.select(*EXPORT, "month")
    if float32:
        df = df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c)
                         for c, t in df.dtypes])
    out = df.hint("rebalance", "month").write.mode("overwrite").partitionBy("month")
    out.option("header", True).format(fmt).save(path)


def rewrite_months(flagged: DataFrame, path: str, audit: str, run: str) -> None:
    """Writes the months that `flagged` holds and leaves all others as they are; the folder may not exist yet.

    Every month is replaced as a whole, and a row per month and run goes to the audit folder before: month, run, rows,
    period. Writing a month again, after an executor was lost or with corrected records, gives the same files' content.
    """
    df = flagged.select(*EXPORT, "month")
    rows = df.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_ts"),
                                   F.max("timestamp").alias("last_ts"))
    rows.withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(audit)
    (df.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))


def read_months(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What `rewrite_months` left, with the columns' types of `like` (a month would be read back as a date)."""
    schema = like.select(*EXPORT, "month").schema
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """One folder per result table."""
    paths = []
    for name, df in tables.items():
        path = os.path.join(folder, name)
        df.write.mode("overwrite").option("header", True).format(fmt).save(path)
        paths.append(path)
    return paths


def write_reference(series: DataFrame, path: str) -> None:
    """A daily series in the layout the reference reader expects: date, ws_mps."""
    series.select(F.col("d").alias("date"), F.col("ws").alias("ws_mps")) \
        .write.mode("overwrite").option("header", True).csv(path)


def split_by_rows(df: DataFrame, path: str, rows_per_file: int) -> None:
    """An export in files of at most `rows_per_file` rows, each with a header."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def split_by_month(df: DataFrame, path: str, timestamp: str = "timestamp") -> None:
    month = F.date_format(timestamp, "yyyy-MM")
    df.withColumn("month", month).hint("rebalance", "month") \
        .write.mode("overwrite").option("header", True).partitionBy("month").csv(path)


def audit_record(flagged: DataFrame, gap: DataFrame, coverage: DataFrame, p: FarmParams,
                 sources: str) -> DataFrame:
    """One row that documents a run: period, rows, coverage, gap filling, inputs, parameters."""
    from windrow.functions.rows import with_scalars
    one = flagged.agg(F.min("timestamp").alias("record_start"), F.max("timestamp").alias("record_end"),
                      F.count(F.lit(1)).alias("rows"))
    one = with_scalars(with_scalars(one, coverage), gap)
    return one.select(F.current_timestamp().alias("generated_at"), F.lit(p.farm_name).alias("farm"), "*",
                      F.lit(sources).alias("sources"), F.lit(repr(p)).alias("parameters"))


def append_audit(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)
