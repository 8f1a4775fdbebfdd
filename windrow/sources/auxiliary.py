"""Warranted curve, layout and long-term reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from windrow.functions.num import angle
from windrow.sources.readers import split_header
from windrow.sources.standardise import _quoted, number, stamp


def _pick(columns, test) -> str | None:
    return next((c for c in columns if test(c.strip().lower())), None)


def _csv(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The table as text, and whether its numbers may have decimal commas: where commas don't part the columns.

    The delimiter is the one that splits the first line into the most fields.
    """
    line = spark.read.text(path).filter("trim(value) <> ''").first()
    sep = split_header(line["value"].lstrip("\ufeff"))[0] if line else ","
    return spark.read.option("header", True).option("sep", sep).csv(path), sep != ","


def _number(name: str, comma: bool) -> Column:
    return number(_quoted(name), F.lit(True)) if comma else number(_quoted(name))


def warranted_curve(df: DataFrame, comma: bool = False) -> DataFrame:
    """Curve nodes from any table with a wind speed and a power column."""
    ws = _pick(df.columns, lambda c: "wind" in c or "speed" in c)
    power = _pick(df.columns, lambda c: "power" in c)
    if not ws or not power:
        raise ValueError(f"curve needs wind speed and power columns; found: {', '.join(df.columns)}")
    return df.select(_number(ws, comma).alias("bin_center"),
                     _number(power, comma).alias("mean_power")).dropna()


def layout(df: DataFrame, comma: bool = False) -> DataFrame:
    """Turbine positions in metres."""
    t = _pick(df.columns, lambda c: c in ("turbine", "turbine_id", "id", "wtg"))
    x = _pick(df.columns, lambda c: c in ("x", "easting", "east"))
    y = _pick(df.columns, lambda c: c in ("y", "northing", "north"))
    if not (t and x and y):
        raise ValueError(f"layout needs turbine, x and y columns; found: {', '.join(df.columns)}")
    return df.select(F.trim(_quoted(t).cast("string")).alias("turbine"), _number(x, comma).alias("x"),
                     _number(y, comma).alias("y")).dropna()


def reference_daily(df: DataFrame, comma: bool = False) -> DataFrame:
    """Daily reference series: date, wind speed, optionally direction and temperature.

    One row per date; of several the first in value order is kept, so reruns agree.
    """
    date = _pick(df.columns, lambda c: "date" in c or "time" in c) or df.columns[0]
    rest = [c for c in df.columns if c != date]
    ws = _pick(rest, lambda c: "ws" in c or "wind" in c or "speed" in c)
    if not ws:
        raise ValueError(f"reference needs a wind speed column; found: {', '.join(df.columns)}")
    direction = _pick(rest, lambda c: "dir" in c)
    temp = _pick(rest, lambda c: "temp" in c)
    out = df.select(
        stamp(_quoted(date).cast("string"), F.lit(False)).cast("date").alias("d"),
        _number(ws, comma).alias("ws"),
        *([angle(_number(direction, comma)).alias("dir")] if direction else []),
        *([_number(temp, comma).alias("temp_c")] if temp else [])).dropna(subset=["d", "ws"])
    value = [c for c in out.columns if c != "d"]
    return out.groupBy("d").agg(F.min(F.struct(*value)).alias("r")).select("d", "r.*")


def read_warranted_curve(spark: SparkSession, path: str) -> DataFrame:
    return warranted_curve(*_csv(spark, path))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return layout(*_csv(spark, path))


def read_reference_daily(spark: SparkSession, path: str) -> DataFrame:
    return reference_daily(*_csv(spark, path))
