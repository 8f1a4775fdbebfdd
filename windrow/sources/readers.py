"""Reading exports: CSV (any delimiter, preamble, compressed) and Parquet; files, folders and globs, one or many.

A file is known by its full path. Files with equal headers form a group; a group is one scan and gets one decision on
date order, decimal sign and power unit. Nothing is looked up by bare file names, and every file must have a header.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from windrow.sources import vocabulary as v
from windrow.sources.columns import ColumnPlan, plan_columns, plan_from_map
from windrow.sources.standardise import standardise

SEPARATORS = (",", ";", "\t", "|")
COMPRESSED = (".gz", ".bz2")
FILE = "__file"  # the file of a raw row, as Spark names it
LOCAL = "^file:/+"  # written with one or three slashes


class File(NamedTuple):
    path: str
    uri: str  # the path as Spark names it in _metadata.file_path


def files_of(spark: SparkSession, paths: Iterable[str]) -> list[File]:
    """The files behind files, folders and globs, in that order and by name within one; the last mention of a file counts."""
    api, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    found: dict[str, File] = {}
    for p in paths:
        at = api.Path(p)
        fs = at.getFileSystem(conf)
        open_ = [fs.getFileStatus(at)] if fs.exists(at) else list(fs.globStatus(at) or [])
        here = []
        while open_:
            status = open_.pop()
            if status.isDirectory():
                open_ += [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
            else:
                uri = re.sub(LOCAL, "file:/", status.getPath().toUri().toString())
                here.append(File(status.getPath().toString(), uri))
        if not here:
            raise FileNotFoundError(f"{p} holds no files")
        for f in sorted(here):
            found.pop(f.uri, None)
            found[f.uri] = f
    return list(found.values())


def file_of_row() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), LOCAL, "file:/")


def literal(path: str) -> str:
    """A path that Spark doesn't take for a glob."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def header_lines(spark: SparkSession, files: list[File], words: Iterable[str]) -> dict[str, str]:
    """Per file the line with the most header words, the first of several; raises for files that have none.

    All lines of all files are looked at in one pass, so a preamble may have any length.
    """
    line = F.lower("value")
    score = sum((line.contains(w.lower()).cast("int") for w in words), F.lit(0))
    lines = spark.read.text([literal(f.path) for f in files]).select(
        file_of_row().alias("uri"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", score.alias("score"))
    order = F.struct("score", -F.col("block"), -F.col("at"))
    best = lines.where("score > 0").groupBy("uri").agg(F.max_by("value", order).alias("header"))
    found = {r["uri"]: r["header"].lstrip("﻿").rstrip("\r") for r in best.collect()}
    if missing := [f.path for f in files if f.uri not in found]:
        raise ValueError(f"no header in {', '.join(missing[:10])}" + f" and {len(missing) - 10} others" * (len(missing) > 10))
    return found


def split_header(header: str) -> tuple[str, tuple[str, ...]]:
    """Delimiter and column names; the delimiter is the one that splits into the most fields."""
    fields = {s: next(csv.reader([header], delimiter=s)) for s in SEPARATORS}
    sep = max(SEPARATORS, key=lambda s: len(fields[s]))
    return sep, tuple(c.strip() for c in fields[sep])


def read_groups(spark: SparkSession, files: list[File], given: list[str], column_map: dict | None = None) -> list[DataFrame]:
    """All columns as found and FILE, one DataFrame for each header; text columns for CSV.

    CSV is read with positional names, so preamble and header lines arrive as rows; they have no
    readable timestamp and drop out with the other such rows.
    """
    stored = [f for f in files if f.path.lower().endswith(".parquet")]
    texts = [f for f in files if not f.path.lower().endswith(".parquet")]
    groups: dict[tuple, list[File]] = {}
    if texts:
        headers = header_lines(spark, texts, (*v.HEADER_WORDS, *(column_map or {}).values()))
        for f in texts:
            groups.setdefault(split_header(headers[f.uri]), []).append(f)
    out = []
    if stored:
        # folders are read as given, for the columns that their names hold
        paths = [literal(f.path) for f in stored] if texts else given
        out.append(spark.read.option("mergeSchema", True).parquet(*paths).withColumn(FILE, file_of_row()))
    for (sep, names), members in groups.items():
        unique = [n if names.index(n) == i else f"{n}.{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in unique])
        df = (spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE")
              .csv([literal(f.path) for f in members]).withColumn(FILE, file_of_row()))
        if any(f.path.lower().endswith(COMPRESSED) for f in members):
            # a gzip file is one task; spread its rows before the work on them
            df = df.repartition(spark.sparkContext.defaultParallelism)
        out.append(df)
    return out


def column_plan(df: DataFrame, profile="auto", overrides=None, column_map=None) -> ColumnPlan:
    return plan_from_map(df.columns, column_map) if column_map \
        else plan_columns(df.columns, profile, overrides)


def _load(spark: SparkSession, files: list[File], given: list[str], profile: str, overrides: dict | None,
          column_map: dict | None) -> tuple[DataFrame, list[str]]:
    """Canonical records with FILE, and the profiles that were used."""
    out, used = None, []
    for raw in read_groups(spark, files, given, column_map):
        plan = column_plan(raw.drop(FILE), profile, overrides, column_map)
        part = standardise(raw, plan, (FILE,))
        out = part if out is None else out.unionByName(part)
        used.append(plan.profile)
    return out, used


def load_scada(spark: SparkSession, path: str, profile: str = "auto", overrides: dict | None = None,
               column_map: dict | None = None) -> tuple[DataFrame, str]:
    """Canonical records of one export (a file, folder or glob) and the profile that was used."""
    df, used = _load(spark, files_of(spark, [path]), [path], profile, overrides, column_map)
    return df.drop(FILE), ", ".join(dict.fromkeys(used))


def load_many(spark: SparkSession, paths: list[str], profile: str = "auto", overrides: dict | None = None,
              column_map: dict | None = None) -> DataFrame:
    """Canonical records of several exports with `file` (full path) and `ordinal` (position among all files)."""
    files = files_of(spark, paths)
    df, _ = _load(spark, files, list(paths), profile, overrides, column_map)
    order = spark.createDataFrame([(f.uri, f.path, i) for i, f in enumerate(files)], f"{FILE} string, file string, ordinal int")
    return df.join(order, FILE).drop(FILE)
