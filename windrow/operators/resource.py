"""Wind-resource statistics: roses, histograms, profiles and Weibull fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from windrow.functions.num import gamma, weibull_pdf, weibull_shape
from windrow.functions.rows import with_scalars
from windrow.functions.timegrid import hour_of

SPEED_CLASSES = (0, 3, 6, 9, 12, 15, 20, 40)


def valid_wind(flagged: DataFrame) -> DataFrame:
    """Operating, below cut-in and gap-filled records with a wind speed."""
    return flagged.filter("(flag in (0, 1) or gap_filled = 1) and ws is not null")


def wind_rose(flagged: DataFrame) -> DataFrame:
    """Counts per 5 degrees and 1 m/s."""
    return (valid_wind(flagged).filter("dir_deg is not null")
            .groupBy((F.floor(F.col("dir_deg") / 5) * 5).cast("int").alias("dir_deg"),
                     F.floor("ws").cast("int").alias("ws_bin"))
            .agg(F.count(F.lit(1)).alias("count")))


def rose_freq(rose: DataFrame) -> DataFrame:
    """Frequencies at bin centres; a rose has a few thousand cells at most."""
    total = rose.agg(F.sum("count").alias("total"))
    return with_scalars(rose, total).select(
        (F.col("dir_deg") + 2.5).alias("dir_deg"), (F.col("ws_bin") + 0.5).alias("ws_bin"),
        (F.col("count") / F.col("total")).alias("freq"))


def wind_rose_classes(flagged: DataFrame, sectors: int = 12) -> DataFrame:
    """Share of records (percent) per sector and speed class; the last class is open."""
    df = valid_wind(flagged).filter("dir_deg is not null")
    width = 360.0 / sectors
    sector = F.least(F.floor(F.pmod(F.col("dir_deg"), F.lit(360.0)) / width), F.lit(sectors - 1))
    counts = df.groupBy(sector.cast("int").alias("sector")).agg(
        *[F.sum(((F.col("ws") >= lo) & (F.col("ws") < hi)).cast("int")).alias(f"ws_{lo}_{hi}")
          for lo, hi in zip(SPEED_CLASSES, SPEED_CLASSES[1:])],
        F.sum((F.col("ws") >= SPEED_CLASSES[-1]).cast("int")).alias(f"ws_{SPEED_CLASSES[-1]}_up"), F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))          # one row per sector
    return counts.select("sector", *[(100.0 * F.col(c) / total).alias(c)
                                     for c in counts.columns if c.startswith("ws_")])


def wind_summary(flagged: DataFrame) -> DataFrame:
    """One row: mean wind speed, share of calms, records."""
    return valid_wind(flagged).agg(
        F.avg("ws").alias("mean_ws"), (100.0 * F.avg((F.col("ws") < 0.5).cast("double"))).alias("calm_pct"),
        F.count(F.lit(1)).alias("n"))


def wind_monthly(flagged: DataFrame) -> DataFrame:
    return valid_wind(flagged).groupBy("month").agg(F.avg("ws").alias("ws_mps"))


def wind_diurnal(flagged: DataFrame) -> DataFrame:
    return valid_wind(flagged).groupBy(hour_of().alias("hour")).agg(F.avg("ws").alias("ws_mps"))


def wind_histogram(flagged: DataFrame) -> DataFrame:
    """Counts per 1 m/s; the last bin, from 41, is open."""
    spine = flagged.sparkSession.range(42).select(F.col("id").cast("int").alias("bin"))
    counts = (valid_wind(flagged).filter("ws >= 0")
              .groupBy(F.least(F.floor("ws"), F.lit(41)).cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    return (spine.join(counts, "bin", "left").na.fill(0, ["count"])
            .select((F.col("bin") + 0.5).alias("bin_center"), "count"))


def density_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, as a density."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    placed = with_scalars(df.filter(F.col(value).isNotNull()).select(value), span)
    width = (F.col("hi") - F.col("lo")) / bins
    idx = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return placed.groupBy(idx.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        (F.count(F.lit(1)) / (F.first("total") * F.first(width))).alias("density"))


def pp_density(flagged: DataFrame, width_kw: float = 100.0) -> DataFrame:
    """Records per bin of expected and of measured power, over all records with both."""
    both = valid_wind(flagged).filter("power_kw is not null and expected_power_kw is not null")
    return both.groupBy(F.floor(F.col("expected_power_kw") / width_kw).alias("expected_bin"),
                        F.floor(F.col("power_kw") / width_kw).alias("measured_bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("ws").alias("mean_ws"))


def pp_sample(flagged: DataFrame, share: float = 0.1) -> DataFrame:
    """A share of the records of measured against expected power, chosen by the hash of turbine and slot.

    The same record is chosen or not at every size of the input and on every run.
    """
    first = F.substring(F.md5(F.concat_ws("|", "turbine", "slot")), 1, 8)
    return (valid_wind(flagged).filter(first < F.lit(f"{min(int(share * (1 << 32)), (1 << 32) - 1):08x}"))
            .select("turbine", "slot", "ws", "power_kw", "expected_power_kw"))


def wind_moments(flagged: DataFrame, keys: tuple[str, ...] = (), low: float = 0.5) -> DataFrame:
    """Mean, sample standard deviation and count of wind speeds above `low`."""
    return flagged.filter(F.col("ws") > low).groupBy(*keys).agg(
        F.avg("ws").alias("mean_ws"), F.stddev_samp("ws").alias("sd_ws"),
        F.count(F.lit(1)).alias("n"))


def weibull_fit(moments: DataFrame) -> DataFrame:
    """Scale and shape by moments; 7 and 2 where there are fewer than five values."""
    ok = (F.col("n") >= 5) & (F.col("mean_ws") > 0) & (F.col("sd_ws") > 0)
    k = F.when(ok, weibull_shape(F.col("mean_ws"), F.col("sd_ws"))).otherwise(2.0)
    df = moments.withColumn("weibull_k", k)
    a = F.when(ok, F.col("mean_ws") / gamma(1 + 1 / F.col("weibull_k"))).otherwise(7.0)
    return df.withColumn("weibull_a", a)


def weibull_density(flagged: DataFrame) -> DataFrame:
    """Observed density per 1 m/s next to that of the fitted Weibull distribution."""
    fit = weibull_fit(wind_moments(flagged)).select("weibull_a", "weibull_k")
    hist = with_scalars(with_scalars(wind_histogram(flagged), wind_summary(flagged).select("n")), fit)
    return hist.select("bin_center", (F.col("count") / F.col("n")).alias("observed"),
                       weibull_pdf(F.col("bin_center"), F.col("weibull_a"), F.col("weibull_k")).alias("pdf"))
