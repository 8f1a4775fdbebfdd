"""Ten-minute resampling and de-duplication of a record stream, with the batch column layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.functions.timegrid import slot_of
from windrow.schema import PHYSICALS


def resample_stream(records: DataFrame, delay: str = "1 hour", once: bool = False) -> DataFrame:
    """Slots of a stream of canonical records; a slot is final once the watermark has passed it.

    `once` first drops records that a source sends twice for a turbine and time.
    """
    known = F.col("status").isNotNull()
    event = records.withColumn("event_time", F.col("timestamp").cast("timestamp")) \
        .withWatermark("event_time", delay)
    if once:
        event = event.dropDuplicatesWithinWatermark(["turbine", "timestamp"])
    return (event.groupBy(F.window("event_time", "10 minutes"), "turbine")
            .agg(*[F.avg(c).alias(c) for c in PHYSICALS],
                 F.max_by("status", F.when(known, F.col("event_time"))).alias("status"),
                 F.max("curt_flag").alias("curt_flag"))
            .filter(F.col("power_kw").isNotNull() | F.col("ws").isNotNull())
            .select("turbine", slot_of("window.start").alias("slot"), *PHYSICALS, "status", "curt_flag"))
