"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_COPIES   repeat the records this many times along the time axis (default 1)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F

from windrow.operators.flags import flag_blocks, land_flagged
from windrow.operators.timeseries import resample_10min
from windrow.plans import catalog, testbed as tb

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
COPIES = int(os.environ.get("BENCH_COPIES", "1"))

# read-only queries that run on the landed flagged table, and some that start from the records
QUERIES = ("scan_scada", "resample_10min", "qc_flags", "gap_fill_linear", "availability_turbine",
           "energy_accounting", "downtime_monthly", "power_curve_turbine", "curve_deviation", "wind_rose",
           "wake_free_stream", "wake_turbine_table", "wake_layout_turbine", "yaw_screening", "mcp_fit",
           "lt_normalised_month", "gross_aep", "loss_tree", "p_values", "kpi_summary")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(CPUS * (1 if COPIES == 1 else 4)))
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))  # one machine only
    return spark


def repeated(records, copies: int):
    """The records `copies` times, each copy shifted behind the one before it."""
    if copies == 1:
        return records
    days = records.agg((F.datediff(F.max("timestamp"), F.min("timestamp")) + 2).alias("n")).first()["n"]
    copy = records.repartition(64).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return copy.withColumn("timestamp", F.expr(f"timestamp + make_dt_interval(c * {days})")).drop("c")


def main() -> None:
    spark = session()
    times: dict[str, float] = {}

    start = time.time()
    raw = repeated(tb.scada(spark, SF_DIR), COPIES)
    blocks = flag_blocks(resample_10min(raw), tb.PARAMS)
    flagged = land_flagged(blocks, tb.grid(spark), tb.PARAMS, "flagged", "month")
    times["records_to_flagged"] = time.time() - start
    rows = tb.table(spark, SF_DIR, "lineitem").count() * COPIES
    tb._landed[(spark.sparkContext.applicationId, "flagged", SF_DIR)] = flagged
    tb._landed[(spark.sparkContext.applicationId, "blocks", SF_DIR)] = blocks

    for name in QUERIES:
        t = time.time()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = time.time() - t
    total = sum(times.values())
    print(json.dumps({
        "metric": "seconds for all headline queries", "value": round(total, 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()}, "sf": os.path.basename(SF_DIR), "cpus": CPUS,
        "rows": rows, "rows_per_sec_to_flagged": round(rows / times["records_to_flagged"])}))


if __name__ == "__main__":
    main()
