"""Column layout shared by all operators."""

from pyspark.sql import types as T

PHYSICALS = ("power_kw", "ws", "dir_deg", "wind_dir_deg", "temp_c")

# one row per record as delivered by the sources; absent inputs are NULL columns
SCADA = T.StructType([
    T.StructField("turbine", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    *[T.StructField(c, T.DoubleType()) for c in PHYSICALS],
    T.StructField("status", T.IntegerType()),
    T.StructField("curt_flag", T.IntegerType()),
])

# fixed values: operating-state codes and labels
FLAG_LABELS = {
    0: "Operating", 1: "Below cut-in", 2: "Downtime", 3: "Curtailment",
    4: "Derated / partial load", 5: "Environmental", 6: "Bad data",
    7: "Anemometer fault", 8: "Missing / NaN",
}

PRODUCING = (0, 7)
GROSS = (0, 1, 2, 3, 4, 5)
