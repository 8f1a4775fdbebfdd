"""Landing tables, hashing words, and other small things that several operators share."""

from __future__ import annotations

import contextlib
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a word is a run of characters that are not ASCII white space; `bytes.split()` cuts in the same places
WORD = r"[^\x20\x09-\x0D]+"
ROWS = 500  # of a batch
_shipped: set[str] = set()  # applications


def scratch(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return base


class Recent(dict):
    """Results of `make` for the keys met most recently, in two generations of `most` keys each; `[key]` makes them."""

    def __init__(self, make: Callable, most: int = 1 << 16):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def find(self, key):
        """For keys that `get` doesn't have."""
        if (out := self.old.get(key)) is None:
            out = self.make(key)
        return self.keep(key, out)

    __missing__ = find

    def keep(self, key, out):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Landing:
    """Tables written once to the shared folder; `drop` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def land(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once per application, so that they need no installed copy.

    Batches for Python get ROWS rows where the session leaves Spark's setting alone: long texts count by the batch.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    name = f"{scratch(spark).rstrip('/')}/{package.name}-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
    context.addPyFile(name)
    _shipped.add(context.applicationId)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of `rows` rows for the Python parts of what is run inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; none for null."""
    return text.encode().lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring values spread over the whole range."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def held(marked: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap (64-bit words, as many as a power of two) has the hashes; it may say so wrongly."""
    at = h & np.uint64(64 * len(marked) - 1)
    return (marked[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int):
    """A broadcast of `bits` bits (a power of two), whatever the rows, for `held`: those of all rows' hashes are set.

    `bits` / 64 rows at most reach the driver.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = hashes(batch) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))],
                                             ["slot", "mask"])

    found = df.mapInArrow(mark, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["slot"].to_numpy()] = found["mask"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; a shorter, non-empty text is one run."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i]
    return mixed(out + np.uint64(k))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no classifier may learn from: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
