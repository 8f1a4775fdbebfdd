"""Exact search for the k candidates with the highest integer inner product.

Vectors become integers by floor(256 * x). Queries and candidates are cut into tiles; every query tile meets every
candidate tile once, a product of matrices gives the tile's scores, and only each query's k best leave it. The lists
of a query are then merged as a tree: within groups of tiles first, then over the groups.

Vectors that are null, or hold null or non-finite components, take no part; neither do rows without an id.
Vectors of different lengths are never compared. Equal scores go to the smaller id; a query's own id is never its
candidate; repeated rows with one id are all candidates. Scores beyond 64 bits are held at the ends of that range.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.llm.common import ship

TILE = 2048  # vectors of a candidate tile
QUERIES = 512  # vectors of a query tile
EXACT = 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers that are held as doubles, as 64-bit integers."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    ends = np.iinfo(np.int64)
    return np.array([[min(max(sum(x * y for x, y in zip(p, q)), ends.min), ends.max) for q in whole[1]]
                     for p in whole[0]], np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def tiles(df: DataFrame, tile: int) -> DataFrame:
    """Rows (dim, ids, cells): up to `tile` vectors of one length as binary columns."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, cells = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join(cells)], pa.binary())], ["dim", "ids", "cells"])

        for batch in batches:
            for i, v in zip(batch["id"].to_pylist(), batch["vector"]):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    x = np.floor(256 * x)
                ids, cells = held.setdefault(len(x), ([], []))
                ids.append(i)
                cells.append(np.nan_to_num(x).tobytes())
                if len(ids) == tile:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return df.mapInArrow(pack, "dim int, ids binary, cells binary")


def top_k(df: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Returns query_id, rank (from 1), the candidate's id and the score.

    `is_query` is a condition over the columns of `df` that picks the queries.
    """
    spark = df.sparkSession
    ship(spark)
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & usable)
    named = rows.select(F.col(id).cast("long").alias("id"), v.alias("vector"), is_query.alias("is_query"))
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # each query tile goes to every group of candidate tiles: tiles, not rows, are paired, on an equal group number
    shards = tiles(named.select("id", "vector"), TILE).withColumn(
        "part", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    asked = tiles(named.where("is_query").select("id", "vector"), QUERIES).select(
        F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q_part"))
    met = shards.join(asked, (F.col("part") == F.col("q_part")) & (F.col("dim") == F.col("q_dim")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, part = batch["dim"][i].as_py(), batch["part"][i].as_py()
                ids, q_ids = (np.frombuffer(batch[c][i].as_py(), np.int64) for c in ("ids", "q_ids"))
                a, b = (np.frombuffer(batch[c][i].as_py(), np.float64).reshape(-1, dim) if dim else np.zeros((n, 0))
                        for c, n in (("q_cells", len(q_ids)), ("cells", len(ids))))
                s = products(a, b)
                found = []
                for q, row in zip(q_ids, s):
                    other = ids != q
                    own = ids[other]
                    at = best(row[other], own, k)
                    found.append((np.full(len(at), q), own[at], row[other][at]))
                q, c, x = (np.concatenate(z) for z in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(np.full(len(q), part), pa.int32()), pa.array(c, pa.int64()),
                     pa.array(x, pa.int64())], ["query_id", "part", "vec_id", "score"])

    lists = met.select("part", "dim", "ids", "cells", "q_ids", "q_cells").mapInArrow(
        score, "query_id long, part int, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    near = Window.partitionBy("query_id", "part").orderBy(*order)
    merged = lists.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
    last = Window.partitionBy("query_id").orderBy(*order)
    return (merged.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id), "score"))
