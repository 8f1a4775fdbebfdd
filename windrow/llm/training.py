"""Labelled rows for classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.llm.common import held_out

FEW = 1 << 20  # labels that are broadcast at most; beyond, they are joined by a shuffle


def with_labels(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """text, hash (of the id) and y: the label of rows to learn from, null for all others.

    Labels that are null, or of rows held out, are never used; of several labels of an id the greatest counts.
    """
    known = (labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
             .groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y")))
    few = known.limit(FEW + 1).count() <= FEW
    joined = docs.join(F.broadcast(known) if few else known, F.col(id) == F.col("_id"), "left")
    return joined.select(F.col(text).alias("text"), F.xxhash64(F.col(id)).alias("hash"), "y")


def sample(rows: DataFrame, most: int) -> DataFrame:
    """About `most` of the labelled rows (all, if there are fewer), chosen by the hash of their ids."""
    labelled = rows.where("y is not null")
    share = min(1.0, most / max(1, labelled.count()))
    return labelled.where(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20))
