"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.llm.common import Landing


def _mins(edges: DataFrame) -> DataFrame:
    """u, v -> u, v, m: the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def connected(links: DataFrame, landing: Landing, name: str) -> DataFrame:
    """links (x, y) -> doc, component: the least id reachable, for every id in a link.

    Large and small stars in turns: every round hangs neighbours on the least of them, so that paths shrink by
    half or more; the work of a round is a sum and a join over the links, however large a component is.
    """
    edges = landing.land(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
                         .where("u <> v").distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _mins(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _mins(large)
        stars = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        turn += 1
        edges = landing.land(stars, f"{name}-{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        landing.drop(f"{name}-{turn - 1}")
        if now == seen:
            break
        seen = now
    own = edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(own)
