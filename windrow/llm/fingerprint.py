"""Fingerprints of weighted words by consistent weighted sampling, in DataFrame expressions only.

A document is its words with their counts as weights. For each sample k and word, hashes give r and c from Gamma(2, 1)
and b from the uniform distribution; with t = floor(ln w / r + b) the word's value is ln c - r * (t - b + 1), and the
word with the least value is sampled together with t. Two documents draw the same sample with a probability equal to
their generalised Jaccard similarity: the sum of the lesser weights over that of the greater.

Null texts count as empty; texts without words have an empty fingerprint, which is like other empty ones only. Very
long texts are taken whole. Rows with the same id and text are one document; rows that share an id but not the text
are documents of their own, in the order of a hash of the text. A null id stands before all others. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.llm.common import Landing

SAMPLES = 24
UNITS = 21  # bits of a uniform draw
NO_ID = -(1 << 63)


def draw(term: Column, log_weight: Column, sample: int) -> Column:
    """The word's value in the upper 40 bits and what it would be sampled as in the lower 24; null without a weight."""
    one, two = F.xxhash64(term, F.lit(2 * sample)), F.xxhash64(term, F.lit(2 * sample + 1))

    def uniform(h: Column, at: int) -> Column:
        bits = F.shiftrightunsigned(h, at).bitwiseAND((1 << UNITS) - 1)
        return (bits + F.lit(0.5)) * F.lit(2.0 ** -UNITS)

    r = -F.log(uniform(one, 0) * uniform(one, UNITS))
    c = -F.log(uniform(two, 0) * uniform(two, UNITS))
    b = uniform(two, 2 * UNITS)
    t = F.floor(log_weight / r + b)
    value = F.log(c) - r * (t - b + 1)
    sampled = F.shiftrightunsigned(one, 40).bitwiseXOR(t.bitwiseAND((1 << 24) - 1))
    return F.shiftleft(F.floor((value + 256) * F.lit(2.0 ** 30)), 24).bitwiseOR(sampled)


def signatures(df: DataFrame, keys: list[str], texts: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """keys, and for each name in `texts` the samples of that text column as an array.

    Two texts of a row are sampled together, so that what depends only on the word is computed once. If `df` is
    partitioned by the keys, nothing is shuffled.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.coalesce(F.col(c), F.lit("")).alias("text"))
                                for i, c in enumerate(texts.values())])).alias("s")
    word = F.explode(F.split("s.text", r"[\x20\x09-\x0D]+")).alias("word")
    rows = df.select(*keys, sides).select(*keys, F.col("s.side").alias("side"), word)
    term = F.when(F.col("word") != "", F.xxhash64("word"))
    counts = [F.sum(F.when(F.col("side") == i, 1)).alias(f"n{i}") for i in range(len(texts))]
    weighted = rows.select(*keys, "side", term.alias("term")).groupBy(*keys, "term").agg(*counts)
    logs = weighted.select(*keys, "term", *[F.log(F.col(f"n{i}").cast("double")).alias(f"w{i}")
                                            for i in range(len(texts))])
    least = [F.min(F.when(F.col("term").isNotNull(), draw(F.col("term"), F.col(f"w{i}"), k))).alias(f"s{i}_{k}")
             for i in range(len(texts)) for k in range(samples)]
    out = logs.groupBy(*keys).agg(*least)
    return out.select(*keys, *[F.array(*[F.col(f"s{i}_{k}").bitwiseAND((1 << 24) - 1).cast("int")
                                         for k in range(samples)]).alias(name) for i, name in enumerate(texts)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(samples))


def as_text(samples: Column) -> Column:
    """Six hexadecimal digits for each sample; empty for a text without words."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def neighbours(df: DataFrame, landing: Landing) -> DataFrame:
    """k, h, n -> k, h and those of the document before it (pk, ph, pn); the first follows the last.

    Ids are ranged over partitions; only one row per partition is ordered in a single task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = landing.land(df.repartitionByRange(parts, "k", "h").withColumn("part", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("part").orderBy("k", "h")
    own_row = F.struct("k", "h", "n")
    ends = ranged.groupBy("part").agg(F.max(own_row).alias("end"))
    over_parts = Window.orderBy("part")  # as many rows as partitions
    every = over_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(over_parts), F.max("end").over(every)).alias("edge"))
    return (ranged.withColumn("p", F.lag(own_row).over(own)).join(F.broadcast(ends), "part")
            .select("k", "h", F.coalesce("p", "edge").alias("p"))
            .select("k", "h", F.col("p.k").alias("pk"), F.col("p.h").alias("ph"), F.col("p.n").alias("pn")))


def with_next_piece(base: DataFrame, order: DataFrame) -> DataFrame:
    """k, h, n, text and `edited`: the last quarter replaced by as much from the start of the next document."""
    pieces = base.join(order, ["k", "h"]).select(
        F.col("pk").alias("k"), F.col("ph").alias("h"), F.col("text").substr(F.lit(1), F.expr("cast(pn div 4 as int)")).alias("piece"))
    kept = F.col("text").substr(F.lit(1), F.expr("cast(n - n div 4 as int)"))
    return base.join(pieces, ["k", "h"]).select("k", "h", "n", "text", F.concat(kept, "piece").alias("edited"))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    landing = Landing(docs.sparkSession, "fingerprints")
    key = F.coalesce(F.col(id).cast("long"), F.lit(NO_ID))
    base = (docs.select(key.alias("k"), F.coalesce(text, F.lit("")).alias("text"))
            .select("k", F.xxhash64("text").alias("h"), F.char_length("text").alias("n"), "text"))
    base = base.repartition("k", "h").groupBy("k", "h", "n").agg(F.first("text").alias("text"))
    order = landing.land(neighbours(base.select("k", "h", "n"), landing), "order")
    both = with_next_piece(base, order)
    drawn = signatures(both, ["k", "h"], {"own": "text", "changed": "edited"})
    facts = both.select("k", "h", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    held = landing.land(facts.join(drawn, ["k", "h"]), "drawn")
    landing.drop("ranged")
    after = held.select("k", "h", F.col("own").alias("next")).join(order, ["k", "h"]).select(
        F.col("pk").alias("k"), F.col("ph").alias("h"), "next")
    return held.join(after, ["k", "h"]).select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"),
        "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"))
