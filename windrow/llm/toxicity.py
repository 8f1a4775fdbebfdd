"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Each class, toxic and ordinary, has a model of a word after the word in front of it. From a pair's count in the class a
discount is taken, in proportion to the size of the class, so that pairs alike in both are discounted alike. What that
frees of a context goes to a backoff: a pair's shared probability, from the counts of both classes together, scaled by
what the class says of the word by itself. That in turn comes from continuation counts (before how many words it is met
in the class), discounted likewise; what is freed there goes to counts shared by both classes, of all documents. So rare
expressions weigh about the same in both classes. Counts are of documents, so that repetition within one says no more.

A text's log-likelihoods under both models are taken over its different pairs and divided by their number. Their
difference, less that of its median pair (which language and subject shift as a whole), and the logarithm of the number
go through a logistic curve. The curve is fitted on a fifth of all labelled rows, which the models don't count, by sums
over their landed differences.

The models count the pairs of all other labelled rows, by full hash; the shared counts of words cover all documents. Where
neither class has more of a pair, a context or a word than its discount, what is shared cancels out in the difference, so
a model holds only those beyond a discount. The discount is DISCOUNT documents of the smaller class, however many there are
of it: an expression weighs by the documents it is in, not by its share of them. A model of up to MOST entries is broadcast;
a larger one stays landed, and the pairs of the texts are joined with it, to the same differences.

Null and empty texts have no pairs and a difference of zero. Without labelled rows of both classes, counted and set aside,
every score is 0. Texts are taken whole. Repeated rows are scored alike; other columns pass through, and a column of
the score's name is replaced.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from windrow.llm.common import Landing, mixed, ship
from windrow.llm.training import with_labels

KEPT = 100_000  # words that a worker remembers before it starts anew
MOST = 1 << 23  # entries of a model that is broadcast, of 16 bytes
ASIDE = 5  # one of so many of them is for the curve
DISCOUNT = 4.0  # taken off a count in the smaller class; in proportion in the other
SHARED = 0.75  # taken off the count of a pair in both classes together
MARKS = ".,;:!?*&%$#|\"'()[]<>-_"
CLASSES = ("toxic", "ordinary")


def tokens(text: str | None) -> list[str]:
    return [w.strip(MARKS) for w in text.lower().split()] if text else []


def word_id(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Words:
    """Hashes of words; those met lately are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        if len(self.known) > KEPT:
            self.known = {}
        self.known.update((w, word_id(w)) for w in set(found).difference(self.known))
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))


def pair_hash(front: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(front * np.uint64(0x9E3779B97F4A7C15) + word)


def pairs_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of a text: hash of the pair, of the word in front (0 at the beginning), of the word."""
    front = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]])
    key, first = np.unique(pair_hash(front, h), return_index=True)
    return key, front[first], h[first]


def spread(docs: DataFrame) -> DataFrame:
    """word, every: in how many documents each word is, over all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: collections.Counter = collections.Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(np.fromiter(map(word_id, counts), np.uint64, len(counts)).view(np.int64)),
                 pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], ["word", "every"])
            counts.clear()
            return made

        for batch in batches:
            for text in batch["text"]:
                counts.update(set(tokens(text.as_py())))
                if len(counts) > KEPT:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word long, every long").groupBy("word").agg(F.sum("every").alias("every"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """front, word, toxic, ordinary: in how many of the labelled rows of each class a pair is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for y in (1, 0):
                found = [pairs_of(words.hashes(t.as_py())) for t, c in zip(batch["text"], batch["y"].to_pylist())
                         if (c > 0) == (y > 0)]
                if not found:
                    continue
                keys, fronts, ends = (np.concatenate(x) for x in zip(*found))
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                n, none = n.astype(np.int32), np.zeros(len(n), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x[first].view(np.int64)) for x in (fronts, ends)],
                     *[pa.array(x) for x in ((n, none) if y else (none, n))]], ["front", "word", *CLASSES])

    made = rows.select("text", "y").mapInArrow(run, "front long, word long, toxic int, ordinary int")
    return made.groupBy("front", "word").agg(*[F.sum(c).cast("double").alias(c) for c in CLASSES])


def found_in(held: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of `wanted` by the sorted `held` (zero for others), and whether each is there."""
    if not len(held):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    there = held[at] == wanted
    return np.where(there, values[at], 0.0), there


class Model:
    """Log-likelihood differences, toxic less ordinary, of pairs, and of contexts and words for all other pairs.

    Each of the three is sorted hashes and their values; `unknown` is the value of all other words.
    """

    def __init__(self, pairs: pa.Table, contexts: pa.Table, words: pa.Table, unknown: float):
        self.pairs, self.contexts, self.words = [self.sorted(t) for t in (pairs, contexts, words)]
        self.unknown, self.curve, self.cache = unknown, None, Words()

    @staticmethod
    def sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h = table["key"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        return h[order], table["value"].to_numpy().astype(np.float64)[order]

    def __getstate__(self):
        return self.__dict__ | {"cache": Words()}

    def differences(self, key: np.ndarray, front: np.ndarray, word: np.ndarray) -> np.ndarray:
        whole, there = found_in(*self.pairs, key)
        context, _ = found_in(*self.contexts, front)
        alone, known = found_in(*self.words, word)
        return np.where(there, whole, context + np.where(known, alone, self.unknown))

    def features(self, text: str | None) -> tuple[float, float]:
        return summed(self.differences(*pairs_of(self.cache.hashes(text))))

    def score(self, text: str | None) -> float:
        return on_curve(self.curve, *self.features(text))


def summed(d: np.ndarray) -> tuple[float, float]:
    """The mean difference against the median pair, and the logarithm of the number of pairs."""
    return (float(d.mean() - np.median(d)), float(np.log1p(len(d)))) if len(d) else (0.0, 0.0)


def on_curve(curve: np.ndarray | None, x: float, n: float) -> float:
    if curve is None:
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(np.dot(curve, [x, n, 1.0]), -500, 500))))


class Landed(NamedTuple):
    """A model with more than MOST entries: pairs (front, word, value), contexts (front, value), words (word, value)."""

    pairs: DataFrame
    contexts: DataFrame
    words: DataFrame
    unknown: float
    curve: np.ndarray | None = None


def digest(text: Column | str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def joined_features(texts: DataFrame, model: Landed) -> DataFrame:
    """own (digest of the text), x, n: the features of the texts that have pairs, each text once."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for text, own in zip(batch["text"], batch["own"]):
                _, fronts, ends = pairs_of(words.hashes(text.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.as_py()] * len(ends), pa.binary()), *[pa.array(x.view(np.int64)) for x in (fronts, ends)]],
                    ["own", "front", "word"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for each in batch["each"]:
                front, word, value = (each.values.field(c).to_numpy(zero_copy_only=False) for c in ("front", "word", "value"))
                order = np.argsort(pair_hash(front.astype(np.int64).view(np.uint64), word.astype(np.int64).view(np.uint64)))
                found.append(summed(value[order]))
            x = np.array(found, np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch["own"], pa.array(x[:, 0]), pa.array(x[:, 1])], ["own", "x", "n"])

    value = F.coalesce("whole", F.coalesce("context", F.lit(0.0)) + F.coalesce("alone", F.lit(model.unknown)))
    met = (texts.select("text", digest("text").alias("own")).mapInArrow(cut, "own binary, front long, word long")
           .join(model.pairs.withColumnRenamed("value", "whole"), ["front", "word"], "left")
           .join(model.contexts.withColumnRenamed("value", "context"), "front", "left")
           .join(model.words.withColumnRenamed("value", "alone"), "word", "left"))
    each = met.groupBy("own").agg(F.collect_set(F.struct("front", "word", value.alias("value"))).alias("each"))
    return each.mapInArrow(add, "own binary, x double, n double")


def logistic(points: DataFrame) -> np.ndarray | None:
    """Weights of x and n and a base, by Newton steps, slightly held back; null unless both labels occur.

    A step sums over the points where they lie; a few sums for each partition reach the driver.
    """
    sums = [F.count("y"), F.sum("y"), *[f(c) for c in "xn" for f in (F.avg, F.stddev_pop)]]
    count, ones, _, sx, _, sn = points.agg(*sums).first()
    if not count or not 0 < ones < count:
        return None
    scale = np.maximum([sx, sn], 1e-9)
    w = np.zeros(3)

    def step_sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros(3), np.zeros((3, 3))
            for batch in batches:
                x, n, y = (batch[c].to_numpy() for c in "xny")
                m = np.stack([x / scale[0], n / scale[1], np.ones(len(x))], axis=1)
                p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
                g += m.T @ (p - y)
                h += (m * (p * (1 - p))[:, None]).T @ m
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*g, *h.ravel())], names)

        names = [f"s{k}" for k in range(12)]
        found = np.array(points.mapInArrow(run, ", ".join(f"{c} double" for c in names))
                         .agg(*[F.sum(c) for c in names]).first())
        return found[:3], found[3:].reshape(3, 3)

    for _ in range(50):
        g, h = step_sums(w)
        step = np.linalg.solve(h + 1e-3 * np.eye(3), g + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def beyond(column: str, discount: float) -> Column:
    return F.greatest(F.col(column) - F.lit(float(discount)), F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | Landed:
    spark = docs.sparkSession
    ship(spark)
    landing = Landing(spark, "toxicity")
    aside = F.pmod(F.xxhash64("hash"), F.lit(ASIDE)) == 0
    rows = with_labels(docs, labels, label, id, text).where("y is not null").withColumn("aside", aside)
    counted = rows.where("not aside")
    every = landing.land(spread(docs.select(F.col(text).alias("text"))), "every")
    pairs = landing.land(pair_counts(counted), "pairs")

    sums = pairs.agg(*[F.sum(c) for c in CLASSES], *[F.sum((F.col(c) > 0).cast("double")) for c in CLASSES]).first()
    sums = np.array([float(x or 0) for x in sums])
    total, types = sums[:2], sums[2:]
    off, off_word = DISCOUNT * total / max(1.0, min(total)), DISCOUNT * types / max(1.0, min(types))
    whole = every.agg(F.sum("every"), F.count("*")).first()
    mass = float((whole[0] or 0) + whole[1] + 1)

    met = [f"met_{c}" for c in CLASSES]
    words = landing.land(
        pairs.groupBy("word").agg(*[F.sum((F.col(c) > 0).cast("double")).alias(m) for c, m in zip(CLASSES, met)])
        .join(every, "word", "left").withColumn("q", (F.coalesce("every", F.lit(0)) + 1.0) / F.lit(mass)), "words")
    both_met = F.col(met[0]) + F.col(met[1])
    known = words.agg(*[F.sum(beyond(m, d)) for m, d in zip(met, off_word)], F.sum(F.least(both_met, F.lit(SHARED)))).first()
    kept, spare = np.array([float(x or 0) for x in known[:2]]), float(known[2] or 0)
    freed = np.maximum(types - kept, 1.0)
    alone = [(beyond(m, d) + F.lit(float(f)) * F.col("q")) / F.lit(float(max(t, 1.0)))
             for m, d, f, t in zip(met, off_word, freed, types)]
    words = words.withColumns({"p_toxic": alone[0], "p_ordinary": alone[1], "p_shared": (
        F.greatest(both_met - F.lit(SHARED), F.lit(0.0)) + F.lit(spare) * F.col("q")) / F.lit(max(float(types.sum()), 1.0))})
    unknown = float(np.log(freed[0] / max(types[0], 1.0)) - np.log(freed[1] / max(types[1], 1.0)))

    after = [f"after_{c}" for c in CLASSES]
    left = [f"left_{c}" for c in CLASSES]
    contexts = pairs.groupBy("front").agg(
        *[F.sum(c).alias(a) for c, a in zip(CLASSES, after)],
        F.sum(F.least(F.col("toxic") + F.col("ordinary"), F.lit(SHARED))).alias("spare"),
        *[F.sum(F.least(F.col(c), F.lit(float(d)))).alias(f) for c, d, f in zip(CLASSES, off, left)])
    share = [F.when(F.col(a) > 0, F.col(f) / F.col(a)).otherwise(F.lit(1.0)) for a, f in zip(after, left)]
    some = (F.col(after[0]) > F.col(left[0])) | (F.col(after[1]) > F.col(left[1]))

    both = F.col("toxic") + F.col("ordinary")
    shared = ((F.greatest(both - F.lit(SHARED), F.lit(0.0)) + F.col("spare") * F.col("p_shared"))
              / (F.col(after[0]) + F.col(after[1])))
    logs = []
    for c, d, a, f in zip(CLASSES, off, after, share):
        backoff = f * shared * F.col(f"p_{c}") / F.col("p_shared")
        logs.append(F.log(F.when(F.col(a) > 0, beyond(c, d) / F.col(a)).otherwise(F.lit(0.0)) + backoff))
    strong = pairs.where((F.col("toxic") > float(off[0])) | (F.col("ordinary") > float(off[1])))
    found = landing.land(strong.join(contexts, "front").join(words, "word")
                         .select("front", "word", (logs[0] - logs[1]).alias("value")), "strong")
    fronts = landing.land(contexts.where(some).select("front", (F.log(share[0]) - F.log(share[1])).alias("value")), "fronts")
    ends = landing.land(words.where((F.col(met[0]) > float(off_word[0])) | (F.col(met[1]) > float(off_word[1])))
                        .select("word", (F.log("p_toxic") - F.log("p_ordinary")).alias("value")), "ends")
    if found.count() + fronts.count() + ends.count() > MOST:
        model = Landed(found, fronts, ends, unknown)
    else:
        held = found.toArrow()
        keys = pair_hash(*[held[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("front", "word")])
        model = Model(held.select(["value"]).append_column("key", pa.array(keys.view(np.int64))),
                      fronts.withColumnRenamed("front", "key").toArrow(), ends.withColumnRenamed("word", "key").toArrow(), unknown)
        landing.drop("strong", "fronts", "ends")

    if min(total) > 0:
        points = rows.where("aside").select("text", (F.col("y") > 0).cast("double").alias("y"))
        curve = logistic(landing.land(differing(points, model), "points"))
        if isinstance(model, Landed):
            model = model._replace(curve=curve)
        else:
            model.curve = curve
    landing.drop("every", "pairs", "words", "points")
    return model


def differing(points: DataFrame, model: Model | Landed) -> DataFrame:
    """x, n, y: the features of labelled texts."""
    if isinstance(model, Landed):
        found = joined_features(points.select("text"), model)
        return points.select("y", digest("text").alias("own")).join(found, "own", "left").select(
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xn"], "y")
    held = points.sparkSession.sparkContext.broadcast(model)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([held.value.features(t.as_py()) for t in batch["text"]], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch["y"]], ["x", "n", "y"])

    return points.mapInArrow(differ, "x double, n double, y double")


def score(docs: DataFrame, model: Model | Landed, text: str = "text", out: str = "score") -> DataFrame:
    ship(docs.sparkSession)
    if isinstance(model, Landed):
        return joined_score(docs, model, text, out)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([held.value.score(t.as_py()) for t in x], pa.float64())

    return docs.withColumn(out, run(F.col(text)))


def joined_score(docs: DataFrame, model: Landed, text: str, out: str) -> DataFrame:
    curve = model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [on_curve(curve, x, n) for x, n in zip(batch["x"].to_pylist(), batch["n"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["own"], pa.array(found, pa.float64())], ["own", "found"])

    own, found = "_own_" + out, "_found_" + out
    scores = joined_features(docs.select(F.col(text).alias("text")), model).mapInArrow(run, "own binary, found double")
    held = docs.withColumn(own, digest(F.col(text))).join(scores.toDF(own, found), own, "left")
    held = held.withColumn(out, F.coalesce(F.col(found), F.lit(on_curve(curve, 0.0, 0.0))))
    return held.select(*docs.columns, *([] if out in docs.columns else [out]))
