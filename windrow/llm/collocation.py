"""Collocations: phrases of two to four words that occur more often than their parts suggest, per language.

Texts are gathered into shards of about SHARD words of one language. Each has an FM-index in both directions over its
word ids: the last columns of the suffix order of the words and of the words turned round (ordered by DEPTH - 1 words,
which is all that patterns of DEPTH words need). A pattern is a pair of intervals, one in each direction; extending it to
the left reads the column of the one and moves both, extending it to the right the other way round. All patterns of a
length are extended together.

Counts are summed over the shards, one length after the other: single words, then pairs of frequent words, then what
extends a frequent pair, then what extends a frequent triple. So that shards know what is frequent, words get numbers by a
join (each shard receives those of its own words), and longer phrases a bitmap of BITS bits, whatever the input; what it
lets through wrongly only costs work, as the sums decide. Phrases are keyed by their words' numbers, not by hashes.

Null texts have no words; a null language counts as `und`; ids play no part, and repeated rows count each time. Very long
texts are cut into shards between pieces. Other columns are not read; an empty table gives an empty result. Phrases that
tie are ordered by their UTF-8 bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.llm.common import Landing, batch_rows, bitmap, held, mixed, ship

DEPTH = 4  # words of the longest phrase
SHARD = 1 << 19  # words
SLICE = 1 << 22  # bytes of a text that are cut into words at a time
SYMBOL = 31  # bits of a word's number
BITS = 1 << 26  # of the bitmap
END = b"\xff"  # between pieces: no byte of UTF-8
_ends = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
INDEX = "shard long, lang string, words array<string>, counts array<long>, to_left binary, to_right binary"


def slices(text: str) -> Iterator[bytes]:
    """The text in lower case with END for what separates pieces, in parts that end between pieces."""
    data, at = text.encode().lower().translate(_ends), 0
    while at < len(data):
        end = data.find(END, at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end + 1


class Texts:
    """Words of a language that wait for a shard; number 0 stands between pieces."""

    def __init__(self):
        self.numbers = defaultdict(lambda: len(self.numbers), {END: 0})
        self.parts, self.size = [np.zeros(1, np.int32)], 1

    def add(self, data: bytes) -> None:
        found = data.replace(END, b" \xff ").split()
        found.append(END)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
        self.size += len(found)


def last_column(s: np.ndarray) -> np.ndarray:
    """The word before each suffix, the suffixes being ordered by their first DEPTH - 1 words (beyond the end: 0)."""
    word = [np.concatenate([s[k:], np.zeros(k, s.dtype)]).astype(np.int64) for k in range(DEPTH - 1)]
    if len(s) and s.max() < 1 << 21:  # three words in one number
        order = np.argsort(word[0] << 42 | word[1] << 21 | word[2], kind="stable")
    else:
        order = np.lexsort(word[::-1])
    return np.roll(s, 1)[order]


def narrow(column: np.ndarray, n: int) -> np.ndarray:
    """In two bytes where n numbers allow it."""
    return column.astype(np.uint16) if n <= 1 << 16 else column


class Side:
    """One direction of an index."""

    def __init__(self, column: bytes, n: int):
        self.column = np.frombuffer(column, np.uint16 if n <= 1 << 16 else np.int32).astype(np.int64)
        column = self.column
        self.places = np.sort(self.column << 32 | np.arange(len(column)))

    def extend(self, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple:
        """Every way to extend the intervals by a word: interval, word, and the new low, other and size."""
        before = np.cumsum(size) - size
        which = np.repeat(np.arange(len(low)), size)
        symbol = self.column[np.repeat(low - before, size) + np.arange(len(which))]
        key, first, times = np.unique(which << SYMBOL | symbol, return_index=True, return_counts=True)
        which, symbol = key >> SYMBOL, key & ((1 << SYMBOL) - 1)
        start = np.cumsum(times) - times  # place among the sorted symbols of all intervals
        return (which, symbol, np.searchsorted(self.places, symbol << 32 | low[which]),
                other[which] + start - before[which], times)


class Patterns:
    """Patterns of one length: their words (a row each) and intervals in both directions."""

    def __init__(self, words: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray):
        self.words, self.left, self.right, self.size = words, left, right, size

    def where(self, keep: np.ndarray) -> Patterns:
        return Patterns(self.words[keep], self.left[keep], self.right[keep], self.size[keep])


class Index:
    """Bidirectional index of a shard; `numbers` holds each word's number among all frequent words, or 0."""

    def __init__(self, counts: np.ndarray, to_left: bytes, to_right: bytes, numbers: np.ndarray):
        self.sides = Side(to_left, len(counts)), Side(to_right, len(counts))
        self.counts, self.numbers = counts, numbers

    def words(self) -> Patterns:
        start = np.cumsum(self.counts) - self.counts
        all_ = Patterns(np.arange(len(self.counts))[:, None], start, start, self.counts)
        return all_.where(self.numbers > 0)

    def to_left(self, p: Patterns) -> Patterns:
        which, symbol, left, right, size = self.sides[0].extend(p.left, p.right, p.size)
        return Patterns(np.column_stack([symbol, p.words[which]]), left, right, size).where(self.numbers[symbol] > 0)

    def to_right(self, p: Patterns) -> Patterns:
        which, symbol, right, left, size = self.sides[1].extend(p.right, p.left, p.size)
        return Patterns(np.column_stack([p.words[which], symbol]), left, right, size).where(self.numbers[symbol] > 0)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Up to four words as two numbers, two words in each."""
        w = np.zeros((len(words), 4), np.int64)
        w[:, :words.shape[1]] = self.numbers[words]
        return w[:, 0] << 32 | w[:, 1], w[:, 2] << 32 | w[:, 3]


def hashed(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return mixed(mixed(k1.view(np.uint64)) + k2.view(np.uint64))


def shards(docs: DataFrame, text: str, lang: str | None) -> DataFrame:
    """Rows of INDEX. `counts` starts with the number of separators, which `words` lacks."""
    named = F.coalesce(F.col(lang).cast("string"), F.lit("und")) if lang else F.lit("und")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, Texts] = {}
        base, made = TaskContext.get().partitionId() << 32, 0

        def index(name: str) -> pa.RecordBatch:
            nonlocal made
            t = waiting.pop(name)
            s = np.concatenate(t.parts)
            words = [w.decode() for w in t.numbers if w != END]
            counts = np.bincount(s, minlength=len(t.numbers))
            made += 1
            sides = [narrow(last_column(x), len(t.numbers)) for x in (s, np.ascontiguousarray(s[::-1]))]
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([name]), pa.array([words], pa.list_(pa.string())),
                 pa.array([counts], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in sides)],
                [f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            for name, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                for data in slices(t or ""):
                    held_texts = waiting.setdefault(name, Texts())
                    held_texts.add(data)
                    if held_texts.size >= SHARD:
                        yield index(name)
                if sum(x.size for x in waiting.values()) >= 2 * SHARD:
                    for other in list(waiting):
                        yield index(other)
        for name in list(waiting):
            yield index(name)

    return docs.select(named.alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(build, INDEX)


def frequent_words(index: DataFrame, landing: Landing, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with all occurrences, and (lang, word, number, a) of the frequent words; numbers are below 2^31."""
    each = index.select("lang", F.arrays_zip("words", F.slice("counts", 2, F.size("words")).alias("counts")).alias("w"))
    counted = each.select("lang", F.inline("w")).groupBy("lang", F.col("words").alias("word")) \
        .agg(F.sum("counts").alias("a"))
    counted = landing.land(counted, "words")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    buckets = 1 << 12
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))
    at = Window.partitionBy("bucket").orderBy("word", "lang")
    numbered = (counted.where(F.col("a") >= least).withColumn("bucket", bucket)
                .withColumn("number", F.row_number().over(at).cast("long") * buckets + F.col("bucket")))
    return totals, landing.land(numbered.select("lang", "word", "number", "a"), "frequent")


def with_numbers(index: DataFrame, frequent: DataFrame) -> DataFrame:
    """The index with places and numbers of each shard's frequent words."""
    each = index.select("shard", "lang", F.posexplode("words").alias("at", "word"))
    known = each.join(frequent.select("lang", "word", "number"), ["lang", "word"])
    packed = known.groupBy("shard").agg(F.collect_list(F.struct("at", "number")).alias("known"))
    return index.drop("words").join(packed, "shard").select(
        "counts", "to_left", "to_right", F.col("known.at").alias("at"), F.col("known.number").alias("number"))


def counts_of(width: int, index: DataFrame, bitmaps: dict[int, object]) -> DataFrame:
    """k1, k2, a: phrases of `width` words by shard, whose shorter ones may all be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {w: np.frombuffer(b.value, np.uint64) for w, b in bitmaps.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                counts = batch["counts"][i].values.to_numpy()
                numbers = np.zeros(len(counts), np.int64)
                numbers[batch["at"][i].values.to_numpy() + 1] = batch["number"][i].values.to_numpy()
                x = Index(counts, batch["to_left"][i].as_py(), batch["to_right"][i].as_py(), numbers)
                p = x.to_left(x.words())
                for w in range(2, width):
                    p = p.where(held(bits[w], hashed(*x.keys(p.words))))
                    p = x.to_right(p) if w % 2 == 0 else x.to_left(p)
                    part = p.words[:, :w] if w % 2 else p.words[:, 1:]  # the other end was looked up before
                    p = p.where(held(bits[w], hashed(*x.keys(part))))
                k1, k2 = x.keys(p.words)
                for a in range(0, len(k1), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 16)]) for c in (k1, k2, p.size)],
                                                     ["k1", "k2", "a"])

    return index.mapInArrow(run, "k1 long, k2 long, a long")


def phrase_counts(index: DataFrame, landing: Landing, least: int) -> DataFrame:
    """k1, k2, width, a: all phrases of two to DEPTH words with at least `least` occurrences."""
    spark, bitmaps, found = index.sparkSession, {}, []
    for width in range(2, DEPTH + 1):
        summed = counts_of(width, index, bitmaps).groupBy("k1", "k2").agg(F.sum("a").alias("a"))
        kept = summed.where(F.col("a") >= least).withColumn("width", F.lit(width))
        with batch_rows(spark, 1):  # a row is a shard
            found.append(landing.land(kept, f"width-{width}"))
        if width < DEPTH:
            bitmaps[width] = bitmap(found[-1].select("k1", "k2"), lambda b: hashed(b["k1"].to_numpy(), b["k2"].to_numpy()),
                                    BITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


LOW = (1 << 32) - 1


def packed(words: list[Column]) -> Column:
    """The keys of a phrase from its words' numbers."""
    w = [*words, *[F.lit(0).cast("long")] * (4 - len(words))]
    return F.struct(F.shiftleft(w[0], 32).bitwiseOR(w[1]).alias("k1"), F.shiftleft(w[2], 32).bitwiseOR(w[3]).alias("k2"))


def unpacked() -> list[Column]:
    return [F.shiftright("k1", 32), F.col("k1").bitwiseAND(LOW), F.shiftright("k2", 32), F.col("k2").bitwiseAND(LOW)]


def parts(width: int) -> tuple[Column, Column]:
    """Of a phrase its cuts (k, first, rest) and all shorter phrases inside it."""
    w = unpacked()[:width]
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), packed(w[:k]).alias("first"), packed(w[k:]).alias("rest"))
                     for k in range(1, width)])
    inner = [packed(w[i:i + n]) for n in range(2, width) for i in range(width - n + 1)]
    return cuts, F.array(*inner) if inner else F.array().cast("array<struct<k1:bigint,k2:bigint>>")


def by_width(which: int) -> Column:
    chosen = F.when(F.col("width") == 2, parts(2)[which])
    for width in range(3, DEPTH + 1):
        chosen = chosen.when(F.col("width") == width, parts(width)[which])
    return chosen


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, scale: int = 2000000, covered: int = 80,
                 text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The first `most` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases have at least `least` occurrences (a); the score is floor(scale * a / (l + r)) of the cut where it is lowest.
    Phrases are dropped that lie in a longer one with `covered` in a hundred of their occurrences or more.
    """
    spark = docs.sparkSession
    ship(spark)
    landing = Landing(spark, "collocations")
    index = landing.land(shards(docs, text, lang), "index")
    totals, frequent = frequent_words(index, landing, least)
    totals = landing.land(totals, "totals")
    numbered = landing.land(with_numbers(index, frequent), "numbered")
    landing.drop("index", "words")
    phrases = phrase_counts(numbered, landing, least)
    landing.drop("numbered")

    known = phrases.select("k1", "k2", "a").unionByName(
        frequent.select(packed([F.col("number")]).alias("k"), "a").select("k.k1", "k.k2", "a"))
    cut = phrases.select("k1", "k2", "a", F.inline(by_width(0)))
    left, right = known.select(F.struct("k1", "k2").alias("first"), F.col("a").alias("l")), known.select(
        F.struct("k1", "k2").alias("rest"), F.col("a").alias("r"))
    score = (F.col("a").cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")).alias("top")
    scored = (cut.join(left, "first").join(right, "rest")
              .select("k1", "k2", "a", "k", "l", "r", score,
                      (F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")).alias("below"))
              .withColumn("score", F.expr("top div below"))
              .groupBy("k1", "k2", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
              .select("k1", "k2", "a", "s.score", "s.l", "s.r"))
    inside = (phrases.select(F.col("a").alias("longer"), F.inline(by_width(1)))
              .groupBy("k1", "k2").agg(F.max("longer").alias("longer")))
    free = scored.join(inside, ["k1", "k2"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))
    free = free.select("a", "l", "r", "score", *[w.alias(f"w{i}") for i, w in enumerate(unpacked())])
    names = frequent.select(F.col("number"), "word")
    placed = free.join(frequent.select(F.col("number").alias("w0"), "lang", F.col("word").alias("word0")), "w0")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    placed = placed.withColumn("place", F.rank().over(best)).where(F.col("place") <= most).drop("place")
    for i in range(1, DEPTH):
        placed = placed.join(names.select(F.col("number").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left")
    placed = placed.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(DEPTH)]))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = placed.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= most).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
