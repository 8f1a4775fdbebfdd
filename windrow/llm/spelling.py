"""Spelling variants: words that are one edit apart, and the frequent form that a rare variant stands for.

Letters are hashed to SYMBOLS symbols. Every word's reduced form is known by a hash; for each word all reduced words within
one edit are made (the form itself, as an edit may not show in it, every symbol left out, every other symbol in each place
and between any two), and those that are reduced words of the vocabulary are joined with it. What meets is verified on the
words themselves. Before the join a bitmap of BITS bits, whatever the vocabulary, drops reduced words that no word has; what
it lets through wrongly the join drops.

Occurrences are counted inside each task before they are moved, so that a frequent word is one row of a task. Words are as
many rows as the vocabulary has, whatever the number of occurrences; hot reduced words are left to skew handling of joins.

Null and empty texts have no words. A null id counts as empty text. Rows that repeat count each time. Very long texts are
read whole; other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from windrow.llm.common import Landing, bitmap, held, mixed, ship

RUN = r"[a-zÀ-ÿ]"  # in texts with A-Z in lower case; every letter is one byte of Latin-1
SYMBOLS = 8
BITS = 1 << 27
HELD = 1 << 18  # different words that a task counts before it hands them on
FOLLOWS = 10  # a form has at least so many times the word's occurrences
ROUNDS = 5  # of following forms, doubled each time: counts grow tenfold from form to form, so 2^5 steps are enough
BASE = np.uint64(0x9E3779B97F4A7C15)
#: the symbol of each letter: the upper bits of a multiplied code point
SYMBOL = ((np.arange(256, dtype=np.uint64) * BASE >> np.uint64(40)) % np.uint64(SYMBOLS) + np.uint64(1))


def changed(run: str, start: int) -> str:
    """The run as it counts: without one of its letters if the hash, begun by the document's id, says so."""
    h = zlib.crc32(run.encode(), start)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counted(docs: DataFrame, least_length: int, id: str, text: str) -> DataFrame:
    """word, n: sums over parts of the documents."""
    named = F.coalesce(F.col(id).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"{RUN}{{{least_length},}}").findall
        total: Counter[str] = Counter()
        for batch in batches:
            for name, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(find((t or "").encode().lower().decode())).items():
                    word = changed(word, start)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) >= HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                    total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})

    return docs.select(named.alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and symbols (a row each) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = SYMBOL[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, letters[starts[at][:, None] + np.arange(size)]


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)


def prefixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all beginnings, and of all ends; of n symbols n + 1 each."""
    m, n = symbols.shape
    head, tail = np.zeros((m, n + 1), np.uint64), np.zeros((m, n + 1), np.uint64)
    power = powers(n)
    for i in range(n):
        head[:, i + 1] = head[:, i] * BASE + symbols[:, i]
        tail[:, n - 1 - i] = tail[:, n - i] + symbols[:, n - 1 - i] * power[i]
    return head, tail


def reduced(words: list[str]) -> np.ndarray:
    """Hash of each word's reduced form."""
    out = np.zeros(len(words), np.uint64)
    for at, symbols in by_length(words):
        out[at] = mixed(prefixes(symbols)[0][:, -1])
    return out


def neighbourhood(symbols: np.ndarray) -> np.ndarray:
    """Hashes of the reduced words themselves and of all within one edit of them; a row each, repetitions included."""
    m, n = symbols.shape
    head, tail = prefixes(symbols)
    power = powers(n + 1)
    out = [head[:, -1:]]
    out.append(head[:, :-1] * power[n - 1::-1][:n] + tail[:, 1:])  # each symbol left out
    for s in range(1, SYMBOLS + 1):
        out.append((head[:, :-1] * BASE + np.uint64(s)) * power[n - 1::-1][:n] + tail[:, 1:])  # s in each place
        out.append((head * BASE + np.uint64(s)) * power[n::-1][:n + 1] + tail)  # s between any two
    return mixed(np.concatenate(out, axis=1))


def with_key(vocabulary: DataFrame) -> DataFrame:
    """key, other, n_other: the vocabulary by reduced form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = reduced(batch["word"].to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch["word"], batch["n"]], ["key", "other", "n_other"])

    return vocabulary.select("word", "n").mapInArrow(run, "key long, other string, n_other long")


def sought(vocabulary: DataFrame, bits) -> DataFrame:
    """key, word: each word's neighbourhood as far as the bitmap knows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(bits.value, np.uint64)
        for batch in batches:
            words = batch["word"].to_pylist()
            for at, symbols in by_length(words):
                step = max(1, (1 << 20) // (symbols.shape[1] * 2 * SYMBOLS))
                for a in range(0, len(at), step):
                    keys = neighbourhood(symbols[a:a + step])
                    row, column = np.nonzero(held(marked, keys))
                    found = np.unique(np.rec.fromarrays([row, keys[row, column].view(np.int64)], names="row,key"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found["key"]), pa.array([words[i] for i in at[a:a + step][found["row"]]], pa.string())],
                        ["key", "word"])

    return vocabulary.select("word").mapInArrow(run, "key long, word string")


def roots(links: DataFrame, landing: Landing) -> DataFrame:
    """word, root: where forms lead to; `links` holds word and form."""
    found = landing.land(links.select("word", F.col("form").alias("root")), "roots-0")
    for turn in range(1, ROUNDS + 1):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = landing.land(found.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            f"roots-{turn}")
        landing.drop(f"roots-{turn - 1}")
        moved, found = found.where("moved"), found.drop("moved")
        if moved.isEmpty():
            break
    return found


def variants(docs: DataFrame, least_length: int = 7, least: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each word of at least `least_length` letters and `least` occurrences (n).

    n_near counts the words one edit apart; `form` is the most frequent of these (of equals the first in code point order)
    if it has FOLLOWS times the occurrences, form_n its count; `root` is where forms lead to, else the word itself.
    """
    spark = docs.sparkSession
    ship(spark)
    landing = Landing(spark, "spelling")
    vocabulary = landing.land(counted(docs, least_length, id, text).groupBy("word").agg(F.sum("n").alias("n"))
                              .where(F.col("n") >= least), "vocabulary")
    keyed = landing.land(with_key(vocabulary), "keyed")
    bits = bitmap(keyed.select("key"), lambda batch: batch["key"].to_numpy().view(np.uint64), BITS)
    met = sought(vocabulary, bits).join(keyed, "key").where(
        (F.col("word") != F.col("other")) & (F.abs(F.char_length("word") - F.char_length("other")) <= 1)
        & (F.levenshtein("word", "other", 1) == 1))
    near = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(
        F.struct((-F.col("n_other")).alias("less"), F.col("other"))).alias("best"))
    near = landing.land(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= FOLLOWS * F.col("n"), F.col("best")).alias("best")).select(
        "word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")), "near")
    landing.drop("keyed", "vocabulary")
    ends = roots(near.where("form is not null"), landing)
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
