"""Byte-pair encoding and decoding of whole texts.

A text is cut at added tokens, then into pre-tokens; each pre-token's bytes are merged with a segment tree over
the ranks of adjacent pairs: the root holds the lowest rank and, among equals, the leftmost place, and a merge
changes three leaves. Pre-tokens of up to SHORT bytes that are not known yet are merged many at a time, each in its own
tree, the trees being rows of a matrix; longer ones are merged one by one. Merged pre-tokens are kept in a dictionary of
bounded size, which forgets those not met for long.

Null texts count as empty and give no identifiers. Very long texts and pre-tokens are encoded whole: a pre-token
of n bytes takes n log n steps. Identifiers are a binary column of little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.llm.common import Recent, ship

NONE = 1 << 62
SHORT = 64  # bytes of a pre-token that is merged together with others
GROUP = 1 << 20  # characters of texts that are encoded together, or one longer text
#: fixed value: how byte-level vocabularies of this kind cut a text
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def merge(symbols: list[int], pairs: dict[int, tuple[int, int]], width: int) -> list[int]:
    """Merges until no adjacent pair is in `pairs` (left * width + right -> rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n - 1:
        size *= 2
    symbols, get = list(symbols), pairs.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if (p := get(symbols[i] * width + symbols[i + 1])) is not None:
            tree[size + i] = p[0] * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        i += size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while (top := tree[1]) != NONE:
        i = top % n
        j = after[i]
        symbols[i] = get(symbols[i] * width + symbols[j])[1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            p = get(symbols[i] * width + symbols[k])
            put(i, NONE if p is None else p[0] * n + i)
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            p = get(symbols[h] * width + symbols[i])
            put(h, NONE if p is None else p[0] * n + h)
    return [s for s in symbols if s >= 0]


def merge_many(pieces: list[bytes], leaves: int, c: Codec) -> list[bytes]:
    """Identifiers of each piece of at most `leaves` bytes, `leaves` being a power of two.

    Row r of `tree` is the segment tree of piece r; every turn makes the merge that each root holds and brings the
    three changed leaves up to the root. Place `leaves` stands for the end, and for what is before the beginning: no
    pair starts at the last place, so its leaf may be cleared at any time.
    """
    n, m = leaves, len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    symbols = np.full((m, n + 1), -1, np.int64)
    symbols[np.arange(n + 1) < sizes[:, None]] = c.first_of[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, n + 2), (m, 1))
    before = np.tile(np.arange(-1, n), (m, 1))
    tree = np.full((m, 2 * n), NONE, np.int64)

    def leaf(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        sought = left * c.width + right
        at = np.minimum(np.searchsorted(c.keys, sought), len(c.keys) - 1)
        return np.where(c.keys[at] == sought, c.ranks[at] * n + place, NONE)

    tree[:, n:] = leaf(symbols[:, :-1], symbols[:, 1:], np.arange(n))
    level = n // 2
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level //= 2
    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        top = tree[row, 1]
        i = top % n
        j, h = after[row, i], before[row, i]
        k = after[row, j]
        symbols[row, i] = made = c.made[top // n]
        symbols[row, j] = -1
        after[row, i] = k
        before[row, k] = i
        tree[row, n + j] = NONE
        tree[row, n + i] = leaf(made, symbols[row, k], i)
        tree[row, n + h % n] = leaf(symbols[row, h], made, h)
        node = n + np.stack([i, j, h % n])
        while node[0, 0] > 1:
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        row = row[tree[row, 1] != NONE]
    live = symbols >= 0
    ids, ends = symbols[live].astype("<u4").tobytes(), (4 * live.sum(axis=1)).cumsum().tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Vocabulary of a byte-level tokenizer file, with the pre-tokens met so far."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        self.width = len(vocab) + len(spec["added_tokens"]) + 1
        self.first = [vocab[c] for c in letters]
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[left] * self.width + vocab[right], (rank, vocab[left + right]))
        self.first_of = np.array(self.first)
        order = sorted(self.pairs)
        self.keys = np.array(order or [-1], np.int64)
        self.ranks = np.array([self.pairs[k][0] for k in order] or [0], np.int64)
        self.made = np.zeros(len(spec["model"]["merges"]) + 1, np.int64)
        for rank, merged in self.pairs.values():
            self.made[rank] = merged
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        self.bytes = [b"".join(back.get(c, c.encode()) for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.cut = (regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
                    if self.added else None)
        self.known: Recent[str, bytes] = Recent(self.piece)

    def piece(self, pretoken: str) -> bytes:
        ids = merge([self.first[b] for b in pretoken.encode()], self.pairs, self.width)
        return np.array(ids, "<u4").tobytes()

    def segments(self, text: str) -> list[list[str] | bytes]:
        """Lists of pre-tokens, and the identifiers of added tokens."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [PRETOKEN.findall(text[at:m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return [*out, PRETOKEN.findall(text[at:] if at else text)]

    def learn(self, found: set[str]) -> dict[str, bytes]:
        """Identifiers of pre-tokens, of which those not known are merged and remembered."""
        table, sized = {}, {}
        for w in found:
            if (ids := self.known.get(w)) is None:
                if (ids := self.known.old.get(w)) is None:
                    n = len(w.encode())
                    if n <= SHORT:
                        sized.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(w)
                        continue
                    ids = self.piece(w)
                self.known.keep(w, ids)
            table[w] = ids
        for leaves, pieces in sized.items():
            for at in range(0, len(pieces), 1 << 14):
                part = pieces[at:at + (1 << 14)]
                for w, ids in zip(part, merge_many([w.encode() for w in part], leaves, self)):
                    table[w] = self.known.keep(w, ids)
        return table

    def encode_group(self, texts: list[str]) -> list[bytes]:
        cut = [self.segments(t) for t in texts]
        table = self.learn({w for t in cut for s in t if type(s) is list for w in s})
        return [b"".join([s if type(s) is bytes else b"".join([table[w] for w in s]) for s in t]) for t in cut]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Identifiers of each text, in order."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self.encode_group(group)
                group, size = [], 0
        yield from self.encode_group(group)

    def encode(self, text: str | None) -> bytes:
        return self.encode_group([text or ""])[0]

    def decode(self, ids: bytes | None) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode(errors="replace")


@functools.lru_cache(maxsize=2)
def codec(raw: bytes) -> Codec:
    return Codec(raw)


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file, a few megabytes, as a broadcast: executors need no copy of their own."""
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds (or replaces) the binary column `ids`."""
    held = vocabulary(df.sparkSession, path)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(held.value)
        for x in batches:
            yield pa.array(c.encode_all(t.as_py() for t in x), pa.binary())

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds (or replaces) the string column `text`."""
    held = vocabulary(df.sparkSession, path)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(held.value)
        for x in batches:
            yield pa.array([c.decode(t.as_py()) for t in x], pa.string())

    return df.withColumn(text, run(F.col(ids)))
