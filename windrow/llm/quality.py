"""Quality by a vote of the nearest labelled documents.

A text's terms are its words, their shapes (case, digits, marks at the end) and repetitions of the word before, by
hash; they are weighed by log counts and by how rare they are in all documents. A singular value decomposition of
about NEIGHBOURS labelled rows gives latent-semantic vectors. Those of the labelled rows are broadcast, NEIGHBOURS
times DIMS numbers; every document is compared with all of them by products of blocks, and the labels of its nearest
VOTES neighbours count by similarity.

Null and empty texts have no terms, a zero vector, and the mean label as score. Without labelled rows every score is 0.
Texts are taken whole; equal similarities go to the row that comes first by hash. Repeated rows are scored alike; other
columns pass through, and a column of the score's name is replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from windrow.llm.common import Recent, ship
from windrow.llm.training import sample, with_labels

WORDS, SHAPES = 4096, 512
TERMS = WORDS + SHAPES + 1
NEIGHBOURS, DIMS, VOTES = 4000, 48, 15
BLOCK = 512  # documents compared at a time
KEPT = 1 << 18  # words whose places are kept, twice
SHAPE_WEIGHT = 4.0  # of shapes and repetitions; single words say little of quality


def shape(word: str) -> str:
    letters = word.rstrip("".join({c for c in word if not c.isalnum()}))
    case = "U" if len(letters) > 1 and word.isupper() else "T" if word[:1].isupper() else "l" if letters else "-"
    return f"{case}{'d' if any(c.isdigit() for c in word) else ''}{'x' if len(letters) > 14 else ''}{word[len(letters):][-2:]}"


def places(word: str) -> int:
    """The places of the word and of its shape in one number."""
    return xxhash.xxh3_64_intdigest(word.lower()) % WORDS * SHAPES + xxhash.xxh3_64_intdigest(shape(word)) % SHAPES


class Terms:
    def __init__(self):
        self.known: Recent[str, int] = Recent(places, KEPT)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of a text's terms."""
        found = text.split() if text else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        both = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        n = np.zeros(TERMS, np.int64)
        n[:WORDS] = np.bincount(both // SHAPES, minlength=WORDS)
        n[WORDS:TERMS - 1] = np.bincount(both % SHAPES, minlength=SHAPES)
        n[TERMS - 1] = sum(map(operator.eq, found, found[1:]))
        at = np.flatnonzero(n)
        return at, n[at].astype(np.float32)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row; of equals those that come first."""
    at = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k:]
    least = np.take_along_axis(near, at, axis=1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((near >= least).sum(axis=1) > k):  # more equals than there is room for
        at[row] = np.argsort(-near[row], kind="stable")[:k]
    return at


class Model(NamedTuple):
    weight: np.ndarray  # of each term
    axes: np.ndarray  # terms x DIMS
    vectors: np.ndarray  # of the labelled rows, of length 1
    labels: np.ndarray

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.log1p(n) * self.weight[at]
        v = w @ self.axes[at] if len(at) else np.zeros(self.axes.shape[1], np.float32)
        length = np.sqrt((v * v).sum())
        return v / length if length > 1e-12 else v * 0

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Scores of vectors."""
        near = x @ self.vectors.T
        k = min(VOTES, near.shape[1])
        at = nearest(near, k)
        s = np.maximum(np.take_along_axis(near, at, axis=1), 0)
        total = s.sum(axis=1)
        mean = float(self.labels.mean())
        return np.where(total > 1e-6, (s * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-6), mean)


def rarity(docs: DataFrame, text: str) -> np.ndarray:
    """Weight of each term from the number of documents that have it, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = Terms(), np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for t in batch["text"]:
                n[terms.of(t.as_py())[0]] += 1
                n[TERMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(n)], ["term", "n"])

    found = (docs.select(F.col(text).alias("text")).mapInArrow(run, "term long, n long")
             .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    n = np.zeros(TERMS + 1)
    n[found["term"].to_numpy()] = found["n"].to_numpy()
    weight = np.log((1 + n[TERMS]) / (1 + n[:TERMS])).astype(np.float32)
    weight[WORDS:] *= SHAPE_WEIGHT
    return weight


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    ship(docs.sparkSession)
    weight = rarity(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["hash"], batch["y"], pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()),
                 pa.array([n.astype("<f4").tobytes() for _, n in found], pa.binary())], ["hash", "y", "at", "n"])

    rows = sample(with_labels(docs, labels, label, id, text), NEIGHBOURS).select("text", "hash", "y")
    found = rows.mapInArrow(run, "hash long, y int, at binary, n binary").toArrow().sort_by("hash")
    m = np.zeros((found.num_rows, TERMS), np.float32)
    for row, (at, n) in enumerate(zip(found["at"].to_pylist(), found["n"].to_pylist())):
        at = np.frombuffer(at, "<i4")
        m[row, at] = np.log1p(np.frombuffer(n, "<f4")) * weight[at]
    m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    axes = np.random.default_rng(7).standard_normal((TERMS, DIMS + 8)).astype(np.float32)
    for _ in range(6):  # subspace iteration
        axes = np.linalg.qr(m.T @ (m @ axes))[0] if len(m) else axes
    _, _, turn = np.linalg.svd(m @ axes, full_matrices=False) if len(m) else (0, 0, np.eye(DIMS + 8, dtype=np.float32))
    axes = (axes @ turn.T)[:, :DIMS].astype(np.float32)
    v = m @ axes
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    return Model(weight, axes, v, (found["y"].to_numpy() > 0).astype(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, terms = held.value, Terms()
        for x in batches:
            if not len(m.labels):
                yield pa.array(np.zeros(len(x)))
                continue
            out = []
            for at in range(0, len(x), BLOCK):
                out.append(m.votes(np.stack([m.vector(*terms.of(t.as_py())) for t in x[at:at + BLOCK]])))
            yield pa.array(np.concatenate(out).astype(np.float64) if out else np.zeros(0))

    return docs.withColumn(out, run(F.col(text)))
