"""Quality by nearest-neighbour voting in a latent semantic space.

Texts become hashed counts of words and word shapes, weighted by inverse document frequencies counted over the whole
corpus. A truncated SVD of a bounded sample of labelled rows gives the latent space; their unit vectors and labels are
broadcast. Every document is projected and its exact cosine to every labelled vector computed in blocks; the K nearest
vote, weighted by similarity.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled
from .features import Buckets, shapes, words

BUCKETS, SHAPES, RANK, NEIGHBOURS = 1 << 15, 1 << 12, 48, 25
#: Bounds of the sample of labelled rows that the neighbours come from, and of its part that the axes are fitted on.
LABELLED, FIT_ROWS = 4000, 1000
#: What a shape counts against a word, and how often the share of repeated triples counts.
SHAPE_WEIGHT, REPEATS = 3.0, 20


class Counts:
    """Bucket counts of a text: words in the first BUCKETS; after them shapes, and how far the text repeats itself."""

    def __init__(self):
        self.word, self.shape = Buckets(BUCKETS), Buckets(SHAPES, 1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        own = words(text)
        w, s = Counter(own), Counter(shapes(text))
        if len(own) > 2:  # tenths of the word triples that repeat an earlier one
            s[b"\0%d" % (10 - 10 * len(set(zip(own, own[1:], own[2:]))) // (len(own) - 2))] = REPEATS
            s[b"\1%d" % (10 * sum(map(eq, own, own[1:])) // len(own))] = REPEATS  # tenths of the words that repeat the one before
        ids = np.fromiter((*map(self.word.__getitem__, w), *(BUCKETS + self.shape[x] for x in s)), np.int64, len(w) + len(s))
        return ids, np.fromiter((*w.values(), *s.values()), np.float32, len(w) + len(s))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Rows and in how many of them each bucket occurs, over all of docs. The driver gets at most eight rows."""
    size = BUCKETS + SHAPES

    def part(batches):
        counts, n, total = Counts(), 0, np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                total[np.unique(counts(text)[0])] += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    def add(batches):
        n, total = 0, np.zeros(size, np.int64)
        for batch in batches:
            n += sum(batch.column(0).to_pylist())
            for x in batch.column(1).to_pylist():
                total += np.frombuffer(x, np.int64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    parts = docs.select(text).mapInArrow(part, "n bigint, total binary").repartition(8).mapInArrow(add, "n bigint, total binary").collect()
    return sum(r.n for r in parts), sum((np.frombuffer(r.total, np.int64) for r in parts), np.zeros(size, np.int64))


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # buckets x rank
    vectors: np.ndarray  # labelled rows x rank, of unit length
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors of rows of (buckets, counts); zero where nothing is known of a row."""
        out = np.zeros((len(rows), self.axes.shape[1]), np.float32)
        for i, (ids, n) in enumerate(rows):
            if len(ids):
                out[i] = weights(ids, n, self.idf) @ self.axes[ids]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 1e-12, length, 1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, by cosine; the prior where no cosine is positive."""
        x, k = self.project(rows), min(self.neighbours, len(self.labels))
        out = np.full(len(rows), self.prior)
        for at in range(0, len(rows) if k else 0, block):
            cosine = x[at : at + block] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(cosine), 1))
            w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64)
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[at : at + block] = np.where(total > 0, vote, self.prior)
        return np.clip(out, 0, 1)


def weights(ids: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf[ids]
    return np.where(ids >= BUCKETS, w * SHAPE_WEIGHT, w).astype(np.float32)


def latent(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, rank: int, seed: int = 11, rounds: int = 3) -> np.ndarray:
    """The leading right singular vectors of the weighted rows (unit length), by randomised subspace iteration.

    The rows stay sparse: memory is that of a few matrices of used buckets x rank.
    """
    used = np.unique(np.concatenate([ids for ids, _ in rows])) if rows else np.empty(0, np.int64)
    sparse = []
    for ids, n in rows:
        at, place = np.unique(np.searchsorted(used, ids), return_inverse=True)
        w = np.bincount(place, weights(ids, n, idf), len(at)).astype(np.float32)
        sparse.append((at, w / max(float(np.linalg.norm(w)), 1e-12)))
    rank = min(rank, len(rows), len(used))
    axes = np.zeros((BUCKETS + SHAPES, max(rank, 1)), np.float32)

    def times(q):
        return np.stack([w @ q[at] for at, w in sparse])

    def back(y):
        out = np.zeros((len(used), y.shape[1]), np.float32)
        for (at, w), row in zip(sparse, y):
            out[at] += np.outer(w, row)
        return out

    if rank:
        q = np.random.default_rng(seed).standard_normal((len(used), min(rank + 8, len(used)))).astype(np.float32)
        for _ in range(rounds):
            q = np.linalg.qr(back(times(q)))[0]
        axes[used] = (q @ np.linalg.svd(times(q), full_matrices=False)[2].T)[:, :rank]
    return axes


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = LABELLED, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from at most `sample` rows of docs that labels covers and `usable` (an expression on doc_id) admits.

    Half of the sample is of each label where there are so many: the rows of least xxhash64(doc_id), however often ids
    repeat; a label other than 0 and 1 doesn't count, and of several labels of an id the largest does. The axes come from
    the first fit_rows of the sample, document frequencies from all of docs. Without labelled rows the model scores every
    text 0.5, the prior of nothing known.
    """
    n, seen = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    marked = labels.where(usable & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order, half = F.xxhash64("doc_id"), sample // 2

    def run(batches):
        counts = Counts()
        for batch in batches:
            for key, quality, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, n = counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([quality], pa.int32()), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["k", "quality", "ids", "n"])

    got = []
    for label in (1, 0):
        chosen = marked.where(F.col("quality") == label).orderBy(order).limit(half).select("doc_id", F.lit(label).alias("quality"))
        rows = sampled(docs, chosen, half, "doc_id", "text").select("h", "quality", "text")
        got += rows.mapInArrow(run, "k bigint, quality int, ids binary, n binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["k"], r["ids"]))
    rows = [(np.frombuffer(r["ids"], np.int32).astype(np.int64), np.frombuffer(r["n"], np.float32)) for r in got]
    marks = np.array([r["quality"] for r in got], np.float64)
    axes = latent(rows[:fit_rows], idf, RANK)
    model = Model(idf, axes, np.zeros((0, axes.shape[1]), np.float32), marks, float(marks.mean()) if len(marks) else 0.5)
    model.vectors = model.project(rows)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1; higher: good quality likelier) for each row. Null and empty texts get the prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 9 MB, whatever the corpus
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        counts, model = Counts(), shared.value
        for batch in batches:
            out = [model.scores([counts(t) for t in batch.column(1).slice(i, 256).to_pylist()]) for i in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["key", "score"])

    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), "score")
