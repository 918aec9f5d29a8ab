"""Toxicity by non-negative positive-unlabelled learning.

A linear model on hashed words and word beginnings is trained from confirmed toxic examples and unlabelled text only; no row counts as
confirmed harmless. The risk of the unlabelled rows as negatives is corrected by the class prior, and where the
corrected part turns negative (overfitting), the step follows its negative instead, as in non-negative PU learning. The
prior is estimated from the same two samples: no share of toxic rows above it could leave so few unlabelled rows among
the highest scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, sampled, staged, with_rows
from .features import words

#: Buckets of whole words, and of word beginnings.
WORDS, STEMS = 1 << 17, 1 << 17
#: Lengths in bytes of the beginnings that count.
LENGTHS = (4, 6, 8)
#: Bounds of the samples that training takes: confirmed toxic rows and unlabelled rows.
POSITIVES, UNLABELLED = 2500, 6000
#: Features that the model uses at most, and how far (in standard errors) their mean among toxic rows must stand out.
FEATURES, STANDS_OUT = 600, 4.0


class Features(dict):
    """Remembers the buckets of words, up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = (zlib.crc32(word) % WORDS, *(WORDS + zlib.crc32(word[:k], k) % STEMS if len(word) >= k else -1 for k in LENGTHS))
        return out

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values of a text: 1 for each word that occurs; for beginnings their share of the words, in per cent, up to 2."""
        counts = Counter(words(text))
        if not counts:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        ids = np.fromiter(chain.from_iterable(map(self.__getitem__, counts)), np.int32, len(counts) * (1 + len(LENGTHS))).reshape(len(counts), -1)
        n = np.fromiter(counts.values(), np.float64, len(counts))
        stems, at = np.unique(ids[:, 1:], return_inverse=True)
        share = np.minimum(2, 100 / n.sum() * np.bincount(at.ravel(), np.repeat(n, len(LENGTHS)), len(stems)))
        seen, known = np.unique(ids[:, 0]), stems >= 0
        return np.concatenate((seen, stems[known])), np.concatenate((np.ones(len(seen)), share[known])).astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of each row of (buckets, values); nothing known of it: by the bias alone."""
        z = np.array([self.weight[ids] @ values for ids, values in rows], np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def unknown(prior: float) -> Model:
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return Model(np.zeros(WORDS + STEMS, np.float32), float(np.log(prior / (1 - prior))), prior)


def standing_out(positive: list[tuple], unlabelled: list[tuple]) -> np.ndarray:
    """The features whose mean among the confirmed rows exceeds that of the unlabelled ones most, in standard errors."""
    size = WORDS + STEMS

    def sums(rows):
        first, second = np.zeros(size), np.zeros(size)
        for ids, v in rows:
            first[ids] += v
            second[ids] += v.astype(np.float64) ** 2
        return first / len(rows), second / len(rows)

    (p, _), (u, uu) = sums(positive), sums(unlabelled)
    z = (p - u) / np.sqrt((np.maximum(uu - u * u, 0) + 1 / len(unlabelled)) / len(positive))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(best[z[best] >= STANDS_OUT])


def fit(positive: list[tuple], unlabelled: list[tuple], prior: float, epochs: int = 300, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """Non-negative PU learning with the logistic loss and full-batch Adagrad steps. prior: share of toxic rows."""
    used = standing_out(positive, unlabelled)
    if not used.size:
        return unknown(prior)

    def dense(rows):
        out = np.zeros((len(rows), len(used)), np.float32)
        for row, (ids, v) in zip(out, rows):
            at = np.minimum(np.searchsorted(used, ids), len(used) - 1)
            own = used[at] == ids
            row[at[own]] = v[own]
        return out

    x_p, x_u = dense(positive), dense(unlabelled)
    w, bias = np.zeros(len(used), np.float32), float(np.log(prior / (1 - prior)))
    square, square_bias = np.full(len(used), 1e-8), 1e-8
    for _ in range(epochs):
        z_p, z_u = x_p @ w + bias, x_u @ w + bias
        s_p, s_u = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (z_p, z_u))  # d/dz of the loss as a negative; as a positive s - 1
        rest = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        g_p, g_u = (-prior / len(s_p)) * s_p, s_u / len(s_u)
        if rest >= 0:
            g_p = g_p + prior * (s_p - 1) / len(s_p)
        else:
            g_p, g_u = -g_p, -g_u
        grad, grad_bias = x_p.T @ g_p + x_u.T @ g_u + decay * w, float(g_p.sum() + g_u.sum())
        square += grad * grad
        square_bias += grad_bias**2
        w -= (rate * grad / np.sqrt(square)).astype(np.float32)
        bias -= rate * grad_bias / np.sqrt(square_bias)
    weight = np.zeros(WORDS + STEMS, np.float32)
    weight[used] = w
    return Model(weight, bias, prior)


def estimated_prior(positive: list[tuple], unlabelled: list[tuple], guess: float = 0.05) -> float:
    """Share of toxic rows among the unlabelled, without a single negative.

    Each half of the samples is scored by a model of the other half. Among unlabelled rows those over a threshold are at
    least prior x the share of confirmed rows over it; so the least ratio of the two shares, over thresholds that half to
    nearly all of the confirmed rows pass, bounds the prior, and is close where only toxic rows score so high.
    """
    ratios = []
    for i in (0, 1):
        p_fit, u_fit, p, u = positive[i::2], unlabelled[i::2], positive[1 - i :: 2], unlabelled[1 - i :: 2]
        if not (p_fit and u_fit and p and u):
            return guess
        model = fit(p_fit, u_fit, guess, epochs=100)
        s_p, s_u = np.sort(model.scores(p)), np.sort(model.scores(u))
        passing = [(1 - np.searchsorted(s, s_p[int(q * len(s_p))], side="left") / len(s)) for q in np.arange(0.1, 0.55, 0.05) for s in (s_p, s_u)]
        ratios.append(min((b + 1 / len(s_u)) / a for a, b in zip(passing[::2], passing[1::2])))
    return float(np.clip(np.mean(ratios), 1e-3, 0.9))


def train(docs: DataFrame, labels: DataFrame, usable: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Train from the rows of docs that `usable` (an expression on doc_id) admits.

    Up to `positives` rows that labels marks toxic = 1 are confirmed; up to `unlabelled` of all admitted rows, labelled or
    not, are unlabelled text. Both samples are the rows of least xxhash64(doc_id), however often ids repeat. No other
    label is looked at. Without a `prior`, it is estimated from the two samples. Without a confirmed row or any text the
    model scores every text with the prior (0.05 if none is given).
    """
    order = F.xxhash64("doc_id")
    confirmed = labels.where(usable & (F.col("toxic") == 1)).select("doc_id").distinct().orderBy(order).limit(positives)
    rows = with_rows(docs.select("doc_id", "text")).where(usable)
    some = staged(rows.select(ROW, order.alias("h")).orderBy("h", ROW).limit(unlabelled), "sample")

    def run(batches):  # only hashed features go to the driver, about 4 KB a row
        features = Features()
        for batch in batches:
            found = [features.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["h", "ids", "v"])

    def of(sample: DataFrame) -> list[tuple]:
        got = sample.select("h", "text").mapInArrow(run, "h bigint, ids binary, v binary").toArrow().sort_by([("h", "ascending"), ("ids", "ascending")])
        return [(np.frombuffer(x, np.int32), np.frombuffer(v, np.float32)) for x, v in zip(got.column("ids").to_pylist(), got.column("v").to_pylist())]

    positive, rest = of(sampled(docs, confirmed, positives, "doc_id", "text")), of(rows.join(F.broadcast(some), ROW))
    if not positive or not rest:
        return unknown(0.05 if prior is None else prior)
    return fit(positive, rest, estimated_prior(positive, rest) if prior is None else prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1; higher: toxic likelier) for each row. Null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the corpus
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        features, model = Features(), shared.value
        for batch in batches:
            out = [model.scores([features.of(t) for t in batch.column(1).slice(i, 256).to_pylist()]) for i in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["key", "score"])

    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), "score")
