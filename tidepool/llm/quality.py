"""A quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters, digits and characters from U+0080 on, or runs of other dark characters;
features are single tokens and pairs, hashed to 2**bits places, where a pair of two equal tokens is a
feature of its own. A text's vector holds each feature's share of all of them; scoring is a sparse
dot product of whole texts with the weights, which are sent to the executors (2**bits numbers).
Updates are per coordinate; features come in the order of their places, the bias last.

Labels are learnt from at most `max_train` labelled documents (expected number), picked by a hash of
doc_id among those that are not held out, in one task in the order of that hash: a documented bound.

Defined cases: null and empty texts score the bias alone; a null label and documents labelled both
ways are not learnt from; of a doc_id that occurs with several texts one is (the least CRC-32, then text);
with nothing to learn every score is 0.5; repeated rows each get a row; long texts are steps of their own.
An input column named score gives way to the result, others pass. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, held_out, mix, plus, sampled, slices, words_hash

BITS, MAX_TRAIN, EPOCHS, SCALE = 18, 5_000, 3, 20.0
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.uint64(0x2545F4914F6CDD1D)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of each feature of a slice, rows ascending."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    dark = kind[starts] > 0
    starts, ends = starts[dark], ends[dark]
    row = np.searchsorted(offsets, starts, "right") - 1
    own = words_hash(_LOWER[data], starts, ends)
    same = own[1:] == own[:-1]
    pair = mix(np.where(same, _SAME, own[:-1] * np.uint64(3) + own[1:] * np.uint64(5)))
    inside = row[1:] == row[:-1]
    every = np.concatenate([own, pair[inside]])
    rows = np.concatenate([row, row[1:][inside]])
    order = np.argsort(rows, kind="stable")
    return (every[order] >> np.uint64(64 - bits)).astype(np.int64), rows[order]


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


class Ftrl:
    """FTRL-proximal: per-coordinate rates, weights read off the accumulated gradients."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.05, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        square = g * g
        self.z[at] += g - (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += square


def _train(bits: int, epochs: int):
    def run(batches):
        rows: list[tuple[np.ndarray, np.ndarray, float]] = []
        for b in batches:
            label = np.asarray(b.column("label"))
            for a, e, data, offsets in slices(b.column("text")):
                place, row = features(data, offsets, bits)
                cuts = np.searchsorted(row, np.arange(e - a + 1))
                for r in range(e - a):
                    at, n = np.unique(place[cuts[r] : cuts[r + 1]], return_counts=True)
                    x = SCALE * n / max(1, n.sum())
                    rows.append((np.append(at, 1 << bits).astype(np.int32), np.append(x, 1.0), float(label[a + r])))
        if not rows:
            return
        model = Ftrl((1 << bits) + 1)
        for _ in range(epochs):
            for at, x, y in rows:
                model.update(at, x, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["place", "weight"])

    return run


def learn(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> np.ndarray:
    """The 2**bits weights and, last, the bias."""
    bounded_batches(docs.sparkSession)
    told = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    told = told.agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").select("doc_id", F.col("label").cast("double").alias("label"))
    place = F.xxhash64("doc_id", F.lit("quality"))
    some = told.where(sampled(place, max_train, told.count()))
    # At most about max_train rows of two numbers: small enough to broadcast whatever the corpus.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").withColumn("place", place)
    rows = rows.groupBy("doc_id", "place", "label").agg(F.min_by("text", F.struct(F.crc32("text"), "text")).alias("text"))  # one text of each doc_id, however often it occurs
    rows = rows.repartition(1).sortWithinPartitions("place", "doc_id").select("text", "label")
    weights = np.zeros((1 << bits) + 1)
    for r in rows.mapInArrow(_train(bits, epochs), "place long, weight double").collect():
        weights[r[0]] = r[1]
    return weights


def score(docs: DataFrame, weights: np.ndarray, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all by default) with score, the probability of quality 1."""
    names = [c for c in (docs.columns if columns is None else columns) if c != "score"]
    source = docs.select(*names, *([] if "text" in names else ["text"]))
    bits = (len(weights) - 1).bit_length() - 1
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = sent.value
        for b in batches:
            parts = []
            for a, e, data, offsets in slices(b.column("text")):
                place, row = features(data, offsets, bits)
                n = np.bincount(row, minlength=e - a)
                dot = np.bincount(row, w[place], minlength=e - a)
                parts.append(sigmoid(float(w[-1]) + SCALE * dot / np.maximum(n, 1)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=[*names, "score"])

    return source.mapInArrow(run, plus(source.select(*names).schema, "score double"))
