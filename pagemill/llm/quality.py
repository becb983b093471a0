"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches
from .words import U, mix, slices, word_hashes

BITS = 20  # of a feature's number
SAMPLE = 12_000  # labelled rows to learn from, at most
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 0.1
SURFACE, SHAPE = 2, 3  # longest n-grams of words and of word shapes


@lru_cache(1)
def _shapes() -> np.ndarray:
    """A byte's class: a letter, u for upper case, 0 for digits, punctuation and white space as they are."""
    out = np.arange(256, dtype=np.uint8)
    out[97:123] = out[128:] = ord("a")
    out[65:91] = ord("u")
    out[48:58] = ord("0")
    out[9:14] = 32
    return out


def _grams(words: np.ndarray, longest: int, salt: int) -> list[np.ndarray]:
    out, sums = [], words
    for n in range(1, longest + 1):
        if n > 1:
            sums = sums[:-1] * U(0xD6E8FEB86659FD93) + words[n - 1 :] if len(words) >= n else words[:0]
        out.append(mix(sums ^ U(salt * 16 + n)) >> U(64 - BITS))
    return out


def features(data: np.ndarray, at: np.ndarray):
    """(numbers, values) of each text: the damped counts of its n-grams, scaled to length 1."""
    words, starts = word_hashes(data, at, "space")
    shape = _shapes()[data]
    keep = np.append(True, shape[1:] != shape[:-1]) if len(shape) else np.zeros(0, bool)
    keep[at[:-1][at[:-1] < len(data)]] = True
    forms, form_starts = word_hashes(shape[keep], np.concatenate([[0], np.cumsum(keep)])[at], "space")
    for k in range(len(at) - 1):
        own, form = words[starts[k] : starts[k + 1]], forms[form_starts[k] : form_starts[k + 1]]
        found, count = np.unique(np.concatenate(_grams(own, SURFACE, 1) + _grams(form, SHAPE, 2)), return_counts=True)
        values = np.log1p(count)
        yield found.astype(np.int64), values / max(1e-9, float(np.sqrt(values @ values)))


class Ftrl:
    """Follow-the-regularised-leader for logistic loss, one learning rate a coordinate."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i):
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, label: int) -> None:
        i, x = np.append(i, len(self.z) - 1), np.append(x, 1.0)  # the last coordinate is the bias
        w = self.weights(i)
        g = (sigmoid(w @ x) - label) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(batches):
    rows = []
    for batch in batches:
        labels = batch.column("label").to_pylist()
        for i, j, data, at in slices(batch.column("text")):
            rows += [(f.astype(np.int32), x.astype(np.float32), y) for (f, x), y in zip(features(data, at), labels[i:j])]
    model = Ftrl()
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(*rows[k])
    w = model.weights(np.arange(len(model.z)))
    i = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([i.tolist()], pa.list_(pa.int32())), pa.array([w[i].tolist()], pa.list_(pa.float64()))], names=["i", "w"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights, the last being the bias, learned from at most ``sample`` rows of labels (doc_id, label), the
    least by a hash, and the texts of their doc_ids. One task learns: its input is bounded by
    ``sample`` and its result by BITS. Rows without a label or doc_id are not used. Without rows all weights are 0."""
    some = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    # of many labels only those of low hashes, about twice the sample, are ranked: no task sees ``sample`` of each partition
    low = min((1 << 64) - 1, 2 * sample * (1 << 64) // max(1, some.count())) - (1 << 63)
    some = some.where(F.xxhash64("doc_id", "label") <= F.lit(low).cast("long"))
    some = some.orderBy(F.xxhash64("doc_id", "label"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id", "label"), "doc_id", "text").limit(sample).select("label", "text")
    found = rows.coalesce(1).mapInArrow(_fit, "i array<int>, w array<double>").first()
    out = np.zeros((1 << BITS) + 1)
    if found is not None:
        out[np.asarray(found[0], np.int64)] = found[1]
    return out


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds score, the probability of label 1, to all columns of docs, from the text alone.

    Each whole text is a sparse vector of hashed n-grams of words and word shapes; the score is
    its dot product with the weights, through the logistic function. Null, empty and wordless texts have
    the bias only. Repeated rows score alike. An empty table gives no rows. A column of docs named
    score is replaced. A worker makes arrays for SLICE bytes of texts at a time, or for one longer text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers whatever the data

    def run(batches):
        w = shared.value
        for batch in batches:
            out = [w[f] @ x + w[-1] for _, _, data, at in slices(batch.column("text")) for f, x in features(data, at)]
            score = pa.array(sigmoid(np.array(out, float)), pa.float64())
            yield pa.RecordBatch.from_arrays([score if n == "score" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return map_batches(docs, run, {"score": F.lit(0.0)})
