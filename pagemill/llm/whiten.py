"""Whitening of embeddings: moments merged pairwise by Chan's formula, components on the driver, a second pass to verify."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000  # an entry c counts as floor(SCALE * c) + OFFSET
LARGEST = float(1 << 40)  # of SCALE * c; a vector beyond it is dropped, as one that is not finite
TOP = 8
BLOCK = 1 << 20  # entries that are worked on at a time
FAN = 1 << 26  # bytes of moments that reach the driver at a time
RANK = 1e-13  # of the largest eigenvalue: what is not above that times the dimension is no direction of the data


class Moments(NamedTuple):
    """Count, sums and scatter about the mean of some vectors."""

    n: int
    sums: np.ndarray | None
    scatter: np.ndarray | None

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


NONE = Moments(0, None, None)


def moments(x: np.ndarray) -> Moments:
    """Of a block of vectors; sums of whole numbers are whole numbers of any size."""
    if not len(x):
        return NONE
    sums = x.astype(object).sum(axis=0) if x.dtype.kind == "i" and np.abs(x).max(initial=0) > (1 << 62) // len(x) else x.sum(axis=0)
    centred = x - np.asarray(sums / len(x), float)
    return Moments(len(x), sums, centred.T @ centred)


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's formula: scatters add up, and what the distance of the two means contributes."""
    if not a.n or not b.n:
        return a if a.n else b
    gap = np.asarray(b.sums / b.n - a.sums / a.n, float)
    return Moments(a.n + b.n, _add(a.sums, b.sums), a.scatter + b.scatter + np.outer(gap, gap) * (a.n * b.n / (a.n + b.n)))


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype.kind == "i" and b.dtype.kind == "i" and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1 << 61:
        return a + b
    return a.astype(object) + b.astype(object) if a.dtype.kind != "f" else a + b


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """The entries of a batch's vectors, all of one length, as floor(SCALE * c)."""
    vectors = batch.column("vector")
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(vectors), -1)


def blocks(batch: pa.RecordBatch, d: int):
    step = max(1, BLOCK // d)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def gathered(vectors: DataFrame, d: int, of) -> Moments:
    """The moments of of(block) over all vectors. Each partition merges its blocks, treeReduce the partitions; the tree
    is as deep as it takes for the driver to get no more than FAN bytes at once."""

    def run(batches):
        total = NONE
        for batch in batches:
            for block in blocks(batch, d):
                total = merge(total, moments(of(block)))
        if total.n:
            kind = total.sums.dtype.kind != "f"
            sums = [str(int(v)) if kind else float(v).hex() for v in total.sums]
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), pa.array([sums], pa.list_(pa.string())), pa.array([kind]), pa.array([total.scatter.astype("<f8").tobytes()], pa.binary())], names=["n", "sums", "exact", "scatter"])

    def unpack(r) -> Moments:
        sums = np.array([int(v) for v in r["sums"]], object) if r["exact"] else np.array([float.fromhex(v) for v in r["sums"]])
        return Moments(r["n"], sums, np.frombuffer(bytes(r["scatter"]), "<f8").reshape(len(sums), len(sums)))

    parts = vectors.select("vector").mapInArrow(run, "n long, sums array<string>, exact boolean, scatter binary").rdd.map(unpack)
    fan, depth = max(2, FAN // (8 * d * d)), 2
    while fan**depth < parts.getNumPartitions():
        depth += 1
    return parts.treeAggregate(NONE, merge, merge, depth)


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # of floor(SCALE * c), whole numbers
    trace: float
    values: np.ndarray  # eigenvalues of the covariance, falling
    components: np.ndarray  # [entry, component], unit length; the largest entry is positive
    identity_error: float


def usable(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector and entries are neither null nor without end, as an array of doubles named vector, and the
    vectors' length. Of several lengths the most frequent one counts, of equally frequent ones the largest; vectors of others
    and empty ones are dropped, and those with an entry of 2**40 / SCALE or more. Length 0: there are none."""
    size = F.col("vector").cast("array<double>")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(SCALE))) < F.lit(LARGEST))
    rows = embeddings.withColumn("vector", F.col(vector)).withColumn("vector", size).where(F.forall("vector", fits) & (F.size("vector") > 0))
    found = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = found["d"] if found else 0
    return rows.where(F.size("vector") == d), d


def project(x: np.ndarray, n: int, sums: np.ndarray, components: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Vectors less their mean, along the components, in their standard deviations."""
    if sums.dtype.kind == "i" and n * max(np.abs(x).max(initial=0), 1) < 1 << 62:
        centred = (x * n - sums) / n  # the whole part exactly
    else:
        centred = np.asarray((x.astype(object) * n - sums.astype(object)) / n, float)
    return centred @ components / np.sqrt(values)


def fit(vectors: DataFrame, d: int, top: int = TOP) -> Whitening | None:
    """The whitening of vectors (vector, ...) of length d; None without vectors. Only directions in which the vectors differ
    count as components, so that there can be less than ``top``, or none."""
    m = gathered(vectors, d, whole) if d else NONE
    if not m.n:
        return None
    values, components = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[: min(top, d)]
    order = order[values[order] > max(values.max(), 0) * d * RANK]
    values, components, trace = values[order], components[:, order], float(np.trace(m.scatter) / m.n)
    components = components * np.where(components[np.abs(components).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    sums = m.sums.astype(np.int64) if m.n and max(map(abs, m.sums.tolist())) < 1 << 61 else m.sums
    error = 0.0
    if len(order):
        again = gathered(vectors, d, lambda block: project(whole(block), m.n, sums, components, values))
        error = float(np.abs(again.scatter / again.n - np.eye(len(order))).max())
    return Whitening(m.n, sums, trace, values, components, error)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sums of (n * x - sums)**2, exact; None where that is no long."""
    small = sums.dtype.kind == "i" and n * max(int(np.abs(x).max(initial=0)), 1) + int(np.abs(sums).max(initial=0)) < int((2**63 / x.shape[1]) ** 0.5)
    gaps = x * n - sums if small else x.astype(object) * n - sums.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (gaps * gaps).sum(axis=1)]


def whitened(vectors: DataFrame, d: int, fitted: Whitening | None, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    deviation is the sum over entries of (n * x - sums)**2, exact, null if it is no long. Equal vectors have equal rows; a
    null key is as any. No vectors, or none that differ: no rows."""
    spark = vectors.sparkSession
    told = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], told)
    shared = spark.sparkContext.broadcast(fitted)  # top * d numbers

    def run(batches):
        w = shared.value
        k = len(w.values)
        for batch in batches:
            for block in blocks(batch, d):
                x, rows = whole(block), block.num_rows
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    block.column(key).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, w.n)),
                    pa.array(_deviation(x, w.n, w.sums), pa.int64()).take(each), pa.array(project(x, w.n, w.sums, w.components, w.values).ravel()),
                    pa.array(np.tile(w.values / w.trace, rows)), pa.array(np.full(rows * k, w.identity_error)),
                ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(key, "vector").mapInArrow(run, told)
