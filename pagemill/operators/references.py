"""Rows whose vectors are close to any of many reference vectors, by coarse cells.

Cells are the surroundings of a bounded number of centres. Rows and references meet in cells, as an equality join, and each pair
that meets is scored with its whole vectors. Either every cell is tried in which a reference can find something, which loses
nothing, or the nearest few, as many as a bounded sample says a recall takes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, SAMPLE, ASKED, ROUNDS = 64, 8192, 512, 8
MOST_BYTES = 32 << 20  # of references that are broadcast
SALTS = 64  # parts that all rows are cut in where references are shuffled, beside one for each cell
BLOCK_BYTES = 1 << 19  # of vectors that are packed to one row
SLACK = 1e-6  # of an angle, for its rounding
FEWEST_PAIRS = 20  # that a number of cells is judged by


@dataclass(frozen=True)
class Cells:
    """Unit centres, one a row, and the sample that they were fitted on."""

    centres: np.ndarray
    sample: np.ndarray = field(repr=False)

    def probes(self, threshold: float, recall: float = 0.95) -> int:
        """How many of the cells nearest to a reference hold ``recall`` of its pairs at a threshold, among rows of the sample. Pairs of
        a text with itself or its copies do not count, as they are always found. All cells where the sample has few pairs."""
        every = len(self.centres)
        if not every:
            return 0
        asked = self.sample[:ASKED]
        scores = asked @ self.sample.T
        rank = np.argsort(np.argsort(-(asked @ self.centres.T), axis=1), axis=1)
        home = np.argmax(self.sample @ self.centres.T, axis=1)
        q, x = np.nonzero((scores >= threshold) & (scores < 1 - SLACK))
        if len(q) < FEWEST_PAIRS:
            return every
        needed = np.sort(rank[q, home[x]])
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    rows = np.asarray(vectors, dtype=np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    """Whether a vector can be compared: entries, none of them null or not finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def fit(rows: DataFrame, vector: str, cells: int = CELLS, sample: int = SAMPLE) -> Cells:
    """Cells for the vectors of a table: of those of the most frequent length, the ``sample`` least by a hash, each once, go through
    ROUNDS of spherical k-means on the driver. No usable vector: no cells."""
    fine = rows.select(F.col(vector).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    length = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return Cells(np.zeros((0, 0)), np.zeros((0, 0)))
    some = fine.where(F.size("v") == length.d).distinct().orderBy(F.xxhash64("v"), "v").limit(sample)
    x = _units([r.v for r in some.collect()])
    centres = x[: min(cells, len(x))]
    for _ in range(ROUNDS):
        home = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return Cells(centres, x)


PLACED = "array<struct<cell: int, angle: double>>"


def _placed(df: DataFrame, name: str, index: Cells, nearest: int) -> DataFrame:
    """df, whose vector is in ``name``, with _near: its ``nearest`` cells and the angles to their centres, nearest first. A vector of another length
    than the centres' has one cell, which all of that length share. Vectors that cannot be compared go."""
    centres, at = index.centres, list(df.columns).index(name)

    def run(batches):
        for batch in batches:
            found: list = []
            vectors = batch.column(at).to_pylist()
            same = [i for i, v in enumerate(vectors) if len(v) == centres.shape[1]]
            near = dict.fromkeys(range(len(vectors)))
            for part in (same[i : i + 2048] for i in range(0, len(same), 2048)):
                close = _units([vectors[i] for i in part]) @ centres.T
                order = np.argsort(-close, axis=1, kind="stable")[:, :nearest]
                angles = np.arccos(np.clip(np.take_along_axis(close, order, axis=1), -1, 1))
                for i, cs, angs in zip(part, order.tolist(), angles.tolist()):
                    near[i] = [{"cell": c, "angle": a} for c, a in zip(cs, angs)]
            found = [near[i] or [{"cell": -len(v), "angle": 0.0}] for i, v in enumerate(vectors)]
            columns = [*batch.columns[:-1], pa.array(found, batch.schema.field("_near").type)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    usable = df.where(_usable(F.col(name))).withColumn("_near", F.lit(None).cast(PLACED))
    return usable.mapInArrow(run, usable.schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _packed(df: DataFrame, group: list[str], vector: str, numbers: list[str], key: str) -> DataFrame:
    """df as blocks: a row for many of one group, whose vectors, and each of whose columns of doubles, are one binary value, with an array of
    their keys. A task holds BLOCK_BYTES of a group at most before it packs them, and packs the rest at its end."""
    schema = df.select(*group, F.array(key).alias(key), *[F.lit(None).cast("binary").alias(c) for c in (vector, *numbers)]).schema

    def run(batches):
        held: dict[tuple, list] = {}
        total = 0
        kinds = None

        def block(g: tuple, parts: list) -> pa.RecordBatch:
            columns = [pa.array([x]).cast(t) for x, t in zip(g, kinds[0])]
            keys = pa.ListArray.from_arrays(pa.array([0, sum(len(p[0]) for p in parts)], pa.int32()), pa.concat_arrays([p[0] for p in parts]))
            columns += [keys, *[pa.array([b"".join(np.ascontiguousarray(p[i]).tobytes() for p in parts)], pa.binary()) for i in range(1, len(numbers) + 2)]]
            return pa.RecordBatch.from_arrays(columns, names=[*group, key, vector, *numbers])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [[batch.schema.field(g).type for g in group]]
            keys, lists = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(vector))
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            plain = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in numbers]
            found: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in group])):
                found.setdefault(g, []).append(i)
            for g, at in found.items():
                wide = int(ends[at[0] + 1] - ends[at[0]])  # a group's vectors have one length
                step = max(1, BLOCK_BYTES // (8 * wide))
                for part in (np.array(at[i : i + step]) for i in range(0, len(at), step)):
                    rows = values[(ends[part][:, None] + np.arange(wide)[None, :])]
                    parts, size = held.pop(g, ([], 0))
                    parts.append((keys.take(pa.array(part)), rows, *[c[part] for c in plain]))
                    size, total = size + rows.nbytes, total + rows.nbytes
                    if size >= BLOCK_BYTES:
                        yield block(g, parts)
                        total -= size
                    else:
                        held[g] = (parts, size)
                while total > MOST_BYTES:  # many groups, none of them full: the oldest one goes
                    old = next(iter(held))
                    parts, size = held.pop(old)
                    yield block(old, parts)
                    total -= size
        for g, (parts, _) in held.items():
            yield block(g, parts)

    return df.select(*group, key, vector, *numbers).mapInArrow(run, schema)


def _scored(met: DataFrame) -> DataFrame:
    """(_ref, _key, score) of pairs of blocks: candidates by a product of matrices, with some slack, then each of them by a sum in the order of
    its entries, so that a score does not depend on how rows were packed."""
    schema = met.select(F.get("_ref", 0).alias("_ref"), F.get("_key", 0).alias("_key"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                numbers = {n: np.frombuffer(one[n].as_buffer(), dtype=np.float64) for n in ("_v", "_w", "_a", "_b", "_norm", "_wnorm", "_least", "_t")}
                v, w = numbers["_v"].reshape(len(numbers["_a"]), -1), numbers["_w"].reshape(len(numbers["_b"]), -1)
                step = max(1, (1 << 21) // len(w))  # of the products that are held at once
                for lo in range(0, len(v), step):
                    close = (v[lo : lo + step] @ w.T) / (numbers["_norm"][lo : lo + step, None] * numbers["_wnorm"][None, :])
                    near = np.abs(numbers["_a"][lo : lo + step, None] - numbers["_b"][None, :]) <= numbers["_t"][None, :] + SLACK
                    i, j = np.nonzero((close >= numbers["_least"][None, :] - SLACK) & near)
                    for k in range(0, len(i), 4096):
                        x, y = i[k : k + 4096] + lo, j[k : k + 4096]
                        score = np.cumsum(v[x] * w[y], axis=1)[:, -1] / (numbers["_norm"][x] * numbers["_wnorm"][y])
                        good = score >= numbers["_least"][y]
                        yield pa.RecordBatch.from_arrays([one["_ref"].values.take(pa.array(y[good])), one["_key"].values.take(pa.array(x[good])), pa.array(score[good])], names=["_ref", "_key", "score"])

    return met.mapInArrow(run, schema)


def close_to(
    rows: DataFrame, references: DataFrame, index: Cells, threshold: float | Column = 0.7, probes: int | None = None,
    key: str = "id", vector: str = "vector", ref_key: str = "ref_id", ref_vector: str = "vector",
) -> DataFrame:
    """(ref_key, key, score): each pair of a row and a reference whose cosine is at least a threshold, above 0, which may be a column of
    the references.

    Without ``probes`` none is lost: a row whose angle to its centre is a can only be within the angle t of a reference whose
    angle to that centre is between a - t and a + t, so cells out of reach, and rows out of reach within a cell, are passed over.
    With it, each reference tries so many nearest cells. Rows have one cell each. Rows and references of a cell meet as blocks, each pair of
    blocks scored as a product of matrices. Rows are not moved while references fit in MOST_BYTES by count; else both are shuffled by
    cell and part of a cell, so that a cell with a third of all rows is no one task's. Null, empty, zero and not finite vectors meet nothing; vectors meet those of their own
    length. Repeated rows and references give repeated pairs; other columns do not matter."""
    if not isinstance(threshold, Column) and not threshold > 0:
        raise ValueError("a threshold is above 0")
    mine = rows.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    mine = _placed(mine, "_v", index, 1).select("_key", "_v", F.get("_near", 0)["cell"].alias("_cell"), F.get("_near", 0)["angle"].alias("_a"))
    mine = mine.withColumn("_norm", F.sqrt(_dot(F.col("_v"), F.col("_v"))))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    asked = references.select(F.col(ref_key).alias("_ref"), F.col(ref_vector).cast("array<double>").alias("_w"), limit.cast("double").alias("_least")).where("_least > 0")
    asked = _placed(asked, "_w", index, probes or max(len(index.centres), 1))
    asked = asked.select("_ref", "_w", "_least", F.sqrt(_dot(F.col("_w"), F.col("_w"))).alias("_wnorm"), F.acos(F.least("_least", F.lit(1.0))).alias("_t"), F.explode("_near").alias("n"))
    asked = asked.select("_ref", "_w", "_least", "_wnorm", "_t", F.col("n.cell").alias("_cell"), F.col("n.angle").alias("_b"))
    if probes is None:
        # the reach of each cell, as many rows as there are cells and other lengths
        reach = mine.groupBy("_cell").agg(F.min("_a").alias("_from"), F.max("_a").alias("_to"))
        asked = asked.join(reach, "_cell").where((F.col("_b") - F.col("_t") <= F.col("_to") + SLACK) & (F.col("_b") + F.col("_t") >= F.col("_from") - SLACK)).drop("_from", "_to")
    size = references.agg(F.sum(F.coalesce(F.size(ref_vector), F.lit(0)) * 8 + 64)).first()[0] or 0
    size *= probes or max(len(index.centres), 1)  # a copy for each cell that is tried
    group = ["_cell"]
    if size > MOST_BYTES:
        # a cell is cut in as many parts as its share of all rows asks for, so that references are copied cells + SALTS times at most
        share = mine.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
        share = share.crossJoin(F.broadcast(share.agg(F.sum("_n").alias("_all")))).select("_cell", F.ceil(F.col("_n") * SALTS / F.col("_all")).cast("int").alias("_parts"))
        mine = mine.join(F.broadcast(share), "_cell").withColumn("_salt", (F.monotonically_increasing_id() % F.col("_parts")).cast("int"))
        asked = asked.join(F.broadcast(share), "_cell").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        group.append("_salt")
    many = _packed(mine, group, "_v", ["_a", "_norm"], "_key")
    few = _packed(asked, group, "_w", ["_b", "_wnorm", "_least", "_t"], "_ref")
    met = many.join(F.broadcast(few) if size <= MOST_BYTES else few.hint("merge"), group).drop(*group)
    return _scored(met).select(F.col("_ref").alias(ref_key), F.col("_key").alias(key), "score")


def recall(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(wanted, found, recall) of pairs: how many of those wanted are among those found; null without any wanted."""
    hits = wanted.select(*keys).distinct().join(found.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    both = hits.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"))
    return both.select("wanted", "found", (F.col("found") / F.nullif(F.col("wanted"), F.lit(0))).alias("recall"))
