"""Rows close to many references: the exact way against all pairs, the nearest cells by their recall."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill import queries
from pagemill.operators import references as rf

ROW, REF = "id long, vector array<double>, score string", "ref_id long, vector array<double>, least double"


def brute(rows, refs, threshold):
    def cosine(a, b):
        if not a or not b or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
            return 0.0
        norms = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / norms if norms else 0.0

    return sorted((r[0], x[0]) for r in refs for x in rows if cosine(r[1], x[1]) >= (r[2] if threshold is None else threshold))


def clustered(n, d=16, groups=12, seed=3, spread=0.35):
    rng = np.random.default_rng(seed)
    homes = rng.normal(size=(groups, d))
    share = np.where(rng.random(n) < 0.34, 0, rng.integers(0, groups, n))  # a third of all rows in one place
    return (homes[share] + spread * rng.normal(size=(n, d))).tolist()


@pytest.mark.parametrize("most", [rf.MOST_BYTES, 0])
def test_exact_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(rf, "MOST_BYTES", most)  # 0: both sides are shuffled
    vectors = clustered(400)
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(900, None, "x"), (901, [], "x"), (902, [0.0] * 16, "x"), (903, [1.0, None], "x"), (904, [float("nan"), 1.0], "x"), (905, [3.0, 4.0], "x"), (906, [float("inf"), 1.0], "x"), (5, vectors[5], "x")]
    refs = [(i, vectors[i], 0.8) for i in range(0, 400, 20)] + [(900, None, 0.5), (901, [], 0.5), (902, [3.0, 4.0], 0.99), (903, [0.0, 0.0], 0.5), (904, [1.0], 0.5), (0, vectors[0], 0.8)]
    df, asked = spark.createDataFrame(rows, ROW), spark.createDataFrame(refs, REF)
    index = rf.fit(df, "vector", cells=8)
    for threshold, column in ((0.8, 0.8), (None, F.col("least"))):
        got = rf.close_to(df, asked, index, column)
        assert got.columns == ["ref_id", "id", "score"]
        assert sorted((r.ref_id, r.id) for r in got.collect()) == brute(rows, refs, threshold)
    assert (902, 905) in brute(rows, refs, 0.99)


def test_nearest_cells_reach_the_recall_that_is_asked_for(spark):
    vectors = clustered(3000)
    df = spark.createDataFrame([(i, v, "") for i, v in enumerate(vectors)], ROW)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("ref_id"), "vector")
    index = rf.fit(df, "vector", cells=24, sample=600)
    probes = index.probes(0.7, 0.95)
    assert 1 <= probes < 24
    some, every = rf.close_to(df, asked, index, 0.7, probes), rf.close_to(df, asked, index, 0.7)
    got = rf.recall(some, every, ["ref_id", "id"]).first()
    assert got.wanted == len(brute([(i, v) for i, v in enumerate(vectors)], [(i, vectors[i]) for i in range(0, 3000, 20)], 0.7)) and got.recall >= 0.9
    assert index.probes(0.9999999) == 24  # no pair of the sample says how many are enough


def test_empty_tables_and_thresholds(spark):
    none, one = spark.createDataFrame([], ROW), spark.createDataFrame([(1, [1.0, 0.0], "")], ROW)
    asked = one.select(F.col("id").alias("ref_id"), "vector")
    empty = rf.fit(none, "vector")
    assert empty.probes(0.5) == 0
    assert rf.close_to(none, asked, empty).collect() == [] and rf.close_to(one, asked.limit(0), rf.fit(one, "vector")).collect() == []
    assert [tuple(r) for r in rf.close_to(one, asked, empty).collect()] == [(1, 1, 1.0)]  # cells of nothing: all vectors of one length meet
    with pytest.raises(ValueError):
        rf.close_to(one, asked, empty, 0.0)
    assert rf.recall(none.select("id"), none.select("id"), ["id"]).first().recall is None


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the given tables")
def test_recall_over_the_given_vectors(spark):
    got = queries.q_semantic_recall(spark, "/root/testdata/sf0.01").first()
    assert got.wanted > 0 and got.recall >= 0.9
