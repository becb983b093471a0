"""Rows and references meet as blocks; how they are packed changes no bit of a score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import references as rf


@pytest.mark.parametrize("most", [rf.MOST_BYTES, 0])
def test_blocks_meet_and_scores_are_those_of_plain_sums(spark, monkeypatch, most):
    monkeypatch.setattr(rf, "MOST_BYTES", most)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(6, 16))[rng.integers(0, 6, 1500)] + 0.5 * rng.normal(size=(1500, 16))).tolist()
    df = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(vectors)] + [(None, [1.0, 2.0]), ("n", [1.0, 2.0])], "id string, vector array<double>").coalesce(2)
    asked = df.where("id IS NULL OR try_cast(substr(id, 2, 9) AS INT) % 20 = 0").select(F.col("id").alias("ref_id"), "vector")
    index = rf.fit(df, "vector", cells=8)
    norm = lambda c: F.sqrt(rf._dot(F.col(c), F.col(c)))
    pairs = df.crossJoin(asked.withColumnRenamed("vector", "w")).where(F.size("vector") == F.size("w"))
    want = pairs.select("ref_id", "id", (rf._dot(F.col("vector"), F.col("w")) / (norm("vector") * norm("w"))).alias("score")).where("score >= 0.5")
    want = sorted(map(str, want.collect()))
    met, scored = [], rf._scored
    monkeypatch.setattr(rf, "_scored", lambda blocks: met.append(blocks) or scored(blocks))
    got = rf.close_to(df, asked, index, 0.5)
    assert sorted(map(str, got.collect())) == want and len(want) > 1000
    if most:
        assert met[0].count() <= 2 * 9  # of over 100,000 pairs
    monkeypatch.setattr(rf, "BLOCK_BYTES", 1000)  # seven vectors a block
    assert sorted(map(str, rf.close_to(df, asked, index, 0.5).collect())) == want
