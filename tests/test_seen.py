"""A growing set of keys behind a Bloom filter, held against a set."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import seen as module
from pagemill.operators.seen import SeenSet
from pagemill.streaming import crawl


@pytest.mark.parametrize("asked", [0, module.ASKED])
def test_loses_and_invents_nothing(spark, monkeypatch, asked):
    monkeypatch.setattr(module, "ASKED", asked)
    rng, have, met = random.Random(asked), set(), SeenSet(spark, crawl.keeper(spark), blocks=4)
    for _ in range(4):
        batch = [f"https://a.test/{rng.randint(0, 900)}" for _ in range(400)] + [None, None]
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(batch)], "k string, w0 int").repartition(3)
        got = sorted(r.w0 for r in met.fresh(rows, "k").collect())
        assert got == [i for i, k in enumerate(batch) if k not in have]
        some = batch[:200]
        met.add(spark.createDataFrame([(k,) for k in some], "key string"))
        have |= {k for k in some if k}
        assert met.n >= len(have) and met.blocks * module.KEYS >= met.n


def test_the_filter_tells_most(spark):
    met = SeenSet(spark, crawl.keeper(spark))
    keys = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("key"))
    met.add(keys.where("key < 'k3'"))
    met.add(keys.where("key >= 'k3'"))  # a filter that is merged
    other = spark.range(20_000).select(F.concat(F.lit("z"), "id").alias("key"))
    assert met.fresh(other, "key").count() == 20_000
    asked, maybe, there = met.rounds[-1]
    assert (asked, there) == (20_000, 50_000) and maybe < 0.03 * asked
    assert met.fresh(keys, "key").count() == 0 and met.rounds[-1][1] == 50_000


def test_empty(spark):
    met = SeenSet(spark, crawl.keeper(spark))
    none = spark.createDataFrame([], "key string")
    met.add(none)
    assert met.fresh(none, "key").count() == 0 and met.fresh(spark.createDataFrame([("a",)], "key string"), "key").count() == 1
