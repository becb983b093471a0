"""Tables are dealt to tasks by their size, and pages are parsed once."""

from pagemill import registry
from pagemill.operators import structured


def test_a_task_does_not_grow_with_the_table(spark, tmp_path):
    spark.range(3000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert df.rdd.getNumPartitions() == 1 and registry.spread(df).rdd.getNumPartitions() == 16
    three = spark.range(0, 3000, 1, 3)
    assert registry.spread(three).rdd.getNumPartitions() == 48 and registry.spread(three).count() == 3000
    many = spark.range(0, 3000, 1, 64)
    assert registry.spread(many) is many


def test_entities_take_one_parse(spark):
    html = '<script type="application/ld+json">[{"@type": "A"}, {"@type": "B"}]</script><div itemscope itemtype="x/C"><b itemprop="n">v</b></div>'
    found = structured.entities(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.columns == ["page_id", "source", "pos", "entity"]
    assert sorted((r.page_id, r.source, r.pos) for r in found.collect()) == [(1, "jsonld", 0), (1, "jsonld", 1), (1, "microdata", 0)]
