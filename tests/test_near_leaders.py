"""Near duplicates of any number are joined by shuffles: no table of pairs or pages is gathered on the driver."""

from pagemill.operators import dedupe
from pagemill.streaming import crawl


def test_nothing_is_broadcast(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(i, " ".join(f"{w}x{i // 3}" for w in words.split()[:40]) + f" end{i % 3}") for i in range(30)] + [(i, words) for i in range(30, 40)]
    keep, plans = crawl.keeper(spark), []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    index = dedupe.PrintIndex(noted)
    known = spark.createDataFrame([(-1, words)], "doc_id long, text string")
    dedupe.near_leaders(known, "doc_id", "text", noted, known=index).collect()
    out = dedupe.near_leaders(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", noted, known=index)
    got = dict(out.collect())
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert all(got[i] == -1 for i in range(30, 40)) and set(got) == set(range(40))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
