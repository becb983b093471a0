"""A spider's pages are met by shuffles: no table of pages is gathered on the driver."""

from pyspark.sql import functions as F

from pagemill.operators import gate
from pagemill.streaming import crawl


def test_pages_are_not_broadcast(spark, tmp_path):
    spark.range(40).write.parquet(str(tmp_path / "ids"))  # a small file, of which long texts are made
    own = F.when(F.col("id") % 4 == 0, F.lit("Sorry, page not found")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.sha2(F.concat((F.col("id") - F.col("id") % 2).cast("string"), i.cast("string")), 256)), " "))
    made = spark.read.parquet(str(tmp_path / "ids")).select(F.concat(F.lit("https://a.test/p"), "id", F.lit("x")).alias("page_key"), own.alias("text"), F.lit(0).cast("long").alias("records"))
    home = spark.range(1).select(F.lit("https://a.test/").alias("page_key"), F.lit("home").alias("text"), F.lit(1).cast("long").alias("records"))
    links = F.when(F.col("text") == "home", F.array(*[F.lit(f"/p{i}x") for i in range(41)]))
    pages = made.unionByName(home).select("*", F.lit(None).cast("string").alias("canonical"), links.alias("links"))
    keep, plans = crawl.keeper(spark), []

    def noted(df):
        if "canonical" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    got, _ = crawl.spider(pages, spark.createDataFrame([("https://a.test/",)], "url string"), gate.Limits(max_depth=1, per_pattern_budget=100), noted)
    told = {r.dedupe_key.removeprefix("https://a.test/"): r.outcome for r in got.collect()}
    # of each two pages of one text the first by key stays, and p0x, p4x, ... say that they are missing
    want = {"": "page", "p40x": "absent"} | {f"p{i}x": "soft_404" for i in range(0, 40, 4)} | {f"p{i}x": "page" for i in range(1, 40, 4)}
    want |= {f"p{i}x": "page" if min(f"p{i}x", f"p{i ^ 1}x") == f"p{i}x" else "duplicate" for j in range(2, 40, 4) for i in (j, j + 1)}
    assert told == want
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)
