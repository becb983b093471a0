"""Redirect chains, held against following them one by one."""

import random

import pytest

from pagemill.operators import redirects
from pagemill.streaming import crawl

SCHEMA = "url string, status int, location string"


def one_by_one(table, start, most):
    """table: number -> (status, target number or None or "bad")."""
    seen, at, hops = [start], start, 0
    while True:
        if at not in table:
            return at, hops, None, "absent"
        status, target = table[at]
        if status not in redirects.STATUSES or target is None:
            return at, hops, status, None
        if hops >= most:
            return at, hops, None, "redirect_max"
        if target == "bad":
            return at, hops, None, "ssrf_reject"
        if target in seen:
            return at, hops, None, "redirect_loop"
        seen.append(target)
        at, hops = target, hops + 1


@pytest.mark.parametrize("most", [0, 1, 5, 6])
def test_chains_as_one_by_one(spark, most):
    rng = random.Random(most)
    table = {i: (rng.choice([200, 301, 302, 307, 308, 301]), rng.choice([None, "bad", *[i + 1] * 8, rng.randint(0, 140), i, max(0, i - rng.randint(1, 4))])) for i in range(130)}
    link = lambda t: None if t is None else "mailto:x" if t == "bad" else f"/n{t}z/?utm_source=q"
    rows = [(f"https://a.test/n{i}z", s, link(t)) for i, (s, t) in table.items()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.url: (r.final_url, r.hops, r.status, r.error_kind) for r in redirects.follow(df, crawl.keeper(spark), most).collect()}
    for i in table:
        at, hops, status, error = one_by_one(table, i, most)
        assert got[f"https://a.test/n{i}z"] == (f"https://a.test/n{at}z", hops, status, error), i
    assert len(got) == len(table)


def test_addresses_rows_and_repeats(spark):
    rows = [("https://a.test/x", 301, "http://127.0.0.1/"), ("http://127.0.0.1/", 301, "https://a.test/y"), ("https://a.test/y", 200, None), ("https://a.test/y/", 404, None), (None, 301, "x"), ("nope", 301, "x"), ("https://a.test/z", None, "https://a.test/y"), ("https://a.test/w", 302, " "), ("https://a.test/y", 200, None)]
    got = sorted((tuple(r) for r in redirects.follow(spark.createDataFrame(rows, SCHEMA), crawl.keeper(spark)).collect()))
    assert got == [
        ("http://127.0.0.1/", "http://127.0.0.1/", 0, None, "ssrf_reject"), ("https://a.test/w", "https://a.test/w", 0, 302, None), ("https://a.test/x", "http://127.0.0.1/", 1, None, "ssrf_reject"),
        ("https://a.test/y", "https://a.test/y", 0, 200, None), ("https://a.test/z", "https://a.test/z", 0, None, None),
    ]
    assert redirects.follow(spark.createDataFrame([], SCHEMA), crawl.keeper(spark)).count() == 0


def test_urls_are_normalised_after_rows_are_dealt(spark, tmp_path):
    from pagemill import registry

    spark.createDataFrame([("https://a.test/x", 301, "/y"), (None, 301, "x")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "t"))
    found = redirects.hops(registry.spread(spark.read.parquet(str(tmp_path / "t"))))
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition", 1)
    assert "transform(" in above and "transform(" not in below
    assert [tuple(r) for r in found.collect()] == [("https://a.test/x", "https://a.test/x", 301, None, "https://a.test/y")]
