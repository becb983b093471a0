import gzip

import pytest

from pagemill.operators import gate
from pagemill.sources import web
from pagemill.streaming import crawl

SITE = "https://a.test"
LONG = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"term{i}" for i in range(60))
PAGES = "page_key string, text string, records long, canonical string, links array<string>"


@pytest.fixture(scope="module")
def visited(spark):
    pages = [
        (f"{SITE}/", "home page", 1, None, ["/a", "/b", "/c", "/ghost/1", "/nowhere", "mailto:x@a.test", "/a?utm_source=z", "/a/a/a/a"]),
        (f"{SITE}/a", LONG, 0, "/canon", ["/canon", "/ghost/2", "/d"]),
        (f"{SITE}/b", LONG, 0, None, ["/only-from-b"]),
        (f"{SITE}/c", OTHER + " end", 0, None, ["/a", None]),
        (f"{SITE}/d", OTHER + " end", 2, None, []),
        (f"{SITE}/ghost/1", "Sorry, page not found", 0, None, ["/only-from-ghost"]),
        (f"{SITE}/ghost/2", "Sorry, page not found", 0, None, []),
        (f"{SITE}/canon", LONG, 0, None, []),
    ]
    df = spark.createDataFrame(pages, PAGES)
    got, bad = crawl.spider(df, spark.createDataFrame([(f"{SITE}/",), (f"{SITE}/?gclid=1",)], "url string"), gate.Limits(max_depth=2, allowed_domains=("a.test",)))
    return {r.dedupe_key.removeprefix(SITE): r for r in got.collect()}, [(r.url.removeprefix(SITE), r.reason) for r in bad.collect()]


def test_spider_outcomes(visited):
    got, _ = visited
    assert {k: (r.depth, r.outcome) for k, r in got.items()} == {
        "/": (0, "page"), "/a": (1, "page"), "/b": (1, "duplicate"), "/c": (1, "page"), "/ghost/1": (1, "soft_404"), "/nowhere": (1, "absent"), "/d": (2, "duplicate"),
    }
    assert got["/b"].of_key == f"{SITE}/a" and got["/d"].of_key == f"{SITE}/c"


def test_spider_rejects(visited):
    _, bad = visited
    assert ("/a/a/a/a", "repeated_segment") in bad and ("/ghost/2", "pattern_budget") in bad and not any("only-from" in u or "canon" in u for u, _ in bad)


def test_spider_stubs(spark):
    stub = "this shelf of ours has nothing at all"
    pages = [(f"{SITE}/", "home page", 1, None, ["/x", "/yy", "/zzz"]), *[(f"{SITE}/{k}", stub, 0, None, []) for k in ("x", "yy", "zzz")]]
    df, seeds = spark.createDataFrame(pages, PAGES), spark.createDataFrame([(f"{SITE}/",)], "url string")
    got, _ = crawl.spider(df, seeds, gate.Limits(max_depth=1))
    assert sorted((r.url.removeprefix(SITE), r.outcome) for r in got.collect()) == [("/", "page"), ("/x", "page"), ("/yy", "page"), ("/zzz", "soft_404")]


def test_seen_urls_use_no_budget(spark):
    links = spark.createDataFrame([(f"{SITE}/", h) for h in ("/item/1", "/item/2")] + [(f"{SITE}/item/{i}", h) for i in (1, 2) for h in ("/item/1", "/item/2", "/item/1?utm_source=q", "/item/3")], "page_key string, href string")
    got, bad = crawl.crawl(links, spark.createDataFrame([(f"{SITE}/",)], "url string"), gate.Limits(max_depth=2, per_pattern_budget=3))
    assert {r.url.removeprefix(SITE) for r in got.collect()} == {"/", "/item/1", "/item/2", "/item/3"} and bad.count() == 0


def _map(kind, locs):
    outer = "sitemapindex" if kind == "sitemap" else "urlset"
    return f"<{outer}>{''.join(f'<{kind}><loc>{x}</loc><lastmod>2024-05</lastmod><priority>7</priority></{kind}>' for x in locs)}</{outer}>".encode()


def test_walk_sitemaps(spark, tmp_path):
    documents = [
        (f"{SITE}/index.xml", _map("sitemap", [f"{SITE}/s1.xml.gz", f"{SITE}/s2.xml", f"{SITE}/index.xml", f"{SITE}/gone.xml"])),
        (f"{SITE}/s1.xml.gz", gzip.compress(_map("url", [f"{SITE}/p1", f"{SITE}/p2"]))),
        (f"{SITE}/s2.xml", _map("sitemap", [f"{SITE}/s3.xml"])),
        (f"{SITE}/s3.xml", _map("url", [f"{SITE}/p3"])),
        ("https://b.test/sitemap.xml", b"<broken"),
        ("https://b.test/sitemap_index.xml", _map("url", ["/q1"])),
    ]
    docs = spark.createDataFrame(documents, "url string, body binary")
    sites = spark.createDataFrame([("a", f"{SITE}/"), ("b", "https://b.test/x")], "site string, url string")
    robots = spark.createDataFrame([("a", f"{SITE}/robots.txt", "User-agent: *\nSitemap: /index.xml\nsitemap: /index.xml")], "site string, url string, text string")
    roots = web.sitemap_roots(sites, robots)
    keep = crawl.keeper(spark)

    def walk(**limits):
        entries, errors = web.walk_sitemaps(docs, roots, keep, **limits)
        return [(r.site, r.loc.split("/")[-1]) for r in entries.orderBy("site", "place", "pos").collect()], [(r.site, r.url) for r in errors.collect()]

    assert walk() == ([("a", "p1"), ("a", "p2"), ("a", "p3"), ("b", "q1")], [("b", "https://b.test/sitemap.xml")])
    assert walk(max_documents=3)[0] == [("a", "p1"), ("a", "p2"), ("b", "q1")]


def test_batches_against_an_index_as_all_at_once(spark):
    """Pages in three batches by key, each near to some before: the leaders are those of all pages together."""
    import random

    from pagemill.operators import dedupe
    from pagemill.streaming import crawl

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    bases = [[word() for _ in range(120)] for _ in range(8)]
    rows = []
    for i in range(60):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 60])):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "k long, t string").repartition(3).cache()
    keep = crawl.keeper(spark)
    want = {r.k: r.leader for r in dedupe.near_leaders(df, "k", "t", keep).collect()}
    index, got = dedupe.PrintIndex(keep), {}
    for lo in (0, 25, 45):
        batch = df.where(f"k >= {lo} AND k < {dict([(0, 25), (25, 45), (45, 99)])[lo]}")
        got |= {r.k: r.leader for r in dedupe.near_leaders(batch, "k", "t", keep, known=index).collect()}
    assert got == want and len(set(want.values())) < len(want)
