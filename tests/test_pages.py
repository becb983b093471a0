import gzip
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import dedupe, extract, filters, gate, jobs, quality
from pagemill.operators.filters import RecordFilter
from pagemill.plans import recipe
from pagemill.sources import web
from pagemill.streaming import crawl

PAGE = """<html><head><title> T </title><link rel="canonical" href="https://a.com/c"><meta property="og:title" content="OG"><meta name="description" content="D">
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "P", "offers": {"@type": "Offer", "price": "9.50"}}]}</script>
<script id="__NEXT_DATA__">{"props": {"items": [{"n": 1}, {"n": 2}]}}</script></head><body>
<nav><a href="/login">in</a></nav><div class="card"><a href="/p/1">One</a><span class="price">$1.50</span></div><div class="card"><a href="/p/2">Two</a><span class="price"></span></div>
<a href="mailto:x@y">m</a><a href="/f.pdf">f</a><a href="/p/1">again</a>
<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">Ann</span></div>
<table><tr><th>a<th>b<tr><td>1<td>2<tr><td>3<td>4</table></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://a.com/x/y", PAGE), (2, "https://a.com/z", None), (3, "https://a.com/e", "")], "page_id long, url string, html string")


def test_parts(pages):
    got = {r.page_id: r for r in extract.extract(pages, list(extract.PARTS)).collect()}
    r = got[1]
    assert (r.title, r.canonical, r.meta["title"], r.meta["description"]) == ("T", "https://a.com/c", "OG", "D")
    assert len(r.jsonld) == 2 and '"Offer"' in r.jsonld[1] and '"Ann"' in r.microdata[0]
    assert [dict(x) for x in r.table] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    assert list(r.embedded) == ["__NEXT_DATA__"]
    assert got[2].title is None and got[2].links == [] and got[3].visible_text is None


def test_links(pages):
    assert [(r.page_id, r.href) for r in extract.links(pages).orderBy("pos").collect()] == [(1, "/login"), (1, "/p/1"), (1, "/p/2")]


def test_recipe_end_to_end(pages):
    r = recipe.Recipe("cards", container=".card", fields=(recipe.parse_field("name=a"), recipe.parse_field("link=a::href|to_absolute_url"), recipe.parse_field("price=.price|to_number")), filters=(RecordFilter("name", "ne", "Three"),))
    rows = recipe.run(r, pages).orderBy("name").collect()
    assert [(x.name, x.link, x.price) for x in rows] == [("One", "https://a.com/p/1", 1.5), ("Two", "https://a.com/p/2", None)]
    row = recipe.measure(r, pages).first()
    assert (row.record_count, row.mean_fill, row.can_activate) == (2, 0.833, True)


@pytest.mark.parametrize(
    "source, container, fields, want",
    [
        ("jsonld", "product", ["name=name"], [("P",)]),
        ("microdata", "Person", ["name=name"], [("Ann",)]),
        ("embedded", "__NEXT_DATA__.props.items", ["n=n"], [("1",), ("2",)]),
        ("table", None, ["a=a", "second=b"], [("1", "2"), ("3", "4")]),
    ],
)
def test_other_sources(pages, source, container, fields, want):
    r = recipe.Recipe("r", source=source, container=container, fields=tuple(map(recipe.parse_field, fields)))
    names = [f.name for f in r.fields]
    assert sorted(tuple(x[n] for n in names) for x in recipe.run(r, pages).collect()) == want


def test_recipe_files(tmp_path):
    r = recipe.Recipe("cards", container=".card", fields=(recipe.Field("name", "a", required=True), recipe.Field("price", ".p", transform=("to_number",))), filters=(RecordFilter("price", "gt", 3),))
    recipe.save(r, str(tmp_path / "cards.yaml"))
    (tmp_path / "bad.yaml").write_text("fields: [{name: x, transform: [nonsense]}]")
    (tmp_path / "_draft.yaml").write_text("[")
    good, bad = recipe.load_all(str(tmp_path))
    assert good == {"cards": r} and list(bad) == ["bad.yaml"]
    with pytest.raises(ValueError):
        recipe.Recipe("x", filters=(RecordFilter("gone", "exists"),))


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "", 50.0), (3, None, None), (4, "b", 7.0)], "id long, s string, n double")
    ids = lambda *rules, **k: [r.id for r in filters.keep(df, list(rules), **k).orderBy("id").collect()]
    assert ids(RecordFilter("s", "exists")) == [1, 4] and ids(RecordFilter("s", "missing")) == [2, 3]
    assert ids(RecordFilter("s", "ne", "a")) == [2, 4] and ids(RecordFilter("s", "not_in", ["a", "b"])) == [2]
    assert ids(RecordFilter("n", "between", [5, 7])) == [1, 4] and ids(RecordFilter("n", "eq", "5")) == []
    assert ids(required=["s"]) == [1, 4]
    told = filters.reasons(df, [RecordFilter("n", "lt", 6)], ["s"]).collect()
    assert {r.reason: r.n for r in told} == {"required": 2, "n lt": 1}
    with pytest.raises(ValueError):
        RecordFilter("n", "between", [1])


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b string")
    row = quality.measure(none, none, ["a", "b"]).first()
    assert (row.record_count, row.score, row.can_activate) == (0, 0.0, False)


def test_gate(spark):
    limits = gate.Limits(max_depth=1, allowed_domains=("a.com",), exclude=("/no",), per_pattern_budget=2, max_repeated_segment=2)
    rows = [("https://a.com/p/1", 0), ("https://a.com/p/2", 0), ("https://a.com/p/3", 0), ("https://b.com/", 0), ("https://a.com/no", 0), ("https://a.com/d", 2), ("https://a.com/x/x/x", 0), ("junk", 0)]
    got = {r.url: r.reject_reason for r in gate.admit(spark.createDataFrame(rows, "url string, depth int"), limits, ["url"]).collect()}
    assert list(map(got.get, [u for u, _ in rows])) == [None, None, "pattern_budget", "out_of_scope", "excluded", "depth_exceeded", "repeated_segment", "invalid_url"]


def test_fetch_errors(spark):
    df = spark.createDataFrame([(s,) for s in (200, 404, 403, 429, 503)], "s int")
    assert [(r.e, r.t) for r in df.select(gate.fetch_error(F.col("s")).alias("e"), gate.retryable(F.col("s")).alias("t")).collect()] == [(None, False), ("http_4xx", False), ("blocked_403", False), ("blocked_429", True), ("http_5xx", True)]


def test_duplicates(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    near = long.replace(" ", " x ", 1)
    rows = [(1, long), (2, long), (3, near), (4, " ".join(f"o{i}" for i in range(300))), (5, "short text"), (6, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    assert [(r.k, r.of_key) for r in dedupe.exact(df, "k", "t", "k").collect()] == [(2, 1)]
    assert {r.k: r.leader for r in dedupe.near_leaders(df, "k", "t", crawl.keeper(spark)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_leaders_are_kept_pages(spark):
    """A page near to one that is itself a duplicate, but to no leader, leads."""
    prints = [(1, 0), (2, 0b111111), (3, 0b111111 << 6 | 0b111111)]
    pairs = dedupe.near_pairs(spark.createDataFrame(prints, "k long, fingerprint long"), "k").collect()
    assert sorted((r.a, r.b, r.distance) for r in pairs) == [(1, 2, 6), (2, 3, 6)]


def test_jobs(spark):
    df = spark.createDataFrame([("a", "completed", 2, 9), ("b", "running", 1, 4), ("c", "pending", 0, 0)], "job_id string, status string, attempts int, pages_crawled int")
    named = df.sparkSession.createDataFrame([("a",), ("b",), ("b",), (None,)], "job_id string")
    assert {r.job_id: (r.status, r.pages_crawled) for r in jobs.retry(df, named).collect()} == {"a": ("pending", 0), "b": ("running", 4), "c": ("pending", 0)}
    assert {r.job_id: r.status for r in jobs.cancel(df, named).collect()} == {"a": "completed", "b": "cancelled", "c": "pending"}
    assert [r.job_id for r in jobs.page(df, ["job_id"], 1, 1).collect()] == ["b"]


# --- sources and sinks


def test_robots_and_sitemaps(spark):
    robots = spark.createDataFrame([("h", "User-agent: *\nSITEMAP: /a.xml\nsitemap: https://h.com/b.xml\nSitemap: /a.xml", "https://h.com/robots.txt")], "h string, body string, url string")
    assert [r.sitemap for r in web.robots_sitemaps(robots, "h", "body", "url").orderBy("pos").collect()] == ["https://h.com/a.xml", "https://h.com/b.xml"]
    xml = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://h.com/1 </loc><lastmod>2024-05</lastmod><priority>7</priority></url><url><loc></loc></url></urlset>'
    df = spark.createDataFrame([(1, xml), (2, gzip.compress(xml)), (3, b"<broken"), (4, b'<!DOCTYPE x [<!ENTITY a "b">]><urlset/>')], "k long, body binary")
    rows = web.sitemap_entries(df, "k", "body").collect()
    good = [(r.k, r.loc, str(r.lastmod)[:10], r.priority) for r in rows if r.error is None]
    assert sorted(good) == [(1, "https://h.com/1", "2024-05-01", 1.0), (2, "https://h.com/1", "2024-05-01", 1.0)]
    assert sorted(r.k for r in rows if r.error) == [3, 4]


def test_feeds(spark):
    rss = b"<rss><channel><item><title>A</title><link>/1</link><pubDate>Wed, 02 Oct 2002 13:00:00 GMT</pubDate></item><item><title>B</title><guid>g</guid></item></channel></rss>"
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link rel="self" href="/s"/><link href="/c"/><author><name>Z</name></author></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, b"<x"), (4, b'<!DOCTYPE a><rss/>')], "k long, body binary")
    got = {r.k: r.f for r in df.select("k", web.read_feed(F.col("body"), F.lit("https://h.com/")).alias("f")).collect()}
    assert [(e.title, e.url, e.published_at) for e in got[1]] == [("A", "https://h.com/1", "2002-10-02T13:00:00+00:00"), ("B", "https://h.com/g", None)]
    assert [(e.title, e.url, e.author) for e in got[2]] == [("C", "https://h.com/c", "Z")]
    assert got[3] == [] and got[4][0].error


def test_decoding(spark):
    cases = [("é".encode(), None, "é", "utf-8"), ("한국".encode("cp949"), "text/html; charset=EUC-KR", "한국", "cp949"), ("한국".encode("cp949"), None, "한국", "cp949"), (b'<meta charset="shift_jis">' + "日".encode("cp932"), None, None, "cp932"), (b"\xef\xbb\xbfx", "text/html; charset=latin-1", "x", "utf-8"), (b"\xe9\xff\x81", "charset=nonsense", None, "cp1252"), (None, None, "", "utf-8")]
    df = spark.createDataFrame([(i, b, c) for i, (b, c, _, _) in enumerate(cases)], "i int, b binary, c string")
    got = {r.i: r.d for r in df.select("i", web.decode_html(F.col("b"), F.col("c")).alias("d")).collect()}
    for i, (_, _, text, encoding) in enumerate(cases):
        assert got[i].encoding == encoding and text in (None, got[i].text)


def test_archive(spark, tmp_path):
    path = str(tmp_path / "archive")
    web.archive(spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "body binary"), path)
    web.archive(spark.createDataFrame([(b"b",), (b"c",)], "body binary"), path)
    assert tuple(web.archive_stats(spark, path).first()) == (3, 3)
    digests = spark.createDataFrame([(b"c",), (b"zz",)], "body binary").select(F.sha2("body", 256).alias("digest"))
    assert [bytes(r.body) for r in web.archived(spark, path, digests).collect()] == [b"c"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, '{"b": null, "a": [1]}'), (1, '{"a": "x,y"}')], "seq long, data string")
    web.export_csv(df, "data", "seq", str(tmp_path / "csv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).collect()) == ["[1],", '"x,y",', "a,b"] or spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    web.export_jsonl(df, "data", "seq", str(tmp_path / "jsonl"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "jsonl")).collect()) == sorted(r.data for r in df.collect())


# --- traversal and streams


def test_depths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 6), (6, 7)], "src long, dst long")
    got = {r.node: r.depth for r in crawl.depths(edges, spark.createDataFrame([(1,)], "node long"), 3).collect()}
    assert got == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2, 6: 3}


def test_crawl(spark):
    links = spark.createDataFrame([("https://a.com/", "/x"), ("https://a.com/", "https://b.com/"), ("https://a.com/x", "/y"), ("https://a.com/y", "/")], "page_key string, href string")
    seeds = spark.createDataFrame([("https://a.com",)], "url string")
    frontier, rejects = crawl.crawl(links, seeds, gate.Limits(max_depth=2, allowed_domains=("a.com",)))
    assert {r.dedupe_key: r.depth for r in frontier.collect()} == {"https://a.com/": 0, "https://a.com/x": 1, "https://a.com/y": 2}
    assert [(r.url, r.reason) for r in rejects.collect()] == [("https://b.com/", "out_of_scope")]
