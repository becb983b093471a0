"""Queries over markup, addresses and answers built from the given tables, so that SQL over the same columns can tell
what has to come out. Each builds its pages in the query and runs an operator over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import paths, texts, urls, values
from pagemill.operators import dedupe, discover, extract, filters, gate, jobs, naming, nodes, redirects, reduce, scopes, structure, structured
from pagemill.operators.filters import RecordFilter
from pagemill.operators.seen import SeenSet
from pagemill.plans import recipe, verbs
from pagemill.registry import query, spread, table
from pagemill.sources import web
from pagemill.streaming import crawl, events as event_stream, tail


def made(spark, sf_dir: str, name: str, *key: str, **columns: str) -> DataFrame:
    """Columns of a table with more, each a Spark SQL expression."""
    return spread(table(spark, sf_dir, name)).select(*key, *[F.expr(v).alias(k) for k, v in columns.items()])


# --- sources


@query("""SELECT s_suppkey, 0 AS pos, 'https://s' || s_suppkey || '.test/maps/' || s_nationkey || '.xml' AS sitemap FROM supplier
UNION ALL SELECT s_suppkey, 1, 'https://maps.test/' || s_suppkey FROM supplier""")
def q_robots_sitemaps(spark, sf_dir):
    text = "'User-agent: *\\nDisallow: /x\\nSITEMAP : /maps/' || s_nationkey || '.xml\\nsitemap: https://maps.test/' || s_suppkey || '\\nSitemap:/maps/' || s_nationkey || '.xml'"
    df = made(spark, sf_dir, "supplier", "s_suppkey", text=text, url="'https://s' || s_suppkey || '.test/robots.txt'")
    return web.robots_sitemaps(df, "s_suppkey", "text", "url").select("s_suppkey", "pos", "sitemap")


SITEMAP = "'<urlset>' || '<url><loc> https://p.test/' || p_partkey || '</loc><lastmod>199' || p_partkey % 8 || '-0' || (1 + p_partkey % 9) || '</lastmod><priority>' || p_size / 10 || '</priority></url><url><loc></loc></url><url><loc>/rel</loc></url>'"


@query("""WITH e AS (SELECT p_partkey, 'url' AS kind, 'https://p.test/' || p_partkey AS loc, make_timestamp(1990 + p_partkey % 8, 1 + p_partkey % 9, 1, 0, 0, 0.0) AS lastmod, least(p_size / 10.0, 1.0)::DOUBLE AS priority, false AS failed FROM part WHERE p_partkey % 7 > 0
UNION ALL SELECT p_partkey, 'url', '/rel', NULL, NULL, false FROM part WHERE p_partkey % 7 > 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, true FROM part WHERE p_partkey % 7 = 0) SELECT * FROM e""")
def q_sitemap_entries(spark, sf_dir):
    body = f"CAST({SITEMAP} || CASE p_partkey % 7 WHEN 0 THEN '<broken' ELSE '</urlset>' END AS BINARY)"
    df = web.sitemap_entries(made(spark, sf_dir, "part", "p_partkey", body=body), "p_partkey", "body")
    return df.select("p_partkey", "kind", "loc", "lastmod", "priority", F.col("error").isNotNull().alias("failed"))


@query("""SELECT n_nationkey AS site, CASE WHEN n_nationkey % 2 = 0 THEN 'https://n' || n_nationkey || '.test/c/' || c_custkey ELSE 'https://n' || n_nationkey || '.test/k/' || c_custkey END AS loc
FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def q_sitemap_walk(spark, sf_dir):
    """Even nations name an index in robots.txt, whose three shards list the customers; odd ones have a plain sitemap at a usual place."""
    home = F.concat(F.lit("https://n"), F.col("n_nationkey").cast("string"), F.lit(".test"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", home.alias("home"))
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    even = F.col("n_nationkey") % 2 == 0
    entry = F.concat(F.lit("<url><loc>"), "home", F.when(even, "/c/").otherwise("/k/"), "c_custkey", F.lit("</loc></url>"))
    part = F.when(even, F.concat("home", F.lit("/s"), F.col("c_custkey") % 3, F.lit(".xml"))).otherwise(F.concat("home", F.lit("/sitemap.xml")))
    body = lambda c: F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(c), ""), F.lit("</urlset>")).cast("binary").alias("body")
    shards = people.groupBy(part.alias("url")).agg(body(entry))
    index = F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>"), "home", F.lit(f"/s{i}.xml</loc></sitemap>")) for i in range(3)], F.lit("</sitemapindex>"))
    documents = shards.unionByName(nations.where(even).select(F.concat("home", F.lit("/index.xml")).alias("url"), index.cast("binary").alias("body")))
    sites = nations.select(F.col("n_nationkey").alias("site"), F.col("home").alias("url"))
    robots = nations.where(even).select(F.col("n_nationkey").alias("site"), F.concat("home", F.lit("/robots.txt")).alias("url"), F.lit("Sitemap: /index.xml").alias("text"))
    entries, _ = web.walk_sitemaps(documents, web.sitemap_roots(sites, robots), crawl.keeper(spark))
    return entries.select("site", "loc")


@query("""SELECT n_nationkey, unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/sitemap/sitemap.xml']) AS path, 'https://' || lower(replace(n_name, ' ', '-')) || '.test' AS root FROM nation""")
def q_sitemap_candidates(spark, sf_dir):
    df = made(spark, sf_dir, "nation", "n_nationkey", root="'https://' || lower(replace(n_name, ' ', '-')) || '.test'")
    df = df.select("n_nationkey", "root", F.explode(web.sitemap_candidates(F.concat("root", F.lit("/x/y?z=1")))).alias("url"))
    return df.select("n_nationkey", F.expr("substr(url, length(root) + 1)").alias("path"), "root")


@query("""SELECT o_orderkey, 'order ' || o_orderkey AS title, 'https://f.test/o/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%dT00:00:00+00:00') AS published_at,
  'about & ' || o_orderpriority AS summary, CASE WHEN o_orderkey % 2 = 1 THEN 'clerk ' || o_custkey END AS author FROM orders WHERE o_orderkey % 5 > 0""")
def q_feed(spark, sf_dir):
    """RSS of even orders, Atom of odd ones; each fifth is malformed and gives nothing."""
    rss = "'<rss><channel><item><title>order ' || o_orderkey || '</title><link>/o/' || o_orderkey || '</link><pubDate>' || date_format(o_orderdate, 'EEE, dd MMM yyyy') || ' 00:00:00 GMT</pubDate><description>about &amp; ' || o_orderpriority || '</description></item></channel></rss>'"
    atom = "'<feed xmlns=\"http://www.w3.org/2005/Atom\"><entry><title>order ' || o_orderkey || '</title><link rel=\"self\" href=\"/no\"/><link href=\"o/' || o_orderkey || '\"/><published>' || date_format(o_orderdate, 'EEE, dd MMM yyyy') || ' 02:00:00 +0200</published><summary>about &amp; ' || o_orderpriority || '</summary><author><name>clerk ' || o_custkey || '</name></author></entry></feed>'"
    body = f"CAST(CASE WHEN o_orderkey % 5 = 0 THEN '<rss><item>' WHEN o_orderkey % 2 = 0 THEN {rss} ELSE {atom} END AS BINARY)"
    df = made(spark, sf_dir, "orders", "o_orderkey", body=body)
    return df.select("o_orderkey", F.explode(web.read_feed(F.col("body"), F.lit("https://f.test/"))).alias("e")).select("o_orderkey", "e.title", "e.url", "e.published_at", "e.summary", "e.author")


@query("""SELECT c_custkey, c_name || ' é ß' || CASE WHEN c_custkey % 5 IN (1, 3) THEN ' x' ELSE ' 한국' END AS text, CASE c_custkey % 5 WHEN 1 THEN 'cp1252' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'cp1252' ELSE 'utf-8' END AS encoding,
  c_custkey % 5 IN (0, 3) AS guessed FROM customer""")
def q_decode(spark, sf_dir):
    """Guessed UTF-8; the header's ISO-8859-1; a byte-order mark over a wrong header; guessed Western; a header that does not decode, then UTF-8 declared by it."""
    rich, plain = "c_name || ' é ß 한국'", "c_name || ' é ß x'"
    body = f"CASE c_custkey % 5 WHEN 1 THEN encode({plain}, 'ISO-8859-1') WHEN 2 THEN unhex('FFFE') || encode({rich}, 'UTF-16LE') WHEN 3 THEN encode({plain}, 'ISO-8859-1') ELSE encode({rich}, 'UTF-8') END"
    kind = "CASE c_custkey % 5 WHEN 1 THEN 'text/html; charset=ISO-8859-1' WHEN 2 THEN 'text/html; charset=utf-8' WHEN 4 THEN 'text/html; charset=UTF-8' END"
    df = made(spark, sf_dir, "customer", "c_custkey", body=body, kind=kind).select("c_custkey", web.decode_html(F.col("body"), F.col("kind")).alias("d"))
    return df.select("c_custkey", "d.text", "d.encoding", F.col("d.declared").isNull().alias("guessed"))


@query("""SELECT c_custkey, unnest([0, 1, 2]) AS place, unnest(['https://e.test/feed/' || c_custkey, 'https://e.test/data.json', 'https://e.test/_next/data/b' || c_nationkey || '/shop/' || c_custkey || '.json']) AS endpoint,
  unnest(['feed', 'json_alternate', 'next_data']) AS kind, unnest(['declared', 'declared', 'derived']) AS confidence, unnest([c_name, NULL, NULL]) AS title FROM customer""")
def q_endpoints(spark, sf_dir):
    link = "'<link rel=\"alternate\" type=\"'"
    html = f"{link} || 'application/rss+xml\" title=\"' || c_name || '\" href=\"/feed/' || c_custkey || '\">' || {link} || 'Application/JSON\" href=\"/data.json\">' || {link} || 'text/css\" href=\"/x.css\">' || {link} || 'application/json\" href=\"/data.json\"><script id=\"__NEXT_DATA__\">{{\"buildId\": \"b' || c_nationkey || '\"}}</script>'"
    df = made(spark, sf_dir, "customer", "c_custkey", html=html.replace("{{", "{").replace("}}", "}"), url="'https://e.test/shop/' || c_custkey || '/'")
    df = discover.endpoints(df, "c_custkey")
    place = F.when(F.col("kind") == "feed", 0).when(F.col("kind") == "json_alternate", 1).otherwise(2)
    return df.select("c_custkey", place.alias("place"), "endpoint", "kind", "confidence", "title")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'link_header' WHEN 1 THEN 'next_url' ELSE 'page' END AS style,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://api.test/v/o?after=' || o_orderkey WHEN 1 THEN 'https://api.test/n/' || o_custkey ELSE CAST(o_custkey + 1 AS VARCHAR) END AS next,
  CASE WHEN o_orderkey % 3 = 2 THEN 'https://api.test/v/list?q=a%20b&page=' || (o_custkey + 1) ELSE CASE o_orderkey % 3 WHEN 0 THEN 'https://api.test/v/o?after=' || o_orderkey ELSE 'https://api.test/n/' || o_custkey END END AS next_page,
  CASE WHEN o_orderkey % 3 > 0 THEN 900 END::BIGINT AS total FROM orders""")
def q_next_page(spark, sf_dir):
    asked = F.lit("https://api.test/v/list?page=9&q=a%20b")
    df = made(spark, sf_dir, "orders", "o_orderkey", link="CASE o_orderkey % 3 WHEN 0 THEN '</v/p>; rel=\"prev\", <o?after=' || o_orderkey || '>; rel=\"next\"' END", body="CASE o_orderkey % 3 WHEN 1 THEN '{\"total\": 900, \"links\": {\"next\": \"/n/' || o_custkey || '\"}}' ELSE '{\"total\": 900, \"page\": ' || o_custkey || '}' END")
    df = df.select("o_orderkey", paths.pagination(F.col("body"), F.col("link"), asked).alias("p"))
    ready = F.when(F.col("p.style").isin("link_header", "next_url"), F.col("p.next")).otherwise(paths.with_parameter(asked, "page", F.col("p.next")))
    return df.select("o_orderkey", "p.style", "p.next", ready.alias("next_page"), "p.total")


@query("SELECT count(DISTINCT o_orderpriority || o_orderstatus) AS blobs, sum(DISTINCT_BYTES) AS bytes FROM (SELECT o_orderpriority, o_orderstatus, length(o_orderpriority || o_orderstatus) AS DISTINCT_BYTES FROM orders GROUP BY ALL)".replace("count(DISTINCT o_orderpriority || o_orderstatus)", "count(*)"))
def q_archive(spark, sf_dir):
    """Written twice; bodies that are there already are not written again."""
    path = crawl.shared_folder(spark)
    bodies = made(spark, sf_dir, "orders", body="CAST(o_orderpriority || o_orderstatus AS BINARY)", half="o_orderstatus < 'O'")
    web.archive(bodies.where("half"), path)
    web.archive(bodies, path)
    return web.archive_stats(spark, path).select("blobs", F.col("bytes").cast("decimal(38,0)").alias("bytes"))


# --- URLs and addresses


@query("""SELECT o_orderkey, 'https://xn--bcher-kva' || o_orderkey % 3 || '.de:8443/a/c~x/' || (o_custkey % 50) || '/%ED%95%9C?b=2&a=1&c=%26' AS url, 'https://bücher' || o_orderkey % 3 || '.de:8443/a/c~x/' || (o_custkey % 50) || '/%ED%95%9C?a=1&b=2&c=%26' AS dedupe_key, 8443 AS port FROM orders""".replace("xn--bcher-kva' || o_orderkey % 3 || '", "bücher' || o_orderkey % 3 || '"))
def q_url_parts(spark, sf_dir):
    """Userinfo, a port, escapes of both kinds, dot segments, double slashes, tabs, tracking, a fragment."""
    raw = "' HTTPS://User:pw@BÜCHER' || o_orderkey % 3 || '.de:8443/a/./b/../c%7Ex//' || (o_custkey % 50) || '/한\\t?b=2&utm_source=q&a=1&c=%26&fbclid=1&PHPSESSID=4#top '"
    df = made(spark, sf_dir, "orders", "o_orderkey", raw=raw).select("o_orderkey", urls.normalize(F.col("raw")).alias("u"))
    return df.select("o_orderkey", "u.url", "u.dedupe_key", "u.port")


@query("""SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'https://j.test/a/b/' || c_custkey WHEN 2 THEN 'https://j.test/r/' || c_custkey WHEN 3 THEN 'http://o.test/x' WHEN 4 THEN 'https://cdn.test/y'
  WHEN 5 THEN 'https://j.test/a/b/c?n=' || c_custkey WHEN 6 THEN 'https://j.test/up/' || c_custkey WHEN 7 THEN NULL ELSE 'https://j.test/a/b/c?q=1' END AS url,
  CASE c_custkey % 3 WHEN 0 THEN 'https://shop.test/x' WHEN 1 THEN 'ftp://x' ELSE '' END AS typed FROM customer""")
def q_url_join(spark, sf_dir):
    href = "CASE c_custkey % 9 WHEN 0 THEN '  ' WHEN 1 THEN '' || c_custkey WHEN 2 THEN '/r/' || c_custkey WHEN 3 THEN 'http://o.test/x' WHEN 4 THEN '//cdn.test/y' WHEN 5 THEN '?n=' || c_custkey WHEN 6 THEN '../../up/' || c_custkey WHEN 7 THEN 'mailto:x@y.z' ELSE '#end' END"
    df = made(spark, sf_dir, "customer", "c_custkey", href=href, typed="CASE c_custkey % 3 WHEN 0 THEN ' shop.test/x ' WHEN 1 THEN 'ftp://x' ELSE '' END")
    return df.select("c_custkey", urls.normalize(F.col("href"), F.lit("https://j.test/a/b/c?q=1"))["url"].alias("url"), urls.with_scheme(F.col("typed")).alias("typed"))


HOSTS = "CASE c_custkey % 8 WHEN 0 THEN 'www.shop' || c_nationkey || '.co.uk' WHEN 1 THEN 'a.b' || c_nationkey || '.com' WHEN 2 THEN 'me' || c_nationkey || '.github.io' WHEN 3 THEN 'co.jp' WHEN 4 THEN '10.0.0.' || c_nationkey WHEN 5 THEN 'x.y.city.kawasaki.jp' WHEN 6 THEN 'p.q.ward.kobe.jp' ELSE 'localhost' END"


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'shop' || c_nationkey || '.co.uk' WHEN 1 THEN 'b' || c_nationkey || '.com' WHEN 2 THEN 'me' || c_nationkey || '.github.io' WHEN 5 THEN 'kawasaki.jp' WHEN 6 THEN 'kobe.jp' END AS built_in,
  CASE c_custkey % 8 WHEN 0 THEN 'shop' || c_nationkey || '.co.uk' WHEN 1 THEN 'b' || c_nationkey || '.com' WHEN 2 THEN 'github.io' WHEN 5 THEN 'city.kawasaki.jp' WHEN 6 THEN 'q.ward.kobe.jp' END AS listed, c_custkey % 8 IN (1, 4) AS scoped FROM customer""")
def q_registrable_hosts(spark, sf_dir):
    """By the rules built in, and by a list with plain, wildcard and exception rules."""
    df = made(spark, sf_dir, "customer", "c_custkey", host=HOSTS)
    rules = urls.suffix_rules(spark.createDataFrame([(x,) for x in ["// list", "com", "uk", "co.uk", "io", "jp", "co.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", ""]], "value string"))
    scope = list(urls.checked_scope(tuple([f"b{i}.com" for i in range(25)] + [f"10.0.0.{i}" for i in range(25)])))
    out = urls.registrable_domains(df, "host", rules)
    return out.select("c_custkey", urls.registrable_domain(F.col("host")).alias("built_in"), F.col("domain").alias("listed"), urls.in_scope(F.col("host"), scope).alias("scoped"))


@query("""SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN 'private' WHEN 3 THEN 'link_local' WHEN 4 THEN 'documentation' WHEN 6 THEN 'translated' WHEN 7 THEN 'multicast' WHEN 8 THEN 'loopback' WHEN 9 THEN 'unspecified' END AS denied,
  o_orderkey % 12 < 11 AS literal FROM orders""")
def q_denied_ipv6(spark, sf_dir):
    """Mapped, 6to4 and compatible spellings of IPv4, plain ranges, public addresses, and what is no address."""
    tail = "lower(hex(o_custkey % 65536))"
    address = f"""CASE o_orderkey % 12 WHEN 0 THEN '::ffff:127.0.' || o_custkey % 256 || '.1' WHEN 1 THEN '2002:0a' || lpad(lower(hex(o_custkey % 256)), 2, '0') || '::' || {tail} WHEN 2 THEN 'fd00:1::' || {tail} WHEN 3 THEN '[fe80::' || {tail} || '%eth0]'
      WHEN 4 THEN '2001:db8:0:0:0:0:0:' || {tail} WHEN 5 THEN '2606:4700::' || {tail} WHEN 6 THEN '64:ff9b::1.2.3.' || o_custkey % 256 WHEN 7 THEN 'FF02::' || {tail} WHEN 8 THEN '::1' WHEN 9 THEN '::' WHEN 10 THEN '::ffff:8.8.8.' || o_custkey % 256 ELSE 'no:address' END"""
    df = made(spark, sf_dir, "orders", "o_orderkey", address=address)
    return df.select("o_orderkey", urls.denied_address(F.col("address")).alias("denied"), urls.ipv6_digits(F.col("address")).isNotNull().alias("literal"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'xn--bcher-kva.de' WHEN 1 THEN 'plain' || c_nationkey || '.org' ELSE 'xn--3e0b707e' END AS host FROM customer""")
def q_idna(spark, sf_dir):
    df = made(spark, sf_dir, "customer", "c_custkey", host="CASE c_custkey % 3 WHEN 0 THEN 'bücher.de' WHEN 1 THEN 'plain' || c_nationkey || '.org' ELSE '한국' END")
    return df.select("c_custkey", urls.idna(F.col("host")).alias("host"))


# --- gate


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN 'conn_timeout' WHEN 1 THEN 'ssrf_reject' WHEN 2 THEN 'conn_refused' WHEN 3 THEN 'tls_error' WHEN 4 THEN 'internal' WHEN 5 THEN 'http_5xx' WHEN 6 THEN 'blocked_429' WHEN 7 THEN 'blocked_403' WHEN 8 THEN 'http_4xx' WHEN 9 THEN 'size_exceeded' END AS error_kind FROM orders)
SELECT f.o_orderkey, error_kind, error_kind IS NOT NULL AND error_kind IN ('conn_timeout', 'conn_refused', 'http_5xx', 'blocked_429') AS retryable, CASE WHEN error_kind = 'blocked_429' THEN CASE WHEN o_custkey % 2 = 0 THEN o_custkey::DOUBLE ELSE 90.0 END END AS retry_after_s,
  CASE error_kind WHEN 'blocked_429' THEN least(CASE WHEN o_custkey % 2 = 0 THEN o_custkey::DOUBLE ELSE 90.0 END, 300.0) WHEN 'blocked_403' THEN 30.0 END AS pause, error_kind IS NULL AS kept FROM f JOIN orders USING (o_orderkey)""")
def q_fetch_outcomes(spark, sf_dir):
    k = "o_orderkey % 11"
    df = made(spark, sf_dir, "orders", "o_orderkey", "o_custkey", status=f"CASE {k} WHEN 5 THEN 502 WHEN 6 THEN 429 WHEN 7 THEN 403 WHEN 8 THEN 410 WHEN 9 THEN 200 WHEN 10 THEN 200 END", body=f"CAST(CASE {k} WHEN 9 THEN 'eleven bytes' ELSE 'short' END AS BINARY)",
              retry_after="CASE WHEN o_custkey % 2 = 0 THEN '' || o_custkey ELSE 'Thu, 01 Jan 1998 00:01:30 GMT' END", error=f"CASE {k} WHEN 0 THEN 'ConnectTimeout' WHEN 1 THEN 'ConnectError' WHEN 2 THEN 'ConnectError' WHEN 3 THEN 'SSLError' WHEN 4 THEN 'KeyError' END", message=f"CASE {k} WHEN 1 THEN 'unpinned host x' END")
    out = gate.judged_fetches(df, F.lit("1998-01-01").cast("timestamp"), byte_limit=10)
    return out.select("o_orderkey", "error_kind", "retryable", "retry_after_s", gate.host_pause(F.col("error_kind"), F.col("retry_after_s")).alias("pause"), F.col("body").isNotNull().alias("kept"))


@query("""WITH r AS (SELECT o_custkey % 40 AS pattern, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS nth FROM orders) SELECT pattern, 20 AS "limit", o_orderkey, (SELECT count(*) FROM r x WHERE x.pattern = r.pattern AND nth > 20 - r.pattern % 3) AS over FROM r WHERE nth = 21""")
def q_budget_exhausted(spark, sf_dir):
    """Each pattern that goes beyond its budget, once, and how many rows are over what earlier rounds left of it."""
    df = made(spark, sf_dir, "orders", "o_orderkey", pattern="o_custkey % 40")
    used = spark.range(40).select(F.col("id").alias("pattern"), (F.col("id") % 3).alias("n"))
    over = gate.within_budget(df, "pattern", ["o_orderkey"], 20, used).where("over").groupBy("pattern").agg(F.count(F.lit(1)).alias("over"))
    return gate.exhausted(df, "pattern", ["o_orderkey"], 20).join(over, "pattern")


@query("""WITH h AS (SELECT c_nationkey, min(c_custkey) AS seen FROM customer GROUP BY 1 ORDER BY seen LIMIT 10) SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM h) ORDER BY c_custkey LIMIT 60""")
def q_host_and_page_limits(spark, sf_dir):
    limits = gate.Limits(max_hosts=10, max_pages=60)
    df = gate.within_hosts(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", limits)
    return gate.page_budget(df, ["c_custkey"], limits).select("c_custkey")


@query("""SELECT c_nationkey AS host, count(*) FILTER (c_mktsegment = 'BUILDING') AS pending, count(*) FILTER (c_mktsegment = 'MACHINERY') AS fetched, count(*) FILTER (c_mktsegment = 'FURNITURE') AS failures FROM customer GROUP BY 1""")
def q_host_stats(spark, sf_dir):
    df = made(spark, sf_dir, "customer", host="c_nationkey", status="CASE c_mktsegment WHEN 'BUILDING' THEN 'pending' WHEN 'MACHINERY' THEN 'fetched' WHEN 'FURNITURE' THEN 'failed' END")
    return gate.host_stats(df, "host")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'path_depth' WHEN 1 THEN 'repeated_segment' WHEN 2 THEN 'query_params' END AS reject_reason FROM customer""")
def q_trap_reasons(spark, sf_dir):
    url = "'https://t.test/' || CASE c_custkey % 4 WHEN 0 THEN 'a/b/c/d/e/' WHEN 1 THEN 'x/y/x/x/' WHEN 2 THEN 'p?a=1&b=2&c=3' ELSE 'ok/x/y/x?a=1' END || c_custkey"
    df = made(spark, sf_dir, "customer", "c_custkey", url=url, depth="0")
    return gate.admit(df, gate.Limits(max_path_depth=5, max_repeated_segment=2, max_query_params=2, per_pattern_budget=1 << 30), ["c_custkey"], keep_table=crawl.keeper(spark)).select("c_custkey", "reject_reason")


SITE = "CASE WHEN c_custkey % 4 = 0 THEN 'a' || c_custkey || '.shop' || c_nationkey || '.com' WHEN c_custkey % 4 = 1 THEN 'shop' || c_nationkey || '.com' WHEN c_custkey % 4 = 2 THEN 'myshop' || c_nationkey || '.com' ELSE '10.0.0.' || c_nationkey END"
DOMAIN = "CASE WHEN s_suppkey % 3 = 0 THEN 'shop' || s_nationkey || '.com' WHEN s_suppkey % 3 = 1 THEN 'a' || s_suppkey || '.shop' || s_nationkey || '.com' ELSE '10.0.0.' || s_nationkey END"


@query(f"""WITH h AS (SELECT c_custkey, {SITE} AS host FROM customer), d AS (SELECT DISTINCT {DOMAIN} AS domain FROM supplier)
SELECT c_custkey, host, max_by(domain, length(domain)) AS scope FROM h LEFT JOIN d ON host = domain OR (host LIKE '%.' || domain AND NOT host LIKE '10.%') GROUP BY ALL""")
def q_scopes(spark, sf_dir):
    """The narrowest domain of a table of scopes for each host."""
    hosts = made(spark, sf_dir, "customer", "c_custkey", host=SITE)
    return scopes.within(hosts, "host", made(spark, sf_dir, "supplier", domain=DOMAIN))


@query(f"""WITH a AS (SELECT DISTINCT s_nationkey % 5 AS crawl, {DOMAIN} AS domain FROM supplier), b AS (SELECT DISTINCT c_nationkey % 4 AS crawl, {SITE} AS domain FROM customer),
p AS (SELECT a.crawl, a.domain AS x, b.domain AS y FROM a JOIN b ON a.crawl = b.crawl)
SELECT crawl, x AS domain FROM p WHERE x = y OR (x LIKE '%.' || y AND NOT x LIKE '10.%') UNION SELECT crawl, y FROM p WHERE y = x OR (y LIKE '%.' || x AND NOT y LIKE '10.%')
UNION SELECT crawl, domain FROM a WHERE crawl NOT IN (SELECT crawl FROM b)""")
def q_narrowed_scopes(spark, sf_dir):
    """What the scopes of crawls and of their recipes share; the fifth crawl's recipe has none."""
    spec = made(spark, sf_dir, "supplier", crawl="s_nationkey % 5", domain=DOMAIN)
    return scopes.narrowed(spec, made(spark, sf_dir, "customer", crawl="c_nationkey % 4", domain=SITE), "crawl")


@query("""WITH r AS (SELECT o_custkey AS host, o_orderkey, o_orderkey % 9 AS k FROM orders),
d AS (SELECT host, CASE k WHEN 0 THEN 'private' WHEN 1 THEN 'loopback' WHEN 2 THEN 'invalid' WHEN 3 THEN 'documentation' WHEN 4 THEN 'private' END AS reason,
  CASE k WHEN 0 THEN '10.' || o_orderkey % 200 WHEN 1 THEN '1' WHEN 2 THEN 'x' WHEN 3 THEN 'd' || o_orderkey % 200 WHEN 4 THEN 'f' WHEN 5 THEN 'g' || o_orderkey % 200 ELSE 'h' || o_orderkey % 200 || '.' || k END AS address FROM r),
u AS (SELECT DISTINCT host, address, reason FROM d)
SELECT host, count(*) AS addresses, count(reason) AS denied, min(reason) AS reason, count(reason) = 0 AS allowed FROM u GROUP BY host""")
def q_routable_hosts(spark, sf_dir):
    """One verdict for each host over all of its addresses, of both families; one private network is let in by a longer prefix."""
    n = "(o_orderkey % 200)"
    address = f"""CASE o_orderkey % 9 WHEN 0 THEN '10.1.2.' || {n} WHEN 1 THEN '::ffff:127.0.0.1' WHEN 2 THEN 'nowhere' WHEN 3 THEN '2001:db8::' || lower(hex({n})) WHEN 4 THEN 'fd00::1' WHEN 5 THEN '10.77.0.' || {n}
      WHEN 6 THEN '8.8.4.' || {n} WHEN 7 THEN '2606:4700::' || lower(hex({n})) ELSE '1.1.' || {n} || '.1' END"""
    more = spark.createDataFrame(scopes.network_rows({"10.77.0.0/16": None}), "length int, prefix string, reason string")
    return scopes.routable(made(spark, sf_dir, "orders", host="o_custkey", address=address), scopes.denied_networks(spark).unionByName(more))


HOP = "CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 97 = 1 THEN o_orderkey - 1 WHEN o_orderkey % 31 = 0 THEN o_orderkey WHEN o_orderkey % 5 = 0 THEN o_orderkey + 100000000 WHEN o_orderkey % 8 < 4 THEN o_orderkey + 3 ELSE o_orderkey // 2 END"


@query(f"""WITH RECURSIVE n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'bad' WHEN o_orderkey % 17 = 0 THEN 'denied' WHEN o_orderkey % 7 = 0 THEN 'end' ELSE 'hop' END AS kind, {HOP} AS nxt FROM orders),
w AS (SELECT k AS s, k AS cur, 0 AS hops, [k] AS seen, NULL::VARCHAR AS error, false AS done FROM n
  UNION ALL SELECT s, CASE WHEN step THEN nxt ELSE cur END, CASE WHEN step THEN hops + 1 ELSE hops END, CASE WHEN step THEN list_append(seen, nxt) ELSE seen END,
    CASE WHEN step OR there AND kind = 'end' THEN NULL WHEN NOT there THEN CASE WHEN cur = -1 THEN 'ssrf_reject' ELSE 'absent' END WHEN hops >= 5 THEN 'redirect_max' WHEN kind = 'bad' THEN 'ssrf_reject' ELSE 'redirect_loop' END, NOT step
  FROM (SELECT w.*, n.k IS NOT NULL AS there, n.kind, CASE WHEN n.kind = 'denied' THEN -1 ELSE n.nxt END AS nxt,
    n.k IS NOT NULL AND n.kind IN ('hop', 'denied') AND w.hops < 5 AND NOT list_contains(w.seen, CASE WHEN n.kind = 'denied' THEN -1 ELSE n.nxt END) AS step FROM w LEFT JOIN n ON n.k = w.cur WHERE NOT w.done))
SELECT 'https://r.test/o/' || s || 'x' AS url, CASE WHEN cur = -1 THEN 'http://10.0.0.1/' ELSE 'https://r.test/o/' || cur || 'x' END AS final_url, hops::INT AS hops, CASE WHEN error IS NULL THEN 200 END::INT AS status, error AS error_kind FROM w WHERE done
UNION ALL SELECT 'http://10.0.0.1/', 'http://10.0.0.1/', 0, NULL, 'ssrf_reject'""")
def q_redirects(spark, sf_dir):
    """Chains over the orders: answers, hops up, hops to half, pairs and single ones that lead back, missing, denied and unusable targets."""
    hop = HOP.replace("o_orderkey // 2", "o_orderkey div 2")
    status = "CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 7 > 0 THEN element_at(array(301, 302, 303, 307, 308), CAST(o_orderkey % 5 AS INT) + 1) ELSE 200 END"
    location = f"CASE WHEN o_orderkey % 13 = 0 THEN 'ftp://r.test/x' WHEN o_orderkey % 17 = 0 THEN 'http://10.0.0.1' WHEN o_orderkey % 7 > 0 THEN '../o/' || ({hop}) || 'x?utm_source=' || o_custkey END"
    df = made(spark, sf_dir, "orders", url="'https://r.test/o/' || o_orderkey || 'x'", status=status, location=location)
    denied = spark.createDataFrame([("http://10.0.0.1/", 200, None)], "url string, status int, location string")
    return redirects.follow(df.unionByName(denied), crawl.keeper(spark))


# --- filters


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 4 = 0 THEN 'missing' WHEN o_orderpriority NOT LIKE '%E%' THEN 'not_contains' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'lt' ELSE 'none' END AS rule FROM orders""")
def q_filter_negations(spark, sf_dir):
    df = made(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", status="CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END")
    rule = F.lit("none")
    for f in (RecordFilter("o_orderdate", "lt", "1995-01-01"), RecordFilter("o_orderpriority", "not_contains", "E"), RecordFilter("status", "missing")):
        rule = F.when(filters.predicate(df, f), f.op).otherwise(rule)
    return df.select("o_orderkey", rule.alias("rule"))


@query("""SELECT o_orderkey, o_orderdate >= TIMESTAMP '1995-06-01' AS bare, CASE o_orderkey % 2 WHEN 0 THEN o_orderdate - INTERVAL 9 HOURS >= TIMESTAMP '1995-05-31 15:00:00' ELSE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' END AS zoned FROM orders""")
def q_filter_zones(spark, sf_dir):
    """Dates with a zone and without against bounds of both kinds."""
    df = made(spark, sf_dir, "orders", "o_orderkey", day="date_format(o_orderdate, 'yyyy-MM-dd') || CASE o_orderkey % 2 WHEN 0 THEN 'T00:00:00+09:00' ELSE 'T00:00' END")
    bare, zoned = (filters.predicate(df, RecordFilter("day", "gte", b)) for b in ("1995-06-01", "1995-06-01T00:00:00+09:00"))
    return df.select("o_orderkey", bare.alias("bare"), zoned.alias("zoned"))


@query("""SELECT c_custkey, substr(c_name || ' ' || c_custkey || ' ' || CASE WHEN c_nationkey > 9 THEN 'True' ELSE 'False' END, 1, 800) AS told, c_mktsegment AS field, CASE WHEN c_mktsegment <> 'BUILDING' THEN length(c_mktsegment)::DOUBLE END AS first FROM customer""")
def q_semantic_text(spark, sf_dir):
    """Texts for a model, and the vectors of those that a cache has."""
    df = made(spark, sf_dir, "customer", "c_name", "c_custkey", big="c_nationkey > 9")
    segments = made(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "k")
    known = segments.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("text")).distinct().withColumn("vector", F.array(F.length("text").cast("double"), F.lit(1.0)))
    found = filters.with_vectors(segments, "c_mktsegment", known)
    out = df.select("c_custkey", filters.semantic_text(df, "*").alias("told")).join(found, F.col("k") == F.col("c_custkey"))
    return out.select("c_custkey", "told", F.col("c_mktsegment").alias("field"), F.element_at("vector", 1).alias("first"))


# --- parts of pages


@query("""SELECT p_partkey, unnest([0, 1, 2, 3]) AS place, unnest(['Product', 'Offer', 'Book', 'Person']) AS type FROM part""")
def q_types_present(spark, sf_dir):
    return structured.types_present(structured.entities(declared(spark, sf_dir), "p_partkey"), "p_partkey").select("p_partkey", F.col("place").cast("int").alias("place"), "type")


def declared(spark, sf_dir) -> DataFrame:
    """Parts as JSON-LD (a graph with a typed list, a product and its offer; a broken script) and as microdata."""
    ld = """'<script type="application/ld+json"><!-- {"@context": "https://schema.org", "@graph": [{"@type": "Product", "name": "' || p_name || '", "sku": ' || p_partkey || ', "offers": {"@type": "Offer", "price": "' || p_retailprice || '", "seller": [{"@value": "' || p_brand || '"}]}}, [{"@type": ["Book", "Product"], "name": "b' || p_size || '"}]]} --></script><script type="application/ld+json">{broken</script>'"""
    micro = """'<div itemscope itemtype="https://schema.org/Person"><meta itemprop="name" content="' || p_brand || '"><a itemprop="url" href="/m/' || p_partkey || '">x</a><span itemprop="tag">t1</span><span itemprop="tag">t2</span><div itemprop="address" itemscope itemtype="http://schema.org/Place"><time itemprop="since" datetime="1999-01-01">then</time></div></div><div itemscope itemtype="https://schema.org/Thing"></div>'"""
    return made(spark, sf_dir, "part", "p_partkey", html=f"'<html><head>' || {ld} || '</head><body>' || {micro} || '</body></html>'", url="'https://p.test/' || p_partkey")


@query("""SELECT p_partkey, 'jsonld' AS source, 'b' || p_size AS name FROM part UNION ALL SELECT p_partkey, 'jsonld', p_name FROM part UNION ALL SELECT p_partkey, 'microdata', p_brand FROM part""")
def q_find_types(spark, sf_dir):
    """Products and persons, in any case, of both kinds of declaration."""
    found = structured.find_types(structured.entities(declared(spark, sf_dir), "p_partkey"), "PRODUCT", "person")
    typed = structured.has_type(F.col("entity"), "product") | structured.has_type(F.col("entity"), "Person")
    return found.where(typed).select("p_partkey", "source", paths.json_path(F.col("entity"), "name").alias("name"))


@query("""SELECT p_partkey, 'https://p.test/' || p_partkey AS url, p_name AS name, p_partkey::DOUBLE AS sku, p_retailprice AS price, p_brand AS seller FROM part UNION ALL SELECT p_partkey, 'https://p.test/' || p_partkey, 'b' || p_size, NULL, NULL, NULL FROM part""")
def q_jsonld_records(spark, sf_dir):
    r = recipe.Recipe("products", "jsonld", "Product", tuple(map(recipe.parse_field, ["name=name", "sku=sku|to_number", "price=offers.price|to_float", "seller=offers.seller"])))
    return recipe.records(r, declared(spark, sf_dir), "p_partkey")


@query("""SELECT p_partkey, 'https://p.test/' || p_partkey AS url, p_brand AS name, 'https://p.test/m/' || p_partkey AS link, '1999-01-01' AS since, 't2' AS tag FROM part""")
def q_microdata_records(spark, sf_dir):
    r = recipe.Recipe("people", "microdata", "Person", tuple(map(recipe.parse_field, ["name=name", "link=url|to_absolute_url", "since=address.since", "tag=tag.1"])))
    return recipe.records(r, declared(spark, sf_dir), "p_partkey")


# Pages hold a bounded number of customers: of each sixty four, twelve and forty-four.
LIST = "CAST((c_custkey // 60) * 3 + CASE WHEN c_custkey % 60 < 4 THEN 0 WHEN c_custkey % 60 < 16 THEN 1 ELSE 2 END AS INT)"


@query(f"""SELECT {LIST} AS page, 'https://n.test/' AS url, c_custkey::VARCHAR AS id, c_name AS title FROM customer""")
def q_embedded_records(spark, sf_dir):
    """One page for each sixty customers, with them in the state of its framework."""
    item = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("title")).alias("info")))
    state = F.concat(F.lit('{"props": {"page": {"items": ['), F.array_join(F.collect_list(item), ", "), F.lit("]}}}"))
    pages = table(spark, sf_dir, "customer").groupBy(F.expr(LIST.replace("//", "div")).alias("page")).agg(state.alias("state"))
    pages = pages.select("page", F.lit("https://n.test/").alias("url"), F.concat(F.lit("<script id=__NUXT_DATA__>{}</script><script id=__NEXT_DATA__ type=application/json>"), "state", F.lit("</script>")).alias("html"))
    r = recipe.Recipe("people", "embedded", "__NEXT_DATA__.props.page.items", (recipe.Field("id", "id"), recipe.Field("title", "info.title")))
    return recipe.records(r, pages, "page")


@query(f"""SELECT {LIST} AS page, 'https://n.test/' AS url, c_custkey::BIGINT AS id, c_mktsegment AS segment, '' AS col_2 FROM customer WHERE {LIST} IN (SELECT {LIST} FROM customer GROUP BY 1 HAVING count(*) > 1)""")
def q_table_records(spark, sf_dir):
    """One page for each few customers, with a small table that does not count before theirs."""
    row = F.concat(F.lit("<tr><td> "), "c_custkey", F.lit("<td><b>"), "c_mktsegment", F.lit("</b></td><td></td></tr>"))
    pages = table(spark, sf_dir, "customer").groupBy(F.expr(LIST.replace("//", "div")).alias("page")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    html = F.concat(F.lit("<table><tr><th>one</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table><table><tr><th>id</th><th>segment</th><th></th></tr>"), "rows", F.lit("</table>"))
    r = recipe.Recipe("t", "table", fields=tuple(map(recipe.parse_field, ["id=id|to_int", "segment=segment", "col_2=col_2"])))
    return recipe.records(r, pages.select("page", F.lit("https://n.test/").alias("url"), html.alias("html")), "page")


@query("""SELECT o_orderkey, 'https://f.test/' AS url, 'order ' || o_orderkey AS title, 'https://f.test/o/' || o_orderkey AS link FROM orders WHERE o_orderstatus = 'O'""")
def q_feed_records(spark, sf_dir):
    """Feeds are read whatever content type they have, other sources only as HTML or XML."""
    html = "'<rss><item><title>order ' || o_orderkey || '</title><link>/o/' || o_orderkey || '</link></item></rss>'"
    df = made(spark, sf_dir, "orders", "o_orderkey", html=html, url="'https://f.test/'", content_type="CASE o_orderstatus WHEN 'O' THEN 'text/plain' END").where("content_type IS NOT NULL")
    r = recipe.Recipe("f", "feed", fields=(recipe.Field("title", "title"), recipe.Field("link", "url")))
    none = recipe.Recipe("c", "css", fields=(recipe.Field("title", "title"), recipe.Field("link", "link")))
    return recipe.records(r, df, "o_orderkey").unionByName(recipe.records(none, df, "o_orderkey"))


@query("""SELECT p_partkey, p_name AS title, 'https://p.test/og/' || p_partkey AS canonical, p_brand AS site_name, p_type AS kind, CASE p_partkey % 3 WHEN 0 THEN '/v.mp4' END AS video, (p_size + 1)::VARCHAR AS duration_s, 'late ' || p_name AS description,
  CASE WHEN p_partkey % 2 = 0 THEN 'x' END AS other, p_partkey % 3 = 0 OR p_type LIKE 'video%' AS is_video, 'https://p.test/link' AS link FROM part""")
def q_meta(spark, sf_dir):
    """The first value of a field in the page counts, whichever name it goes by; a link gives the canonical URL where no tag does."""
    tag = lambda k, n, v: f"'<meta {k}=\"{n}\" content=\"' || {v} || '\">'"
    tags = [tag("name", "twitter:title", "p_name"), tag("property", "og:title", "'other'"), tag("property", "OG:url", "'https://p.test/og/' || p_partkey"), tag("property", "og:site_name", "p_brand"), tag("property", "og:type", "p_type"),
            tag("name", "description", "' '"), tag("name", "description", "'late ' || p_name"), tag("property", "og:video:duration", "(p_size + 1.75)"), "CASE p_partkey % 3 WHEN 0 THEN " + tag("property", "og:video", "'/v.mp4'") + " ELSE '' END", "CASE p_partkey % 2 WHEN 0 THEN " + tag("property", "og:other", "'x'") + " ELSE '' END"]
    df = made(spark, sf_dir, "part", "p_partkey", html=" || ".join(["'<head><link rel=\"canonical\" href=\" https://p.test/link \">'", *tags]))
    df = extract.extract(df, ["meta", "canonical"])
    named = [F.col("meta")[n].alias(n) for n in ("title", "canonical", "site_name", "kind", "video", "duration_s", "description")]
    return df.select("p_partkey", *named, F.col("meta")["og:other"].alias("other"), structured.is_video_page(F.col("meta")).alias("is_video"), F.col("canonical").alias("link"))


@query("""SELECT c_custkey, c_name AS label, '<b class="n">' || c_name || ' &amp; co</b><img src="/i.png">' AS markup, '/c/' || c_custkey AS href, '/lazy.png' AS src, c_mktsegment AS attr, '<br>' AS empty FROM customer""")
def q_field_kinds(spark, sf_dir):
    html = "'<div><p><b class=n>' || c_name || ' &amp; co</b><img SRC=/i.png></p><i data-k=\"' || c_mktsegment || '\"> ' || c_name || ' <script>x</script></i><a href=\"/c/' || c_custkey || '\">y</a><img class=l data-src=/lazy.png src=/eager.png><br></div>'"
    df = made(spark, sf_dir, "customer", "c_custkey", html=html, url="'https://c.test/'")
    fields = [("label", "i", "text", None), ("markup", "p", "html", None), ("href", "a", "href", None), ("src", "img.l", "src", None), ("attr", "i", "attr", "data-k"), ("empty", "br", "html", None)]
    out = nodes.css_records(df, "div", [{"name": n, "selector": s, "type": t, "attr": a} for n, s, t, a in fields], "c_custkey")
    return out.select("c_custkey", F.regexp_replace("label", " x$", "").alias("label"), F.regexp_extract("markup", "^<p>(.*)</p>$", 1).alias("markup"), "href", "src", "attr", "empty")


@query("""SELECT c_custkey, 'a ' || c_name || ' b' AS text, CASE WHEN c_custkey % 2 = 0 THEN 'https://x.test/' || c_custkey END AS canonical, c_custkey % 2 = 0 AND c_custkey % 3 > 0 AS duplicate FROM customer""")
def q_visible_and_canonical(spark, sf_dir):
    """The text that shows, and pages that name another one as canonical."""
    html = "'<html><head><title>no</title>' || CASE c_custkey % 2 WHEN 0 THEN '<link href=\" https://x.test/' || c_custkey || ' \" rel=canonical>' ELSE '' END || '</head><body>a<script>1</script><style>2</style>\n <noscript>3</noscript><p>' || c_name || '</p><template>4</template> b</body></html>'"
    df = extract.extract(made(spark, sf_dir, "customer", "c_custkey", html=html, key="CASE c_custkey % 3 WHEN 0 THEN 'https://x.test/' ELSE 'https://y.test/' END || c_custkey"), ["visible_text", "canonical"])
    twin = dedupe.canonical_duplicates(df.select("key", F.col("canonical").alias("canonical_key"))).select("key", F.lit(True).alias("duplicate"))
    return df.join(twin, "key", "left").select("c_custkey", F.col("visible_text").alias("text"), "canonical", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


@query("""SELECT p_partkey, unnest(['name', 'offers.price', 'sku', 'tags[]']) AS path, unnest([p_name, p_retailprice::VARCHAR, p_partkey::VARCHAR, '(2 items)']) AS sample FROM part""")
def q_leaf_paths(spark, sf_dir):
    data = """'{"@type": "Product", "name": "' || p_name || '", "sku": ' || p_partkey || ', "offers": {"price": "' || p_retailprice || '"}, "tags": [{"a": 1}, {"a": 2}], "list": [1], "none": null}'"""
    return structured.leaf_paths(made(spark, sf_dir, "part", "p_partkey", data=data), ["p_partkey"], "data").select("p_partkey", "path", "sample")


@query("""SELECT p_partkey, unnest([1, 2, 3]) AS place, unnest(['props.items', 'props.few', 'menu']) AS path, unnest([2 + p_size % 3, 2, 8]) AS items, unnest(['a,b,c', 'a,b', 'url,title']) AS keys FROM part""")
def q_array_paths(spark, sf_dir):
    item, menu = '{"a": 1, "b": 2, "c": 3}', '{"url": 1, "title": 2}'
    data = f"""'{{"menu": [' || repeat('{menu}, ', 7) || '{menu}], "props": {{"few": [{{"a": 1, "b": 2}}, {{"a": 1, "b": 2}}], "one": [{{"z": 1}}], "plain": [1, 2], "items": [' || repeat('{item}, ', 1 + p_size % 3) || '{item}]}}}}'"""
    out = structured.array_paths(made(spark, sf_dir, "part", "p_partkey", data=data), ["p_partkey"], "data")
    return out.select("p_partkey", "place", "path", F.col("items").cast("int").alias("items"), F.array_join("keys", ",").alias("keys"))


@query("""SELECT o_orderkey, 'a b ' || o_orderkey AS ws, lower(o_orderpriority) AS low, o_orderstatus || '!' AS up, 'x ' || o_orderkey || ' &amp; y' AS bare, floor(o_totalprice)::BIGINT AS whole, 'https://v.test/o/' || o_orderkey AS url, o_orderkey::VARCHAR AS found, CASE WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey END AS part, 'c' || o_custkey AS last,
  CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END AS filled FROM orders""")
def q_more_transforms(spark, sf_dir):
    t = lambda sql, *steps: values.chain(F.expr(sql), list(steps), F.lit("https://v.test/a/"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", t("'\u3000a \t b\n ' || o_orderkey || ' '", "normalize_ws").alias("ws"), t("o_orderpriority", "lower").alias("low"), t("o_orderstatus || '!'", "upper").alias("up"),
        t("'<p>x</p> <b>' || o_orderkey || '</b> &amp;<br/>y'", "strip_html").alias("bare"), t("format_number(o_totalprice, 2) || ' EUR'", "to_int").alias("whole"), t("'../o/' || o_orderkey", "to_absolute_url").alias("url"),
        t("'no. ' || o_orderkey || ' of'", r"regex_extract(no\. (\d+), 1)").alias("found"), t("CASE o_custkey % 2 WHEN 0 THEN 'a/b/c' || o_custkey ELSE 'a' END", "split(/, 2)").alias("part"), t("'a/c' || o_custkey", "split(/, -1)").alias("last"),
        t("CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END", "trim", "default(none)").alias("filled"),
    )


# --- duplicates


@query("""WITH d AS (SELECT c_custkey, c_custkey % 12 AS pattern, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 9 IN (1, 2) THEN 'Sorry, Page Not Found ' || c_name ELSE 'page of ' || c_name END AS text, c_custkey % 9 = 2 AS found FROM customer),
s AS (SELECT *, NOT found AND (text = '' OR contains(text, 'Not Found')) AS soft_404 FROM d), h AS (SELECT pattern, min(c_custkey) AS hit FROM s WHERE soft_404 GROUP BY 1)
SELECT c_custkey, soft_404, coalesce(c_custkey > hit, false) AS burnt FROM s LEFT JOIN h USING (pattern)""")
def q_soft_404_patterns(spark, sf_dir):
    """A page with records is none; the first of a pattern ends the pattern's budget."""
    df = made(spark, sf_dir, "customer", "c_custkey", pattern="c_custkey % 12", text="CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 9 IN (1, 2) THEN 'Sorry, Page Not Found ' || c_name ELSE 'page of ' || c_name END", records="CASE c_custkey % 9 WHEN 2 THEN 1 ELSE 0 END")
    df = dedupe.soft_404(df, "c_custkey", "text", "records")
    burnt = dedupe.burnt(df, "pattern", "c_custkey").select("c_custkey", F.lit(True).alias("burnt"))
    return df.join(burnt, "c_custkey", "left").select("c_custkey", "soft_404", F.coalesce("burnt", F.lit(False)).alias("burnt"))


@query("""WITH t AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer WHERE c_custkey % 3 > 0) SELECT c_custkey FROM t WHERE nth >= 3""")
def q_stub_pages(spark, sf_dir):
    """Thin pages of equal text in each nation: stubs from the third on. Each third page is long and counts for nothing."""
    words = " || ' ' || ".join(f"sha2('{i}x' || c_nationkey, 256)" for i in range(12))
    df = made(spark, sf_dir, "customer", "c_custkey", text=f"CASE c_custkey % 3 WHEN 0 THEN repeat('word ', 50) ELSE {words} END")
    return dedupe.stub_pages(df, "c_custkey", "text", keep_table=crawl.keeper(spark))


# --- structure


def shelf(spark, sf_dir) -> DataFrame:
    """Shop pages of a few customers each, with a card for each of them and a menu."""
    card = """'<li class="card col-' || c_custkey || '"><h3><a href="/c/' || c_custkey || '">Customer ' || c_name || ' of this shop</a></h3><span class="price">$' || c_custkey || '.50</span><p class="desc">some words that tell of ' || c_name || ' at length</p></li>'"""
    # pages are dealt to all cores, as grouping alone would leave so few bytes to one task
    customers = table(spark, sf_dir, "customer").withColumn("page_id", F.expr(LIST.replace("//", "div"))).repartition(spark.sparkContext.defaultParallelism, "page_id")
    cards = customers.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("c_custkey", F.expr(card).alias("card"))))["card"], "").alias("cards"), F.count(F.lit(1)).alias("n"))
    menu = "<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a><li><a href=/c>C</a></ul></nav>"
    html = F.concat(F.lit(f"<html><head><title>Shop</title></head><body>{menu}<main><ul class=list>"), "cards", F.lit("</ul></main></body></html>"))
    return cards.where("n >= 3").select("page_id", F.concat(F.lit("https://s.test/"), "page_id").alias("url"), html.alias("html"))


SHELF = f"SELECT {LIST} AS page_id, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1 HAVING count(*) >= 3"


@query(f"""SELECT page_id, 'li.card' AS selector, 'ul.list' AS parent_selector, n AS count, unnest(['h3', 'h3 > a', 'p.desc', 'span.price']) AS path, unnest(['text', 'href', 'text', 'text']) AS kind, 1.0::DOUBLE AS fill_rate,
  unnest(['Customer Customer#' || lpad(first::VARCHAR, 9, '0') || ' of this shop', '/c/' || first, 'some words that tell of Customer#' || lpad(first::VARCHAR, 9, '0') || ' at length', '$' || first || '.50']) AS sample FROM ({SHELF})""")
def q_containers(spark, sf_dir):
    """The best container of each page, column by column, with its first sample."""
    best = structure.containers(shelf(spark, sf_dir), crawl.keeper(spark)).where("place = 1")
    rows = best.select("page_id", "selector", "parent_selector", "count", F.explode("columns").alias("c"))
    return rows.select("page_id", "selector", "parent_selector", "count", "c.path", "c.kind", "c.fill_rate", F.element_at("c.samples", 1).alias("sample"))


FEATURES = """['c:ul.list>li.card@3x' || size, 'f:li.card|h3 > a|href', 'f:li.card|h3|text', 'f:li.card|p.desc|text', 'f:li.card|span.price|text']"""


@query(f"""WITH p AS (SELECT page_id, CASE WHEN n < 5 THEN 's' WHEN n < 20 THEN 'm' WHEN n < 100 THEN 'l' ELSE 'xl' END AS size FROM ({SHELF}))
SELECT size, count(*) AS pages, 'fp1:' || substr(sha256(array_to_string(list_sort({FEATURES}), chr(10))), 1, 32) AS digest, CASE size WHEN 's' THEN 1.0 ELSE 0.667 END::DOUBLE AS like_other FROM p GROUP BY size""")
def q_fingerprints(spark, sf_dir):
    """Pages of one shape have one fingerprint; the menu does not score. Against one of another size it differs by a feature."""
    keep = crawl.keeper(spark)
    found = keep(structure.containers(shelf(spark, sf_dir), keep))
    prints = structure.fingerprints(found).join(found.where("place = 1").select("page_id", structure.magnitude(F.col("count")).alias("size")), "page_id")
    swapped = F.transform("features", lambda f: F.regexp_replace(f, "@3x(m|l|xl)$", "@3xother"))
    return prints.groupBy("size", "digest").agg(F.count(F.lit(1)).alias("pages"), F.max(structure.similarity(F.col("features"), swapped)).alias("like_other"))


@query(f"""SELECT page_id, '<title>  Shop' || chr(10) || '<body>' || chr(10) || '  <nav>' || chr(10) || '    <ul>' || chr(10) || '      [x3] li' || chr(10) || '        <li>' || chr(10) || '          <a href="/a">  A' || chr(10) || '        <li>' || chr(10) || '          <a href="/b">  B' || chr(10) || '  <main>' || chr(10) || '    <ul class="list">' || chr(10) || '      [x' || n || '] li.card' AS head, false AS truncated, true AS smaller FROM ({SHELF})""")
def q_reduced(spark, sf_dir):
    """The skeleton of each page, up to where its cards are told once with their number."""
    out = reduce.reduced(shelf(spark, sf_dir), keep_table=crawl.keeper(spark))
    return out.select("page_id", F.regexp_extract("skeleton", r"(?s)^(.*?\] li\.card)", 1).alias("head"), "truncated", (F.col("tokens") <= F.col("original_tokens")).alias("smaller"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ['가격', '제목', '링크'] WHEN 1 THEN ['가격', '가격2', '이미지'] WHEN 2 THEN ['작성자', '작성자 링크'] WHEN 3 THEN ['날짜', '항목'] ELSE ['widget box'] END AS names FROM customer""".replace("['가격', '제목', '링크']", "'가격,제목,링크'").replace("['가격', '가격2', '이미지']", "'가격,가격2,이미지'").replace("['작성자', '작성자 링크']", "'작성자,작성자 링크'").replace("['날짜', '항목']", "'날짜,항목'").replace("['widget box']", "'widget box'"))
def q_names(spark, sf_dir):
    pick = lambda *pairs: "array(" + ", ".join(f"named_struct('path', '{p}', 'kind', '{k}')" for p, k in pairs) + ")"
    columns = f"CASE c_custkey % 5 WHEN 0 THEN {pick(('span.price', 'text'), ('h3', 'text'), ('h3 > a', 'href'))} WHEN 1 THEN {pick(('b.old-price', 'text'), ('b.newPrice', 'text'), ('img', 'src'))} WHEN 2 THEN {pick(('i.author', 'text'), ('a.author', 'href'))} WHEN 3 THEN {pick(('time', 'text'), ('div', 'text'))} ELSE {pick(('p.widget_box', 'text'))} END"
    df = made(spark, sf_dir, "customer", "c_custkey", columns=columns)
    return df.select("c_custkey", F.array_join(naming.names(F.col("columns")), ",").alias("names"))


@query(f"""SELECT page_id, 'Shop' AS title, 'li.card' AS container, n AS count, '제목,링크,설명,가격' AS names FROM ({SHELF})""")
def q_inspect(spark, sf_dir):
    out = verbs.inspect(shelf(spark, sf_dir), crawl.keeper(spark))
    named = F.array_join(F.transform(F.array_sort(F.transform("columns", lambda c: F.struct(F.when(c["path"] == "h3", 1).when(c["path"] == "h3 > a", 2).when(c["path"] == "p.desc", 3).otherwise(4).alias("o"), c["name"].alias("name")))), lambda c: c["name"]), ",")
    return out.select("page_id", "title", "container", "count", named.alias("names"))


@query(f"""SELECT {LIST} AS page_id, 'https://s.test/' || {LIST} AS url, 'Customer ' || c_name || ' of this shop' AS name, 'https://s.test/c/' || c_custkey AS link FROM customer WHERE {LIST} IN (SELECT page_id FROM ({SHELF}))""")
def q_collect(spark, sf_dir):
    return verbs.collect(shelf(spark, sf_dir), "li.card", [("name", "h3 > a", "text"), ("link", "h3 > a", "href"), (" ", "p", "text")])


@query(f"""SELECT 'li.card' AS container, 4 AS fields, n AS record_count, 1.0::DOUBLE AS mean_fill, true AS can_activate FROM ({SHELF}) ORDER BY page_id LIMIT 1""")
def q_adapt(spark, sf_dir):
    """A recipe for one page, the first, from what repeats on it and what its markup calls that."""
    page = shelf(spark, sf_dir).orderBy("page_id").limit(1)
    made_, quality = verbs.adapt(page, crawl.keeper(spark))
    return quality.select(F.lit(made_.container).alias("container"), F.lit(len(made_.fields)).alias("fields"), "record_count", "mean_fill", "can_activate")


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'rendered' END AS via, n AS records FROM ({SHELF}) WHERE page_id % 2 = 0 OR page_id % 3 > 0""")
def q_auto_fallback(spark, sf_dir):
    """Odd pages come bare; they are read again as rendered, but for each third, which could not be."""
    full = shelf(spark, sf_dir)
    bare = full.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("<div id=root></div>"))
    r = recipe.Recipe("c", container="li.card", fields=(recipe.Field("name", "h3"),))
    out = recipe.with_fallback(r, bare, full.where("page_id % 3 > 0"), crawl.keeper(spark))
    return out.groupBy("page_id", "via").agg(F.count(F.lit(1)).alias("records"))


# --- real pages


NAV = "regexp_extract(html, '<nav>(.*?)</nav>', 1)"
NAV_ROWS = f"""WITH n AS (SELECT page_id, url, unnest(regexp_extract_all({NAV}, '<li><a href="[^"]*">[^<]*</a>')) AS a FROM pages),
r AS (SELECT page_id, url, trim(replace(replace(replace(regexp_extract(a, '>([^<]*)</a>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS label, replace(replace(replace(regexp_extract(a, 'href="([^"]*)"', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href FROM n)"""


@query("""SELECT page_id, url, label, target FROM (""" + NAV_ROWS + """ SELECT page_id, url, label, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || href AS target FROM r WHERE label <> '' AND NOT regexp_matches(label, '^[a-f]'))""")
def q_recipe_records(spark, sf_dir):
    return recipe.run(PAGE_RECIPE, table(spark, sf_dir, "pages"))


PAGE_RECIPE = recipe.Recipe("pages", container="nav li", fields=(recipe.Field("label", "a", required=True), recipe.Field("target", "a", "href", transform=("to_absolute_url",))), filters=(RecordFilter("label", "not_matches", "^[a-f]"),))


@query(NAV_ROWS + """, k AS (SELECT label, CASE WHEN regexp_matches(label, '^(https?://|/)') THEN 'url' WHEN regexp_matches(regexp_replace(label, '[,.-]', '', 'g'), '^\\d+$') THEN 'number' ELSE 'text' END AS shape FROM r WHERE label <> '' AND NOT regexp_matches(label, '^[a-f]')),
s AS (SELECT max(n) / sum(n) AS share FROM (SELECT shape, count(*) AS n FROM k GROUP BY 1))
SELECT (SELECT count(*) FROM k) AS record_count, round((round((SELECT avg((label <> '')::INT) FROM r), 3) + 1.0) / 2, 3) AS mean_fill, round(((SELECT share FROM s) + 1) / 2, 3) AS consistency,
  round((SELECT count(*) FROM k) * round((round((SELECT avg((label <> '')::INT) FROM r), 3) + 1.0) / 2, 3) * (round(((SELECT share FROM s) + 1) / 2, 3) / 2 + 0.5), 3) AS score, true AS can_activate""")
def q_recipe_quality(spark, sf_dir):
    return recipe.measure(PAGE_RECIPE, table(spark, sf_dir, "pages")).select("record_count", "mean_fill", "consistency", "score", "can_activate")


# --- jobs, events, exports


CRAWL = """SELECT event_id, user_id AS job_id, CASE event_type WHEN 'error' THEN 'page.failed' WHEN 'purchase' THEN 'records.extracted' WHEN 'signup' THEN 'duplicate.detected' ELSE 'page.fetched' END AS type, event_id % 7 AS count, CASE event_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'near' ELSE 'canonical' END AS via FROM events"""


def crawl_events(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "page.failed").when(F.col("event_type") == "purchase", "records.extracted").when(F.col("event_type") == "signup", "duplicate.detected").otherwise("page.fetched")
    via = F.when(F.col("event_id") % 3 == 0, "exact").when(F.col("event_id") % 3 == 1, "near").otherwise("canonical")
    return events.select("event_id", F.col("user_id").alias("job_id"), kind.alias("type"), (F.col("event_id") % 7).alias("count"), via.alias("via"))


@query(f"""WITH e AS (SELECT job_id % 9 AS job_id, 'h' || event_id % 5 AS host, event_id, type, count FROM ({CRAWL})),
a AS (SELECT job_id, host, event_id * 2 + 1 AS event_id, (type = 'page.fetched')::INT AS page, 0 AS came, (type IN ('page.fetched', 'page.failed'))::INT AS gone, CASE WHEN type = 'records.extracted' THEN count ELSE 0 END AS records FROM e
  UNION ALL SELECT job_id, host, (event_id - event_id % 50) * 2, 0, 1, 0, 0 FROM e WHERE type IN ('page.fetched', 'page.failed') AND event_id % 11 > 0),
g AS (SELECT job_id, host, event_id, sum(page) AS page, sum(came) AS came, sum(gone) AS gone, sum(records) AS records FROM a GROUP BY ALL),
h AS (SELECT *, sum(came - gone) OVER (PARTITION BY job_id, host ORDER BY event_id) AS own FROM g),
r AS (SELECT job_id, event_id, page, sum(page) OVER w AS pages_done, sum(came - gone) OVER w AS pages_queued, sum(records) OVER w AS records_total, sum((own > 0)::INT - (own - came + gone > 0)::INT) OVER w AS hosts_active FROM h WINDOW w AS (PARTITION BY job_id ORDER BY event_id))
SELECT DISTINCT job_id, event_id, pages_done::BIGINT AS pages_done, pages_queued::BIGINT AS pages_queued, records_total::BIGINT AS records_total, hosts_active::BIGINT AS hosts_active FROM r WHERE page = 1 AND pages_done % 10 = 0""")
def q_progress(spark, sf_dir):
    """Snapshots after each ten pages of nine jobs, whose URLs were queued fifty events at a time; one in eleven never was."""
    events = crawl_events(spark, sf_dir).withColumns({"job_id": F.col("job_id") % 9, "host": F.concat(F.lit("h"), F.col("event_id") % 5)}).select("job_id", "host", "event_id", "type", "count")
    pages = events.where("type IN ('page.fetched', 'page.failed') AND event_id % 11 > 0")
    queued = pages.select("job_id", "host", ((F.col("event_id") - F.col("event_id") % 50) * 2).alias("event_id"), F.lit(jobs.QUEUED).alias("type"), F.lit(None).cast("long").alias("count"))
    return jobs.progress(events.withColumn("event_id", F.col("event_id") * 2 + 1).unionByName(queued))


@query(f"SELECT via, count(*) AS n FROM ({CRAWL}) WHERE type = 'duplicate.detected' GROUP BY 1")
def q_duplicates_by_via(spark, sf_dir):
    return jobs.duplicates_by_via(crawl_events(spark, sf_dir))


@query("""SELECT event_id, 'event: page.failed' || chr(10) || 'data: {"event_id":' || event_id || ',"job_id":' || job_id || ',"via":"' || via || '"}' || chr(10) || chr(10) AS frame FROM (""" + CRAWL + """) WHERE type = 'page.failed'""")
def q_sse_frames(spark, sf_dir):
    return jobs.sse(crawl_events(spark, sf_dir).where("type = 'page.failed'"), ["event_id", "job_id", "via"])


@query("""SELECT p_brand AS page, min_by(p_partkey, (-p_retailprice, p_partkey)) AS recipe, max(p_retailprice) AS score FROM part GROUP BY 1""".replace("min_by(p_partkey, (-p_retailprice, p_partkey))", "arg_min(p_partkey, struct_pack(a := -p_retailprice, b := p_partkey))"))
def q_best_recipe(spark, sf_dir):
    df = made(spark, sf_dir, "part", page="p_brand", recipe="p_partkey", score="p_retailprice")
    return jobs.best_recipes(df, "page")


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, 'preview' AS part FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
UNION ALL SELECT o_orderkey, NULL, 'keyset' FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 40) UNION ALL SELECT o_orderkey, NULL, 'page' FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 30 OFFSET 60)""")
def q_paging(spark, sf_dir):
    """A preview with the number of all rows, the page past a key, a page by offset."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    parts = {"preview": jobs.preview(df, [F.desc("o_totalprice"), "o_orderkey"], 50), "keyset": jobs.keyset_page(df, "o_orderkey", 100, 40), "page": jobs.page(df, ["o_orderdate", "o_orderkey"], 60, 30)}
    rows = [p.select("o_orderkey", (F.col("total") if n == "preview" else F.lit(None).cast("long")).alias("total"), F.lit(n).alias("part")) for n, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND o_orderstatus IN ('F', 'P') AS again, o_orderkey IN (SELECT c_custkey FROM customer WHERE c_nationkey > 8) AS off,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_custkey FROM orders)
SELECT job_id, CASE WHEN off AND (again OR status = 'running') THEN 'cancelled' WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE o_custkey END AS pages_crawled FROM j""")
def q_retry_cancel(spark, sf_dir):
    """Jobs named by one table start anew, then those named by another one are cancelled; some are in both."""
    df = made(spark, sf_dir, "orders", job_id="o_orderkey", status="CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'completed' END", pages_crawled="o_custkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), "c_nationkey")
    return jobs.cancel(jobs.retry(df, people.where("c_nationkey < 12")), people.where("c_nationkey > 8"))


RECORDS = """'{"name": "' || p_name || '", "size": ' || p_size || CASE p_partkey % 2 WHEN 0 THEN ', "tags": ["a", "' || p_brand || '"]' ELSE '' END || CASE WHEN p_partkey % 50 = 49 THEN ', "late": null, "extra": {"k": 1}' ELSE '' END || '}'"""


@query("""SELECT p_partkey AS seq, CASE WHEN p_partkey % 50 = 49 THEN '{"k":1}' ELSE '' END AS extra, '' AS late, p_name AS name, p_size::VARCHAR AS size, CASE WHEN p_partkey % 2 = 0 THEN '["a","' || p_brand || '"]' ELSE '' END AS tags, 'https://p.test/' || p_partkey AS _page_url, 'css' AS _extractor,
  '{"name": "' || p_name || '", "size": ' || p_size || CASE p_partkey % 2 WHEN 0 THEN ', "tags": ["a", "' || p_brand || '"]' ELSE '' END || CASE WHEN p_partkey % 50 = 49 THEN ', "late": null, "extra": {"k": 1}' ELSE '' END || ', "_page_url":"https://p.test/' || p_partkey || '","_extractor":"css"}' AS line,
  'name,size,tags,late,extra' AS first_seen FROM part""")
def q_export(spark, sf_dir):
    """The cells of the CSV, the lines of the JSONL, both with their source, and the columns by first appearance."""
    df = made(spark, sf_dir, "part", seq="p_partkey", data=RECORDS, page_url="'https://p.test/' || p_partkey", extractor="'css'")
    cells = web.csv_cells(df, "data", ["seq"], include_source=True)
    seen = ",".join(web.column_names(web.first_seen_columns(df, "data", "seq"), web.MOST_COLUMNS))
    lines = web.jsonl_lines(df, "data", "seq", include_source=True).withColumnRenamed("value", "line")
    return cells.join(lines, "seq").withColumn("first_seen", F.lit(seen))


@query(f"""SELECT job_id, type, CASE WHEN type = 'page.failed' THEN via END AS reason, count(*) AS n, sum(count)::BIGINT AS count FROM (SELECT (job_id % 20)::VARCHAR AS job_id, type, via, count FROM ({CRAWL})) GROUP BY ALL""")
def q_event_sink(spark, sf_dir):
    """Events as a stream of files, written by batches to their tables; the tallies of all batches are added up."""
    root = crawl.shared_folder(spark)
    events = crawl_events(spark, sf_dir).select("event_id", F.lit(None).cast("timestamp").alias("at"), (F.col("job_id") % 20).cast("string").alias("job_id"), "type", F.lit("u").alias("url"), F.when(F.col("type") == "page.failed", F.col("via")).alias("reason"), F.col("count").cast("long").alias("count"), F.lit(None).cast("string").alias("payload"))
    events.repartition(4).write.parquet(f"{root}/in")
    event_stream.drain(event_stream.sink_events(event_stream.read_events(spark, f"{root}/in", 2), f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out/tallies").groupBy("job_id", "type", "reason").agg(F.sum("n").alias("n"), F.sum("count").alias("count"))


@query("""SELECT (event_id % 20)::VARCHAR AS job_id, 'https://p.test/' || user_id AS url, '{"a":' || v.n || ',"b":{"k":' || v.n || ',"z":"' || event_type || '"}}' AS data
FROM (SELECT event_id, user_id, event_type, unnest([event_id % 3, event_id % 3 + 1]) AS n FROM events) v GROUP BY ALL""")
def q_record_sink(spark, sf_dir):
    """Records of a stream that comes in three goes, each with events of its own and a third of the goes before, in another order of
    names; the sink is started anew for each and keeps one of each identity."""
    root = crawl.shared_folder(spark)
    record = lambda n, e: f"'{{\"b\": {{\"z\": \"' || event_type || '\", \"k\": ' || ({n}) || '}}, \"a\": ' || ({n}) || ' }}{e}'"
    payload = f"'[' || {record('event_id % 3', ',')} || {record('event_id % 3 + 1', ']')}"
    rows = made(spark, sf_dir, "events", "event_id", at="ts", job_id="CAST(event_id % 20 AS STRING)", type="'records.extracted'", url="'https://p.test/' || user_id", reason="CAST(NULL AS STRING)", count="2L", payload=payload)
    for go in range(3):
        rows.where(f"event_id % 3 = {go} OR (event_id % 3 < {go} AND event_id % 7 < 3)").repartition(2).write.mode("append").parquet(f"{root}/in")
        event_stream.drain(event_stream.sink_events(event_stream.read_events(spark, f"{root}/in", 1), f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out/records").select("job_id", "url", "data")


@query("""SELECT (user_id % 20)::VARCHAR AS job_id, event_id, 'id: ' || event_id || chr(10) || 'event: ' || type || chr(10) || 'data: {"id":' || event_id || ',"event_type":"' || type || '","payload":{"k":' || json_extract_string(props, '$.k') || '},"created_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}' || chr(10) || chr(10)
  || CASE WHEN type = 'job.completed' THEN 'event: end' || chr(10) || 'data: {}' || chr(10) || chr(10) ELSE '' END AS frame
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'job.completed' ELSE 'page.' || event_type END AS type FROM events WHERE event_id > 10)""")
def q_live_tail(spark, sf_dir):
    """A log that grows in three goes, followed from behind an id on; the tail is started anew after each and goes on where it was."""
    root = crawl.shared_folder(spark)
    rows = made(spark, sf_dir, "events", "event_id", at="ts", job_id="CAST(user_id % 20 AS STRING)", type="CASE event_type WHEN 'signup' THEN 'job.completed' ELSE 'page.' || event_type END", url="'u'", reason="CAST(NULL AS STRING)", count="1L", payload="props")
    ends = rows.agg(F.max("event_id")).first()[0] or 0

    def take(batch, n):
        tail.frames(batch).write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    for go in range(3):
        rows.where((F.col("event_id") > ends * go // 3) & (F.col("event_id") <= ends * (go + 1) // 3)).repartition(4).write.mode("append").parquet(f"{root}/log")
        written = tail.follow(spark, f"{root}/log", cursor=10).writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint")
        written.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("job_id", "event_id", "frame")


# --- traversal


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '%U%')""")
def q_seen_set(spark, sf_dir):
    """Customers met in none of two batches of orders: the filter tells most of them, the exact table the rest."""
    met = SeenSet(spark, crawl.keeper(spark))
    orders = table(spark, sf_dir, "orders")
    for rule in ("o_orderstatus = 'F'", "o_orderpriority LIKE '%U%'"):
        met.add(orders.where(rule).select(F.col("o_custkey").alias("key")))
    return met.fresh(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


LINKED = "(o_orderkey * 7 + o_custkey) % 2000"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey % 200 AS src, {LINKED} AS dst FROM orders), b AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3 AND e.dst % 10 > 0)
SELECT 'https://g.test/n/x' || node AS dedupe_key, min(depth)::INT AS depth, (1000 - 100 * min(depth))::INT AS priority FROM b GROUP BY node""")
def q_crawl_graph(spark, sf_dir):
    """A crawl of a link graph; each tenth node is excluded, and its links are not followed."""
    links = made(spark, sf_dir, "orders", page_key="'https://g.test/n/x' || o_orderkey % 200", href=f"'../n/x' || {LINKED} || '?utm_source=z'")
    seeds = spark.createDataFrame([("https://g.test/n/x1",)], "url string")
    frontier, _ = crawl.crawl(links, seeds, gate.Limits(max_pages=10**6, max_depth=3, per_pattern_budget=10**6, allowed_domains=("g.test",), exclude=("x[0-9]*0/?$",)))
    return frontier.select("dedupe_key", "depth", "priority")


@query("""SELECT 'https://s.test/p' || s_suppkey || 'x' AS dedupe_key, CASE WHEN s_suppkey % 7 = 0 THEN 'absent' WHEN s_suppkey % 7 = 1 THEN 'soft_404' WHEN s_suppkey % 7 IN (2, 3) AND s_suppkey || 'x' > (SELECT min(s_suppkey || 'x') FROM supplier WHERE s_suppkey % 7 IN (2, 3)) THEN 'duplicate' ELSE 'page' END AS outcome, 1 AS depth FROM supplier
UNION ALL SELECT 'https://s.test/', 'page', 0""")
def q_spider(spark, sf_dir):
    """A site whose home page links to a page for each supplier: missing, saying so, all of one text, or of their own."""
    text = "CASE s_suppkey % 7 WHEN 1 THEN 'Sorry, page not found' WHEN 2 THEN 'same' WHEN 3 THEN 'same' ELSE 'own' || s_suppkey END"
    own = " || ' ' || ".join(f"sha2('{i}' || kind, 256)" for i in range(40))
    pages = made(spark, sf_dir, "supplier", "s_suppkey", kind=text).where("s_suppkey % 7 > 0")
    pages = pages.select(F.expr("'https://s.test/p' || s_suppkey || 'x'").alias("page_key"), F.expr(f"CASE WHEN kind LIKE 'Sorry%' THEN kind ELSE {own} END").alias("text"), F.lit(0).cast("long").alias("records"), F.lit(None).cast("string").alias("canonical"), F.array().cast("array<string>").alias("links"))
    everyone = table(spark, sf_dir, "supplier").agg(F.collect_list(F.expr("'/p' || s_suppkey || 'x'")).alias("links"))
    home = everyone.select(F.lit("https://s.test/").alias("page_key"), F.lit("home").alias("text"), F.lit(1).cast("long").alias("records"), F.lit(None).cast("string").alias("canonical"), "links")
    visited, _ = crawl.spider(pages.unionByName(home), spark.createDataFrame([("https://s.test/",)], "url string"), gate.Limits(max_pages=10**6, max_depth=1, per_pattern_budget=10**6))
    return visited.select("dedupe_key", "outcome", "depth")
