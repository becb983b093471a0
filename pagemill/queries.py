"""One query for each group of operators over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import paths, texts, urls, values
from pagemill.operators import dedupe, extract, filters, gate, jobs, nodes, quality, references
from pagemill.operators.filters import RecordFilter
from pagemill.registry import QUERIES, SQL, query, spread, table
from pagemill.streaming import crawl

# Common parts of the SQL side. The pages' URLs have no userinfo, port, escape or dot segment.
URLS = r"""
WITH raw AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
  CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END AS path,
  list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z_]+|ref|source|src|from)(=|$)')) AS q FROM pages),
n AS (SELECT page_id, scheme, host, path, q,
  scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url,
  scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS dedupe_key FROM raw),
p AS (SELECT *, host || '/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
    CASE WHEN regexp_matches(s, '^\d{4}-\d{2}(-\d{2})?$') THEN '{date}' WHEN length(s) >= 8 AND regexp_matches(s, '^[A-Za-z0-9_-]+$') AND regexp_matches(s, '\d') THEN '{id}'
         WHEN regexp_matches(s, '^\d+$') THEN '{n}' ELSE s END), '/')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(list_transform(q, lambda x: regexp_extract(x, '^[^=]*') || '={v}')), '&') ELSE '' END AS pattern,
  1000 - 100 * (page_id % 4) + CASE WHEN regexp_matches(url, '(?i)/(product|item|goods|article|post|news|story|job|listing|detail|view|p|read)(/|$|\?)') THEN 200 ELSE 0 END
  - CASE WHEN regexp_matches(url, '(?i)/(tag|tags|category|search|login|about|help|faq|feed)(/|$|\?)') THEN 400 ELSE 0 END - 20 * (length(url) - length(replace(url, '&', ''))) AS score FROM n)
"""


def seen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "pages")).select("page_id", urls.normalize(F.col("url")).alias("u"))
    return df.select("page_id", "u.*", urls.pattern(F.col("u")).alias("pattern"), urls.score(F.col("u.url"), F.col("page_id") % 4).alias("score"))


@query(URLS + "SELECT page_id, url, dedupe_key, scheme, host, path FROM p")
def q_url_normalize(spark, sf_dir):
    return seen_pages(spark, sf_dir).select("page_id", "url", "dedupe_key", "scheme", "host", "path")


@query(URLS + "SELECT page_id, pattern, score::INT AS score FROM p")
def q_url_pattern_score(spark, sf_dir):
    return seen_pages(spark, sf_dir).select("page_id", "pattern", "score")


@query(URLS + "SELECT host, pattern, count(*) AS urls, count(*) FILTER (nth <= 2) AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY page_id) AS nth FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY page_id) = 1)) GROUP BY ALL")
def q_pattern_budget(spark, sf_dir):
    df = gate.first_seen(seen_pages(spark, sf_dir), "dedupe_key", ["page_id"])
    df = gate.within_budget(df, "pattern", ["page_id"], 2)
    return df.groupBy("host", "pattern").agg(F.count(F.lit(1)).alias("urls"), F.count_if(~F.col("over")).alias("admitted"))


@query(URLS + "SELECT page_id, host, score::INT AS score, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id)::INT AS turn, min(page_id) OVER (PARTITION BY host) AS host_seen FROM p")
def q_host_round_robin(spark, sf_dir):
    return gate.round_robin(seen_pages(spark, sf_dir), "host", "score", "page_id").select("page_id", "host", "score", "turn", "host_seen")


GATE = gate.Limits(max_depth=2, allowed_domains=("example.com", "example.org"), exclude=(r"/de/",), include=(r"^https?://",), max_url_length=40, max_query_params=0, per_pattern_budget=1)


@query(URLS + """, g AS (SELECT page_id, pattern, CASE WHEN page_id % 4 > 2 THEN 'depth_exceeded'
  WHEN NOT (host IN ('example.com', 'example.org') OR host LIKE '%.example.com' OR host LIKE '%.example.org') THEN 'out_of_scope' WHEN url LIKE '%/de/%' THEN 'excluded'
  WHEN length(url) > 40 THEN 'url_length' WHEN len(q) > 0 THEN 'query_params' END AS r FROM p)
SELECT page_id, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY r IS NULL, pattern ORDER BY page_id) > 1 THEN 'pattern_budget' ELSE r END AS reject_reason FROM g""")
def q_gate_reasons(spark, sf_dir):
    df = spread(table(spark, sf_dir, "pages")).select("page_id", "url", (F.col("page_id") % 4).cast("int").alias("depth"))
    return gate.admit(df, GATE, ["page_id"], keep_table=crawl.keeper(spark)).select("page_id", "reject_reason")


@query(URLS + "SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(*) AS n FROM p GROUP BY ALL")
def q_registrable_domain(spark, sf_dir):
    df = seen_pages(spark, sf_dir).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return df.select("host", urls.registrable_domain(F.col("host")).alias("domain"), "n")


IPS = "o_orderkey % 224 || '.' || o_custkey % 256 || '.' || o_orderkey % 7 || '.1'"


@query(f"""WITH a AS (SELECT o_orderkey, {IPS} AS ip, o_orderkey % 224 AS a, o_custkey % 256 AS b, o_orderkey % 7 AS c FROM orders)
SELECT o_orderkey, ip, CASE WHEN a = 0 THEN 'this_network' WHEN a = 10 THEN 'private' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'shared' WHEN a = 127 THEN 'loopback' WHEN a = 169 AND b = 254 THEN 'link_local'
  WHEN a = 172 AND b BETWEEN 16 AND 31 THEN 'private' WHEN a = 192 AND b = 0 AND c = 0 THEN 'protocol' WHEN a = 192 AND b = 0 AND c = 2 THEN 'documentation' WHEN a = 192 AND b = 168 THEN 'private'
  WHEN a = 198 AND b IN (18, 19) THEN 'benchmark' WHEN a = 198 AND b = 51 AND c = 100 THEN 'documentation' WHEN a = 203 AND b = 0 AND c = 113 THEN 'documentation' END AS denied FROM a""")
def q_denied_address(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(IPS).alias("ip"))
    return df.withColumn("denied", urls.denied_address(F.col("ip")))


LINKS = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i FROM pages),
u AS (SELECT page_id, replace(trim(href), '&amp;', '&') AS href, min(i) AS i FROM l GROUP BY ALL)"""


@query(LINKS + "SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, href FROM u WHERE href <> ''")
def q_links(spark, sf_dir):
    return extract.links(spread(table(spark, sf_dir, "pages"))).select("page_id", "pos", "href")


@query(LINKS + "SELECT page_id, count(*) AS links, count(DISTINCT href[1:2]) AS heads FROM u WHERE href <> '' GROUP BY page_id")
def q_link_counts(spark, sf_dir):
    return extract.links(spread(table(spark, sf_dir, "pages"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct(F.substring("href", 1, 2)).alias("heads"))


UNESCAPED = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {UNESCAPED.replace('x,', 'regexp_extract(html, $$<h1>([^<]*)$$, 1),', 1)} AS title, length({UNESCAPED.replace('x,', 'regexp_extract(html, $$<title>([^<]*)$$, 1),', 1)}) AS title_length FROM pages")
def q_css_records(spark, sf_dir):
    df = nodes.css_records(spread(table(spark, sf_dir, "pages")), None, [{"name": "title", "selector": "article > h1"}, {"name": "head", "selector": "head title"}])
    return df.select("page_id", "title", F.length("head").alias("title_length"))


# Runs of text between tags; every page's best block is its article element. A title that holds references is read as they are.
ARTICLE = r"""WITH a AS (SELECT page_id, list_transform(list_filter(string_split_regex(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>'), lambda x: x <> ''), lambda x: {0}) AS runs, {1} AS title FROM pages),
t AS (SELECT page_id, title, trim(regexp_replace(array_to_string(runs, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM a)
SELECT page_id, title, len(regexp_extract_all(text, '[0-9a-zA-Z가-힣一-鿿ぁ-ヿ]+'))::BIGINT AS word_count, sha256(text) AS text_sha256 FROM t WHERE len(regexp_extract_all(text, '[0-9a-zA-Z가-힣一-鿿ぁ-ヿ]+')) >= 40"""
READ = "trim(regexp_replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&nbsp;', ' '), '&amp;?', '&', 'g'), ' ' || chr(10))"


@query(ARTICLE.replace("{0}", READ.format("x")).replace("{1}", READ.format("regexp_extract(html, '<h1>([^<]*)', 1)")))
def q_article(spark, sf_dir):
    df = nodes.articles(spread(table(spark, sf_dir, "pages")), ["page_id"])
    return df.select("page_id", "title", "word_count", F.sha2("text", 256).alias("text_sha256"))


TOKENS = "regexp_extract_all(text, '[0-9a-zA-Z가-힣一-鿿]+')"


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len({TOKENS}) >= 30 AS long_enough FROM documents")
def q_tokens(spark, sf_dir):
    n = F.size(texts.tokens(F.col("text")))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", n.alias("n_tokens"), (n >= 30).alias("long_enough"))


@query(f"WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS of_key FROM documents WHERE len({TOKENS}) >= 30) SELECT * FROM d WHERE doc_id <> of_key")
def q_exact_duplicates(spark, sf_dir):
    return dedupe.exact(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "doc_id").select("doc_id", "of_key")


# 60 sums a document, as in the operator
SIMHASH = f"""WITH t AS (SELECT doc_id, list_transform({TOKENS}, lambda x: lower(x)) AS w FROM documents WHERE len({TOKENS}) >= 30),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM t),
h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 15))::BIGINT AS h FROM s),
b AS (SELECT doc_id, bit, sum((h >> bit) & 1) AS ones, count(*) AS n FROM h, (SELECT unnest(range(60))::INT AS bit) GROUP BY ALL),
f AS (SELECT doc_id, sum(CASE WHEN ones * 2 > n THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS fingerprint FROM b GROUP BY doc_id)"""


@query(SIMHASH + "SELECT doc_id, fingerprint FROM f")
def q_simhash(spark, sf_dir):
    df = spread(table(spark, sf_dir, "documents")).where(F.size(texts.tokens(F.col("text"))) >= 30)
    return texts.simhash(df, "doc_id", texts.tokens(F.col("text")))


@query(SIMHASH + ", g AS (SELECT fingerprint, min(doc_id) AS node FROM f GROUP BY 1) SELECT x.node AS a, y.node AS b, bit_count(xor(x.fingerprint, y.fingerprint))::INT AS distance FROM g x JOIN g y ON x.node < y.node AND bit_count(xor(x.fingerprint, y.fingerprint)) <= 6")
def q_near_pairs(spark, sf_dir):
    groups = q_simhash(spark, sf_dir).groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    return dedupe.near_pairs(groups, "node")


# Nodes with earlier neighbours in turn: one that has a neighbour not dropped before is dropped.
LEADERS = SIMHASH + """, g AS (SELECT fingerprint, min(doc_id) AS node FROM f GROUP BY 1),
p AS (SELECT x.node AS a, y.node AS b FROM g x JOIN g y ON x.node < y.node AND bit_count(xor(x.fingerprint, y.fingerprint)) <= 6),
o AS (SELECT b AS node, list(a) AS near, row_number() OVER (ORDER BY b) AS i FROM p GROUP BY b),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS dropped UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(near, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, node) ELSE dropped END FROM r JOIN o ON o.i = r.i + 1),
l AS (SELECT node, list_min(list_filter(near, lambda x: NOT list_contains(dropped, x))) AS leader FROM o, (SELECT dropped FROM r ORDER BY i DESC LIMIT 1))
SELECT doc_id, coalesce(l.leader, g.node) AS leader FROM f JOIN g USING (fingerprint) LEFT JOIN l USING (node)"""


@query(LEADERS.replace("WITH t AS", "WITH RECURSIVE t AS", 1))
def q_near_leaders(spark, sf_dir):
    return dedupe.near_leaders(spread(table(spark, sf_dir, "documents")), "doc_id", "text", crawl.keeper(spark))


@query(f"SELECT doc_id, trim(text) = '' OR (regexp_matches(lower(text), 'not found|no longer exists|does not exist|doesn''t exist|sorry, we can') AND len({TOKENS}) < 160) AS soft_404 FROM documents")
def q_soft_404(spark, sf_dir):
    return dedupe.soft_404(spread(table(spark, sf_dir, "documents")), "doc_id", "text").select("doc_id", "soft_404")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag NOT IN ('A', 'X') AND l_discount > 0.05 AND l_linestatus <> 'F' AND contains(CAST(l_orderkey AS VARCHAR), '1')")
def q_filters(spark, sf_dir):
    rules = [RecordFilter("l_quantity", "between", [10, 20]), RecordFilter("l_returnflag", "not_in", ["A", "X"]), RecordFilter("l_discount", "gt", 0.05), RecordFilter("l_linestatus", "ne", "F"), RecordFilter("l_orderkey", "contains", "1")]
    return filters.keep(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount", "l_linestatus"), rules).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


ORDER_RULES = [RecordFilter("o_orderstatus", "in", ["F", "O"]), RecordFilter("o_totalprice", "gte", 50000), RecordFilter("o_orderpriority", "not_matches", "^[45]"), RecordFilter("o_custkey", "eq", "7"), RecordFilter("priority", "exists")]


@query("""WITH d AS (SELECT CASE WHEN coalesce(nullif(o_orderstatus, 'P'), '') = '' THEN 'required' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus in' WHEN NOT o_totalprice >= 50000 THEN 'o_totalprice gte'
  WHEN regexp_matches(o_orderpriority, '^[45]') THEN 'o_orderpriority not_matches' WHEN nullif(o_orderpriority, '1-URGENT') IS NULL THEN 'priority exists' END AS reason FROM orders) SELECT reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY 1""")
def q_filter_reasons(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumns({"o_orderstatus": F.nullif("o_orderstatus", F.lit("P")), "priority": F.nullif("o_orderpriority", F.lit("1-URGENT"))})
    return filters.reasons(df, [r for r in ORDER_RULES if r.op != "eq"], ["o_orderstatus"])


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey = 7) AS n_eq, 0 AS n_text, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01') AS n_dates")
def q_filter_typed(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    same = filters.predicate(df, RecordFilter("o_custkey", "eq", 7))
    none = filters.predicate(df, RecordFilter("o_custkey", "eq", "7"))
    late = filters.predicate(df, RecordFilter("day", "gte", "1996-06-01"))
    return df.agg(F.count_if(same).alias("n_eq"), F.count_if(none).alias("n_text"), F.count_if(late).alias("n_dates"))


@query("""WITH p AS (SELECT nullif(p_brand, 'Brand#11') AS brand, CASE WHEN p_size > 10 THEN p_size END AS size, CASE WHEN p_partkey % 7 = 0 THEN '/part/' || p_partkey WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS label FROM part),
f AS (SELECT round(avg((brand IS NOT NULL)::INT), 3) AS brand, round(avg((size IS NOT NULL)::INT), 3) AS size, round(avg((label <> '')::INT), 3) AS label FROM p),
s AS (SELECT 'brand' AS k, 'text' AS shape FROM p WHERE brand IS NOT NULL UNION ALL SELECT 'size', 'number' FROM p WHERE size IS NOT NULL UNION ALL SELECT 'label', CASE WHEN label LIKE '/%' THEN 'url' ELSE 'text' END FROM p WHERE label <> ''),
c AS (SELECT k, max(n) / sum(n) AS share FROM (SELECT k, shape, count(*) AS n FROM s GROUP BY ALL) GROUP BY k)
SELECT (SELECT count(*) FROM p) AS record_count, round((brand + size + label) / 3, 3) AS mean_fill, (SELECT round(sum(share) / 3, 3) FROM c) AS consistency FROM f""")
def q_quality(spark, sf_dir):
    label = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("/part/"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name"))
    df = table(spark, sf_dir, "part").select(F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), label.alias("label"))
    return quality.measure(df, df, ["brand", "size", "label"]).select("record_count", "mean_fill", "consistency")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string('{\"a\":[{\"b\":{\"@value\":' || json_extract_string(props, '$.k') || '}}]}', '$.a[0].b.\"@value\"') AS deep FROM events")
def q_json_path(spark, sf_dir):
    k = paths.json_path(F.col("props"), "k")
    nested = F.concat(F.lit('{"a":[{"b":{"@value":'), k, F.lit("}}]}"))
    return spread(table(spark, sf_dir, "events")).select("event_id", k.alias("k"), paths.json_path(nested, "a.b").alias("deep"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'cursor' WHEN 2 THEN 'offset' ELSE 'none' END AS style,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey + 1 AS VARCHAR) WHEN 1 THEN 'c' || o_custkey WHEN 2 THEN CAST(o_custkey + 20 AS VARCHAR) END AS next FROM orders""")
def q_pagination(spark, sf_dir):
    c, way = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    body = (
        F.when(way == 0, F.concat(F.lit('{"meta":{"page":'), c, F.lit("}}"))).when(way == 1, F.concat(F.lit('{"next_cursor":"c'), c, F.lit('"}')))
        .when(way == 2, F.concat(F.lit('{"offset":'), c, F.lit(',"limit":20}'))).otherwise("[]")
    )
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", paths.pagination(body).alias("p")).select("o_orderkey", "p.style", "p.next")


@query("""SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE AS price, o_custkey::DOUBLE AS grouped, ((o_custkey % 60) * 60 + o_orderkey % 60)::BIGINT AS clock, (o_orderkey % 24 * 3600 + o_custkey % 60)::BIGINT AS iso,
  strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+00:00' AS day FROM orders""")
def q_transforms(spark, sf_dir):
    price = F.concat(F.lit("$"), F.format_string("%.2f", "o_totalprice"), F.lit(" net"))
    clock = F.format_string("%02d:%02d", (F.col("o_custkey") % 60).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    iso = F.format_string("PT%dH%dS", (F.col("o_orderkey") % 24).cast("int"), (F.col("o_custkey") % 60).cast("int"))
    return spread(table(spark, sf_dir, "orders")).select(
        "o_orderkey", values.chain(price, ["to_number"]).alias("price"), values.chain(F.concat(F.lit("no. "), F.format_number("o_custkey", 0)), ["to_float"]).alias("grouped"),
        values.chain(clock, ["duration_to_seconds"]).alias("clock"), values.chain(iso, ["trim", "duration_to_seconds"]).alias("iso"), values.chain(F.date_format("o_orderdate", "yyyy/MM/dd"), ["parse_date"]).alias("day"),
    )


AS_JOBS = {"page.fetched": ["view", "click"], "page.failed": ["error"], "records.extracted": ["purchase", "signup"]}


def crawl_events(spark, sf_dir):
    kind = F.lit(None).cast("string")
    for name, types in AS_JOBS.items():
        kind = F.when(F.col("event_type").isin(types), name).otherwise(kind)
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", kind.alias("type"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("count"))


@query("SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS pages_crawled, count(*) FILTER (event_type = 'error') AS pages_failed, coalesce(sum(json_extract_string(props, '$.k')::BIGINT) FILTER (event_type IN ('purchase', 'signup')), 0)::BIGINT AS records_extracted FROM events GROUP BY user_id")
def q_job_rollup(spark, sf_dir):
    return jobs.rollup(crawl_events(spark, sf_dir), "user_id")


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS tally FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def q_event_tally(spark, sf_dir):
    out = jobs.tally(crawl_events(spark, sf_dir), "user_id", "event_type")
    return out.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("tally")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("tally"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def q_after_cursor(spark, sf_dir):
    return jobs.after_cursor(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), 500, 100)


def order_jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "running").otherwise("completed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("heartbeat_at"), F.col("o_orderdate").alias("started_at"), (F.col("o_custkey") % 4).cast("int").alias("attempts"))


@query("SELECT o_orderkey AS job_id, substr(o_orderpriority, 1, 1)::INT AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY priority DESC, o_orderdate, o_orderkey LIMIT 25")
def q_claim_next(spark, sf_dir):
    return jobs.claim_next(order_jobs(spark, sf_dir), 25).select("job_id", "priority")


@query("""WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'running' ELSE 'completed' END AS status, (o_custkey % 4)::INT AS attempts, o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 120 SECONDS AS stale FROM orders)
SELECT job_id, CASE WHEN stale AND attempts + 1 > 3 THEN 'failed' WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN stale THEN attempts + 1 ELSE attempts END AS attempts FROM j""")
def q_reap_stale(spark, sf_dir):
    return jobs.reap_stale(order_jobs(spark, sf_dir), F.lit("1996-01-01").cast("timestamp")).select("job_id", "status", "attempts")


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT sha256(l_returnflag || '|' || l_linestatus || '|' || l_linenumber || '|' || CAST(l_quantity AS INT))) AS records FROM lineitem GROUP BY ALL")
def q_record_identity(spark, sf_dir):
    key = F.sha2(F.concat_ws("|", "l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").cast("int")), 256)
    df = dedupe.new_records(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", key.alias("record_hash")), None, ["l_returnflag", "l_linestatus", "record_hash"])
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("records"))


EDGES = "SELECT o_orderkey AS src, (o_orderkey * 7 + o_custkey) % 2000 AS dst FROM orders"


@query(f"WITH RECURSIVE e AS ({EDGES}), b AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 6) SELECT node, min(depth)::INT AS depth FROM b GROUP BY node")
def q_bfs_depth(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 2000).alias("dst"))
    return crawl.depths(edges, spark.range(1, 2).withColumnRenamed("id", "node"), 6)


@query()
def q_crawl(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"))
    found = extract.extract(pages.select("page_id", "url", "html"), ["links"]).select(urls.normalize(F.col("url"))["dedupe_key"].alias("page_key"), "links")
    found = found.select("page_key", F.explode("links").alias("href"))
    frontier, _ = crawl.crawl(found, pages.select("url"), gate.Limits(max_pages=1 << 30, max_depth=1, per_pattern_budget=50))
    return frontier


VEC = "list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END::FLOAT)"


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC}::DOUBLE[]), 5) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {VEC}::DOUBLE[]) >= 0.1")
def q_semantic(spark, sf_dir):
    df = filters.semantic(table(spark, sf_dir, "embeddings"), "embedding", [1.0 if i % 2 == 0 else -1.0 for i in range(64)], 0.1)
    return df.select("vec_id", F.round("score", 5).alias("score"))


def asked_vectors(spark, sf_dir):
    """All vectors, those of each twentieth row as references, and cells for them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("ref_id"), "embedding")
    return rows, asked, references.fit(rows, "embedding")


NAMES = {"key": "vec_id", "vector": "embedding", "ref_vector": "embedding"}


@query("""SELECT r.vec_id AS ref_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], r.embedding::DOUBLE[]), 5) AS score
FROM embeddings e JOIN embeddings r ON r.vec_id % 20 = 0 AND list_cosine_similarity(e.embedding::DOUBLE[], r.embedding::DOUBLE[]) >= 0.3""")
def q_semantic_references(spark, sf_dir):
    """Rows close to any of many references, by all cells within reach: none is lost."""
    rows, asked, index = asked_vectors(spark, sf_dir)
    return references.close_to(rows, asked, index, 0.3, **NAMES).withColumn("score", F.round("score", 5))


@query()
def q_semantic_recall(spark, sf_dir):
    """The nearest cells alone, as many as a recall of 0.95 takes in the sample, against the exact way."""
    rows, asked, index = asked_vectors(spark, sf_dir)
    probes = index.probes(0.3)
    some = references.close_to(rows, asked, index, 0.3, probes, **NAMES)
    return references.recall(some, references.close_to(rows, asked, index, 0.3, **NAMES), ["ref_id", "vec_id"]).withColumn("probes", F.lit(probes))


@query(f"""WITH t AS (SELECT doc_id, list_distinct(list_transform({TOKENS}, lambda x: lower(x))) AS w FROM documents)
SELECT a.doc_id, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 3) ELSE 0.0 END AS similarity FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def q_fingerprint_jaccard(spark, sf_dir):
    df = spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_distinct(texts.tokens(F.col("text"))).alias("w"))
    other = df.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"))
    return df.join(other, "doc_id").select("doc_id", texts.jaccard(F.col("w"), F.col("w2")).alias("similarity"))


def queries() -> dict:
    from pagemill import made_queries  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
