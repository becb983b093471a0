"""Traversal of a link table round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import texts, urls
from pagemill.operators import dedupe, gate
from pagemill.operators.seen import SeenSet
from pagemill.tables import Keeper, keeper, shared_folder  # noqa: F401


def depths(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(node, depth): breadth-first distance over edges (src, dst) from seeds (node). Each round joins the last
    frontier, not all nodes, with the edges, and drops what was seen before."""
    keep = keeper(edges.sparkSession)
    seen = keep(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, parts = seen, [seen]
    for d in range(1, max_depth + 1):
        found = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = keep(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        parts.append(front)
        seen = seen.unionByName(front)
    return seen


def fresh(links: DataFrame, seen: SeenSet, limits: gate.Limits) -> DataFrame:
    """Links (url, depth) of keys not in seen, one of each, with normal; those without a key stay as they are."""
    normal = urls.normalize(F.col("url"), keep=list(limits.query_whitelist) if limits.query_whitelist else None)
    plain = links.select("url", "depth").distinct().withColumn("normal", normal)
    one = gate.first_seen(plain.withColumn("dedupe_key", F.coalesce("normal.dedupe_key", "url")), "dedupe_key", ["url"])
    return seen.fresh(one, "dedupe_key")


def _admitted(checked: DataFrame) -> DataFrame:
    new = checked.where(F.col("reject_reason").isNull()).select("dedupe_key", F.col("normal.url").alias("url"), "depth", "pattern")
    return new.withColumn("priority", urls.score(F.col("url"), F.col("depth")))


def _rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull()).select("url", "depth", F.col("reject_reason").alias("reason"))


def crawl(links: DataFrame, seeds: DataFrame, limits: gate.Limits, keep: Keeper | None = None) -> tuple[DataFrame, DataFrame]:
    """Traverse a table of links (page_key, href) from seed URLs.

    Returns (frontier, rejects): frontier has dedupe_key, url, depth and priority of admitted URLs, up to
    max_pages in order of depth and priority; rejects has url, depth and reason. Seen keys are dropped
    before the gate and use up no budget, so rejected URLs may be met and rejected again; budgets carry over
    from round to round."""
    keep = keep or keeper(links.sparkSession)
    todo = seeds.select("url").withColumn("depth", F.lit(0))
    seen = SeenSet(links.sparkSession, keep)
    frontier = rejects = used = None
    for d in range(limits.max_depth + 1):
        checked = keep(gate.admit(fresh(todo, seen, limits), limits, ["url"], used))
        new, bad = _admitted(checked), _rejected(checked)
        frontier = new if frontier is None else frontier.unionByName(new)
        rejects = bad if rejects is None else rejects.unionByName(bad)
        if new.isEmpty() or d == limits.max_depth:
            break
        seen.add(new.select(F.col("dedupe_key").alias("key")))
        counted = new.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        used = keep(counted if used is None else used.unionByName(counted).groupBy("pattern").agg(F.sum("n").alias("n")))
        todo = new.join(links, new.dedupe_key == links.page_key).select(urls.join(F.col("url"), F.col("href")).alias("url"), F.lit(d + 1).alias("depth")).where(F.col("url").isNotNull())
    # the hosts met first, and of their pages the first ones
    place = frontier.withColumns({"host": urls.normalize(F.col("url"))["host"], "seq": F.struct("depth", (-F.col("priority")).alias("p"), "dedupe_key")})
    chosen = gate.page_budget(gate.within_hosts(place, "host", "seq", limits), ["seq"], limits)
    return chosen.drop("pattern", "host", "seq"), rejects


def spider(pages: DataFrame, seeds: DataFrame, limits: gate.Limits, keep: Keeper | None = None) -> tuple[DataFrame, DataFrame]:
    """Traverse fetched pages from seed URLs and judge each one before its links are followed.

    pages has page_key, text, records (a count), canonical (a URL or null) and links (an array). Returns
    (visited, rejects). visited has dedupe_key, url, depth, priority, outcome and of_key; the outcome is

    - ``absent``: the table has no such page;
    - ``soft_404``: no records, and its text says it is missing or is the third of its thin shape. Its URL
      pattern gets no more budget from the next round on;
    - ``duplicate``: an earlier page, of_key, has its text or nearly so;
    - ``page``: any other. Only the links of these are followed.

    Another page that a page names as canonical counts as seen from the next round on. Earlier is of less
    depth, then of more priority, then by key. Judging reads the texts of the round's pages and an index of the
    fingerprints of those kept before; no more than max_pages are visited."""
    keep = keep or keeper(pages.sparkSession)
    todo = seeds.select("url").withColumn("depth", F.lit(0))
    visited = rejects = used = burnt = None
    seen, left, thin, kept = SeenSet(pages.sparkSession, keep), limits.max_pages, None, dedupe.PrintIndex(keep)
    both = lambda a, b: b if a is None else a.unionByName(b)
    for d in range(limits.max_depth + 1):
        checked = keep(gate.admit(fresh(todo, seen, limits), limits, ["url"], used))
        admitted = keep(_admitted(checked))
        rejects = both(rejects, _rejected(checked))
        place = F.concat_ws(" ", F.lpad(F.col("depth").cast("string"), 4, "0"), F.lpad((F.lit(1_000_000) - F.col("priority")).cast("string"), 8, "0"), "dedupe_key")
        now = admitted.withColumn("place", place).orderBy("place").limit(left)
        # by shuffles: pages made from a short column, and keys that repeat, pass for small tables and would go through the driver to all tasks
        round_ = keep(now.join(dedupe.shuffled(pages.withColumnRenamed("page_key", "dedupe_key")), "dedupe_key", "left").withColumn("there", F.col("records").isNotNull()))
        bare = round_.where("there AND records = 0")
        missing = bare.where(texts.says_missing(F.col("text"))).select("place")
        thin = keep(both(thin, bare.where(~texts.says_missing(F.col("text"))).where(F.size(texts.tokens(F.col("text"))) < 40).select("place", "text")))
        stubs = dedupe.stub_pages(thin, "place", "text", keep_table=keep).select("place") if not thin.isEmpty() else missing.where("false")
        soft = keep(missing.union(stubs.join(round_.select("place"), "place", "left_semi")).withColumn("soft", F.lit(True)))
        good = keep(round_.where("there").join(soft, "place", "left_anti").where(F.size(texts.tokens(F.col("text"))) >= dedupe.MIN_TOKENS).select("place", "text"))
        leaders = good.select("place", F.col("place").alias("leader")) if good.isEmpty() else keep(dedupe.near_leaders(good, "place", "text", keep, known=kept))
        judged = round_.join(dedupe.shuffled(soft), "place", "left").join(dedupe.shuffled(leaders), "place", "left")
        outcome = F.when(~F.col("there"), "absent").when(F.col("soft"), "soft_404").when(F.col("leader") != F.col("place"), "duplicate").otherwise("page")
        judged = judged.withColumn("outcome", outcome).withColumn("of_key", F.when(F.col("outcome") == "duplicate", F.substring_index("leader", " ", -1)))
        judged = keep(judged.drop("text", "soft", "leader", "there", "records"))
        visited = both(visited, judged.drop("place", "canonical", "links"))
        here, left = judged.count(), left - judged.count()
        if not here or left <= 0 or d == limits.max_depth:
            break
        canonical = urls.normalize(urls.join(F.col("url"), F.col("canonical")), keep=list(limits.query_whitelist) if limits.query_whitelist else None)["dedupe_key"]
        named = judged.where("canonical IS NOT NULL").select(canonical.alias("dedupe_key")).where("dedupe_key IS NOT NULL")
        seen.add(admitted.select("dedupe_key").union(named).withColumnRenamed("dedupe_key", "key"))
        burnt = both(burnt, judged.where("outcome = 'soft_404'").select("pattern", F.lit(limits.per_pattern_budget).cast("long").alias("n")))
        counted = both(used, admitted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))).unionByName(burnt)
        used = keep(counted.groupBy("pattern").agg(F.least(F.sum("n"), F.lit(limits.per_pattern_budget).cast("long")).alias("n")))
        follow = judged.where("outcome = 'page'").select("url", F.explode("links").alias("href"))
        todo = follow.select(urls.join(F.col("url"), F.col("href")).alias("url"), F.lit(d + 1).alias("depth")).where(F.col("url").isNotNull())
    return visited.drop("pattern"), rejects
