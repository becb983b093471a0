"""Chains of redirects over a table of responses: where each URL ends, after how many hops, or why it does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import texts, urls

MOST = 5
# Fixed values.
STATUSES = [301, 302, 303, 307, 308]


def hops(responses: DataFrame) -> DataFrame:
    """(key, url, status, stop, next) of responses (url, status, location), one for each dedupe_key, the least by URL.

    ``next`` is the dedupe_key that a redirect leads to. It is null where the chain ends: stop is then null for a response that is
    the answer, "ssrf_reject" for a URL whose address is denied, and "bad_target" for a redirect to what is no URL that can be fetched."""
    own = texts.bound(urls.normalize(F.col("url")), lambda n: F.struct(n["dedupe_key"].alias("key"), n["url"].alias("url"), urls.denied_address(n["host"]).alias("denied")))
    # an explode of one value: what is asked of a column goes down to where the table is read, in few tasks, and normalises each URL once more
    df = responses.select(F.explode(F.array(own)).alias("n"), "status", F.trim(F.coalesce("location", F.lit(""))).alias("location")).where("n.key IS NOT NULL")
    df = df.groupBy("n.key").agg(F.min(F.struct("n.url", "n.denied", "status", "location")).alias("r")).select("key", "r.*")
    leads = F.col("status").isin(STATUSES) & (F.col("location") != "") & F.col("denied").isNull()
    target = F.when(leads, urls.normalize(F.col("location"), F.col("url"))["dedupe_key"])
    df = df.withColumns({"leads": F.coalesce(leads, F.lit(False)), "next": target})
    stop = F.when(F.col("denied").isNotNull(), "ssrf_reject").when(F.col("leads") & F.col("next").isNull(), "bad_target")
    return df.select("key", "url", "status", stop.alias("stop"), "next")


def _first_repeat(path: Column) -> Column:
    """The first place, from 1, whose key is the start's or an earlier one's, of an array that begins with the start; null if all differ."""
    places = F.sequence(F.lit(1), F.size(path) - 1)
    again = F.filter(places, lambda i: F.array_contains(F.slice(path, F.lit(1), i), F.get(path, i)))
    return F.when(F.size(path) > 1, F.get(again, 0))


def follow(responses: DataFrame, keep_table, most: int = MOST) -> DataFrame:
    """(url, final_url, hops, status, error_kind) of each URL of responses (url, status, location), one row for each dedupe_key.

    Chains are followed for at most ``most`` hops, each target normalised against the URL before. error_kind: "redirect_max" beyond that;
    "ssrf_reject" at a denied address or a target that is no URL; "redirect_loop" at a hop back to a URL of the chain, told by
    dedupe_key; "absent" where the table has no response. Then final_url is the URL where it failed. Null: final_url answered with status.

    Pointer jumping: each URL has the keys of its next hops, and a round joins it with those of the last of them, so lists double
    from round to round and ``most`` hops take log2(most + 1) joins, whatever the number of chains. A list never holds more than most + 1
    keys, so cycles end. A URL that very many lead to stands once on its side of the join; the other may be split."""
    nodes = keep_table(hops(responses))
    paths = nodes.select("key", F.when(F.col("next").isNotNull(), F.array("next")).otherwise(F.array().cast("array<string>")).alias("path"))
    reach = 1
    while reach < most + 1:
        onward = paths.select(F.col("key").alias("_last"), F.col("path").alias("_more"))
        open_ = (F.size("path") == reach) & (F.size("path") > 0)  # what is shorter has ended, and is not joined
        whole = F.slice(F.concat("path", F.coalesce("_more", F.array().cast("array<string>"))), 1, most + 1)
        longer = paths.where(open_).withColumn("_last", F.element_at("path", -1)).join(onward, "_last", "left").select("key", whole.alias("path"))
        paths, reach = keep_table(longer.unionByName(paths.where(~open_))), min(2 * reach, most + 1)
    chain = F.concat(F.array("key"), "path")
    repeat = texts.bound(chain, _first_repeat)
    rows = paths.withColumn("repeat", repeat)
    looped = F.col("repeat") <= most
    n = F.when(looped, F.col("repeat") - 1).otherwise(F.least(F.size("path"), F.lit(most)))
    over = ~F.coalesce(looped, F.lit(False)) & (F.size("path") > most)
    rows = rows.select("key", n.alias("hops"), F.get(chain, n).alias("at"), F.coalesce(looped, F.lit(False)).alias("looped"), over.alias("over"))
    ends = nodes.select(F.col("key").alias("at"), F.col("url").alias("at_url"), "status", "stop", F.lit(True).alias("there"))
    out = rows.join(ends, "at", "left").join(nodes.select("key", "url"), "key")
    error = (
        F.when(F.col("looped"), "redirect_loop").when(F.col("over") | ((F.col("stop") == "bad_target") & (F.col("hops") >= most)), "redirect_max")
        .when(F.col("there").isNull(), "absent").when(F.col("stop").isNotNull(), "ssrf_reject")
    )
    return out.select("url", F.coalesce("at_url", "at").alias("final_url"), "hops", F.when(error.isNull(), F.col("status")).alias("status"), error.alias("error_kind"))
