"""Which URLs may be crawled, why others may not, and in what order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import texts, urls


@dataclass(frozen=True)
class Limits:
    max_pages: int = 100
    max_depth: int = 3
    max_url_length: int = 2048
    max_path_depth: int = 12
    max_repeated_segment: int = 2
    max_query_params: int = 8
    per_pattern_budget: int = 500
    max_hosts: int = 10_000
    query_whitelist: tuple[str, ...] | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = field(default=())


def reject_reason(normal: Column, depth: Column, limits: Limits) -> Column:
    """The first rule that rejects a normalised URL, but for the pattern budget; null if none does."""
    segments = F.filter(F.split(normal["path"], "/"), lambda s: s != "")
    repeats = F.coalesce(F.array_max(F.transform(F.array_distinct(segments), lambda x: F.size(F.filter(segments, lambda y: y == x)))), F.lit(0))
    params = F.size(urls.query_pairs(F.regexp_extract(normal["url"], r"\?(.*)$", 1)))
    out = F.when(normal.isNull(), "invalid_url").when(depth > limits.max_depth, "depth_exceeded")
    if limits.allowed_domains:
        out = out.when(~urls.in_scope(normal["host"], list(limits.allowed_domains)), "out_of_scope")
    for rule in limits.exclude:
        out = out.when(normal["url"].rlike(rule), "excluded")
    if limits.include:
        hit = F.lit(False)
        for rule in limits.include:
            hit = hit | normal["url"].rlike(rule)
        out = out.when(~hit, "not_included")
    return (
        out.when(F.length(normal["url"]) > limits.max_url_length, "url_length").when(F.size(segments) > limits.max_path_depth, "path_depth")
        .when(repeats > limits.max_repeated_segment, "repeated_segment").when(params > limits.max_query_params, "query_params")
    )


def first_of(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, with nth. Each task cuts its keys to that before the shuffle, so a key
    with any number of rows brings ``most`` of each task together, not all."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= most)


def within_budget(df: DataFrame, key: str, order: list[str], budget: int, used: DataFrame | None = None) -> DataFrame:
    """Adds over: whether a row comes after the first ``budget`` ones of its key, less those of ``used`` (key, n).

    Only the place where each key's budget ends is looked for, in the rows of ``first_of``; all rows are then held
    against that one place, in a join that may split a hot key. Rows with equal ``order`` fare alike."""
    first = first_of(df.select(key, *order), key, [F.col(c) for c in order], budget)
    if used is not None:
        first = first.join(used.select(key, F.col("n").alias("_n")), key, "left").where(F.col("nth") <= budget - F.coalesce("_n", F.lit(0)))
    place = F.struct(*order)
    ends = first.groupBy(key).agg(F.max(place).alias("_end"))
    return df.join(ends, key, "left").withColumn("over", F.coalesce(place > F.col("_end"), F.lit(True))).drop("_end")


def exhausted(df: DataFrame, key: str, order: list[str], budget: int) -> DataFrame:
    """(key, limit, first_over ...) of each key that goes beyond its budget, once: where its first row over it is."""
    over = first_of(df.select(key, *order), key, [F.col(c) for c in order], budget + 1).where(F.col("nth") == budget + 1)
    return over.select(key, F.lit(budget).alias("limit"), *order)


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    names = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *[c for c in names if c not in order])).alias("_first"))
    return best.select(key, *[F.col(f"_first.{c}").alias(c) for c in names])


def admit(candidates: DataFrame, limits: Limits, order: list[str], used: DataFrame | None = None, keep_table=lambda t: t) -> DataFrame:
    """candidates (url, depth, ..., normal if it is known) with normal, pattern and reject_reason (null: admitted).

    Every check but the last is by the row, and all of them read one parsed URL; the budget of a pattern counts what passes the others, in
    ``order``, on top of ``used`` (pattern, n) of earlier rounds. ``keep_table`` may write the rows checked, which are read several times."""
    known = "normal" in candidates.columns
    normal = F.col("normal") if known else urls.normalize(F.col("url"), keep=list(limits.query_whitelist) if limits.query_whitelist else None)
    told = lambda n: F.struct(n.alias("normal"), reject_reason(n, F.col("depth"), limits).alias("reject_reason"), urls.pattern(n).alias("pattern"))
    df = candidates.withColumn("_told", texts.bound(normal, told)).select(*[c for c in candidates.columns if c != "normal"], "_told.*")
    df = keep_table(df)
    passing = df.where(F.col("reject_reason").isNull())
    ranked = within_budget(passing, "pattern", order, limits.per_pattern_budget, used)
    ranked = ranked.withColumn("reject_reason", F.when(F.col("over"), "pattern_budget")).drop("over")
    return ranked.select(df.columns).unionByName(df.where(F.col("reject_reason").isNotNull()))


def within_hosts(df: DataFrame, host: str, seq: str, limits: Limits) -> DataFrame:
    """Rows of the first max_hosts hosts, by when each was first seen."""
    hosts = df.groupBy(host).agg(F.min(seq).alias("_seen")).orderBy("_seen", host).limit(limits.max_hosts)
    return df.join(hosts.select(host), host, "left_semi")


def page_budget(df: DataFrame, order: list, limits: Limits) -> DataFrame:
    """The first max_pages rows in an order; each task keeps no more than that."""
    return df.orderBy(*order).limit(limits.max_pages)


CHUNK = 1 << 16  # values of seq that are ranked in one group


def round_robin(df: DataFrame, host: str, priority: str, seq: str) -> DataFrame:
    """Adds turn and host_seen: hosts take turns, each with its best page; a host's rank is when it was first seen.
    ``seq`` is a whole number, without repeats.

    A host's pages are ranked by priority and CHUNK of seq, and the sizes of those groups added up, so that one
    task sees a part of a large host."""
    chunk = F.floor(F.col(seq) / CHUNK).alias("_chunk")
    sizes = df.groupBy(host, priority, chunk).agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_least"))
    all_of = Window.partitionBy(host)
    before = F.sum("_n").over(all_of.orderBy(F.desc(priority), "_chunk")) - F.col("_n")
    sizes = sizes.select(host, priority, "_chunk", before.alias("_before"), F.min("_least").over(all_of).alias("host_seen"))
    inside = F.row_number().over(Window.partitionBy(host, priority, "_chunk").orderBy(seq))
    ranked = df.withColumn("_chunk", chunk).withColumn("_in", inside).join(sizes, [host, priority, "_chunk"])
    return ranked.withColumn("turn", (F.col("_before") + F.col("_in")).cast("int")).select(*df.columns, "turn", "host_seen")


def host_stats(df: DataFrame, host: str) -> DataFrame:
    """Pages, failures and pending URLs of each host."""
    n = lambda s: F.count_if(F.col("status") == s)
    return df.groupBy(host).agg(n("pending").alias("pending"), n("fetched").alias("fetched"), n("failed").alias("failures"))


def fetch_error(status: Column) -> Column:
    """The kind of failure of a response's status; null below 400."""
    return F.when(status >= 500, "http_5xx").when(status == 429, "blocked_429").when(status == 403, "blocked_403").when(status >= 400, "http_4xx")


# Names of transport errors, and the kinds they count as; of these the last four are not worth a retry.
TRANSPORT = {
    "ConnectTimeout": "conn_timeout", "ReadTimeout": "read_timeout", "WriteTimeout": "read_timeout", "PoolTimeout": "read_timeout", "ConnectError": "conn_refused", "TransportError": "conn_refused",
    "UnpinnedHost": "ssrf_reject", "ProtocolError": "parse_fail", "RemoteProtocolError": "parse_fail", "SSLError": "tls_error",
}
RETRIED = ["conn_timeout", "read_timeout", "conn_refused"]


def transport_error(name: Column, message: Column) -> Column:
    """The kind of a failure before any status, by the error's name; a refused address shows in its message."""
    known = F.lit(None).cast("string")
    for error, kind in TRANSPORT.items():
        known = F.when(name == error, kind).otherwise(known)
    refused = (name == "ConnectError") & F.coalesce(message, F.lit("")).contains("unpinned host")
    return F.when(refused, "ssrf_reject").when(name.isNotNull(), F.coalesce(known, F.lit("internal")))


def judged_fetches(fetched: DataFrame, now: Column, byte_limit: int = 5_000_000) -> DataFrame:
    """fetched (status, body, retry_after, error, message) with error_kind, retryable and retry_after_s.

    An error before any status goes by its name, then a status of 400 or more, then a body above the limit
    (size_exceeded), of which the bytes go. Null error_kind: the page counts. Other columns stay."""
    kind = F.coalesce(transport_error(F.col("error"), F.col("message")), fetch_error(F.col("status")), F.when(F.octet_length("body") > byte_limit, "size_exceeded"))
    again = F.col("error_kind").isin(*RETRIED) | F.coalesce(retryable(F.col("status")), F.lit(False))
    out = fetched.withColumn("error_kind", kind).withColumn("retryable", F.coalesce(again, F.lit(False)))
    wait = F.when(F.col("error_kind") == "blocked_429", retry_after(F.col("retry_after"), now))
    return out.withColumns({"retry_after_s": wait, "body": F.when(F.col("error_kind").isNull(), F.col("body"))})


def host_pause(error_kind: Column, retry_after_s: Column, most: int = 300) -> Column:
    """Seconds that a host rests after a refusal."""
    return F.when(error_kind.isin("blocked_429", "blocked_403"), F.least(F.coalesce(retry_after_s, F.lit(30.0)), F.lit(float(most))))


def retryable(status: Column) -> Column:
    return (status >= 500) | (status == 429)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait, of a number or an HTTP date; not below 0; null if neither."""
    plain = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.greatest(F.coalesce(plain, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double")), F.when(plain.isNotNull() | date.isNotNull(), F.lit(0.0)))
