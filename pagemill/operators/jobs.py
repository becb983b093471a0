"""Crawl jobs: tallies of events, queue order, recovery, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tally(events: DataFrame, job: str, kind: str, type_: str | None = None) -> DataFrame:
    """(job, tally): a map of counts by kind."""
    df = events.where(F.col("type") == type_) if type_ else events
    counts = df.groupBy(job, kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(job).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("tally"))


def rollup(events: DataFrame, job: str) -> DataFrame:
    """Counters of each job: pages, failures, records."""
    n = lambda t: F.count_if(F.col("type") == t)
    return events.groupBy(job).agg(n("page.fetched").alias("pages_crawled"), n("page.failed").alias("pages_failed"), F.sum(F.when(F.col("type") == "records.extracted", F.col("count")).otherwise(0)).alias("records_extracted"))


def claim_next(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The pending jobs that go first: by falling priority, then age."""
    return jobs.where(F.col("status") == "pending").orderBy(F.desc("priority"), "created_at", "job_id").limit(n)


def reap_stale(jobs: DataFrame, now: Column, after_s: int = 120, attempts: int = 3) -> DataFrame:
    """Running jobs without a heartbeat for too long go back to the queue, or fail after too many attempts."""
    stale = (F.col("status") == "running") & (F.coalesce("heartbeat_at", "started_at") < now - F.expr(f"INTERVAL {after_s} SECONDS"))
    tried = F.col("attempts") + 1
    status = F.when(stale & (tried > attempts), "failed").when(stale, "pending").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "attempts": F.when(stale, tried).otherwise(F.col("attempts"))})


TERMINAL = ["completed", "failed", "cancelled"]


def _named(jobs: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """jobs with a flag: whether ids (job_id) names the job."""
    return jobs.join(ids.select("job_id").distinct().withColumn(flag, F.lit(True)), "job_id", "left")


def retry(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Finished jobs that ids (job_id) names start anew with their counters at 0; their records stay."""
    df = _named(jobs, ids, "_again")
    again = F.col("_again").isNotNull() & F.col("status").isin(TERMINAL)
    zero = {c: F.when(again, 0).otherwise(F.col(c)) for c in ("attempts", "pages_crawled", "pages_failed", "records_extracted") if c in jobs.columns}
    return df.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), **zero}).select(jobs.columns)


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Open jobs that ids (job_id) names are cancelled."""
    df = _named(jobs, ids, "_off")
    return df.withColumn("status", F.when(F.col("_off").isNotNull() & ~F.col("status").isin(TERMINAL), "cancelled").otherwise(F.col("status"))).select(jobs.columns)


def after_cursor(events: DataFrame, cursor: int, limit: int, id_: str = "event_id") -> DataFrame:
    """The next events after a cursor. Only rows past it are read, and each task keeps the first ``limit``."""
    return events.where(F.col(id_) > cursor).orderBy(id_).limit(limit)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def record_hash(url: Column, record: Column) -> Column:
    """Identity of a record on its page; record is a struct with its fields by name."""
    return F.sha2(F.concat(url, F.lit("\x00"), F.to_json(record)), 256)


def duplicates_by_via(events: DataFrame) -> DataFrame:
    """(via, n) of the duplicates found, by how."""
    return events.where("type = 'duplicate.detected'").groupBy("via").agg(F.count(F.lit(1)).alias("n")).orderBy("via")


PROGRESS_EVERY = 10
QUEUED = "url.queued"
RUN = 1 << 16  # event ids that are added up in one group


def _running(df: DataFrame, part: list[str], order: str, run: int, **sums: Column) -> DataFrame:
    """df with running sums by ``order``, a whole number, within ``part``: inside runs of ``run`` numbers and between the totals of
    those, so one task sees a part of a long sequence. Rows of equal order count together."""
    df = df.withColumn("_run", F.floor(F.col(order) / run))
    df = df.withColumns({f"_in_{n}": c for n, c in sums.items()})
    totals = df.groupBy(*part, "_run").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    past = Window.partitionBy(*part).orderBy("_run")
    totals = totals.select(*part, "_run", *[(F.sum(f"_t_{n}").over(past) - F.col(f"_t_{n}")).alias(f"_p_{n}") for n in sums])
    here = Window.partitionBy(*part, "_run").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_in_{n}": F.sum(f"_in_{n}").over(here) for n in sums}).join(totals, [*part, "_run"])
    return df.withColumns({n: F.col(f"_p_{n}") + F.col(f"_in_{n}") for n in sums}).drop("_run", *[x for n in sums for x in (f"_in_{n}", f"_p_{n}")])


def progress(events: DataFrame, job: str = "job_id", every: int = PROGRESS_EVERY) -> DataFrame:
    """(job, event_id, pages_done, pages_queued, records_total, hosts_active) after each ``every`` pages of a job, by event_id.

    events has type, count, url and host. pages_queued: URLs queued (events of type QUEUED) less those that were fetched or failed so far.
    hosts_active: hosts of which some URL is queued and neither fetched nor failed. Rejected URLs do not count.

    All four are sums of differences: a page adds one, a URL leaves its queue by one, and a host adds one when its own queue
    rises from nothing and takes one away when it is empty again. Sums run within RUN ids and between the totals of those, for a
    job and for each of its hosts, so one task sees a part of a long job."""
    type_, one = F.col("type"), lambda c: F.coalesce(c, F.lit(False)).cast("long")
    count = F.when(type_ == "records.extracted", F.coalesce("count", F.lit(0))).otherwise(0).cast("long")
    rows = events.select(job, "event_id", F.coalesce("host", F.lit("")).alias("host"), one(type_ == "page.fetched").alias("page"), one(type_ == QUEUED).alias("came"), one(type_.isin("page.fetched", "page.failed")).alias("left"), count.alias("records"))
    rows = rows.groupBy(job, "host", "event_id").agg(*[F.sum(c).alias(c) for c in ("page", "came", "left", "records")])
    queue = _running(rows, [job, "host"], "event_id", RUN, own=F.col("came") - F.col("left"))
    before = F.col("own") - F.col("came") + F.col("left")
    queue = queue.withColumn("turn", one(F.col("own") > 0) - one(before > 0)).groupBy(job, "event_id").agg(*[F.sum(c).alias(c) for c in ("page", "came", "left", "records", "turn")])
    out = _running(queue, [job], "event_id", RUN, pages_done=F.col("page"), records_total=F.col("records"), pages_queued=F.col("came") - F.col("left"), hosts_active=F.col("turn"))
    shown = out.where(F.floor(F.col("pages_done") / every) > F.floor((F.col("pages_done") - F.col("page")) / every))
    return shown.select(job, "event_id", "pages_done", "pages_queued", "records_total", "hosts_active")


def best_recipes(measured: DataFrame, key: str, recipe: str = "recipe", score: str = "score") -> DataFrame:
    """(key, recipe, score): the recipe of the best score; of equals the first by name."""
    best = measured.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(recipe).alias("r"))).alias("b"))
    return best.select(key, F.col("b.r").alias(recipe), (-F.col("b.s")).alias(score))


def preview(df: DataFrame, order: list, most: int = 500) -> DataFrame:
    """The first rows, each with the number of all (``total``), for a screen."""
    return df.orderBy(*order).limit(most).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))


def keyset_page(df: DataFrame, seq: str, after: int, most: int = 500) -> DataFrame:
    """The next rows past a key, in its order: what was read before is not read again."""
    return df.where(F.col(seq) > after).orderBy(seq).limit(most)


def sse(events: DataFrame, payload: list[str]) -> DataFrame:
    """(event_id, frame): each event as a frame of a server-sent stream, without an id of its own."""
    data = F.to_json(F.struct(*payload))
    return events.select("event_id", F.concat(F.lit("event: "), "type", F.lit("\ndata: "), data, F.lit("\n\n")).alias("frame"))
