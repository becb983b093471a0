"""The event stream of crawls, and the tables it is written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions import texts

EVENTS = "event_id long, at timestamp, job_id string, type string, url string, reason string, count long, payload string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDENTITY = ["job_id", "url", "record_hash"]


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over an append-only folder of events."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def payload_records(payload: Column) -> Column:
    """The records of an event as JSON texts, of an array each element, of anything else the whole; null for null.
    Names are sorted at every level and white space goes, so that equal records have equal texts. What is no JSON is its own text."""

    def told(v: Column) -> Column:
        found = F.transform(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)), lambda r: F.to_json(r))
        return F.when(v.isNull() & payload.isNotNull(), F.array(payload)).when(v.isNotNull(), found)

    return texts.bound(F.try_parse_json(payload), told)


def records_of(events: DataFrame) -> DataFrame:
    """(job_id, url, record_hash, data, event_id): a row for each record of each event that brings some."""
    some = events.where("type = 'records.extracted'").select("job_id", "url", "event_id", F.explode(payload_records(F.col("payload"))).alias("data"))
    some = some.where("data IS NOT NULL")
    return some.select("job_id", "url", F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("\x00"), "data"), 256).alias("record_hash"), "data", "event_id")


def _start(rows: DataFrame, write, checkpoint: str, interval: str | None) -> StreamingQuery:
    """The query keeps its state in RocksDB, on the executors' disks and in the checkpoint, so that it may outgrow their memory."""
    conf = rows.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        to = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (to.trigger(processingTime=interval) if interval else to.trigger(availableNow=True)).start()
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)


def sink_events(events: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> list[StreamingQuery]:
    """Starts two queries that write a stream of events (EVENTS) to three tables under ``out``.

    ``records`` gets each record once for its job, URL and hash, however often, in whichever batch, and before or after however
    many restarts it comes: the identities met are the state of that query. ``events`` gets each event, without its records, once
    for its job and event_id. ``tallies`` counts new events and adds up their ``count`` by job, type and reason, a part for
    each batch; a reader sums the parts. A batch that is run again after a failure overwrites what it wrote before, and
    its state is that of its first run, so nothing is lost or doubled.

    State is spread over the shuffle's partitions by a hash of the whole identity, so one large job has no partition of its own.
    Null job_id, url and event_id count as values. ``interval``: keep running at that pace; else until what is there is written."""

    def write_events(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{out}/events/batch={n}")
            counts = batch.groupBy("job_id", "type", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("count"))
            counts.write.mode("overwrite").parquet(f"{out}/tallies/batch={n}")
        finally:
            batch.unpersist()

    def write_records(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/records/batch={n}")

    # a file of one row group is one task; payloads are parsed by as many as the state has
    dealt = events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return [
        _start(events.drop("payload").dropDuplicates(["job_id", "event_id"]), write_events, f"{checkpoint}/events", interval),
        _start(records_of(dealt).dropDuplicates(IDENTITY), write_records, f"{checkpoint}/records", interval),
    ]


def drain(queries: list[StreamingQuery]) -> None:
    """Waits until all queries have ended; an error of one is raised."""
    for q in queries:
        q.awaitTermination()
