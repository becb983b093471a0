"""Tables between jobs, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets one of its own
    and a cluster gets an error: a machine's own folder is not seen by other executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/pagemill"


LIVE: list[Stash] = []


def release(spark: SparkSession, but: tuple[Stash, ...] = ()) -> None:
    """Deletes the tables that operators of this session have written, but for those of some stashes. To be called
    when their results are written: results read these tables until then."""
    for stash in [s for s in LIVE if s.spark is spark and s not in but]:
        stash.clear()


class Stash:
    """Tables written during one operator call, until ``release``.

    ``keep`` writes a DataFrame as Parquet to the shared folder and returns it read back, so that a
    lost executor costs a reread and not the work before. ``drop`` removes a table that no later
    step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        LIVE.append(self)

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # what was shuffled for this table goes once it is written
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stash_path = path
        return out

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df.stash_path)

    def clear(self) -> None:
        self._delete(self.root)
        LIVE.remove(self)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two non-null longs that tell rows of different (doc_id, text) apart."""
    d = F.coalesce(doc_id.cast("string"), F.lit("\x00"))
    t = F.coalesce(text, F.lit("\x00"))
    return [F.xxhash64(d, t), F.xxhash64(t, F.lit(1), d)]


def hidden(docs: DataFrame, **more: Column) -> DataFrame:
    """docs with its columns renamed to _0, _1, ... so that no name can clash, and more columns."""
    return docs.select(*[F.col(_quoted(c)).alias(f"_{i}") for i, c in enumerate(docs.columns)], *[v.alias(k) for k, v in more.items()])


def shown(docs: DataFrame, but: tuple = ()) -> list[Column]:
    """The columns of docs by their own names again, without those named in ``but``."""
    return [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in but]


def with_text(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with its columns renamed to _0, _1, ..., but for one."""
    return hidden(docs).withColumnRenamed(f"_{docs.columns.index(column)}", column)


def map_batches(docs: DataFrame, run, added: dict[str, Column], column: str = "text") -> DataFrame:
    """Adds columns, filled by ``run`` over Arrow batches that hold ``column`` and the added ones by name."""
    plain = with_text(docs, column).withColumns(added)
    out = plain.mapInArrow(run, plain.schema).withColumnRenamed(column, f"_{docs.columns.index(column)}")
    return out.select(*shown(docs, but=tuple(added)), *added)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_digest(text: Column) -> Column:
    """16 bytes of SHA-256 over a text's UTF-8; null for a null text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
