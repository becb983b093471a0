"""Tables that are written between jobs, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which executors share; a local master without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or 'file:///tmp/checkpoints').rstrip('/')}/crawl-{uuid.uuid4().hex}"


class Keeper:
    """Called with a table, writes it to the shared folder and returns it read back, so lineage ends there.
    ``release`` deletes what was written, once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_folder(spark), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n:04d}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keeper(spark: SparkSession) -> Keeper:
    return Keeper(spark)
