"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES, SQL = {}, {}
PIECES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, dealt to as many or to PIECES for each that reads it, if that is more: a small
    file of one row group is one task, whatever work a row costs, and a task's work does not grow with the table. A table of many
    files stays as it is."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if parts >= cores else df.repartition(max(cores, PIECES * parts))


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named
