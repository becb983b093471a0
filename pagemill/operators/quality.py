"""How well a recipe fits: fill rates, consistency of shapes, score, and the activation gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import values


def _filled(df: DataFrame, c: str):
    return F.col(c).isNotNull() & ((F.col(c) != "") if dict(df.dtypes)[c] == "string" else F.lit(True))


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the share of filled values of each field, 3 decimals."""
    return df.agg(*[F.coalesce(F.round(F.avg(_filled(df, c).cast("double")), 3), F.lit(0.0)).alias(c) for c in fields])


def consistency(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the mean over fields of the share of the most common shape among filled values; an all-empty field
    counts 0. Shapes are counted per task before a shuffle of at most fields x shapes rows a task."""
    kinds = dict(df.dtypes)
    of = lambda c: values.shape(F.col(c)) if kinds[c] == "string" else F.when(F.col(c).isNull(), "empty").otherwise("bool" if kinds[c] == "boolean" else "number")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), of(c).alias("shape")) for c in fields])).alias("x")).select("x.*")
    counts = long.where(F.col("shape") != "empty").groupBy("field", "shape").agg(F.count(F.lit(1)).alias("n"))
    share = counts.groupBy("field").agg((F.max("n") / F.sum("n")).alias("share"))
    return share.agg(F.round(F.coalesce(F.sum("share"), F.lit(0.0)) / len(fields), 3).alias("consistency"))


def measure(found: DataFrame, kept: DataFrame, fields: list[str]) -> DataFrame:
    """One row of a recipe's quality: fill before required fields and filters, the rest after."""
    fill = fill_rates(found, fields)
    mean = F.round(sum((F.col(c) for c in fields), F.lit(0.0)) / max(1, len(fields)), 3)
    fill = fill.select(F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.col(c) for c in fields])).alias("fill_rates"), mean.alias("mean_fill"))
    count = kept.agg(F.count(F.lit(1)).alias("record_count"))
    # three tables of one row each
    row = fill.join(F.broadcast(count), F.lit(True)).join(F.broadcast(consistency(kept, fields)), F.lit(True))
    score = F.when(F.col("record_count") > 0, F.round(F.col("record_count") * F.col("mean_fill") * (F.col("consistency") / 2 + 0.5), 3)).otherwise(0.0)
    return row.withColumn("score", score).withColumn("can_activate", (F.col("record_count") >= 1) & (F.col("mean_fill") >= 0.5))
