"""Record filters with the reason of each drop, required fields, and semantic filters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import texts, values

OPS = ["exists", "missing", "eq", "ne", "in", "not_in", "contains", "not_contains", "matches", "not_matches", "between", "gt", "gte", "lt", "lte", "semantic"]


@dataclass(frozen=True)
class RecordFilter:
    field: str
    op: str
    value: Any = None
    threshold: float = 0.7

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown filter {self.op!r}")
        if self.op == "between" and (not isinstance(self.value, (list, tuple)) or len(self.value) != 2):
            raise ValueError("between takes two values")

    @property
    def reason(self) -> str:
        return f"{self.field} {self.op}"


def _alike(kind: str, value: Any) -> bool:
    """Whether a value can equal a column of this type; nothing is coerced."""
    if kind == "string":
        return isinstance(value, str)
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return isinstance(value, (bool, int, float))
    return True


ZONE = r"(?:Z|[+-]\d{2}:?\d{2})$"


def _moments(c: Column, bound: str) -> tuple[Column, Column]:
    """A field of ISO dates and a bound as moments; where either has no zone, the zones of both go."""
    bare = lambda x: F.try_to_timestamp(F.regexp_replace(x, r"(?<=\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?" + ZONE, "$1"))
    field, limit = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c), F.lit(bound)
    if not re.search(r"\d{2}:\d{2}.*" + ZONE, bound):
        return bare(field), F.try_to_timestamp(limit)
    zoned = field.rlike(r"\d{2}:\d{2}.*" + ZONE)
    return F.when(zoned, F.try_to_timestamp(field)).otherwise(bare(field)), F.when(zoned, F.try_to_timestamp(limit)).otherwise(bare(limit))


def _ordered(df: DataFrame, field: str, bounds: list, typed: bool) -> list[tuple[Column, Column]]:
    """A field beside each bound in a type that compares: numbers through to_number, dates first if ``typed``."""
    kind, c = dict(df.dtypes)[field], F.col(field)
    if kind != "string":
        return [(c, F.lit(b)) for b in bounds]
    if typed and all(isinstance(b, str) and b[:4].isdigit() and b[4:5] == "-" for b in bounds):
        return [_moments(c, b) for b in bounds]
    return [(values.to_number(c), values.to_number(F.lit(b)) if isinstance(b, str) else F.lit(float(b))) for b in bounds]


def predicate(df: DataFrame, f: RecordFilter, typed: bool = True) -> Column:
    """True where a record passes; null fields pass only ``missing``. ``typed`` compares ISO dates as dates,
    otherwise by their first number, the year."""
    c, kind, v = F.col(f.field), dict(df.dtypes)[f.field], f.value
    there = c.isNotNull() & ((c != "") if kind == "string" else F.lit(True))
    if f.op == "exists":
        return there
    if f.op == "missing":
        return ~there
    if f.op == "semantic":
        return F.lit(True)
    many = list(v) if isinstance(v, (list, tuple, set)) else [v]
    fitting = [x for x in many if _alike(kind, x)]
    text = c.cast("string")
    if f.op in ("eq", "ne"):
        same = (c == F.lit(v)) if _alike(kind, v) else F.lit(False)
        out = same if f.op == "eq" else ~same
    elif f.op in ("in", "not_in"):
        inside = c.isin(fitting) if fitting else F.lit(False)
        out = inside if f.op == "in" else ~inside
    elif f.op in ("contains", "not_contains"):
        out = text.contains(str(v)) if f.op == "contains" else ~text.contains(str(v))
    elif f.op in ("matches", "not_matches"):
        out = text.rlike(v) if f.op == "matches" else ~text.rlike(v)
    elif f.op == "between":
        (x, low), (y, high) = _ordered(df, f.field, many, typed)
        out = (x >= low) & (y <= high)
    else:
        ((x, bound),) = _ordered(df, f.field, [v], typed)
        out = {"gt": x > bound, "gte": x >= bound, "lt": x < bound, "lte": x <= bound}[f.op]
    return F.coalesce(c.isNotNull() & out, F.lit(False))


def with_reason(df: DataFrame, filters: list[RecordFilter], required: list[str] = (), typed: bool = True) -> DataFrame:
    """Adds drop_reason: "required", the first failing filter, or null for what is kept. One pass."""
    kinds = dict(df.dtypes)
    lacks = F.lit(False)
    for r in required:
        lacks = lacks | F.col(r).isNull() | ((F.col(r) == "") if kinds[r] == "string" else F.lit(False))
    out = F.when(lacks, "required")
    for f in filters:
        out = out.when(~predicate(df, f, typed), f.reason)
    return df.withColumn("drop_reason", out)


def keep(df: DataFrame, filters: list[RecordFilter], required: list[str] = (), typed: bool = True) -> DataFrame:
    return with_reason(df, filters, required, typed).where(F.col("drop_reason").isNull()).drop("drop_reason")


def reasons(df: DataFrame, filters: list[RecordFilter], required: list[str] = (), typed: bool = True) -> DataFrame:
    """(reason, n) of dropped records."""
    return with_reason(df, filters, required, typed).where(F.col("drop_reason").isNotNull()).groupBy(F.col("drop_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def semantic_text(df: DataFrame, field: str) -> Column:
    """A field's text, or of all scalar fields for ``*``: its first 800 characters."""
    if field != "*":
        return F.substring(F.col(field).cast("string"), 1, 800)
    kinds = [n for n, k in df.dtypes if k in ("string", "int", "bigint", "float", "double", "boolean")]
    return F.substring(F.concat_ws(" ", *[F.initcap(F.col(n).cast("string")) if dict(df.dtypes)[n] == "boolean" else F.col(n).cast("string") for n in kinds]), 1, 800)


def semantic(df: DataFrame, vector: str, reference: list[float], threshold: float = 0.7) -> DataFrame:
    """Rows whose vector is as close to a reference as the threshold, with their score."""
    return df.withColumn("score", texts.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in reference]))).where(F.col("score") >= threshold)


def with_vectors(df: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """df with vector, of a cache (text, vector) that has each text once; null where it has none. Each distinct text
    is looked up once, so that a text of many rows is no hot key of the cache."""
    wanted = df.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    found = wanted.join(cache.select(F.col("text").alias("_text"), "vector"), "_text")
    return df.join(found, df[text] == F.col("_text"), "left").drop("_text")


def missing_vectors(df: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """(text): the distinct texts that a cache lacks."""
    return df.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct().join(cache.select("text"), "text", "left_anti")
