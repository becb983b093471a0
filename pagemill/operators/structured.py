"""Entities that pages declare in JSON-LD and microdata, as rows: their types, and where their values are."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pagemill.operators import extract

# Names of page furniture in a path; keys that say what an entity is and not what it has.
CHROME = re.compile(r"(?:^|[.\[])(?:nav|navigation|menu|footer|header|breadcrumb|sidebar|locale|language)s?(?:[.\[]|$)", re.I)
KINDS = {"@context", "@type"}
LEAVES, LEAF_DEPTH, ARRAYS, ARRAY_DEPTH = 15, 2, 200, 6


def entities(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, source, pos, entity): the JSON-LD entities of each page, then its microdata; entity is JSON."""
    read = extract.extract(pages.select(key, "html"), ["jsonld", "microdata"])
    # both from one parse; a union would parse each page for either
    both = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("found")) for c in ("jsonld", "microdata")])
    return read.select(key, F.explode(both).alias("x")).select(key, "x.source", F.posexplode("x.found").alias("pos", "entity"))


def types(entity: Column) -> Column:
    """The types of an entity: of a list those that are texts."""
    kind = F.get_json_object(entity, "$['@type']")
    return F.when(kind.startswith("["), F.filter(F.from_json(kind, "array<string>"), lambda t: t.isNotNull())).when(kind.isNull(), F.array().cast("array<string>")).otherwise(F.array(kind))


def find_types(found: DataFrame, *wanted: str) -> DataFrame:
    """Rows of entities of any of these types, in any case."""
    low = [w.lower() for w in wanted]
    return found.where(F.exists(types(F.col("entity")), lambda t: F.lower(t).isin(low)))


def has_type(entity: Column, wanted: str) -> Column:
    """Whether one of an entity's types is, after its last slash, the wanted one."""
    return F.exists(types(entity), lambda t: F.lower(F.substring_index(t, "/", -1)) == wanted.lower())


def types_present(found: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, type): the types of each page, each once, in order of appearance."""
    each = found.select(key, "source", "pos", F.posexplode(types(F.col("entity"))).alias("i", "type"))
    first = each.groupBy(key, "type").agg(F.min(F.struct("source", "pos", "i")).alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at", "type")) - 1
    return first.select(key, place.alias("place"), "type")


def is_video_page(meta: Column) -> Column:
    return (F.coalesce(meta["video"], F.lit("")) != "") | F.coalesce(meta["kind"], F.lit("")).startswith("video")


def _leaves(node, prefix: str = "", depth: int = 0) -> Iterator[tuple[str, str]]:
    if not isinstance(node, dict) or depth > LEAF_DEPTH:
        return
    told = 0
    for k, v in node.items():
        if k in KINDS:
            continue
        below = []
        if isinstance(v, (str, int, float)):
            below = [(prefix + k, str(v)[:44])]
        elif isinstance(v, dict):
            below = list(_leaves(v, f"{prefix}{k}.", depth + 1))
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            below = [(f"{prefix}{k}[]", f"({len(v)} items)")]
        yield from below
        told += len(below)
        if told >= LEAVES:
            return


def _arrays(node) -> list[dict]:
    out, todo = [], [("", node, 0)]
    while todo and len(out) <= ARRAYS:
        at, value, depth = todo.pop()
        if isinstance(value, list):
            some = [x for x in value[:5] if isinstance(x, dict)]
            width = sum(map(len, some)) / len(some)
            out.append({"path": at, "items": len(value), "keys": list(some[0])[:5], "score": width * width * len(value) / (8 if CHROME.search(at) else 1)})
        elif depth <= ARRAY_DEPTH:
            below = [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
            keep = [(p, v, depth + 1) for p, v in below if isinstance(v, dict) or (isinstance(v, list) and len(v) >= 2 and isinstance(v[0], dict))]
            todo += reversed(keep)
    return out


def _read(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


_rows = lambda *fields: T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))
LEAF = _rows(("path", T.StringType()), ("sample", T.StringType()))
ARRAY = _rows(("path", T.StringType()), ("items", T.LongType()), ("keys", T.ArrayType(T.StringType())), ("score", T.DoubleType()))


@F.arrow_udf(LEAF)
def _leaf_udf(col: pa.Array) -> pa.Array:
    return pa.array([[{"path": p, "sample": s} for p, s in _leaves(_read(x))] for x in col.to_pylist()], to_arrow_type(LEAF))


@F.arrow_udf(ARRAY)
def _array_udf(col: pa.Array) -> pa.Array:
    return pa.array([_arrays(v) if isinstance(v := _read(x), dict) else [] for x in col.to_pylist()], to_arrow_type(ARRAY))


def leaf_paths(df: DataFrame, key: list[str], data: str) -> DataFrame:
    """(key ..., pos, path, sample): dotted paths to the plain values of JSON objects, for recipes to copy, down to
    two levels below the top; about LEAVES of each object."""
    return df.select(*key, F.posexplode(_leaf_udf(F.col(data))).alias("pos", "x")).select(*key, "pos", "x.*")


def array_paths(df: DataFrame, key: list[str], data: str, most: int = 6) -> DataFrame:
    """(key ..., place, path, items, keys, score): the lists of objects in JSON, those that say most of each item
    first: by the mean number of keys, squared, times the length; an eighth of it below names of page furniture."""
    rows = df.select(*key, F.posexplode(_array_udf(F.col(data))).alias("pos", "x")).select(*key, "pos", "x.*")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "pos"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(*key, "place", "path", "items", "keys", "score")
