"""Data addresses that a page tells of: feeds and JSON it declares, and the data route of its framework."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import dom, urls

# Media types of alternates and what they are.
TYPES = {"application/rss+xml": "feed", "application/atom+xml": "feed", "application/feed+json": "feed", "application/json": "json_alternate"}
TOLD = "array<struct<href: string, kind: string, title: string>>"


def next_data_url(url: Column, build: Column) -> Column:
    """Where a Next.js site serves the data of a page; null without a build."""
    leaf = F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(url, "^[^:]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", ""), F.lit("")), F.lit("index"))
    return F.when(build != "", F.concat(F.regexp_extract(url, "^([^:]+://[^/?#]*)", 1), F.lit("/_next/data/"), build, F.lit("/"), leaf, F.lit(".json")))


def _told(html: str | None) -> tuple[list[dict], str | None]:
    tree = dom.parse(html)
    out = []
    for n in dom.select(tree, 'link[rel="alternate"]'):
        href, kind = (n.attrs.get("href") or "").strip(), TYPES.get((n.attrs.get("type") or "").strip().lower())
        if href and kind:
            out.append({"href": href, "kind": kind, "title": (n.attrs.get("title") or "").strip() or None})
    state = dom.first(tree, "script#__NEXT_DATA__")
    return out, state.text() if state else None


def endpoints(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, endpoint, kind, confidence, title): declared alternates in page order, then the data route that follows
    from a build, each address once a page. Null and empty pages have none."""

    def run(batches):
        for batch in batches:
            found = [_told(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([x[0] for x in found], batch.schema.field("told").type), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != "html"])

    plain = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), F.lit(None).cast(TOLD).alias("told"), F.lit(None).cast("string").alias("state"))
    read = plain.mapInArrow(run, plain.drop("html").schema)
    declared = F.transform("told", lambda x: F.struct(urls.join(F.col("url"), x["href"]).alias("endpoint"), x["kind"].alias("kind"), F.lit("declared").alias("confidence"), x["title"].alias("title")))
    route = next_data_url(F.col("url"), F.get_json_object("state", "$.buildId"))
    derived = F.array(F.struct(route.alias("endpoint"), F.lit("next_data").alias("kind"), F.lit("derived").alias("confidence"), F.lit(None).cast("string").alias("title")))
    rows = read.select(F.col("key").alias(key), F.posexplode(F.concat(declared, derived)).alias("pos", "x")).select(key, "pos", "x.*").where("endpoint IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(key, "endpoint").orderBy("pos"))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
