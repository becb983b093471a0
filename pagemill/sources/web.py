"""Sources of the web: robots.txt, sitemaps, feeds, encoded bodies, an archive by digest."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib
from datetime import UTC
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pagemill.functions import urls

# Fixed values.
CANDIDATES = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml"]
ALIASES = {"euc-kr": "cp949", "ks_c_5601-1987": "cp949", "iso-8859-1": "cp1252", "latin-1": "cp1252", "gb2312": "gb18030", "shift_jis": "cp932", "ascii": "utf-8", "us-ascii": "utf-8"}


def robots_sitemaps(robots: DataFrame, key: str, text: str, url: str) -> DataFrame:
    """(key, pos, sitemap): the Sitemap lines of robots.txt, distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    rows = robots.select(key, url, F.posexplode(found).alias("pos", "raw"))
    rows = rows.withColumn("sitemap", urls.normalize(F.col("raw"), F.col(url))["url"]).where(F.col("sitemap").isNotNull())
    return rows.groupBy(key, "sitemap").agg(F.min("pos").alias("pos")).select(key, "pos", "sitemap")


def sitemap_candidates(base: Column) -> Column:
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1)
    return F.array(*[F.concat(root, F.lit(p)) for p in CANDIDATES])


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


MOST_BYTES = 64 << 20  # of a document after it is unpacked


def unpacked(body: bytes, most: int = MOST_BYTES) -> bytes:
    """A gzipped body unpacked, any other as it is; an error beyond ``most`` bytes, before they are made."""
    if body[:2] != b"\x1f\x8b":
        return body
    reader = zlib.decompressobj(31)
    out = reader.decompress(body, most)
    if reader.unconsumed_tail:
        raise ValueError(f"more than {most} bytes unpacked")
    return out


def _root(body: bytes):
    body = unpacked(body)
    if re.search(rb"<!(DOCTYPE|ENTITY)", body[:4096], re.I):
        raise ValueError("declares entities")
    return ET.fromstring(body)


SITEMAP = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("loc", T.StringType()), T.StructField("lastmod", T.StringType()), T.StructField("priority", T.StringType()), T.StructField("error", T.StringType())]))


def _told(kind: T.ArrayType, rows: list[tuple]) -> list[dict]:
    return [dict(zip(kind.elementType.names, r)) for r in rows]


def _sitemap(body: bytes | None) -> list[tuple]:
    out: list[tuple] = []
    try:
        for e in _root(body or b"").iter():
            if _local(e) in ("url", "sitemap") and len(out) < 50_000:
                have = {_local(c): (c.text or "").strip() for c in e}
                if have.get("loc"):
                    out.append((_local(e), have["loc"], have.get("lastmod"), have.get("priority"), None))
        return out
    except Exception as e:  # a bad document is a row, not a failed job
        return [(None, None, None, None, str(e)[:200])]


@F.arrow_udf(SITEMAP)
def read_sitemap(body: pa.Array) -> pa.Array:
    """Entries of a sitemap or an index, plain or gzipped; what cannot be read is one row with an error."""
    return pa.array([_told(SITEMAP, _sitemap(x)) for x in body.to_pylist()], to_arrow_type(SITEMAP))


def sitemap_time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy")])


def sitemap_priority(text: Column) -> Column:
    """From 0 to 1; null if it is no number."""
    number = text.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def sitemap_entries(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, kind, loc, lastmod, priority, error) with typed times and priorities from 0 to 1."""
    out = df.select(key, F.explode(read_sitemap(F.col(body))).alias("e")).select(key, "e.*")
    return out.withColumn("lastmod", sitemap_time(F.col("lastmod"))).withColumn("priority", sitemap_priority(F.col("priority")))


def sitemap_roots(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, pos, url): where to look for the sitemaps of each of sites (site, url): at the addresses that its
    robots.txt, in robots (site, url, text), names, else at the usual ones."""
    named = robots_sitemaps(robots.select("site", "url", "text"), "site", "text", "url").select("site", "pos", F.col("sitemap").alias("url"))
    usual = sites.join(named.select("site"), "site", "left_anti").select("site", F.posexplode(sitemap_candidates(F.col("url"))).alias("pos", "url"))
    return named.unionByName(usual)


def walk_sitemaps(documents: DataFrame, roots: DataFrame, keep_table, max_depth: int = 3, max_documents: int = 50, max_entries: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """All addresses that the sitemaps of each site list, indexes followed round by round.

    documents has url and body; roots has site, pos and url. Returns (entries, errors): entries has site,
    place, pos, loc, lastmod and priority, place being the document's turn; errors has site, url and error. A
    site's documents are read breadth first, each once, up to max_documents counting robots.txt and those
    that documents lacks; the first max_entries entries of a site stay. Indexes below max_depth are not followed.
    ``keep_table`` writes a round's rows."""
    bodies = documents.select(urls.normalize(F.col("url"))["url"].alias("url"), "body").where("url IS NOT NULL").dropDuplicates(["url"])
    todo = roots.select("site", F.lit(0).cast("long").alias("up"), F.col("pos").cast("long").alias("pos"), urls.normalize(F.col("url"))["url"].alias("url")).where("url IS NOT NULL")
    seen = read = None
    for depth in range(max_depth + 1):
        new = todo.groupBy("site", "url").agg(F.min(F.struct("up", "pos")).alias("at"))
        if seen is not None:
            new = new.join(seen.select("site", "url"), ["site", "url"], "left_anti").join(seen.groupBy("site").agg(F.max("place").alias("before")), "site")
        else:
            new = new.withColumn("before", F.lit(0).cast("long"))
        new = new.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("at", "url"))).where(F.col("nth") < max_documents)
        front = keep_table(new.select("site", "url", (F.col("before") + F.col("nth")).alias("place")).where(F.col("place") < max_documents))
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
        rows = front.join(bodies, "url").select("site", "url", "place", F.posexplode(read_sitemap(F.col("body"))).alias("pos", "e"))
        rows = rows.withColumn("loc", urls.normalize(F.col("e.loc"), F.col("url"))["url"])
        rows = keep_table(rows.select("site", "url", "place", F.col("pos").cast("long").alias("pos"), "e.kind", "loc", "e.lastmod", "e.priority", "e.error"))
        read = rows if read is None else read.unionByName(rows)
        todo = rows.where("kind = 'sitemap' AND loc IS NOT NULL").select("site", F.col("place").alias("up"), "pos", F.col("loc").alias("url"))
    if read is None:
        read = seen_nothing(front)
    listed = read.where("kind = 'url' AND loc IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("place", "pos")))
    entries = listed.where(F.col("nth") <= max_entries).select("site", "place", "pos", "loc", sitemap_time(F.col("lastmod")).alias("lastmod"), sitemap_priority(F.col("priority")).alias("priority"))
    return entries, read.where("error IS NOT NULL").select("site", "url", "error")


def seen_nothing(front: DataFrame) -> DataFrame:
    """The rows of no document."""
    told = [F.lit(None).cast("string").alias(c) for c in ("kind", "loc", "lastmod", "priority", "error")]
    return front.where("false").select("site", "url", "place", F.lit(None).cast("long").alias("pos"), *told)


FEED = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "published_at", "summary", "author", "error")]))


def _feed(body: bytes | None, base: str | None) -> list[tuple]:
    try:
        root = _root(body or b"")
    except ET.ParseError:
        return []
    except Exception as e:
        return [(None, None, None, None, None, str(e)[:200])]
    out = []
    for e in root.iter():
        if _local(e) not in ("item", "entry"):
            continue
        have, link = {}, None
        for c in e:
            name, text = _local(c), (c.text or "").strip()
            if name == "link":
                if c.get("href") and c.get("rel", "alternate") == "alternate":
                    link = link or c.get("href")
                elif text:
                    link = link or text
            elif name == "author":
                inner = next((x.text for x in c if _local(x) == "name" and x.text), None)
                have["author"] = (inner or text).strip() or have.get("author")
            elif text:
                have.setdefault(name, text)
        link = link or have.get("guid") or have.get("id")
        when = have.get("published") or have.get("pubdate") or have.get("updated") or have.get("date")
        if when:
            try:
                d = parsedate_to_datetime(when)
                when = (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
            except (ValueError, TypeError):
                pass
        out.append((have.get("title"), urljoin(base or "", link) if link else None, when, have.get("description") or have.get("summary") or have.get("content"), have.get("author") or have.get("creator"), None))
    return out


@F.arrow_udf(FEED)
def read_feed(body: pa.Array, base: pa.Array) -> pa.Array:
    """Entries of RSS or Atom; a document with entities is refused, a malformed one is empty."""
    return pa.array([_told(FEED, _feed(x, y)) for x, y in zip(body.to_pylist(), base.to_pylist())], to_arrow_type(FEED))


DECODED = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "encoding", "declared")])


def _decoded(body: bytes | None, content_type: str | None) -> tuple:
    raw = body or b""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), name, name
    told = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    meta = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", raw[:4096], re.I)
    for name in (told and told[1], meta and meta[1].decode("ascii")):
        if name:
            real = ALIASES.get(name.lower(), name.lower())
            try:
                return raw.decode(real), real, real
            except (LookupError, UnicodeDecodeError):
                continue
    for name in ("utf-8", "cp949"):
        try:
            return raw.decode(name), name, None
        except UnicodeDecodeError:
            continue
    return raw.decode("cp1252", "replace"), "cp1252", None


@F.arrow_udf(DECODED)
def decode_html(body: pa.Array, content_type: pa.Array) -> pa.Array:
    """Text of a body: by its byte-order mark, its header, its meta tag, else UTF-8, Korean, Western; a
    declaration that does not decode is passed over. Without a declaration declared is null: the encoding is a guess."""
    rows = [_decoded(x, y) for x, y in zip(body.to_pylist(), content_type.to_pylist())]
    return pa.array([dict(zip(DECODED.names, r)) for r in rows], to_arrow_type(DECODED))


def archive(bodies: DataFrame, path: str, body: str = "body") -> None:
    """Appends bodies that the archive lacks, by their SHA-256, as zstd Parquet dealt by the digest's first byte."""
    spark = bodies.sparkSession
    new = bodies.select(F.sha2(body, 256).alias("digest"), F.col(body).alias("body")).dropDuplicates(["digest"])
    try:
        new = new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.withColumn("shard", F.substring("digest", 1, 2)).write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(path)


def archived(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """(digest, body) of digests in the archive; the shard column prunes what is read."""
    wanted = digests.select("digest", F.substring("digest", 1, 2).alias("shard"))
    return spark.read.parquet(path).join(wanted, ["shard", "digest"]).select("digest", "body")


def archive_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("blobs"), F.sum(F.octet_length("body")).alias("bytes"))


MOST_COLUMNS = 2000


def export_columns(records: DataFrame, data: str) -> DataFrame:
    """Distinct keys of JSON records, sorted."""
    return records.select(F.explode(F.json_object_keys(data)).alias("key")).distinct().orderBy("key")


def first_seen_columns(records: DataFrame, data: str, seq: str) -> DataFrame:
    """Distinct keys of JSON records in order of the first record that has each, then of their place in it."""
    each = records.select(F.col(seq).alias("seq"), F.posexplode(F.json_object_keys(data)).alias("pos", "key"))
    return each.groupBy("key").agg(F.min(F.struct("seq", "pos")).alias("at")).orderBy("at").select("key")


def column_names(columns: DataFrame, most: int) -> list[str]:
    names = [r.key for r in columns.limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    return names


def _with_source(data: str, source: dict[str, str]) -> Column:
    """A JSON object with more fields, those behind its own."""
    more = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in source.items()]), {"ignoreNullFields": "false"})
    bare = F.regexp_replace(F.col(data), r"\}\s*$", "")
    return F.concat(bare, F.when(F.size(F.json_object_keys(data)) > 0, ", ").otherwise(""), F.substring(more, 2, 1 << 30))


SOURCE = {"_page_url": "page_url", "_extractor": "extractor"}


def jsonl_lines(records: DataFrame, data: str, seq: str, include_source: bool = False) -> DataFrame:
    """(seq, value): one JSON object a record, with the page and the extractor it came from behind its own fields if asked."""
    return records.select(F.col(seq).alias("seq"), (_with_source(data, SOURCE) if include_source else F.col(data)).alias("value"))


def export_jsonl(records: DataFrame, data: str, seq: str, path: str, include_source: bool = False) -> None:
    """One JSON object a line; files and their lines are in order of seq."""
    jsonl_lines(records, data, seq, include_source).repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(path)


def csv_cells(records: DataFrame, data: str, keep: list[str], include_source: bool = False, order: str | None = None, most: int = MOST_COLUMNS) -> DataFrame:
    """JSON records flattened to the union of their keys, sorted, or by first appearance in ``order``; null is empty, nested
    values are JSON. More than ``most`` keys are an error: no table has so many columns."""
    keys = column_names(first_seen_columns(records, data, order) if order else export_columns(records, data), most)
    cell = lambda k: F.coalesce(F.get_json_object(data, "$['" + k.replace("'", "\\'") + "']"), F.lit(""))
    source = [F.col(c).alias(k) for k, c in SOURCE.items()] if include_source else []
    return records.select(*keep, *[cell(k).alias(k) for k in keys], *source)


def _write_csv(flat: DataFrame, seq: str, path: str, mark: str = "") -> None:
    columns = [c for c in flat.columns if c != "_seq"]
    if mark:  # in front of the first name of each file's header
        flat, columns = flat.withColumnRenamed(columns[0], mark + columns[0]), [mark + columns[0], *columns[1:]]
    flat.repartitionByRange("_seq").sortWithinPartitions("_seq").select(*[F.col(f"`{c}`") for c in columns]).write.option("header", True).option("emptyValue", "").csv(path)


def export_csv(records: DataFrame, data: str, seq: str, path: str, include_source: bool = False) -> None:
    """Sorted union of keys; files and their lines are in order of seq."""
    _write_csv(csv_cells(records, data, [F.col(seq).alias("_seq")], include_source), seq, path)


def quick_csv(records: DataFrame, data: str, seq: str, path: str) -> None:
    """Columns by first appearance; a byte-order mark leads each file, so that spreadsheets read it as UTF-8."""
    _write_csv(csv_cells(records, data, [F.col(seq).alias("_seq")], order=seq), seq, path, mark="\ufeff")
