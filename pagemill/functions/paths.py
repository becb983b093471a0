"""Dotted paths into JSON, and paging styles of JSON answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .texts import bound


def json_path(data: Column, path: str) -> Column:
    """The value at a dotted path as text: digits index lists, a list of one and @value are unwrapped, a
    longer list without an index gives null."""
    steps = [f"[{part}]" if part.isdigit() else f"['{part}']" for part in path.split(".")]
    at = lambda p: F.call_function("get_json_object", data, p)

    def walk(p: Column, step: Column) -> Column:  # a list of one gives way to its value before a name
        return F.concat(p, F.when(step.startswith("['") & (F.json_array_length(at(p)) == 1), "[0]").otherwise(""), step)

    def plain(value: Column) -> Column:
        inner = F.get_json_object(value, "$['@value']")
        return F.when(value.startswith("{") & inner.isNotNull(), inner).otherwise(value)

    def one(value: Column) -> Column:
        return F.when(value.startswith("["), F.when(F.json_array_length(value) == 1, F.get_json_object(value, "$[0]"))).otherwise(value)

    return bound(bound(at(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit("$"), walk)), one), plain)


def pagination(data: Column, link: Column | None = None, base: Column | None = None) -> Column:
    """(style, next, total) of a JSON answer: the next URL of a Link header, else one in the answer, a cursor, a page
    number, an offset, or none. URLs are taken against ``base``."""
    kind = "map<string,string>"

    def inside(top: Column) -> Column:
        """The plain values of an answer, then those of each part of it that may tell of pages."""
        plain = F.map_filter(top, lambda _, v: ~v.rlike(r"^\s*[\[{]"))
        return F.filter(F.array(plain, *[F.from_json(F.try_element_at(top, F.lit(p)), kind) for p in PARTS], top), lambda m: m.isNotNull())

    return bound(bound(F.from_json(data, kind), inside), lambda maps: _paged(maps, link, base))


# Parts of an answer that tell of pages, and the names they use.
PARTS = ["pagination", "meta", "paging", "page_info", "pageInfo", "links"]
NEXT = ["next", "next_url", "nextUrl", "next_page_url", "nextPageUrl"]
CURSOR = ["next_cursor", "nextCursor", "cursor", "endCursor", "end_cursor", "after", "next_token", "nextToken"]
PAGE, OFFSET = ["page", "current_page", "currentPage", "pageNumber"], ["offset", "skip", "start"]
SIZE, TOTAL = ["limit", "size", "per_page", "perPage", "page_size", "pageSize", "count"], ["total", "total_count", "totalCount", "total_results", "totalResults"]


def _paged(maps: Column, link: Column | None, base: Column | None) -> Column:
    def first(names: list[str]) -> Column:
        one = lambda n: F.try_element_at(F.filter(F.transform(maps, lambda m: F.try_element_at(m, F.lit(n))), lambda v: v.isNotNull()), F.lit(1))
        return F.coalesce(*[one(n) for n in names])

    url = first(NEXT)
    url = F.when(url.startswith("{"), F.coalesce(F.get_json_object(url, "$.href"), F.get_json_object(url, "$.url"))).otherwise(url)
    url = F.when(url.rlike("^(https?://|/|\\?)"), url)
    cursor, number, offset, size, total = first(CURSOR), *[first(n).try_cast("long") for n in (PAGE, OFFSET, SIZE, TOTAL)]
    if base is not None:
        url = urls.join(base, url)
    style = F.when(url.isNotNull(), "next_url").when(cursor.isNotNull(), "cursor").when(number.isNotNull(), "page").when(offset.isNotNull() & size.isNotNull(), "offset").otherwise("none")
    following = F.when(url.isNotNull(), url).when(cursor.isNotNull(), cursor).when(number.isNotNull(), (number + 1).cast("string")).when(offset.isNotNull() & size.isNotNull(), (offset + size).cast("string"))
    if link is None:
        return F.struct(style.alias("style"), following.alias("next"), total.alias("total"))
    ahead = F.nullif(F.trim(F.regexp_extract(link, r"(?i)<([^>]*)>\s*;[^,]*rel=[\"']?next[\"']?", 1)), F.lit(""))
    ahead = urls.join(base, ahead) if base is not None else ahead
    told = lambda first, then: F.when(ahead.isNotNull(), first).otherwise(then)
    return F.struct(told(F.lit("link_header"), style).alias("style"), told(ahead, following).alias("next"), told(F.lit(None).cast("long"), total).alias("total"))


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """A URL with one query parameter replaced: removed, then added last."""
    base, query = F.substring_index(url, "?", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    rest = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(rest, F.array(F.concat(F.lit(name + "="), F.url_encode(value)))), "&"))
