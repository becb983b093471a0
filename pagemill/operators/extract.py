"""From pages to records: one parse of a page fills the columns asked for; the rest is DataFrame work."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.functions.batches import slices

# Fixed values.
SKIP_SCHEMES = r"^(?i)(#|mailto:|tel:|javascript:|data:|ftp:|file:)"
SKIP_FILES = r"(?i)\.(css|js|mjs|json|xml|png|jpe?g|gif|svg|webp|ico|bmp|woff2?|ttf|eot|otf|mp3|mp4|avi|mov|webm|zip|gz|rar|7z|pdf|exe|dmg)(\?|#|$)"
STATES = ["__NEXT_DATA__", "__NUXT_DATA__", "__APOLLO_STATE__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "ng-state"]
# Names of meta tags and the fields they fill.
META = dict(x.split("=") for x in """
og:title=title og:description=description og:url=canonical og:site_name=site_name og:type=kind og:image=image og:image:secure_url=image
og:video=video og:video:url=video og:video:secure_url=video og:video:type=video_type article:published_time=published_at article:author=author
twitter:title=title twitter:description=description twitter:image=image twitter:player=video description=description author=author
og:video:duration=duration_s video:duration=duration_s
""".split())  # fmt: skip

def _links(tree):
    out = [(n.attrs.get("href") or "").strip() for n in dom.select(tree, "a[href]")]
    return [x for x in dict.fromkeys(out) if x]


def _canonical(tree):
    n = dom.first(tree, 'link[rel="canonical"]')
    return (n.attrs.get("href") or "").strip() or None if n else None


def _title(tree):
    n = dom.first(tree, "title")
    return dom.clean(n.text()) if n else None


def _visible(tree):
    return dom.clean((dom.first(tree, "body") or tree).text(dom.SILENT))


def _meta(tree):
    """Fields of meta tags, the first value of each in the page; other og: and twitter: names as they are."""
    out = {}
    for n in dom.select(tree, "meta"):
        name, value = (n.attrs.get("property") or n.attrs.get("name") or "").strip().lower(), (n.attrs.get("content") or "").strip()
        field = META.get(name) or (name if name.startswith(("og:", "twitter:")) else None)
        if field == "duration_s":
            try:
                out[field] = str(int(float(value)))
            except (ValueError, OverflowError):
                continue
        elif field and value:
            out.setdefault(field, value)
    if "canonical" not in out and (link := _canonical(tree)):
        out["canonical"] = link
    return out


def _loads(raw: str):
    raw = re.sub(r"^\s*(<!--|/?/?\s*<!\[CDATA\[)|(-->|/?/?\s*\]\]>)\s*$", "", raw.strip())
    try:
        return json.loads(raw) if len(raw) <= 4_000_000 else None
    except ValueError:
        return None


def _flatten(value, depth=0):
    """Typed entities of JSON-LD, outer ones first."""
    if depth > 6:
        return
    if isinstance(value, list):
        for v in value:
            yield from _flatten(v, depth)
    elif isinstance(value, dict):
        if "@type" in value:
            yield value
        for k, v in value.items():
            if k == "@graph":
                yield from _flatten(v, depth)
            elif not k.startswith("@") and isinstance(v, (dict, list)):
                yield from _flatten(v, depth + 1)


def _jsonld(tree):
    found = [_loads(n.text()) for n in dom.select(tree, 'script[type="application/ld+json"]')]
    return [json.dumps(x, ensure_ascii=False, sort_keys=True) for v in found for x in _flatten(v)]


def _prop(n):
    if "content" in n.attrs:
        return n.attrs["content"]
    for tags, attr in (({"a", "area", "link"}, "href"), ({"audio", "embed", "iframe", "img", "source", "track", "video"}, "src"), ({"object"}, "data"), ({"time"}, "datetime"), ({"data", "meter"}, "value")):
        if n.tag in tags and n.attrs.get(attr):
            return n.attrs[attr]
    return "" if n.tag == "meta" else dom.clean(n.text()) or ""


def _item(scope, depth=0):
    out = {"@type": (scope.attrs.get("itemtype") or "").rstrip("/").rsplit("/", 1)[-1]}

    def visit(node, level):
        for c in node.children:
            if not isinstance(c, dom.Node) or level > 12:
                continue
            inner = "itemscope" in c.attrs
            if c.attrs.get("itemprop"):
                value = (_item(c, depth + 1) if depth < 5 else None) if inner else _prop(c)
                for name in c.attrs["itemprop"].split():
                    out[name] = value if name not in out else [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
            if not inner:
                visit(c, level + 1)

    visit(scope, 0)
    return out


def _microdata(tree):
    tops = [n for n in dom.select(tree, "[itemscope]") if "itemprop" not in n.attrs]
    return [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in map(_item, tops) if len(x) > 1]


def _embedded(tree):
    return {n.attrs["id"]: json.dumps(v, ensure_ascii=False) for n in dom.select(tree, "script[id]") if n.attrs["id"] in STATES and (v := _loads(n.text())) is not None}


def _tables(tree):
    """The first table with a header of two cells and two rows, as maps."""
    for t in dom.select(tree, "table"):
        rows = dom.select(t, "tr")
        head = next((r for r in rows if dom.first(r, "th")), None)
        names = [dom.clean(c.text()) or f"col_{i}" for i, c in enumerate(dom.select(head, "th, td"))] if head else []
        body = [[dom.clean(c.text()) or "" for c in dom.select(r, "td")] for r in rows if r is not head]
        body = [b for b in body if b]
        if len(names) >= 2 and len(body) >= 2:
            return [dict(zip(names, b)) for b in body]
    return []


PARTS = {
    "links": (_links, "array<string>"), "canonical": (_canonical, "string"), "title": (_title, "string"), "visible_text": (_visible, "string"), "meta": (_meta, "map<string,string>"),
    "jsonld": (_jsonld, "array<string>"), "microdata": (_microdata, "array<string>"), "embedded": (_embedded, "map<string,string>"), "table": (_tables, "array<map<string,string>>"),
}


def extract(pages: DataFrame, parts: list[str], html: str = "html") -> DataFrame:
    """Adds the parts of each page that are asked for as columns, from one parse. The page itself is dropped, so
    that it is not carried on. Null pages give empty parts."""

    def run(batches):
        for batch in slices(batches, html):
            found, cols = [[PARTS[p][0](t) for p in parts] for t in dom.trees(x.as_py() for x in batch.column(html))], {}
            for i, p in enumerate(parts):
                kind = batch.schema.field(p).type
                cols[p] = pa.array([list(map(_pairs, x[i])) if pa.types.is_list(kind) and pa.types.is_map(kind.value_type) else _pairs(x[i]) if pa.types.is_map(kind) else x[i] for x in found], kind)
            names = [n for n in batch.schema.names if n != html]
            yield pa.RecordBatch.from_arrays([cols[n] if n in cols else batch.column(n) for n in names], names=names)

    plain = pages.withColumns({p: F.lit(None).cast(PARTS[p][1]) for p in parts})
    return plain.mapInArrow(run, plain.drop(html).schema)


def _pairs(x):
    return list(x.items()) if isinstance(x, dict) else x


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, href) of the links that can lead to pages: distinct by page, in order of appearance."""
    df = extract(pages.select(key, "html"), ["links"])
    df = df.select(key, F.posexplode("links").alias("pos", "href"))
    return df.where((F.col("href") != "") & ~F.col("href").rlike(SKIP_SCHEMES) & ~F.col("href").rlike(SKIP_FILES))
