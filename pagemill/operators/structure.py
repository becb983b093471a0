"""What repeats on pages: groups of like siblings, the columns they share, and a page's fingerprint.

A parse gives one row for each element; the rest is grouping, joining and ranking of those rows, so a page of a
million elements is spread like a million pages of one."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import dom, texts
from pagemill.functions.batches import slices

MIN_GROUP, MAX_DEPTH, MIN_FILL, TOP, MIN_SCORE = 3, 4, 0.5, 5, 1.0
# Elements that hold no records, and those around them that are no content.
SKIPPED = set("script style noscript template svg path br hr meta link".split())
CHROME = set("nav header footer aside".split())
# Classes that number or style an element and do not say what it is.
STATE = "active selected current open first last odd even hover"
LAYOUT = "col grid flex clearfix rounded shadow block inline hidden absolute relative fixed sticky truncate antialiased italic underline group peer uppercase lowercase capitalize visible invisible isolate contents"
SCALES = "d p m w h z gap mt mb ml mr pt pb pl pr px py mx my inset top left right bottom order basis grow shrink"
STYLED = (
    "row container wrapper text bg border align justify items self content place space divide overflow object aspect select pointer cursor transition duration ease delay animate transform"
    " translate scale rotate skew origin opacity blur backdrop filter ring outline font leading tracking whitespace break list decoration indent table columns min max size fill stroke from"
    " via to scroll snap touch will accent caret appearance resize"
)
_either = lambda words: "|".join(words.split())
NO_NAME = re.compile(
    rf"(?:[a-z]+(?:[-_][a-z]+)*[-_])?\d+|[0-9a-f]{{6,}}|(?:is|has|js)[-_].*|{_either(STATE)}|(?:css-|sc-)\w+|.*[:\[\]].*"
    rf"|-*(?:(?:{_either(LAYOUT)})(?:[-_].*)?|(?:{_either(SCALES)}|{_either(STYLED)})[-_].+)",
    re.I,
)

NODES = "array<struct<node: int, parent: int, last: int, depth: int, sig: string, sel: string, chrome: boolean, text: string, href: string, src: string>>"


def naming_classes(node: dom.Node) -> list[str]:
    """The classes that say what an element is, sorted."""
    return sorted(c for c in node.classes() if not NO_NAME.fullmatch(c))


def naming(classes: Column) -> Column:
    """The same of a column of class lists."""
    named = lambda flags: lambda c: ~c.rlike(f"(?{flags})^(?:{NO_NAME.pattern})$")
    # letters beyond ASCII take other tables, which cost four times as much
    return F.array_sort(F.filter(classes, lambda c: F.when(F.length(c) == F.octet_length(c), named("i")(c)).otherwise(named("iU")(c))))


def _rows(tree: dom.Node) -> list[dict]:
    """The elements of a body in document order; ``last`` is the last element below."""
    top = dom.first(tree, "body") or tree
    out: list[dict] = []
    todo: list = [(top, -1, 0, False)]
    while todo:
        item = todo.pop()
        if isinstance(item, int):  # all below that row are in
            out[item]["last"] = len(out) - 1
            continue
        n, parent, depth, chrome = item
        own, tag = naming_classes(n), n.tag
        me = len(out)
        out.append({
            "node": me, "parent": parent, "depth": depth, "sig": ".".join([tag, *own]), "sel": ".".join([tag, *own[:3]]), "chrome": chrome, "text": dom.clean(" ".join(n.pieces())),
            "href": n.attrs.get("href") or None, "src": n.attrs.get("data-src") or n.attrs.get("src") or None,
        })
        todo.append(me)
        todo += [(c, me, depth + 1, chrome or tag in CHROME) for c in reversed(n.children) if isinstance(c, dom.Node) and c.tag not in SKIPPED]
    return out


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, node, parent, last, depth, sig, sel, chrome, text, href, src): a row for each element of each body."""

    def run(batches):
        for batch in slices(batches, 1):
            found = pa.array([_rows(t) for t in dom.trees(x.as_py() for x in batch.column(1))], batch.schema.field("found").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "found"])

    plain = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), F.lit(None).cast(NODES).alias("found"))
    return plain.mapInArrow(run, plain.drop("html").schema).select(F.col("key").alias(key), F.explode("found").alias("x")).select(key, "x.*")


def groups(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, parent, sig, count): siblings of one signature, at least MIN_GROUP of them."""
    return nodes.groupBy(key, "parent", "sig").agg(F.count(F.lit(1)).alias("count")).where((F.col("count") >= MIN_GROUP) & (F.col("parent") >= 0))


def columns(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, parent, sig, path, kind, fill_rate, samples, ...): what the members of each group have in common.

    A path spells the selectors from a member down, up to MAX_DEPTH; its value in a member is that of the
    first element there. Paths and values that fewer than MIN_FILL of the members have are left out, and
    of columns of equal values the shallowest stays."""
    many = groups(nodes, key)
    members = nodes.join(many, [key, "parent", "sig"]).select(key, "parent", "sig", "count", F.col("node").alias("member"))
    here = members.select(key, "parent", "sig", "count", "member", F.col("member").alias("at"), F.lit("").alias("path"), F.lit(0).alias("level"))
    below = nodes.select(key, F.col("node").alias("_node"), F.col("parent").alias("at"), "sel", "text", "href", "src")
    found = None
    for level in range(1, MAX_DEPTH + 1):
        step = F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(" > "))), F.col("sel"))
        here = here.join(below, [key, "at"]).select(key, "parent", "sig", "count", "member", F.col("_node").alias("at"), step.alias("path"), F.lit(level).alias("level"), "text", "href", "src")
        found = here if found is None else found.unionByName(here)
        here = here.drop("text", "href", "src")
    first = found.groupBy(key, "parent", "sig", "count", "path", "level", "member").agg(F.min(F.struct("at", "text", "href", "src")).alias("v"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"v.{k}").alias("value")) for k in ("text", "href", "src")])
    values = first.select(key, "parent", "sig", "count", "path", "level", "member", F.explode(kinds).alias("x")).select("*", "x.*").drop("x").where("value IS NOT NULL")
    hashed = F.sum(F.xxhash64("member", "value").cast("decimal(38,0)"))
    # three samples come from the members of least place, not from a list of all
    nth = F.row_number().over(Window.partitionBy(key, "parent", "sig", "path", "kind").orderBy("member"))
    shown = F.sort_array(F.collect_list(F.when(F.col("nth") <= 3, F.struct("nth", F.substring("value", 1, 120).alias("value")))))
    cols = values.withColumn("nth", nth).groupBy(key, "parent", "sig", "count", "path", "level", "kind").agg(F.count(F.lit(1)).alias("filled"), hashed.alias("same"), shown.alias("shown"), F.min("member").alias("first_member"))
    cols = cols.where(F.col("filled") >= F.col("count") * MIN_FILL)
    alike = F.row_number().over(Window.partitionBy(key, "parent", "sig", "kind", "same").orderBy("level", "path"))
    cols = cols.withColumn("alike", alike).where(F.col("alike") == 1)
    cols = cols.select(key, "parent", "sig", "count", "path", "level", "kind", F.round(F.col("filled") / F.col("count"), 3).alias("fill_rate"), F.transform("shown", lambda s: s["value"]).alias("samples"))
    return cols.join(_wrappers(values, cols, key), [key, "parent", "sig", "path", "kind"], "left_anti")


def _wrappers(values: DataFrame, cols: DataFrame, key: str) -> DataFrame:
    """Text columns whose every value holds that of some deeper text column, and more: whole cards in one value."""
    group = [key, "parent", "sig"]
    text = values.where("kind = 'text'").join(cols.where("kind = 'text'").select(*group, "path"), [*group, "path"]).select(*group, "path", "level", "member", "value")
    deep = text.select(*group, "member", F.col("path").alias("path2"), F.col("level").alias("level2"), F.col("value").alias("value2"))
    met = text.join(deep, [*group, "member"]).where(F.col("level2") > F.col("level"))
    holds = F.col("value").contains(F.col("value2")) & (F.col("value") != F.col("value2"))
    return met.groupBy(*group, "path", "path2").agg(F.bool_and(holds).alias("all")).where("all").select(*group, "path", F.lit("text").alias("kind")).distinct()


def containers(pages: DataFrame, keep_table, key: str = "page_id", html: str = "html", limit: int = TOP) -> DataFrame:
    """The repeated containers of each page, best first.

    (key, place, selector, parent_selector, count, depth, text_density, score, columns). The score grows with
    the number of members, how filled and how many their columns are, and the words of a member; a group
    inside navigation counts a quarter. Of groups with equal counts on a page, from the best score down, one goes that shares over
    0.6 of the samples of the smaller with the last one kept. Ties go by place in the page. Pages without
    repeats, null and empty ones give no rows. ``keep_table`` writes the elements, which are read several times."""
    nodes = keep_table(elements(pages, key, html))
    group = [key, "parent", "sig"]
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    members = nodes.join(groups(nodes, key).drop("count"), group).groupBy(*group).agg(
        F.avg(F.when(F.col("text").isNull(), 0).otherwise(words)).alias("density"), F.min("node").alias("first"), F.min("depth").alias("depth"), F.bool_or("chrome").alias("chrome"), F.min_by("sel", "node").alias("selector"),
    )
    cols = columns(nodes, key)
    packed = F.sort_array(F.collect_list(F.struct("level", "path", "kind", "fill_rate", "samples")))
    # as many columns as a page's markup has paths, whatever the number of members
    each = cols.groupBy(*group).agg(F.first("count").alias("count"), F.avg("fill_rate").alias("fill"), F.countDistinct("path").alias("variety"), packed.alias("columns"))
    score = F.col("count") * F.col("fill") * (F.col("variety") * 0.15 + 1) * (F.least(F.col("density") / 8, F.lit(1.5)) + 0.2) * F.when(F.col("chrome"), 0.25).otherwise(1.0)
    found = each.join(members, group).withColumn("score", F.round(score, 2)).where(F.col("score") >= MIN_SCORE)
    parents = nodes.select(key, F.col("node").alias("parent"), F.col("sel").alias("parent_selector"))
    found = found.join(parents, [key, "parent"])
    found = found.withColumn("seen", F.array_distinct(F.flatten(F.col("columns.samples"))))
    kept = found.join(_unlike(found, key), group, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "first")))
    return kept.where(F.col("place") <= limit).select(key, "place", "selector", "parent_selector", "count", "depth", F.round("density", 1).alias("text_density"), "score", "columns")


SAME_ROWS = 0.6  # of the samples of the smaller group


def _unlike(found: DataFrame, key: str) -> DataFrame:
    """(key, parent, sig) of the groups that stay, of groups with seen, their samples. Each is held against the last one kept of its
    count, so the order decides: a fold over the groups of one page and count, best first."""
    here = F.struct((-F.col("score")).alias("s"), F.col("first"), F.col("parent"), F.col("sig"), F.col("seen"))
    lined = found.groupBy(key, "count").agg(F.sort_array(F.collect_list(here)).alias("line"))
    ident = "struct<parent: int, sig: string>"
    start = F.struct(F.array().cast("array<string>").alias("last"), F.array().cast(f"array<{ident}>").alias("kept"))

    def step(done: Column, g: Column) -> Column:
        share = F.size(F.array_intersect(done["last"], g["seen"])) / F.least(F.size(done["last"]), F.size(g["seen"]))
        like = (F.size(done["last"]) > 0) & (F.size(g["seen"]) > 0) & (share > SAME_ROWS)
        own = F.array(F.struct(g["parent"].cast("int").alias("parent"), g["sig"].alias("sig")))
        return F.when(like, done).otherwise(F.struct(g["seen"].alias("last"), F.concat(done["kept"], own).alias("kept")))

    kept = lined.select(key, F.explode(F.aggregate("line", start, step)["kept"]).alias("x"))
    return kept.select(key, "x.parent", "x.sig")


def magnitude(count: Column) -> Column:
    return F.when(count < 5, "s").when(count < 20, "m").when(count < 100, "l").otherwise("xl")


def fingerprints(found: DataFrame, key: str = "page_id", top: int = 3) -> DataFrame:
    """(key, digest, features) of the shape of each page's best containers; no text enters it."""
    varied = F.filter("columns", lambda c: (F.size(c["samples"]) < 2) | (F.size(F.array_distinct(c["samples"])) > 1))
    own = F.concat(F.lit("c:"), "parent_selector", F.lit(">"), "selector", F.lit("@"), F.col("depth").cast("string"), F.lit("x"), magnitude(F.col("count")))
    fields = F.transform(varied, lambda c: F.concat(F.lit("f:"), F.col("selector"), F.lit("|"), c["path"], F.lit("|"), c["kind"]))
    all_of = found.where(F.col("place") <= top).groupBy(key).agg(F.sort_array(F.flatten(F.collect_list(F.concat(F.array(own), fields)))).alias("features"))
    return all_of.select(key, F.concat(F.lit("fp1:"), F.substring(F.sha2(F.array_join("features", "\n"), 256), 1, 32)).alias("digest"), "features")


def similarity(a: Column, b: Column) -> Column:
    """Of two fingerprints' features: the share that both have, 0 if either has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), texts.jaccard(a, b)).otherwise(0.0)
