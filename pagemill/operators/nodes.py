"""Pages as tables of elements: selectors as structural joins, articles by sums over regions.

Only the parse is Python. It numbers a page's elements in document order and gives each the number of the last element below
it and the runs of text that it holds, numbered as well; everything else is windows, joins and grouping of those rows.
An element is inside another one if its number is above the other's and not above the other's last. As such regions
nest or are apart, the question whether any of some elements holds a given one needs no pairs: it is whether the
greatest last among those that begin before reaches it, a running maximum in document order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import dom, values
from pagemill.functions.batches import slices
from pagemill.tables import keeper

NODE = "struct<node: int, parent: int, last: int, depth: int, tag: string, classes: array<string>, attrs: map<string,string>, r0: int, r1: int, m0: int, m1: int>"
PAGE = {"runs": "array<string>", "owners": "array<int>", "markup": "array<string>", "nodes": f"array<{NODE}>"}
SPACE = r"(?U)[\s\x1C-\x1F]+"


NUMBERS = ("node", "parent", "last", "depth", "r0", "r1", "m0", "m1")


class _Pages:
    """The elements of some pages, column by column, and where each page's begin."""

    def __init__(self, markup: bool, owners: bool = False):
        self.markup, self.owned = markup, owners
        self.numbers: dict[str, list] = {c: [] for c in NUMBERS}
        self.tags: list[str] = []
        self.lists: dict[str, list] = {c: [] for c in ("classes", "names", "values", "runs", "markup")}
        self.owners: list[int] = []
        self.ends: dict[str, list] = {c: [0] for c in ("nodes", "runs", "owners", "markup", "classes", "attrs")}

    def add(self, html: str | None) -> None:
        """Elements in document order, each with the first of its runs of text and the one behind its last, and so for the pieces that
        the page is written out with. Element 0 holds all."""
        n, lists, ends = self.numbers, self.lists, self.ends
        base, run0, piece0 = len(self.tags), len(lists["runs"]), len(lists["markup"])
        runs, out = lists["runs"], lists["markup"]
        todo: list = [(dom.unlink(dom.parse(html)), -1, 0)]
        while todo:
            item = todo.pop()
            if isinstance(item, int):  # all below that element are in
                if self.markup and item > base and self.tags[item] not in dom.VOID:
                    out.append(f"</{self.tags[item]}>")
                n["last"][item], n["r1"][item], n["m1"][item] = len(self.tags) - 1 - base, len(runs) - run0, len(out) - piece0
                continue
            x, parent, depth = item
            if isinstance(x, str):
                if x:
                    runs.append(x)
                    if self.owned:
                        self.owners.append(parent)
                    if self.markup:
                        out.append(x if self.tags[base + parent] in dom.RAW else dom.escape(x, quote=False))
                continue
            me = len(self.tags)
            for c, v in zip(NUMBERS, (me - base, parent, 0, depth, len(runs) - run0, 0, len(out) - piece0, 0)):
                n[c].append(v)
            self.tags.append(x.tag)
            lists["classes"] += x.classes()
            lists["names"] += x.attrs
            lists["values"] += x.attrs.values()
            ends["classes"].append(len(lists["classes"]))
            ends["attrs"].append(len(lists["names"]))
            if self.markup and me > base:
                out.append("<" + x.tag + "".join(f' {k}="{dom.escape(v)}"' for k, v in x.attrs.items()) + ">")
            todo.append(me)
            todo += [(c, me - base, depth + 1) for c in reversed(x.children)]
        ends["nodes"].append(len(self.tags))
        ends["runs"].append(len(runs))
        ends["owners"].append(len(self.owners))
        ends["markup"].append(len(out))

    def columns(self) -> dict[str, pa.Array]:
        texts = lambda c: pa.array(self.lists[c], pa.string())
        listed = lambda c, items: pa.ListArray.from_arrays(pa.array(self.ends[c], pa.int32()), items)
        parts = {c: pa.array(v, pa.int32()) for c, v in self.numbers.items()} | {"tag": pa.array(self.tags, pa.string()), "classes": listed("classes", texts("classes"))}
        parts["attrs"] = pa.MapArray.from_arrays(pa.array(self.ends["attrs"], pa.int32()), texts("names"), texts("values"))
        names = ["node", "parent", "last", "depth", "tag", "classes", "attrs", "r0", "r1", "m0", "m1"]
        return {"runs": listed("runs", texts("runs")), "owners": listed("owners", pa.array(self.owners, pa.int32())), "markup": listed("markup", texts("markup")), "nodes": listed("nodes", pa.StructArray.from_arrays([parts[x] for x in names], names))}


def parsed(pages: DataFrame, keep: list[str], html: str = "html", markup: bool = False, keep_table=None, owners: bool = False) -> DataFrame:
    """(row, the columns of ``keep``, runs, owners, markup, nodes): each page parsed once and written, as what follows reads it more than
    once. ``row`` tells pages apart, whatever their keys. Null pages have element 0 alone. ``keep_table`` writes to a place of its own.
    ``markup`` and ``owners``, for each run the element right above it, are empty unless asked for."""

    def run(batches):
        for batch in slices(batches, "_html"):
            found = _Pages(markup, owners)
            for x in batch.column("_html"):
                found.add(x.as_py())
            made, names = found.columns(), [n for n in batch.schema.names if n != "_html"]
            yield pa.RecordBatch.from_arrays([made[n].cast(batch.schema.field(n).type) if n in PAGE else batch.column(n) for n in names], names=names)

    # the page's own columns go by other names, so that none can clash with those of the parse
    plain = pages.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(html).alias("_html"), *[F.lit(None).cast(t).alias(n) for n, t in PAGE.items()])
    out = plain.mapInArrow(run, plain.drop("_html").schema)
    return (keep_table or keeper(pages.sparkSession))(out)


def elements(pages: DataFrame) -> DataFrame:
    """(row, node, parent, last, depth, tag, classes, attrs, r0, r1, m0, m1) of parsed pages."""
    return pages.select("row", F.explode("nodes").alias("x")).select("row", "x.*")


def with_body(pages: DataFrame) -> DataFrame:
    """The elements with _body (node, last): the bounds of their page's first body, or of element 0. The body is looked for once a page: an
    explode of one value, unlike a column, is not put into what is asked of each element."""
    body = F.coalesce(F.get(F.filter("nodes", lambda x: x["tag"] == "body"), 0), F.get("nodes", 0))
    once = pages.select("row", "nodes", F.explode(F.array(F.struct(body["node"].alias("node"), body["last"].alias("last")))).alias("_body"))
    return once.select("row", "_body", F.explode("nodes").alias("x")).select("row", "_body", "x.*")


def clean(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, SPACE, " ")), F.lit(""))


def piece(runs: Column, start: Column, end: Column) -> Column:
    """The runs of a stretch, put together."""
    return F.array_join(F.slice(runs, start + 1, end - start), "")


def _passes(tests: list) -> Column:
    """Whether an element fits the tests of one step of a selector."""
    out = F.col("node") > 0
    for tag, cls, id_, attr, op, value in tests:
        if tag and tag != "*":
            out = out & (F.col("tag") == tag)
        if cls:
            out = out & F.array_contains("classes", cls)
        if id_:
            out = out & (F.col("attrs")["id"] == id_)
        if attr:
            have = F.col("attrs")[attr]
            fits = {"": have.isNotNull(), "=": have == value, "*=": have.contains(value), "^=": have.startswith(value), "$=": have.endswith(value), "~=": F.array_contains(F.split(F.coalesce(have, F.lit("")), SPACE), value)}
            out = out & fits[op]
    return F.coalesce(out, F.lit(False))


def _met(order: Column | str):
    """The rows of a page before this one, in an order."""
    return Window.partitionBy("row").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def within(flag: Column) -> Column:
    """Whether any flagged element holds this one."""
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(_met("node")) >= F.col("node"), F.lit(False))


def tests_of(selector: str, flag: str) -> dict[str, Column]:
    """For each step of a selector, by name, whether an element fits the step by itself."""
    return {f"{flag}_{g}_{k}": _passes(tests) for g, steps in enumerate(dom._compile(selector)) for k, (_, tests) in enumerate(steps)}


def matched(nodes: DataFrame, selector: str, flag: str) -> DataFrame:
    """nodes with a boolean ``flag``: whether the element fits a selector (groups by comma, steps by space and >), of the
    columns of ``tests_of``, which go. Elements that fit no step need not be there.

    A step below another one is a running maximum, a step right below another one an equality join of parents."""
    names, used = [], []
    for g, steps in enumerate(dom._compile(selector)):
        before = None
        for k, (lead, _) in enumerate(steps):
            name, fits = f"{flag}_{g}_{k}_", F.col(f"{flag}_{g}_{k}")
            if before is not None and lead == ">":
                above = nodes.where(F.col(before)).select(F.col("row").alias("_row"), F.col("node").alias("_node"))
                nodes = nodes.join(above, (F.col("row") == F.col("_row")) & (F.col("parent") == F.col("_node")), "left")
                nodes = nodes.withColumn(name, fits & F.col("_node").isNotNull()).drop("_row", "_node")
            else:
                nodes = nodes.withColumn(name, fits & within(F.col(before)) if before is not None else fits)
            used += [name, f"{flag}_{g}_{k}"]
            before = name
        names.append(before)
    hit = F.lit(False)
    for name in names:
        hit = hit | F.col(name)
    return nodes.withColumn(flag, hit).drop(*used)


def _value(kind: str, attr: str | None) -> Column:
    """What a field takes from an element: a text, or the ends of a stretch of the page's runs or markup."""
    attrs = F.col("attrs")
    plain = {"href": attrs["href"], "src": F.coalesce(F.nullif(attrs["data-src"], F.lit("")), attrs["src"]), "attr": attrs[attr] if attr else F.lit(None)}.get(kind, F.lit(None))
    ends = ("m0", "m1") if kind == "html" else ("r0", "r1")
    return F.struct("node", plain.cast("string").alias("value"), F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b"))


def css_records(pages: DataFrame, container: str | None, fields: list[dict], key: str = "page_id", url: str = "url", keep_table=None) -> DataFrame:
    """(key, url, one column a field): a row for each element that fits ``container``, or for each page without one.

    A field's value is that of the first element in the container that fits its selector, of the container itself without a
    selector: in reversed document order the last one met. Rows without any value go. Transforms are columns behind that.
    Only elements that fit some step of some selector are shuffled, as their numbers, tests and values."""
    took = parsed(pages, [key, url], markup=any(f.get("type") == "html" for f in fields), keep_table=keep_table)
    kind = lambda f: f.get("type") or "text"
    asked = ({"_top": container} if container else {}) | {f"_hit{i}": f["selector"] for i, f in enumerate(fields) if f.get("selector")}
    tests = {} if container else {"_top": F.col("node") == 0}
    for flag, selector in asked.items():
        tests |= tests_of(selector, flag)
    some = F.lit(False)
    for test in tests.values():
        some = some | test
    own = {f"_v{i}": _value(kind(f), f.get("attr")) for i, f in enumerate(fields)}
    nodes = elements(took).where(some).select("row", "node", "parent", "last", *[c.alias(n) for n, c in (tests | own).items()])
    for flag, selector in asked.items():
        nodes = matched(nodes, selector, flag)
    hits = F.col("_top")
    for flag in asked:
        hits = hits | F.col(flag)
    nodes = nodes.where(hits)
    # one window over all fields, then those elements alone that hold what was met
    met = {f"_v{i}": F.last(F.when(F.col(f"_hit{i}"), F.col(f"_v{i}")), ignorenulls=True).over(_met(F.desc("node"))) if f.get("selector") else F.col(f"_v{i}") for i, f in enumerate(fields)}
    rows = nodes.withColumns(met).where("_top").select("row", "node", *[F.when((F.col(v)["node"] <= F.col("last")), F.col(v)).alias(v) for v in met])
    # a page's records meet its runs as one row, so that these are not carried once for each record
    page = rows.groupBy("row").agg(F.collect_list(F.struct("node", *met)).alias("_found")).join(took.select("row", "_0", "_1", "runs", "markup"), "row")

    def shown(x: Column) -> Column:
        out = []
        for i, f in enumerate(fields):
            v = x[f"_v{i}"]
            out.append({"html": piece(F.col("markup"), v["a"], v["b"]), "text": clean(piece(F.col("runs"), v["a"], v["b"]))}.get(kind(f), v["value"]).alias(f"_v{i}"))
        return F.struct(*out)

    rows = page.select("_0", "_1", F.explode(F.transform("_found", shown)).alias("x")).select("_0", "_1", "x.*")
    rows = rows.where(F.coalesce(*[F.nullif(n, F.lit("")) for n in met]).isNotNull()) if met else rows.where("false")
    return rows.select(F.col("_0").alias(key), F.col("_1").alias(url), *[values.chain(F.col(f"_v{i}"), f.get("transform", ["trim"]), F.col("_1")).alias(f["name"]) for i, f in enumerate(fields)])


# Elements whose text is no article's, those that may hold an article, and the beginnings of class and id names
# that announce furniture or content.
DROPPED = "script style noscript template nav header footer aside form iframe svg".split()
BLOCKS = "article main section div td".split()
FURNITURE = "nav menu footer header sidebar comment share social related promo advert banner cookie newsletter subscribe breadcrumb".split()
CONTENT = "article post story content entry main body prose".split()
ARTICLE_WORD = "[0-9a-zA-Z가-힣一-鿿ぁ-ヿ]+"
LEAST_WORDS = 40


def announces(marker: Column, names: list[str]) -> Column:
    return marker.rlike(rf"(?i)(^|[-_\s])({'|'.join(names)})")


def articles(pages: DataFrame, keep: list[str], html: str = "html", keep_table=None) -> DataFrame:
    """(columns of ``keep``, title, text, word_count) of the pages that have an article.

    Of the body's blocks the one with the most words outside links counts, weighed by what its class and id announce, a half more for an
    article element; of equals the first. The text of DROPPED elements is left out. Texts below LEAST_WORDS words are none.
    text: the runs of the block, trimmed, a line each, of blank lines one in a row. title: of the first h1 that is not left out, or the title.

    Runs of text and the two ends of each block stand in one order, by place. A run is left out if the greatest end of a dropped
    element before it lies beyond it. Words so far, and words in links so far, are running sums, and a block's number of words
    is what they grow by between its ends: each page costs its length, however deep its blocks are."""
    keep_table = keep_table or keeper(pages.sparkSession)
    took = parsed(pages, keep, html, keep_table=keep_table)
    nodes = with_body(took)
    inside = (F.col("node") > F.col("_body.node")) & (F.col("node") <= F.col("_body.last"))
    marker = F.concat_ws(" ", F.coalesce(F.col("attrs")["class"], F.lit("")), F.coalesce(F.col("attrs")["id"], F.lit("")))
    weight = F.when(announces(marker, FURNITURE), 0.25).otherwise(1.0) * F.when(announces(marker, CONTENT), 1.6).otherwise(1.0) * F.when(F.col("tag") == "article", 1.5).otherwise(1.0)
    kind = F.when(F.col("tag").isin(BLOCKS) & inside, "block").when(F.col("tag").isin(DROPPED) & inside, "dropped").when((F.col("tag") == "a") & inside, "link").when(F.col("tag").isin("h1", "title"), "title")
    marked = nodes.select("row", "node", "tag", "r0", "r1", kind.alias("kind"), weight.alias("weight")).where("kind IS NOT NULL")
    runs = took.select("row", F.posexplode("runs").alias("at", "run"))
    none = lambda kind: F.lit(None).cast(kind)
    starts = marked.select("row", F.col("r0").alias("at"), F.lit(0).alias("side"), "node", "tag", "kind", "weight", F.col("r1").alias("end"), none("string").alias("run"))
    ends = marked.where("kind = 'block'").select("row", F.col("r1").alias("at"), F.lit(0).alias("side"), "node", "tag", F.lit("end").alias("kind"), none("double").alias("weight"), none("int").alias("end"), none("string").alias("run"))
    texts = runs.select("row", "at", F.lit(1).alias("side"), none("int").alias("node"), none("string").alias("tag"), F.lit("run").alias("kind"), none("double").alias("weight"), none("int").alias("end"), "run")
    order = Window.partitionBy("row").orderBy("at", "side", "node").rowsBetween(Window.unboundedPreceding, 0)
    reach = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("end"))).over(order) > F.col("at"), F.lit(False))
    line = starts.unionByName(ends).unionByName(texts).withColumns({"gone": reach("dropped"), "linked": reach("link")})
    words = F.when((F.col("kind") == "run") & ~F.col("gone"), F.regexp_count("run", F.lit(ARTICLE_WORD))).otherwise(0)
    line = line.withColumn("words", words)
    line = line.withColumns({"so_far": F.sum("words").over(order), "in_links": F.sum(F.when(F.col("linked"), F.col("words")).otherwise(0)).over(order)})
    line = keep_table(line.where("kind NOT IN ('dropped', 'link')"))  # read thrice
    # a block inside a dropped element is gone as well
    sized = line.where("kind IN ('block', 'end')").groupBy("row", "node").agg(
        F.max("weight").alias("weight"), F.min("at").alias("r0"), F.max("at").alias("r1"), F.bool_or((F.col("kind") == "block") & F.col("gone")).alias("gone"), F.bool_or((F.col("kind") == "block") & F.col("linked")).alias("linked"),
        (F.max("so_far") - F.min("so_far")).alias("words"), (F.max("in_links") - F.min("in_links")).alias("links"),
    )
    sized = sized.withColumn("links", F.when(F.col("linked"), 0).otherwise(F.col("links")))  # a link around a block is none of the block's
    score = F.col("words") * (1 - F.least(F.col("links") / F.col("words"), F.lit(1.0))) * F.col("weight")
    sized = sized.where("NOT gone AND words > 0").withColumn("score", score).where("score > 0")
    best = sized.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "node", "r0", "r1")).alias("best")).select("row", "best.r0", "best.r1")
    # the runs of the best block alone, each page's by itself
    kept = line.where("kind = 'run' AND NOT gone").select("row", "at", trimmed(F.col("run")).alias("run")).join(best, "row").where("at >= r0 AND at < r1")
    body = kept.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "run"))), lambda r: r["run"]), "\n").alias("text"))
    body = body.withColumn("text", trimmed(F.regexp_replace("text", r"\n{3,}", "\n\n"))).withColumn("word_count", F.regexp_count("text", F.lit(ARTICLE_WORD)).cast("long")).where(F.col("word_count") >= LEAST_WORDS)
    named = line.where("kind = 'title' AND NOT gone").groupBy("row").agg(F.min(F.struct(F.when(F.col("tag") == "h1", 0).otherwise(1).alias("after"), "node", F.col("at").alias("h0"), F.col("end").alias("h1"))).alias("t")).select("row", "t.h0", "t.h1")
    out = body.join(named, "row", "left").join(took.select("row", *[f"_{i}" for i in range(len(keep))], F.col("runs").alias("_runs")), "row")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.nullif(trimmed(piece(F.col("_runs"), F.col("h0"), F.col("h1"))), F.lit("")).alias("title"), "text", "word_count")


def region_sums(nodes: DataFrame, **sums: Column) -> DataFrame:
    """nodes with, for each name, the sum of a column over an element and all elements around it.

    Each element adds its number where it begins and takes it away behind its last, so that a running sum by place holds
    those that are open: linear in a page's length, however deep it is."""
    marks = {f"_own_{n}": c for n, c in sums.items()}
    less = {n: -F.col(n) for n in marks}
    begun = nodes.withColumns(marks)
    at = begun.withColumns({"_mark": F.col("node"), "_side": F.lit(0)}).unionByName(begun.withColumns(less | {"_mark": F.col("last"), "_side": F.lit(1)}))
    order = Window.partitionBy("row").orderBy("_mark", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumns({n: F.sum(f"_own_{n}").over(order) for n in sums}).where("_side = 0").drop("_mark", "_side", *marks)


def subtree_sums(nodes: DataFrame, name: str, value: Column) -> DataFrame:
    """nodes with the sum of a column over an element and all elements below it: what the running sum grows by from one of its ends to the other."""
    own = nodes.withColumn("_own", value)
    ends = own.select("row", "node", F.col("node").alias("_at"), F.lit(0).alias("_side"), "_own").unionByName(own.select("row", "node", F.col("last").alias("_at"), F.lit(1).alias("_side"), F.lit(0).alias("_own")))
    order = Window.partitionBy("row").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    grown = ends.withColumn("_so_far", F.sum("_own").over(order)).groupBy("row", "node").agg((F.max("_so_far") - F.min("_so_far") + F.max("_own")).alias(name))
    return nodes.join(grown, ["row", "node"])


def trimmed(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
