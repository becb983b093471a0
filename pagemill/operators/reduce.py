"""A page's skeleton: its elements in outline, like siblings told once with their number.

Only the parse is Python. An outline is not in document order, as like siblings stand together; the line of an element is
told by sums over regions: its siblings' lines before it, and so for all elements around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.operators import nodes, structure

# Elements without structure, attributes that identify or address, the characters that cost most.
DROPPED = "script style noscript template svg path canvas iframe object embed br hr link meta source track param picture".split()
KEPT = "class id href src data-src itemprop role type".split()
WIDE = "[　-鿿가-힣]"
CLIP, LONGEST, SAMPLES, MAX_TOKENS = 80, 60, 2, 3000
CUT = "... (truncated: page exceeded the reduction budget)"
BLANK = r"(?U)^[\s\x1C-\x1F]*$"


def _tokens(length: Column, wide: Column) -> Column:
    return F.floor((length - wide) / 4 + wide / 1.5).cast("int") + 1


def estimate_tokens(text: Column) -> Column:
    """A rough number of tokens: four letters each, of East Asian ones one and a half; 0 without text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(_tokens(F.length(text), F.regexp_count(text, F.lit(WIDE))))


def _opening() -> Column:
    """An element's tag with what identifies it."""
    value = lambda k: nodes.clean(F.col("attrs")[k])
    told = [F.concat(F.lit(f'{k}="'), F.substring(value(k), 1, LONGEST), F.when(F.length(value(k)) > LONGEST, "...").otherwise(""), F.lit('"')) for k in KEPT]
    return F.concat(F.lit("<"), F.concat_ws(" ", "tag", *told), F.lit(">"))


def _shown(took: DataFrame) -> DataFrame:
    """The elements of bodies that the outline shows, with their group: ``first`` and ``many``, its first member and its size, and
    ``nth``, their place in it. A page without a body is one, but for what stands in its head."""
    found = nodes.with_body(took.where("NOT _blank"))
    found = found.where((F.col("node") >= F.col("_body.node")) & (F.col("node") <= F.col("_body.last")))
    bare = (F.col("_body.node") == 0) & (F.col("depth") == 1) & F.col("tag").isin("head", "title")
    found = found.where(~F.col("tag").isin(DROPPED) | (F.col("node") == F.col("_body.node")) | (F.col("last") > F.col("node")))  # a dropped element with none below hides nothing
    found = found.withColumn("tag", F.when(F.col("node") == 0, "body").otherwise(F.col("tag")))
    named = structure.naming(F.col("classes"))
    found = found.withColumns({"sig": F.concat_ws(".", "tag", named), "top": F.col("node") == F.col("_body.node")})
    alike = Window.partitionBy("row", "parent", "sig")
    found = found.withColumns({"nth": F.row_number().over(alike.orderBy("node")), "many": F.count(F.lit(1)).over(alike), "first": F.min("node").over(alike)})
    collapsed = ~F.col("top") & (F.col("many") >= structure.MIN_GROUP)
    found = found.withColumns({"collapsed": collapsed, "hides": ~F.col("top") & (F.col("tag").isin(DROPPED) | bare | (collapsed & (F.col("nth") > SAMPLES)))})
    found = found.withColumn("gone", F.col("hides") | nodes.within(F.col("hides"))).where("NOT gone")
    headed = F.col("collapsed") & (F.col("nth") == 1)
    sel = F.when(headed, F.concat_ws(".", "tag", F.slice(named, 1, 3)))
    return found.select("row", "node", "parent", "last", "top", sel.alias("sel"), "first", "many", "collapsed", headed.alias("headed"), _opening().alias("opening"))


def _lines(took: DataFrame, shown: DataFrame) -> DataFrame:
    """(row, at, indent, line): the lines of the outlines by their place, without their indents, which grow with depth."""
    headed = F.col("headed").cast("int")
    sized = nodes.subtree_sums(shown, "lines", headed + 1)
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("row", "parent").orderBy("first", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumns({"_place": before + 1 + headed, "_step": F.col("collapsed").cast("int") + 1})
    placed = nodes.region_sums(sized, **{n: F.when(F.col("top"), 0).otherwise(F.col(c)) for n, c in {"at": "_place", "indent": "_step"}.items()})
    runs = took.where("NOT _blank").select("row", F.posexplode(F.arrays_zip("runs", "owners")).alias("n", "x")).select("row", F.col("x.owners").alias("node"), "n", F.col("x.runs").alias("run"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "run"))), lambda r: r["run"]), "")
    own = runs.groupBy("row", "node").agg(F.substring(nodes.clean(joined), 1, CLIP).alias("own"))
    told = placed.join(own, ["row", "node"], "left")
    line = F.struct(F.col("at"), F.col("indent"), F.concat("opening", F.coalesce(F.concat(F.lit("  "), "own"), F.lit(""))).alias("line"))
    head = F.struct((F.col("at") - 1).alias("at"), (F.col("indent") - 1).alias("indent"), F.concat(F.lit("[x"), F.col("many").cast("string"), F.lit("] "), "sel").alias("line"))
    told = told.select("row", F.explode(F.when(F.col("headed"), F.array(head, line)).otherwise(F.array(line))).alias("x")).select("row", "x.*")
    title = F.get(F.filter("nodes", lambda x: x["tag"] == "title"), 0)
    named = took.where("NOT _blank").select("row", "runs", title.alias("t")).where("t IS NOT NULL")
    named = named.select("row", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("indent"), F.concat(F.lit("<title>  "), F.coalesce(F.substring(nodes.clean(nodes.piece(F.col("runs"), F.col("t.r0"), F.col("t.r1"))), 1, CLIP), F.lit(""))).alias("line"))
    return told.unionByName(named)


def reduced(pages: DataFrame, key: str = "page_id", html: str = "html", max_tokens: int = MAX_TOKENS, keep_table=None) -> DataFrame:
    """(key, skeleton, tokens, original_tokens, truncated, ratio) of each page. Lines stop where the next one would go
    beyond ``max_tokens``, which ``truncated`` tells. Null and blank pages have an empty skeleton; repeated keys are pages of their
    own. ``keep_table`` writes the parsed pages.

    What a line costs is summed in outline order; only lines within the budget are written out and put together, so deep and long pages
    make no long texts."""
    blank = F.coalesce(F.col(html), F.lit("")).rlike(BLANK)
    asked = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), estimate_tokens(F.col(html)).alias("original"), blank.alias("blank"))
    took = nodes.parsed(asked, ["key", "original", "blank"], keep_table=keep_table, owners=True).withColumnsRenamed({"_0": "_key", "_1": "_original", "_2": "_blank"})
    lines = _lines(took, _shown(took))
    cost = _tokens(F.length("line") + 2 * F.col("indent"), F.regexp_count("line", F.lit(WIDE)))
    used = F.sum(cost).over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("used", used)
    written = F.when(F.col("used") <= max_tokens, F.struct("at", F.concat(F.repeat(F.lit("  "), F.col("indent").cast("int")), "line").alias("line")))
    whole = lines.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(written)), lambda x: x["line"]).alias("kept"), (F.max("used") > max_tokens).alias("truncated"))
    text = F.array_join(F.when(F.col("truncated"), F.array_append("kept", F.lit(CUT))).otherwise(F.col("kept")), "\n")
    out = took.select("row", "_key", "_original").join(whole.select("row", text.alias("skeleton"), "truncated"), "row", "left")
    out = out.select("_key", F.coalesce("skeleton", F.lit("")).alias("skeleton"), "_original", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    out = out.withColumn("tokens", estimate_tokens(F.col("skeleton")))
    ratio = F.when(F.col("_original") > 0, F.round(F.col("tokens") / F.col("_original"), 4)).otherwise(0.0)
    return out.select(F.col("_key").alias(key), "skeleton", "tokens", F.col("_original").alias("original_tokens"), "truncated", ratio.alias("ratio"))
