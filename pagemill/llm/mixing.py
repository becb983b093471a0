"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Stash, hidden, row_key, shown

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
GOLDEN = 2654435769  # the golden ratio's fraction in 32 bits
SLOTS = 65536  # blocks that a whole corpus is cut into, while they hold LEAST to MOST words
LEAST, MOST = 16, 65536
CELLS = 1024  # of the unit interval, to find a point's source by equality
CHUNK = 4096  # slots, and rows, that are numbered in one group


class Mix(NamedTuple):
    sources: DataFrame  # key, source, source_size, weight, target, words, slots
    schedule: DataFrame  # slot, key, rank, block, epoch, words
    documents: DataFrame  # k1, k2, copy_no, doc_id, size, source_size, target, taken, slots, at


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, repeat: int = 2) -> DataFrame:
    """Targets for (key, source, source_size), one row a source.

    Sources by code point, null last, get the weights in turn. They share ``share`` times all words;
    a target stops at ``repeat`` times its source and what is over goes to the others by weight,
    until none is above. With t = min(repeat * size, level * weight) that level is the largest of
    those met when sources fill up in order of repeat * size / weight."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * repeat).cast("double")
    rising = Window.orderBy("full", "key")
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("full", F.col("cap") / F.col("weight"))
    before = F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    behind = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (F.sum("source_size").over(all_rows) * share - before) / behind)
    return df.select("key", "source", "source_size", "weight", F.least("cap", F.max("level").over(all_rows) * F.col("weight")).alias("target"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """df with ``from``: the sum of value over the rows before, by bucket and order, within keys.
    No group is larger than a bucket, but for the one that adds up the buckets."""
    per = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    at = Window.partitionBy(*keys).orderBy(bucket)
    per = per.select(*keys, bucket, (F.sum("_sum").over(at) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum(value).over(inside) - F.col(value)).join(per, [*keys, bucket]).withColumn("from", F.col("_before") + F.col("_in")).drop("_in", "_before")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, repeat: int = 2, seed: int = 17) -> Mix:
    """Mix the documents' sources so that each gives its target of words.

    Each source's documents are shuffled by a hash into one stream of words, cut into blocks of equal
    words (the last may be short). Slot n lies at the golden-ratio point n * phi mod 1; the source
    whose stretch of the cumulative weights holds the point gets the slot, and the source's r-th
    slot takes its block r mod blocks, in epoch r div blocks. A source stops at the slot that reaches
    its target, of which only the first words are taken; slots that the schedule gave it too few
    come at the end. So a source's taken words are its target, rounded down, and no document is
    taken more than ``repeat`` times.

    documents has one row for each input row: copy_no tells apart rows of equal doc_id and text (k1
    and k2 are their hash), taken counts words, repeats included, slots has the slots that take the
    document's first word, rising, and at its place in its source's stream. Null or wordless text: size and taken 0,
    no slots. Null doc_id: as any value. Null source: a source of its own, last. An empty table gives empty tables. Ties in
    the shuffle go by doc_id and the second hash. Other columns are ignored."""
    spark, stash = docs.sparkSession, Stash(docs.sparkSession, "mix")
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = stash.keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), k1.alias("k1"), k2.alias("k2"), key.alias("key")), "rows")
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, repeat)
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    block = min(MOST, max(LEAST, -(-total // SLOTS)))
    words = F.floor(F.col("target") + 1e-6).cast("long")
    size = F.col("source_size")
    plan = plan.withColumn("words", words).withColumn("blocks", F.ceil(size / block).cast("long"))
    laps = F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0)
    plan = plan.withColumn("slots", (laps * F.col("blocks") + F.ceil((F.col("words") - laps * size) / block)).cast("long"))
    plan = stash.keep(plan, "sources")

    n = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    upto = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cuts = plan.select("key", F.sum("slots").over(upto).alias("_hi"), "slots").withColumn("_lo", F.col("_hi") - F.col("slots")).where(F.col("slots") > 0)
    low, high = F.col("_lo") / F.lit(float(max(n, 1))), F.col("_hi") / F.lit(float(max(n, 1)))
    cuts = cuts.select("key", low.alias("low"), F.when(F.col("_hi") == n, 1.0).otherwise(high).alias("high"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    cuts = cuts.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32)) / float(1 << 32)
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", cell(F.col("point")))
    given = points.join(cuts, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    given = given.select("slot", "key", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).cast("long").alias("one"))
    ranked = _running(given, ["key"], "chunk", ["slot"], "one").select("slot", "key", F.col("from").alias("rank"))
    ranked = stash.keep(ranked, "ranked")
    have = plan.join(ranked.groupBy("key").agg(F.count(F.lit(1)).alias("have")), "key", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    late = have.where(F.col("have") < F.col("slots")).select("key", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank"))
    ranked = ranked.unionByName(late.select((F.col("rank") + n).alias("slot"), "key", "rank"))
    facts = plan.select("key", "source_size", "words", "blocks", "slots")
    sched = ranked.join(facts, "key").where(F.col("rank") < F.col("slots"))
    sched = sched.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
    reach = F.col("epoch") * size + F.col("block") * block
    part = F.least(F.lit(block), size - F.col("block") * block, F.col("words") - reach).cast("long")
    sched = sched.select("slot", "key", "rank", "block", "epoch", part.alias("words"))
    taken = sched.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("uses"))  # ``repeat`` at most

    buckets = 1
    while buckets * CHUNK < n_rows:
        buckets *= 2
    mixed = F.xxhash64(F.lit(seed), F.col("k1"))
    copy_no = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("key"))
    streams = rows.withColumn("copy_no", copy_no).withColumn("h", mixed).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    streams = stash.keep(_running(streams, ["key"], "bucket", ["h", "doc_id", "k2", "copy_no"], "size"), "streams")
    some = streams.where(F.col("size") > 0).withColumn("to", F.col("from") + F.col("size"))
    pieces = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    start = F.col("block") * block
    left, right = F.greatest("from", start), F.least(F.col("to"), start + block)
    first = F.col("from") >= start
    met = pieces.join(taken, ["key", "block"])
    words_of = F.aggregate("uses", F.lit(0).cast("long"), lambda sum_, u: sum_ + F.greatest(F.lit(0).cast("long"), F.least(right, start + u["words"]) - left))
    begun = F.transform(F.filter("uses", lambda u: F.col("from") < start + u["words"]), lambda u: u["slot"])
    got = met.withColumns({"taken": words_of, "slots": F.when(first, begun)})
    cols = ["k1", "k2", "copy_no", "doc_id", "size", "key"]
    got = got.groupBy(*cols, F.col("from").alias("at")).agg(F.sum("taken").alias("taken"), F.max("slots").alias("slots"))
    none = F.array().cast("array<long>")
    every = streams.select(*cols, F.col("from").alias("at")).join(got.select("k1", "k2", "copy_no", "taken", "slots"), ["k1", "k2", "copy_no"], "left")
    every = every.withColumns({"taken": F.coalesce("taken", F.lit(0).cast("long")), "slots": F.coalesce("slots", none)})
    documents = every.join(plan.select("key", "source_size", "target"), "key").drop("key")
    return Mix(plan, sched, documents)


def mixed_documents(docs: DataFrame, mix: Mix, one_order: bool = True) -> DataFrame:
    """The rows of docs as the mix takes them: each once for every slot that takes its first word, so
    none to ``repeat`` times; wordless documents go. The columns are those of docs.

    Rows come in the order of the slots, and within a slot in that of its source's stream. With ``one_order`` partitions hold
    ranges of slots, one behind the other, which shuffles the texts once more; without it each partition holds a random part of
    the rows in that order. Either way any first part of a file is mixed as the whole is."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    by = Window.partitionBy("k1", "k2").orderBy("_0")
    mine = mix.documents.where(F.size("slots") > 0).select("k1", "k2", "copy_no", F.explode("slots").alias("slot"), "at")
    out = hidden(docs, k1=k1, k2=k2).withColumn("copy_no", F.row_number().over(by)).join(mine, ["k1", "k2", "copy_no"])
    out = out.repartitionByRange("slot", "at") if one_order else out
    return out.sortWithinPartitions("slot", "at", "k1", "k2", "copy_no").select(*shown(docs))
