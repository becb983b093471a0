"""Duplicate pages by canonical link, exact and near content; pages that mean "not found"."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import texts
from pagemill.operators.gate import first_of

BITS, THRESHOLD, MIN_TOKENS = 60, 6, 30
STEPS = 3  # of near_leaders before its state is written


def shuffled(df: DataFrame) -> DataFrame:
    """df, for joins that shuffle both sides. Pairs and keys of repeated documents take a bit or so a row as files, so Spark takes many millions
    of them for a small table and gathers them on the driver to send them to all tasks."""
    return df.hint("merge")


def exact(df: DataFrame, key: str, text: str, order: str, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(key, of_key) of pages whose text an earlier page has. A group of any size costs one join of two
    columns; only digests are shuffled."""
    long = df.where(F.size(texts.tokens(F.col(text))) >= min_tokens).select(*dict.fromkeys([key, order]), F.sha2(text, 256).alias("digest"))
    first = long.groupBy("digest").agg(F.min(F.struct(F.col(order).alias("at"), F.col(key).alias("of"))).alias("f")).select("digest", F.col("f.of").alias("of_key"))
    return long.join(first, "digest").where(F.col(key) != F.col("of_key")).select(key, "of_key")


def block_keys(prints: DataFrame, threshold: int = THRESHOLD, bits: int = BITS, blocks: int = 9) -> tuple[DataFrame, list[int]]:
    """prints (..., fingerprint) with a row (n, k) for each choice of blocks - threshold of ``blocks`` disjoint blocks of bits, k being a hash of
    those bits, and the bits of each choice as a mask. Fingerprints within the threshold share all but ``threshold`` blocks at least,
    so they agree in some choice: 84 keys of 20 bits each, in place of the 7 keys of 9 bits that single blocks give."""
    width = -(-bits // blocks)
    part = [F.shiftright("fingerprint", i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for i in range(blocks)]
    choices = list(combinations(range(blocks), blocks - threshold))
    masks = [sum(((1 << width) - 1) << i * width for i in choice) & ((1 << bits) - 1) for choice in choices]
    keys = F.array(*[F.xxhash64(F.lit(n), *[part[i] for i in choice]) for n, choice in enumerate(choices)])
    return prints.select("*", F.posexplode(keys).alias("n", "k")), masks


def near_pairs(prints: DataFrame, key: str, threshold: int = THRESHOLD, bits: int = BITS, blocks: int = 9) -> DataFrame:
    """(a, b, distance) of different fingerprints within the threshold, a < b by key.

    Those meet that agree in some choice of ``block_keys``. A pair is kept by the first choice that
    it agrees in, so none comes twice. Equal fingerprints should be one row before, as in ``near_leaders``."""
    cut, masks = block_keys(prints.select(F.col(key).alias("a"), "fingerprint"), threshold, bits, blocks)
    shared = cut.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k")
    cut = cut.join(shuffled(shared), "k")
    other = cut.select("k", "n", F.col("a").alias("b"), F.col("fingerprint").alias("fb"))
    differ = F.col("fingerprint").bitwiseXOR(F.col("fb"))
    earlier = F.exists(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).cast("long").alias("m")) for n, m in enumerate(masks)]), lambda x: (x["n"] < F.col("n")) & (differ.bitwiseAND(x["m"]) == 0))
    met = cut.join(shuffled(other), ["k", "n"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= threshold))
    return met.where(~earlier).select("a", "b", F.bit_count(differ).alias("distance"))


class PrintIndex:
    """Fingerprints of pages kept before, with their block keys, so that a batch meets them without work on their texts.

    Keys are written in order of their hash, so that a look-up joins the batch's keys with sorted files. ``add`` takes (key, fingerprint);
    ``nearest`` gives (node, leader) of the batch's nodes that have a page within the threshold, leader being the least key of those."""

    def __init__(self, keep_table, threshold: int = THRESHOLD):
        self.keep, self.threshold, self.parts = keep_table, threshold, []

    def add(self, prints: DataFrame, key: str) -> None:
        cut, _ = block_keys(prints.select(F.col(key).alias("kept"), "fingerprint"), self.threshold)
        self.parts.append(self.keep(cut.repartition("k").sortWithinPartitions("k")))

    def nearest(self, groups: DataFrame) -> DataFrame | None:
        """Of groups (node, fingerprint)."""
        if not self.parts:
            return None
        cut, _ = block_keys(groups.select("node", "fingerprint"), self.threshold)
        known = reduce(DataFrame.unionByName, self.parts).withColumnRenamed("fingerprint", "_print")
        met = cut.join(shuffled(known), ["k", "n"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("_print"))) <= self.threshold)
        return met.groupBy("node").agg(F.min("kept").alias("leader"))


def near_leaders(df: DataFrame, key: str, text: str, keep_table, threshold: int = THRESHOLD, min_tokens: int = MIN_TOKENS, known: PrintIndex | None = None) -> DataFrame:
    """(key, leader): each page of enough words and the earliest kept page within the threshold, itself if kept.

    A page is kept if no page kept before it is that near; keys give the order. Exact copies follow their first.
    Each step settles the pages whose earlier neighbours are settled; settled pages and their pairs leave, so that
    tables shrink from round to round, and a round takes STEPS steps before it writes. A chain of pages each near the next
    needs a step for each two of them: that is the order's own nature, and rounds end when nothing is open.

    ``known`` holds pages kept before, whose keys precede all of df: a page near one of them follows the earliest of those, and the pages
    that are kept now are added to it. Neither the texts nor the fingerprints of known pages are worked on again."""
    long = df.where(F.size(texts.tokens(F.col(text))) >= min_tokens)
    prints = keep_table(texts.simhash(long, key, texts.tokens(F.col(text))))
    groups = prints.groupBy("fingerprint").agg(F.min(key).alias("node"))
    kind = groups.schema["node"].dataType
    followers = known.nearest(groups) if known is not None else None
    if followers is not None:
        followers = keep_table(followers)
        groups = groups.join(shuffled(followers.select("node")), "node", "left_anti")
    pairs = keep_table(near_pairs(groups, "node", threshold).select("a", "b"))
    done, state = [], pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("leader", F.lit(None).cast(kind))
    while True:
        for _ in range(STEPS):
            led = state.select(F.col("node").alias("a"), F.col("leader").alias("la"))
            before = pairs.join(shuffled(led), "a").groupBy(F.col("b").alias("node")).agg(
                F.min(F.when(F.col("la") == F.col("a"), F.col("a"))).alias("lead"), F.min(F.when(F.col("la").isNull(), F.col("a"))).alias("open"),
            )
            # settled once the earliest leader precedes all open neighbours, or none is open
            sure = F.when(F.col("open").isNull(), F.coalesce("lead", "node")).when(F.col("lead") < F.col("open"), F.col("lead"))
            state = state.join(shuffled(before), "node", "left").select("node", F.coalesce("leader", sure).alias("leader"))
        state = keep_table(state)
        done.append(state.where("leader IS NOT NULL"))
        open_ = state.where("leader IS NULL")
        if open_.isEmpty():
            break
        # settled leaders still decide for the open pages next to them; nothing else does
        pairs = keep_table(pairs.join(shuffled(open_.select(F.col("node").alias("b"))), "b", "left_semi"))
        still = pairs.select("a").distinct().join(shuffled(done[-1].where("leader = node").select(F.col("node").alias("a"))), "a", "left_semi")
        pairs = keep_table(pairs.join(shuffled(open_.select(F.col("node").alias("a")).union(still)), "a", "left_semi"))
        state = open_.unionByName(still.select(F.col("a").alias("node"), F.col("a").alias("leader")))
    settled = reduce(DataFrame.unionByName, done).distinct()
    if followers is not None:
        settled = settled.unionByName(followers)
        groups = prints.groupBy("fingerprint").agg(F.min(key).alias("node"))
    back = groups.join(shuffled(settled), "node", "left").select("fingerprint", F.coalesce("leader", "node").alias("leader"))
    out = prints.join(shuffled(back), "fingerprint")
    if known is not None:
        known.add(out.where(F.col(key) == F.col("leader")), key)
    return out.select(key, "leader")


def canonical_duplicates(pages: DataFrame) -> DataFrame:
    """(key, canonical_key) of pages (key, canonical_key) that name another page as canonical."""
    return pages.where(F.col("canonical_key").isNotNull() & (F.col("canonical_key") != F.col("key"))).select("key", "canonical_key")


def soft_404(df: DataFrame, key: str, text: str, records: str | None = None) -> DataFrame:
    """df with soft_404: no text, or a phrase that says the page is missing among few words; never where
    ``records``, a count, is above 0."""
    found = F.coalesce(F.col(records), F.lit(0)) > 0 if records else F.lit(False)
    return df.withColumn("soft_404", ~found & texts.says_missing(F.col(text)))


def burnt(df: DataFrame, pattern: str, seq: str, soft: str = "soft_404") -> DataFrame:
    """Rows that come after a soft 404 of their pattern: its budget is spent then."""
    hits = df.where(F.col(soft)).groupBy(pattern).agg(F.min(seq).alias("_hit"))
    return df.join(hits, pattern).where(F.col(seq) > F.col("_hit")).drop("_hit")


def stub_pages(df: DataFrame, key: str, text: str, corroboration: int = 3, keep_table=lambda t: t) -> DataFrame:
    """Keys of thin pages (6 to 39 words) that at least two earlier thin pages resemble: the shape rule, with
    each page's earliest near neighbour as its group. ``keep_table`` may write the fingerprints, which are read thrice."""
    thin = df.where(F.size(texts.tokens(F.col(text))).between(6, 39))
    prints = keep_table(texts.simhash(thin, key, texts.tokens(F.col(text))))
    same = prints.groupBy("fingerprint").agg(F.min(key).alias("node"))
    lead = near_pairs(same, "node").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("lead"))
    grouped = prints.join(same.join(lead, "node", "left").select("fingerprint", F.coalesce("lead", "node").alias("lead")), "fingerprint").select(key, "lead")
    # the place in each group from which pages are stubs
    third = first_of(grouped, "lead", [F.col(key)], corroboration).where(F.col("nth") == corroboration).select("lead", F.col(key).alias("_from"))
    return grouped.join(third, "lead").where(F.col(key) >= F.col("_from")).select(key)


def new_records(records: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """Records with a new identity: one of each in the batch, without those stored."""
    fresh = records.dropDuplicates(keys)
    return fresh.join(stored.select(*keys), keys, "left_anti") if stored is not None else fresh
