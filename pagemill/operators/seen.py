"""A set of keys that grows batch by batch: an exact table, and a Bloom filter as a table in front of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 4  # of 64 bits in a block; a key sets one bit in each word of one block
KEYS = 20  # a block is made for: of 256 bits, which takes about one unseen key in a hundred for seen
BUCKETS = 64  # that the exact table is written in
SENT = 1 << 24  # bytes of filter, 8 * (WORDS + 1) a block, that are sent to all tasks at most
ASKED = 100_000  # keys that the exact table is asked for without a shuffle of it, at most


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return [F.element_at(F.lit([1 << b if b < 63 else -(1 << 63) for b in range(64)]).cast("array<long>"), bit(i) + 1) for i in range(WORDS)]


class SeenSet:
    """Keys added so far. ``fresh`` drops the rows of a batch whose key is there, ``add`` adds keys.

    The filter is a table of blocks; two filters merge by OR of equal blocks, so a batch is added without a look at what is there.
    A key whose bits are not all set is new for certain. Only the others are looked up in the exact table, in the buckets that they
    fall in, so nothing is taken for seen that is not. While they are ASKED or less they are sent to the exact table and that is not
    shuffled; beyond that both are shuffled. The filter is made anew, four times as large as needed, when it has more than KEYS a block.

    Null keys are never seen. ``rounds`` tells of each ``fresh``: rows asked, rows that the filter could not tell, keys there."""

    def __init__(self, spark: SparkSession, keep_table, blocks: int = 1 << 12):
        self.spark, self.keep, self.blocks = spark, keep_table, blocks
        self.parts: list[DataFrame] = []
        self.filter: DataFrame | None = None
        self.n = 0
        self.rounds: list[tuple[int, int, int]] = []

    def _bits(self, keys: DataFrame) -> DataFrame:
        marks = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))]
        return keys.groupBy(_block(F.col("key"), self.blocks).alias("block")).agg(*marks)

    def known(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.parts) if self.parts else None

    def add(self, keys: DataFrame) -> None:
        """Adds keys (key), which may repeat or be there already."""
        rows = keys.where("key IS NOT NULL").distinct().withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(BUCKETS)).cast("int"))
        part = self.keep(rows.repartition("bucket").sortWithinPartitions("bucket", "key"))
        self.parts.append(part)
        self.n += part.count()
        if self.n > KEYS * self.blocks:
            while self.n > KEYS * self.blocks:
                self.blocks *= 4
            self.filter = self.keep(self._bits(self.known()))
        else:
            new = self._bits(part)
            if self.filter is not None:
                new = self.filter.unionByName(new).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
            self.filter = self.keep(new)

    def fresh(self, batch: DataFrame, key: str) -> DataFrame:
        """The rows of batch whose key is not in the set; rows of equal keys all stay or all go."""
        if self.filter is None:
            return batch
        bits = self.filter.select(F.col("block").alias("_block"), F.struct(*[f"w{i}" for i in range(WORDS)]).alias("_bits"))
        bits = F.broadcast(bits) if self.blocks * 8 * (WORDS + 1) <= SENT else bits
        told = batch.withColumn("_block", _block(F.col(key), self.blocks)).join(bits, "_block", "left")
        all_set = F.lit(True)
        for i, mask in enumerate(_masks(F.col(key))):
            all_set = all_set & (F.col("_bits")[f"w{i}"].bitwiseAND(mask) == mask)
        maybe = F.coalesce(all_set, F.lit(False)) & F.col(key).isNotNull()
        told = self.keep(told.withColumn("_maybe", maybe).select(*batch.columns, "_maybe"))
        counts = told.agg(F.count(F.lit(1)), F.count_if("_maybe")).first()
        self.rounds.append((counts[0], counts[1], self.n))
        sure = told.where("NOT _maybe").drop("_maybe")
        if not counts[1]:
            return sure
        asked = told.where("_maybe").drop("_maybe")
        keys = asked.select(F.col(key).alias("key")).distinct()
        there = self.known()
        if counts[1] <= ASKED:
            in_ = [r[0] for r in keys.select(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
            met = there.where(F.col("bucket").isin(in_)).join(F.broadcast(keys), "key", "left_semi").select("key").distinct()
        else:
            met = there.join(keys, "key", "left_semi").select("key").distinct()
        met = met.withColumnRenamed("key", "_met")
        return sure.unionByName(asked.join(met, asked[key] == met["_met"], "left_anti"))
