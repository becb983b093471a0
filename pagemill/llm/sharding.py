"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random
from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Stash, hidden, shown, text_digest

HEAD = 16384  # groups, the largest ones, that go through the tree on the driver
SALTS = 1024  # parts of a group that no shard could hold
DIGIT = 2  # hexadecimal digits of a group's place that one pass looks at
SIZE_DIGITS = 12  # hexadecimal digits of a text's bytes
SLOT_ROWS = 2048  # rows to number in one group


class _Tree:
    """A treap of (remaining capacity, bin): the tightest bin that still holds an item in O(log n)."""

    def __init__(self):
        self.root, self.draw = None, random.Random(7).random

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key):
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.draw(), None, None]), right)

    def pop_tightest(self, need):
        """The least key of at least (need,), or None."""
        left, right = self._split(self.root, (need,))
        if right is None:
            self.root = left
            return None
        first = right
        while first[2] is not None:
            first = first[2]
        key = first[0]
        _, rest = self._split(right, (key[0], key[1] + 0.5))
        self.root = self._merge(left, rest)
        return key

    def pop_roomiest(self):
        t = self.root
        while t[3] is not None:
            t = t[3]
        left, _ = self._split(self.root, t[0])
        self.root = left
        return t[0]


def best_fit_decreasing(sizes: list[int], capacity: int, n_bins: int | None = None) -> list[int]:
    """The bin of each item. Items go in by falling size, each to the bin with the least room that
    holds it. With n_bins None a new bin opens when none holds the item (an item above the capacity
    gets its own); else an item that fits nowhere goes to the bin with most room."""
    tree, out, opened = _Tree(), [0] * len(sizes), n_bins or 0
    for b in range(opened):
        tree.add((capacity, b))
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.pop_tightest(sizes[i])
        if found is None and n_bins is None:
            found, opened = (capacity, opened), opened + 1
        elif found is None:
            found = tree.pop_roomiest()
        out[i] = found[1]
        tree.add((found[0] - sizes[i], found[1]))
    return out


def _level(filled: list[int], more: int) -> int:
    """The height up to which bins filled that far come when ``more`` goes into the lowest ones."""
    have, n = sorted(filled), 0
    for n in range(1, len(have) + 1):
        height = -(-(more + sum(have[:n])) // n)
        if n == len(have) or height <= have[n]:
            return height
    return 0


def _cuts(tail: DataFrame, targets: list[int]) -> list[str]:
    """For each target, a number of bytes, the place (a text) of the group in which the running sum of ``tail``
    (place, bytes), in order of place, comes to it. Looks at DIGIT digits a pass, of those groups only that begin
    as a target's does, so the driver sees at most 16^DIGIT sums for each target and pass."""
    if not targets:
        return []
    shared = commonprefix(list(tail.agg(F.min("place"), F.max("place")).first()))
    found = [(shared, 0)] * len(targets)  # the digits so far, and the bytes of all groups before those
    for length in range(len(shared) + DIGIT, SIZE_DIGITS + 32 + DIGIT, DIGIT):
        open_ = sorted({p for p, _ in found if len(p) == length - DIGIT})
        if not open_:
            break
        head = F.substring("place", 1, length - DIGIT)
        sums = tail.where(head.isin(open_)).groupBy(F.substring("place", 1, length).alias("p"))
        sums = sums.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("place").alias("one"))
        by_head: dict[str, list] = {}
        for p, b, n, one in sums.select("p", "b", "n", F.when(F.col("n") == 1, F.col("one"))).collect():
            by_head.setdefault(p[: length - DIGIT], []).append((p, b, n, one))
        for i, target in enumerate(targets):
            p, before = found[i]
            if len(p) != length - DIGIT:
                continue
            for q, b, n, one in sorted(by_head[p]):
                if before + b >= target:
                    break
                before += b
            # alone: its whole place is known
            found[i] = (one if n == 1 else q, before)
    return [p for p, _ in found]


def _end_of_head(groups: DataFrame, most: int) -> str | None:
    """The first place, by falling bytes, that is not among the ``most`` first groups, all groups of equal bytes or
    none; None if all are. Counts by digits, as ``_cuts`` adds up bytes: no task and not the driver sees ``most`` rows of each partition."""
    low, high, n = groups.agg(F.min("rank"), F.max("rank"), F.count(F.lit(1))).first()
    if n <= most:
        return None
    found, before = commonprefix([low, high]), 0
    while len(found) < SIZE_DIGITS:
        length = min(len(found) + DIGIT, SIZE_DIGITS)
        sums = groups.where(F.substring("rank", 1, len(found)) == found).groupBy(F.substring("rank", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        for q, m in sorted(map(tuple, sums.collect())):
            if before + m > most:
                break
            before += m
        found = q
    return found


def pack_shards(docs: DataFrame, n_shards: int = 24, overhead: int = 8, keep_text: bool = False, capacity: int | None = None, head: int = HEAD) -> DataFrame:
    """Deal documents to n_shards of near equal bytes, or to as few as hold ``capacity`` bytes each; equal texts stay together.

    A document's size is its text's UTF-8 bytes plus overhead. Groups of equal texts (null is a text
    of its own here) are indivisible; only a group of more bytes than a shard's capacity is dealt in parts, SALTS
    hashes of doc_id. Groups go in by falling size, each to the bin with the least room that
    holds it, or with most room if none does. The ``head`` largest groups (those of equal bytes all or none) take that way one by one, through the tree, on the driver.
    Of the rest each has less than 1/head of all bytes, and what the rule does with such a stream is to
    fill the bin with the least room up, then the next one: so the running sum of their bytes, by falling size of the text
    and then its digest, is cut at the bins' rooms. The cuts are found by digits, in a few passes that the driver sees
    sums of. A row then tells its shard from the ``head`` groups, broadcast, or from its own size and
    digest: no group is split, and no table of groups is joined.

    With ``capacity`` each shard's room is kept short of it by the largest group of the rest, so that no
    cut overfills one; a document of more bytes than the capacity has a shard of its own.

    Returns doc_id, text_crc32, size, shard, slot (gapless from 0 within the shard), with keep_text
    all input columns, text included. Null text: no bytes, checksum 0. Null doc_id: as any value.
    Repeated rows each get a slot. Ties go by doc_id, then text digest. Empty input: empty output.
    Columns other than doc_id and text are not read unless keep_text; those with the returned names are replaced."""
    spark, stash = docs.sparkSession, Stash(docs.sparkSession, "shards")
    text = F.col("text")
    facts = [
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
        F.coalesce(text_digest(text), F.lit(b"").cast("binary")).alias("_digest"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(SALTS)).cast("int").alias("_salt"),
    ]
    place = F.concat(F.lpad(F.hex(F.lit((1 << 4 * SIZE_DIGITS) - 1) - F.col("_size")), SIZE_DIGITS, "0"), F.rpad(F.hex("_digest"), 32, "0"))
    rows = stash.keep(docs.select("doc_id", *facts), "rows")
    total, n_rows = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    room = capacity or max(1, -(-total // n_shards))
    rank = F.lpad(F.hex(F.lit((1 << 4 * SIZE_DIGITS) - 1) - F.col("bytes")), SIZE_DIGITS, "0")
    groups = rows.groupBy("_digest", "_size").agg((F.count(F.lit(1)) * F.col("_size")).alias("bytes"))
    groups = stash.keep(groups.withColumn("rank", rank), "groups")
    end = _end_of_head(groups, head)
    first = groups if end is None else groups.where(F.col("rank") < end)  # ``head`` rows at most
    large = sorted(((bytes(r[0]), r[1]) for r in first.select("_digest", "bytes").collect()), key=lambda x: (-x[1], x[0]))
    parts = []
    if split := [d for d, b in large if b > room]:  # fewer than the shards there are bytes for
        hot = F.broadcast(spark.createDataFrame([(d,) for d in split], "_digest binary"))
        got = rows.join(hot, "_digest").groupBy("_digest", "_salt").agg(F.sum("_size")).collect()
        parts = sorted((bytes(r[0]), r[1], r[2]) for r in got)
    units = [(d, -1, b) for d, b in large if b <= room] + parts
    bins = best_fit_decreasing([b for *_, b in units], room, None if capacity else n_shards)
    if capacity:
        n_shards = max(bins, default=-1) + 1
    filled = [0] * n_shards
    for (*_, b), x in zip(units, bins):
        filled[x] += b
    seen = F.broadcast(spark.createDataFrame([(d,) for d, _ in large], "_digest binary"))
    tail = groups.join(seen, "_digest", "left_anti").select(place.alias("place"), "bytes")
    left = total - sum(b for _, b in large)
    largest = (1 << 4 * SIZE_DIGITS) - 1 - int(end, 16) if end else 0  # of the rest
    order, cuts = list(range(n_shards)), []
    if left:
        if capacity:
            rooms = [max(0, capacity - largest - x) for x in filled]
            while sum(rooms) < left:
                rooms.append(max(1, capacity - largest))
                filled.append(0)
            height = [x + r for x, r in zip(filled, rooms)]
        else:
            height = [_level(filled, left)] * n_shards
        order = sorted((b for b in range(len(filled)) if height[b] > filled[b]), key=lambda b: (height[b] - filled[b], b))
        n_shards, upto, targets = len(filled), 0, []
        for b in order[:-1]:
            upto += height[b] - filled[b]
            if upto < left:
                targets.append(upto)
        cuts = _cuts(tail, targets)
    # bounded by head, SALTS and the shards, not by the input
    whole = F.broadcast(spark.createDataFrame([(d, b) for (d, s, _), b in zip(units, bins) if s < 0], "_digest binary, _w int"))
    part = F.broadcast(spark.createDataFrame([(d, s, b) for (d, s, _), b in zip(units, bins) if s >= 0], "_digest binary, _salt int, _p int"))
    rest = F.lit(order[0] if order else 0)
    for cut, b in zip(cuts, order[1:]):
        rest = F.when(F.col("_place") > cut, b).otherwise(rest)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_place", place).join(whole, "_digest", "left").join(part, ["_digest", "_salt"], "left")
        buckets = max(1, -(-n_rows // (max(1, n_shards) * SLOT_ROWS)))
        bucket = F.pmod(F.xxhash64("_digest", "_salt"), F.lit(buckets)).cast("int")
        return df.select(*[c for c in df.columns if c not in ("_place", "_salt", "_w", "_p")], F.coalesce("_w", "_p", rest).alias("_shard"), bucket.alias("_bucket"))

    dealt = placed(rows)
    before = Window.partitionBy("_shard").orderBy("_bucket")
    offsets = dealt.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("_from", F.sum("n").over(before) - F.col("n")).drop("n")
    if keep_text:
        dealt = placed(hidden(docs, doc_id=F.col("doc_id"), text=F.col("text")).select("*", *facts).drop("text"))
    slot = F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("doc_id", "_digest")) - 1
    out = dealt.withColumn("_slot", slot).join(offsets, ["_shard", "_bucket"])
    named = {"size": F.col("_size"), "text_crc32": F.col("_crc"), "shard": F.col("_shard").cast("int"), "slot": (F.col("_from") + F.col("_slot")).cast("long")}
    kept = shown(docs, but=tuple(named)) if keep_text else ["doc_id"]
    return out.select(*kept, *[v.alias(k) for k, v in named.items()])
