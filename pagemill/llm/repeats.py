"""Removal of repeated byte strings by anchored hash grouping of suffixes, through a limited depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stash, hidden, row_key, shown
from .words import SLICE, U, flat, mix, powers

DEPTH = 400  # bytes that suffixes are ordered through
GRAM = 100  # bytes of the first digit
BLOCK = 32  # suffixes that the third digit treats together

_BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_BACKS = tuple(U(pow(int(b), -1, 1 << 64)) for b in _BASES)
_VALUES = [np.random.default_rng(s).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for s in (5, 6)]


class _Hasher:
    """64-bit hashes of any strings of some bytes, from sums of their prefixes."""

    def __init__(self, data: np.ndarray, which: int):
        self.back = powers(max(SLICE, len(data)) + 1, int(_BACKS[which]))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[which][data] * powers(max(SLICE, len(data)) + 1, int(_BASES[which]))[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):  # of single numbers; arrays wrap silently
            return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    reach, y = 1, x
    while reach * 2 <= width:
        y = np.minimum(y[:-reach], y[reach:])
        reach *= 2
    n = len(x) - width + 1
    return np.minimum(y[:n], y[width - reach : width - reach + n])


def _anchored(data: np.ndarray, at: np.ndarray, depth: int, gram: int, most: int = SLICE) -> tuple[np.ndarray, ...]:
    """(low, count, h, s): runs of suffix starts whose first ``depth`` bytes have the same anchor, the
    leftmost of the least-hashed grams in them, with hashes of the gram and of all bytes of the run's
    strings. ``at`` are the texts' bounds; no string crosses one. A long text is read ``most`` bytes at a
    time, and each run comes whole from the part it begins in."""
    found = []
    step = most if len(at) == 2 else max(len(data), 1)
    for c in range(0, max(len(data) - depth + 1, 0), step):
        lead = min(c, 1)  # one suffix before the part tells whether a run only goes on in it
        part = data[c - lead : c + step + 2 * depth]
        first, second = _Hasher(part, 0), _Hasher(part, 1)
        starts = np.arange(len(part) - gram + 1)
        h = first(starts, starts + gram)
        order = (h & U(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
        least = _least(order, depth - gram + 1)
        anchor = (least & U(0xFFFFFFFF)).astype(np.int64)
        if len(at) > 2:
            ends = at[1:]
            own = np.searchsorted(ends, np.arange(len(anchor)), "right")
            anchor[np.arange(len(anchor)) + depth > ends[own]] = -1
        turn = np.flatnonzero(np.diff(anchor, prepend=-2) != 0)
        stop = np.append(turn[1:], len(anchor))
        ok = (anchor[turn] >= 0) & (turn >= lead) & (turn < lead + step)
        low, stop = turn[ok], stop[ok]
        found.append((low + c - lead, stop - low, h[anchor[low]], second(low, stop - 1 + depth)))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found))


def _slices(col, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = flat(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _lists(counts: list, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()))


def _runs(depth: int, gram: int):
    def run(batches):
        for batch in batches:
            counts, cols = [], [[], [], []]
            for i, j, data, at in _slices(batch.column("text"), SLICE):
                low, n, h, s = _anchored(data, at, depth, gram, SLICE)
                own = np.searchsorted(at, low, "right") - 1
                counts += np.bincount(own, minlength=j - i).tolist()
                for c, x in zip(cols, (h.view(np.int64), s.view(np.int64), (low - at[own]) * 1024 + n)):
                    c.append(x)
            lists = [_lists(counts, np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *lists], names=["k1", "k2", "h", "s", "spot"])

    return run


def _blocks(depth: int, gram: int):
    """Rows for BLOCK suffixes each: hashes of the bytes that all their strings share (core), of the
    bytes that any of them covers (hull, null where the text ends before), and of each string."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            wins, counts = [], []
            data, at = flat(batch.column("text"))
            for k in range(len(batch)):
                text, asked = data[at[k] : at[k + 1]], batch.column("asked")[k].as_py()
                by_piece: dict[int, list] = {}
                for x in asked:
                    by_piece.setdefault((x["spot"] >> 10) // SLICE, []).append(x)
                for p, xs in by_piece.items():
                    c = max(0, p * SLICE - depth)  # a piece of a long text, with what its blocks may cover
                    part = text[c : (p + 1) * SLICE + 3 * depth]
                    first, second = _Hasher(part, 0), _Hasher(part, 1)
                    for x in xs:
                        low, n = (x["spot"] >> 10) - c, x["spot"] & 1023
                        grams = np.arange(low + n - 1, low + depth - gram + 1)
                        anchor = grams[np.flatnonzero(first(grams, grams + gram).view(np.int64) == x["h"])[0]]
                        lows = np.arange(anchor - low - n + 1, anchor - low + 1)  # distances to the anchor
                        for b in range(int(lows[0]) // BLOCK, int(lows[-1]) // BLOCK + 1):
                            r0, r1 = b * BLOCK, min(b * BLOCK + BLOCK - 1, depth - gram)
                            own = lows[(lows >= r0) & (lows <= r1)]
                            core = int(second(anchor - r0, anchor - r1 + depth).view(np.int64))
                            whole = anchor - r1 >= 0 and anchor - r0 + depth <= len(part)
                            hull = int(second(anchor - r1, anchor - r0 + depth).view(np.int64)) if whole else None
                            for o, v in zip(out, (x["rid"], x["spot"], x["h"], x["c"], b, core, hull, int(anchor + c))):
                                o.append(v)
                            own = own[::-1]
                            wins.append(second(anchor - own, anchor - own + depth).view(np.int64))
                            counts.append(len(own))
            names = ["rid", "spot", "h", "c", "block", "core", "hull", "anchor"]
            lists = _lists(counts, np.concatenate(wins) if wins else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[pa.array(o, pa.int64()) for o in out], lists], names=[*names, "wins"])

    return run


def _cut(depth: int):
    def run(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            found, flags = flat_longs(batch.column("found"))
            kept, sizes, spans = [], [0], []
            for k in range(len(batch)):
                text = data[at[k] : at[k + 1]]
                ranges = np.sort(found[flags[k] : flags[k + 1]])
                if len(ranges):
                    low, stop = ranges >> 10, (ranges >> 10) + (ranges & 1023) - 1 + depth
                    reach = np.maximum.accumulate(stop)
                    new = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
                    start, end = low[new], reach[np.append(new[1:] - 1, len(low) - 1)]
                    keep = np.ones(len(text), bool)
                    for a, b in zip(start, end):
                        keep[a:b] = False
                    text = text[keep]
                    spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(start, end)])
                else:
                    spans.append([])
                kept.append(text)
                sizes.append(sizes[-1] + len(text))
            body = np.concatenate(kept) if kept else np.zeros(0, np.uint8)
            cols = {"kept": pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(np.array(sizes, np.int32)), pa.py_buffer(body)])}
            cols["spans"] = pa.array(spans, batch.schema.field("spans").type)
            yield pa.RecordBatch.from_arrays([cols.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return run


def flat_longs(col) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list<long> column and its n + 1 offsets; null is empty."""
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """Remove from each text every byte covered by a string of ``depth`` bytes that also starts anywhere
    else in the corpus, same text included; all strings are judged on the input.

    Suffixes are grouped by hashes of ever more of their first ``depth`` bytes, in place of the digit passes
    of a radix sort; each pass is an aggregation by key that drops the suffixes left alone in their group:

    1. the anchor, the least-hashed gram among the suffix's first ``depth`` bytes. It depends on those
       bytes alone, so equal strings share it, and neighbours that share it travel as one row;
    2. all bytes of such a run: runs equal throughout are repeats, and done;
    3. of runs that differ under one anchor, blocks of BLOCK suffixes: by the bytes common to a block
       (alone: no repeat in it) and by all bytes it covers (met again: all repeats);
    4. the strings of the blocks still open, one by one.

    The groups left at full depth are exactly the repeated strings. Bytes are told apart by pairs of
    64-bit hashes. No group is gathered anywhere: passes count and join back.

    Adds to all columns of docs: kept (binary: the bytes that stay, which may break a character) and
    spans (start, stop: maximal removed runs of the UTF-8 bytes). Null text: as empty. Texts shorter
    than ``depth`` stay whole. Repeated rows of ``depth`` bytes or more are each other's repeats. Ties do not
    occur: every occurrence goes. Empty table: no rows. Null doc_id: as any value. Columns of docs
    named kept or spans are replaced."""
    spark, stash = docs.sparkSession, Stash(docs.sparkSession, "repeats")
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), "text")
    runs = keyed.mapInArrow(_runs(depth, gram), "k1 long, k2 long, h array<long>, s array<long>, spot array<long>")
    # ids are given while this table is written, and read from it ever after
    runs = stash.keep(runs.where(F.size("h") > 0).withColumn("rid", F.monotonically_increasing_id()), "runs")
    each = runs.select("rid", F.explode(F.arrays_zip("h", "s", "spot")).alias("x")).select("rid", "x.h", "x.s", "x.spot")

    seen = each.groupBy("h", "s").agg(F.count(F.lit(1)).alias("c"), F.first("rid").alias("rid"), F.first("spot").alias("spot"))
    forms = seen.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    met = stash.keep(seen.join(forms, "h", "left").where((F.col("c") > 1) | F.col("m").isNotNull()), "met")
    whole = each.join(met.where(F.col("c") > 1).select("h", "s"), ["h", "s"], "left_semi").select("rid", "spot")

    asked = met.where(F.col("m").isNotNull()).select("rid", F.struct("rid", "spot", "h", "c").alias("x"))
    names = runs.select("rid", "k1", "k2")
    asked = asked.groupBy("rid").agg(F.collect_list("x").alias("x")).join(names, "rid")
    asked = asked.groupBy("k1", "k2").agg(F.flatten(F.collect_list("x")).alias("asked"))
    # repeated rows become one in each task before they are brought together
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(asked, ["k1", "k2"]).select("text", "asked")
    cols = ["rid", "spot", "h", "c", "block", "core", "hull", "anchor"]
    blocks = stash.keep(texts.mapInArrow(_blocks(depth, gram), ", ".join(f"{c} long" for c in cols) + ", wins array<long>"), "blocks")
    twice = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    cores = twice(blocks, "h", "block", "core")
    hulls = twice(blocks.where(F.col("hull").isNotNull()), "h", "block", "hull").withColumn("same", F.lit(True))
    open_ = stash.keep(blocks.join(cores, ["h", "block", "core"]).join(hulls, ["h", "block", "hull"], "left"), "open")
    # a block's suffixes start at descending distances from the anchor, so by rising place
    last = F.least(F.col("block") * BLOCK + (BLOCK - 1), F.lit(depth - gram))
    from_ = F.greatest(F.col("anchor") - last, F.shiftright("spot", 10))
    settled = open_.where(F.col("same") & (F.col("c") == 1)).select("rid", (from_ * 1024 + F.size("wins")).alias("spot"))
    pending = open_.where(F.col("same").isNull() & (F.col("c") == 1)).select("h", "block", "core").distinct()
    strings = open_.join(pending, ["h", "block", "core"], "left_semi").select("rid", "c", "h", "anchor", from_.alias("from"), F.posexplode("wins").alias("i", "w"))
    strings = strings.select("rid", "c", "h", (F.col("from") + F.col("i")).alias("p"), (F.col("anchor") - F.col("from") - F.col("i")).alias("r"), "w")
    again = twice(strings, "h", "r", "w")
    single = strings.where(F.col("c") == 1).join(again, ["h", "r", "w"], "left_semi").select("rid", (F.col("p") * 1024 + 1).alias("spot"))

    found = whole.union(settled).union(single).groupBy("rid").agg(F.collect_list("spot").alias("found")).join(names, "rid")
    found = stash.keep(found.select("k1", "k2", "found").dropDuplicates(["k1", "k2"]), "found")
    stash.drop(runs, met, blocks, open_)
    plain = hidden(docs, text=F.col("text"), k1=k1, k2=k2).drop(f"_{docs.columns.index('text')}")
    joined = plain.join(found, ["k1", "k2"], "left").drop("k1", "k2").withColumns({"kept": F.lit(b"").cast("binary"), "spans": F.array().cast("array<struct<start: long, stop: long>>")})
    out = joined.mapInArrow(_cut(depth), joined.schema)
    out = out.withColumnRenamed("text", f"_{docs.columns.index('text')}")
    return out.select(*shown(docs, but=("kept", "spans")), "kept", "spans")
