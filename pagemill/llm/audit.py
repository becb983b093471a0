"""How filters overlap: what each removes after which others, from packed bitmaps of their verdicts."""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Stash
from .words import flat

MIN_WORDS, DISTINCT, UPPER = 200, 50, 3  # words; percent of words; percent of characters
PIECE = 1 << 20  # bytes of a text that are split into words at a time
PARTS = 4096  # parts whose counts a task holds before it hands them on
MOST = 6  # filters: each has a bit, and all orders of them are told
SALTS = 64  # that a text's copies are dealt to
BLANKS, SYMBOLS, CAPITALS = bytes([32, *range(9, 14)]), b"#$%&*|", bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character


def pieces(data: bytes, most: int = PIECE):
    """A text's bytes in pieces of about ``most``, cut at white space only."""
    at = 0
    while at < len(data):
        end = at + most
        while end < len(data) and data[end] not in BLANKS:
            end += 1
        yield data[at:end]
        at = end


def text_bits(data: bytes) -> int:
    """Bit 0: too few words; 1: too few distinct ones; 2: too many capitals; 3: a character of SYMBOLS."""
    words, known = 0, set()
    for piece in pieces(data):
        found = piece.split()  # by the bytes of BLANKS
        words += len(found)
        known.update(found)
    without = lambda chars: len(data.translate(None, chars))
    upper, points = len(data) - without(CAPITALS), without(CONTINUED)
    return (words < MIN_WORDS) | (100 * len(known) < DISTINCT * words) << 1 | (100 * upper > UPPER * points) << 2 | (without(SYMBOLS) < len(data)) << 3


def _bits(batches):
    for batch in batches:
        data, at = flat(batch.column("text"))
        data, at = data.tobytes(), at.tolist()
        bits = pa.array([text_bits(data[a:b]) for a, b in zip(at, at[1:])], pa.int32())
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([bits if n == "bits" else batch.column(n) for n in names], names=names)


def document_filters(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of docs (doc_id, text, part): whether a document fails each of five filters.

    A: under 200 words. B: under half of its words differ. C: over 3 % capitals A-Z. D: a character of
    ``#$%&*|``. E: a document of smaller doc_id has the same text. Null text is an empty one; null part the
    empty string. Null doc_ids are neither smaller nor larger, so they pass E; rows of one doc_id and text
    fare alike. An empty table gives no rows; other columns are ignored.

    Texts are read once, into a table of bits and digests. The least doc_id of a text is found for each of
    SALTS parts of its copies and then for all of them, and goes back to those parts, so that a text of any
    number of copies is spread."""
    stash = Stash(docs.sparkSession, "audit")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"), F.lit(0).alias("bits"), "text")
    rows = stash.keep(plain.mapInArrow(_bits, plain.drop("text").schema), "bits")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    met = salted.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # one row for each text and salt: of texts with more than one doc_id only
    first = met.groupBy("digest").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last")
    first = met.join(first, "digest").select("digest", "salt", "first")
    fails = [((F.col("bits").bitwiseAND(F.lit(1 << k))) != 0).alias(name) for k, name in enumerate("ABCD")]
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")
    return salted.join(first, ["digest", "salt"], "left").select("doc_id", "part", *fails, later)


def with_labels(rows: DataFrame, labels: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows (doc_id, ...) with a flag for each of ``names``: whether that column of labels (doc_id, ...) is 1 in any row of the doc_id."""
    flags = labels.groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for n, c in names.items()])
    return rows.join(flags, "doc_id", "left").withColumns({n: F.coalesce(F.col(n) == 1, F.lit(False)) for n in names})


def _subsets(k: int) -> list[tuple[int, int]]:
    """(filters before, filter) as (mask, number), for all masks without that filter."""
    return [(mask, f) for mask in range(1 << k) for f in range(k) if not mask >> f & 1]


def bitmaps(codes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of k bits of codes a packed bitmap, its groups on byte bounds, and where each group's bytes begin.
    ``starts`` tells where groups begin in codes."""
    sizes = np.diff(np.append(starts, len(codes)))
    room = -(-sizes // 8) * 8
    first = np.cumsum(room) - room
    spots = np.arange(len(codes)) + np.repeat(first - starts, sizes)
    wide = np.zeros((k + 1, int(room.sum())), np.uint8)
    for i in range(k):
        wide[i, spots] = codes >> i & 1
    wide[k, spots] = 1  # that there is a row
    return np.packbits(wide, axis=1), first // 8


def tally(codes: np.ndarray, starts: np.ndarray, n_filters: int, n_labels: int) -> np.ndarray:
    """[group, (mask, filter), what]: of rows not removed by the filters of mask, how many the filter leaves and removes; how many
    fail it and are removed already; how many of each label it removes. AND-NOT and popcounts of bitmaps."""
    maps, at = bitmaps(codes, starts, n_filters + n_labels)
    fails, flags, there = maps[:n_filters], maps[n_filters:-1], maps[-1]
    alive = [there]
    for mask in range(1, 1 << n_filters):
        low = (mask & -mask).bit_length() - 1
        alive.append(alive[mask & mask - 1] & ~fails[low])
    count = lambda bits: np.add.reduceat(np.bitwise_count(bits), at, dtype=np.int64)
    out = []
    for mask, f in _subsets(n_filters):
        gone = alive[mask] & fails[f]
        out.append([count(alive[mask | 1 << f]), count(gone), count(fails[f] & ~alive[mask]), *[count(gone & x) for x in flags]])
    return np.array(out).transpose(2, 0, 1)


def _tallies(n_filters: int, n_labels: int):
    pairs = np.array(_subsets(n_filters), np.int32)

    def batch_of(held: dict):
        told = np.array(list(held.values()))
        names = ["part", "mask", "filter", "kept", "removed", "redundant", *[f"lost{i}" for i in range(n_labels)]]
        parts = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), len(pairs))))
        cols = [parts, *[pa.array(np.tile(pairs[:, i], len(held))) for i in (0, 1)], *[pa.array(told[:, :, i].ravel()) for i in range(told.shape[2])]]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            kind, codes = part.indices.to_numpy(zero_copy_only=False), batch.column("codes").to_numpy(zero_copy_only=False)
            order = np.argsort(kind, kind="stable")
            starts = np.flatnonzero(np.diff(kind[order], prepend=-1))
            for name, found in zip(part.dictionary.take(pa.array(kind[order][starts])).to_pylist(), tally(codes[order], starts, n_filters, n_labels)):
                held[name] = held[name] + found if name in held else found
            if len(held) >= PARTS:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    return run


def filter_audit(rows: DataFrame, part: Column, filters: dict[str, Column], labels: dict[str, Column]) -> DataFrame:
    """One row for each part, order of all filters (their names joined) and step.

    filters says by name whether a row fails, labels whether it has a label; null is false. Columns: part,
    filter_order, step, filter, kept (after this step), removed (here), redundant (failing, removed before),
    unique_fails (failing this filter alone), <label>_lost (removed here with the label) and shapley, the rows that the
    filter removes in all orders together. Parts without rows do not come; an empty table gives no rows. At most MOST filters.

    Each task packs the verdicts of its rows into bitmaps by part and counts, for every set of filters before and each filter after
    it, by AND-NOT and popcount; counts are summed over tasks. Rows are neither shuffled nor compared."""
    k, n = len(filters), len(labels)
    if not 0 < k <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    flags = [F.coalesce(c, F.lit(False)).cast("int") for c in (*filters.values(), *labels.values())]
    code = F.lit(0)
    for i, flag in enumerate(flags):
        code = code + flag * F.lit(1 << i)
    counted = ["kept", "removed", "redundant", *[f"lost{i}" for i in range(n)]]
    schema = "part string, mask int, filter int, " + ", ".join(f"{c} long" for c in counted)
    plain = rows.select(part.cast("string").alias("part"), code.cast("int").alias("codes"))
    counts = plain.mapInArrow(_tallies(k, n), schema).groupBy("part", "mask", "filter").agg(*[F.sum(c).alias(c) for c in counted])
    counts = Stash(rows.sparkSession, "audit-counts").keep(counts, "counts")
    before = F.bit_count("mask")
    # a set of b filters comes first, in any order, and the other k - 1 - b last
    times = F.element_at(F.array(*[F.lit(factorial(b) * factorial(k - 1 - b)) for b in range(k)]), before + 1)
    alone = F.max(F.when(before == k - 1, F.col("removed")))
    whole = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * times).alias("shapley"), alone.alias("unique_fails"))
    names, steps = list(filters), []
    for order in permutations(range(k)):
        mask = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[i] for i in order), step, names[f], mask, f))
            mask |= 1 << f
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter_name string, mask int, filter int")  # of k * k! rows
    lost = [F.col(f"lost{i}").alias(f"{name}_lost") for i, name in enumerate(labels)]
    out = counts.join(F.broadcast(orders), ["mask", "filter"]).join(whole, ["part", "filter"])
    return out.select("part", "filter_order", "step", F.col("filter_name").alias("filter"), "kept", "removed", "redundant", "unique_fails", *lost, "shapley")
