"""Benchmark decontamination: an FM-index for each shard of the training texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stash, shown, with_text
from .words import U, mix, slices, word_hashes

WINDOW = 13
SHARD = 1 << 22  # bytes of text that one index covers; a longer text has its own
SEGMENT = 4096  # words of an item that travel in one row
BLOCK = 1 << 18  # words of the benchmark that are searched for, and broadcast, at a time
SAMPLE = 8  # of each so many text positions, one is kept to locate rows
FILTER = 22  # bits of the tables that tell which words and pairs of words no phrase has

SPANS = "array<struct<first: long, last: long, start: long, stop: long>>"


def _segments(width: int):
    def run(batches):
        """Rows (item, part, words) of up to SEGMENT window starts each."""
        for batch in batches:
            items, parts, words, lengths = [], [], [], [0]
            names = batch.column("item")
            for i, j, data, at in slices(batch.column("text")):
                hashes, starts = word_hashes(data, at, "alnum")
                for k in range(j - i):
                    own = hashes[starts[k] : starts[k + 1]]
                    for p, s in enumerate(range(0, max(1, len(own) - width + 1) if len(own) else 0, SEGMENT)):
                        piece = own[s : s + SEGMENT + width - 1]
                        items.append(names[i + k].as_py())
                        parts.append(p)
                        words.append(piece)
                        lengths.append(lengths[-1] + len(piece))
            flat = np.concatenate(words).view(np.int64) if words else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(parts, pa.int64()), lists], names=["item", "part", "words"])

    return run


class Phrases:
    """The windows of a block of the benchmark, over the numbers 1 to n of its words."""

    def __init__(self, rows: list, width: int):
        texts = [np.asarray(r[1], np.int64).view(np.uint64) for r in rows]
        self.words = np.unique(np.concatenate(texts))
        self.names = sorted({r[0] for r in rows if r[0] is not None})
        number = {x: i for i, x in enumerate(self.names)}
        by_length: dict[int, list] = {}
        pairs = []
        for (name, _), text in zip(rows, texts):
            ids = np.searchsorted(self.words, text).astype(np.int32) + 1
            n = min(width, len(ids))
            view = np.lib.stride_tricks.sliding_window_view(ids, n)
            by_length.setdefault(n, []).append((view, np.full(len(view), number.get(name, -1))))
            pairs.append(self.pair(ids[:-1], ids[1:]))
        # (windows, where each window's items begin, those items) by length
        self.windows = []
        for n, found in sorted(by_length.items()):
            view, owner = np.concatenate([v for v, _ in found]), np.concatenate([o for _, o in found])
            unique, which = np.unique(view, axis=0, return_inverse=True)
            owned = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
            self.windows.append((unique, np.searchsorted(owned[:, 0], np.arange(len(unique) + 1)), owned[:, 1]))
        self.shortest = min(by_length)
        self.may_be_word = self._table(self.words)
        self.may_be_pair = self._table(np.concatenate(pairs))

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((a.astype(np.uint64) << U(32)) | b.astype(np.uint64))

    @staticmethod
    def _table(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << FILTER, bool)
        out[hashes >> U(64 - FILTER)] = True
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, 0 for words of no phrase."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.may_be_word[hashes >> U(64 - FILTER)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        same = self.words[at] == hashes[maybe]
        out[maybe[same]] = at[same] + 1
        return out

    def stretches(self, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the runs of words in which a window may lie: neighbours that are a pair of
        some phrase, in one text, as long as the shortest window at least."""
        if not len(ids):
            return ids, ids
        tied = np.zeros(len(ids) + 1, bool)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & ~firsts[1:])
        tied[both[self.may_be_pair[self.pair(ids[both], ids[both + 1]) >> U(64 - FILTER)]] + 1] = True
        known = ids > 0
        begin = np.flatnonzero(known & ~tied[:-1])
        end = np.flatnonzero(known & ~tied[1:]) + 1
        long = end - begin >= self.shortest
        return begin[long], end[long]


class WaveletMatrix:
    """rank(symbol, i) over a sequence of numbers, by a bit of the symbol a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        start = np.zeros_like(i)
        for b, ones, zeros in self.levels:
            one = (symbol >> b) & 1 == 1
            i = np.where(one, zeros + ones[i], i - ones[i])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return i - start


class FMIndex:
    """Over stretches of numbers from 1 to n, each closed by a separator that no phrase holds."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int):
        size = end - begin
        starts = np.cumsum(size + 1) - size - 1
        self.source = np.repeat(begin - starts, size + 1) + np.arange(int((size + 1).sum()))
        closing = np.zeros(len(self.source), bool)
        closing[starts + size] = True
        text = np.where(closing, 0, ids[np.where(closing, 0, self.source)]).astype(np.int64)
        # suffixes sorted by prefix doubling; separators differ, so no comparison passes one
        rank = np.where(closing, np.cumsum(closing), text + len(begin))
        reach, longest = 1, int(size.max()) + 1
        order = np.argsort(rank, kind="stable")
        while True:
            key = rank[order]
            if reach > 1:
                key = key * (len(text) + len(begin) + n + 2) + second[order]
            new = np.zeros(len(text), np.int64)
            new[order[1:]] = np.cumsum(key[1:] != key[:-1])
            rank = new + 1
            if reach >= longest or rank[order[-1]] == len(text):
                break
            second = np.concatenate([rank[reach:], np.zeros(min(reach, len(text)), np.int64)])
            order = np.argsort(rank * (len(text) + 2) + second, kind="stable")
            reach *= 2
        last = text[order - 1]  # order 0 reads the end of the text, a separator
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n + 1))])
        self.last, self.tree = last, WaveletMatrix(last, max(1, int(n).bit_length()))
        begins = np.zeros(len(text), bool)
        begins[starts] = True  # walks back never pass a separator
        kept = (order % SAMPLE == 0) | begins[order]
        self.kept, self.samples = kept, order[kept]
        self.place = np.cumsum(kept) - 1

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, row)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low, high): the rows that begin with each window that occurs, from its last word back."""
        alive = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.last), np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, k].astype(np.int64)
            low, high = self.step(symbol, low), self.step(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the shard's words where each row's suffix begins."""
        out, ahead = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.kept[rows[todo]]
            done = todo[here]
            out[done] = self.samples[self.place[rows[done]]] + ahead[done]
            todo = todo[~here]
            rows[todo] = self.step(self.last[rows[todo]], rows[todo])
            ahead[todo] += 1
        return self.source[out]


def _hits(phrases: Phrases, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's words: which are hit, and (word place, item) of the windows found."""
    edge = np.zeros(len(ids) + 1, np.int64)
    begin, end = phrases.stretches(ids, firsts)
    spots, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(begin):
        index = FMIndex(ids, begin, end, len(phrases.words))
        for windows, at, items in phrases.windows:
            which, low, high = index.search(windows)
            count = high - low
            row = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            place, which = index.locate(row), np.repeat(which, count)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + windows.shape[1], -1)
            n = at[which + 1] - at[which]
            spots.append(np.repeat(place, n))
            owners.append(items[np.repeat(at[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
    return np.cumsum(edge[:-1]) > 0, np.concatenate(spots), np.concatenate(owners)


def _scan(shared):
    def run(batches):
        phrases: Phrases = shared.value
        for batch in batches:
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words, spans, items = [], [], []
            for i, j, data, at in slices(batch.column("text"), SHARD):
                hashes, starts, first, stop = word_hashes(data, at, "alnum", spots=True)
                firsts = np.zeros(len(hashes) + 1, bool)
                firsts[starts] = True
                hit, spot, owner = _hits(phrases, phrases.numbers(hashes), firsts[:-1])
                for k in range(i, j):
                    for s in old_spans[k]:
                        hit[starts[k - i] + s["first"] : starts[k - i] + s["last"]] = True
                n_words += np.diff(starts).tolist()
                firsts[len(hashes)] = True
                turn = hit.copy()
                turn[1:] &= ~hit[:-1] | firsts[1:-1]
                over = hit.copy()
                over[:-1] &= ~hit[1:] | firsts[1:-1]
                a, b = np.flatnonzero(turn), np.flatnonzero(over)
                doc = np.searchsorted(starts, a, "right") - 1
                own = [[] for _ in range(j - i)]
                for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist()):
                    own[d].append({"first": x - int(starts[d]), "last": y + 1 - int(starts[d]), "start": int(first[x] - at[d]), "stop": int(stop[y] - at[d])})
                spans += own
                met = np.unique(np.stack([np.searchsorted(starts, spot, "right") - 1, owner], 1)[owner >= 0], axis=0)
                named = [set(x) for x in old_items[i:j]]
                for d, o in met.tolist():
                    named[d].add(phrases.names[o])
                items += [sorted(x) for x in named]
            cols = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, batch.schema.field("spans").type), "items": pa.array(items, batch.schema.field("items").type)}
            yield pa.RecordBatch.from_arrays([cols.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Where benchmark passages occur in documents.

    Words are runs of letters, digits and non-ASCII characters, A-Z folded. A window is ``width``
    consecutive words of an item, or the whole of a shorter item. Each shard of up to SHARD bytes of
    whole texts gets an FM-index over those stretches of words in which each neighbouring pair is a
    pair of some item (no window can lie elsewhere); all windows are searched backwards through the
    ranks of its wavelet matrix, located by sampled suffix positions, and merged into spans. The
    benchmark is broadcast, and searched, in blocks of about BLOCK words, one pass each, whatever its size; a
    pass is written before the next, and its broadcast freed.

    Adds to all columns of docs: n_words, spans (first, last: words; start, stop: bytes of the UTF-8
    text; ends excluded), items (ids of the items with occurring windows, as sorted strings). Null,
    empty or wordless texts: 0 words, no spans. Items without words have no windows; an item without
    id hits words and is not listed; repeated items count once. Empty benchmark: no spans. Empty
    docs: no rows. Columns of docs with the added names are replaced."""
    spark, columns = docs.sparkSession, ("n_words", "spans", "items")
    stash, done = Stash(spark, "decontam"), None
    at = f"_{docs.columns.index('text')}"
    out = with_text(docs).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    parts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_segments(width), "item string, part long, words array<long>")
    total = parts.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    if not total:
        words = F.coalesce(F.regexp_count("text", F.lit(r"[0-9A-Za-z[^\x00-\x7F]]+")), F.lit(0)).cast("long")
        out = out.withColumn("n_words", words)
        blocks = 0
    shared = None
    for b in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item", "part", "words"), F.lit(blocks)) == b).select("item", "words").collect()
        if not rows:
            continue
        if shared is not None:  # what the block before found is written, so that one block is broadcast at a time
            before, out = done, stash.keep(out, "found")
            shared.destroy()
            if before is not None:
                stash.drop(before)
            done = out
        shared = spark.sparkContext.broadcast(Phrases(rows, width))
        out = out.mapInArrow(_scan(shared), out.schema)
    return out.withColumnRenamed("text", at).select(*shown(docs, but=columns), *columns)


def contaminated(n_hit, n_words, share: int = 20):
    """At least one word in ``share`` is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, as they are."""
    found = find_contamination(with_text(docs), benchmark)
    clean = found.where(~contaminated(hit_words(F.col("spans")), F.col("n_words")))
    return clean.withColumnRenamed("text", f"_{docs.columns.index('text')}").select(*shown(docs))
