"""Quality rules: lines marked as content or boilerplate by a linear-chain conditional random field."""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches
from .words import flat, mix

SAMPLE = 3000  # labelled documents to learn from, at most
PIECE = 1 << 20  # bytes of a line that are split into words at a time
CHAIN = 32  # lines of a training chain
STEPS, RATE, L2 = 150, 0.2, 1e-3
SHARE = 0.5  # of a text's words that lines of content must have
MIN_WORDS, REPEATED = 50, 50  # words; percent of words
BLANKS, SYMBOLS = bytes([32, *range(9, 14)]), b"#[]*$%&|<>"
COUNTED = b"#*$%&|<>"  # the symbols that n_symbols counts
CAPITALS, DIGITS, CONTINUED = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(0x80, 0xC0))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS)  # punctuation

BITS = 24
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")


class Model(NamedTuple):
    """unary: how much more each feature, and the last number, speaks for content; steps: [label before, label] with 1 for content."""

    unary: np.ndarray
    steps: np.ndarray

    def scores(self, codes: np.ndarray) -> np.ndarray:
        found, where = np.unique(codes, return_inverse=True)
        return (_spread(found) @ self.unary)[where]


PLAIN = Model(np.zeros(BITS + 1), np.zeros((2, 2)))  # marks every line as content


def _spread(codes: np.ndarray) -> np.ndarray:
    """The features of each code as 0 and 1, and a 1."""
    return np.append((codes[:, None] >> np.arange(BITS) & 1).astype(float), np.ones((len(codes), 1)), axis=1)


def line_words(line: bytes):
    """The words of a line, PIECE bytes of it at a time."""
    at = 0
    while at < len(line):
        end = at + PIECE
        while end < len(line) and line[end] not in BLANKS:
            end += 1
        yield line[at:end].split()
        at = end


def line_code(line: bytes, n_words: int, n_distinct: int, again: bool, first: bool) -> int:
    """The features of a line with a word, a bit each: its length, how it ends and begins, what it is made of, whether it repeats."""
    size = len(line)
    share = lambda chars: (size - len(line.translate(None, chars))) / size
    body = line.strip(BLANKS)
    symbols, marks, capitals, digits, mean = share(SYMBOLS), share(MARKS), share(CAPITALS), share(DIGITS), size / n_words
    head, end = body[:1], body[-1:]
    told = (
        n_words <= 3, 4 <= n_words <= 9, 10 <= n_words <= 39, n_words >= 40, end in (b".", b"?", b"!", b'"', b")"), end in (b":", b",", b";", b"|"), symbols > 0.01, symbols > 0.05, symbols > 0.15,
        marks > 0.06, marks > 0.12, capitals > 0.1, capitals > 0.4, digits > 0.05, digits > 0.2, mean < 4, mean > 10, again, head.islower(), not head.isalnum() and head < b"\x80",
        b"://" in body or b"www." in body or b"@" in body, first, 2 * n_distinct < n_words, 10 * n_distinct < 7 * n_words,
    )
    return sum(1 << i for i, x in enumerate(told) if x)


def read_lines(data: bytes) -> tuple[list, list, list, np.ndarray]:
    """(numbers, codes, words) of the lines that have a word, whether each is equal to an earlier one, and hashes of all words."""
    numbers, codes, counts, again, seen, hashes = [], [], [], [], set(), array("q")
    for number, line in enumerate(data.split(b"\n")):
        before, known = len(hashes), set()
        for words in line_words(line):
            hashes.extend(map(hash, words))
            known.update(words)
        if n := len(hashes) - before:
            twice = line in seen
            seen.add(line)
            codes.append(line_code(line, n, len(known), twice, not numbers))
            numbers.append(number)
            counts.append(n)
            again.append(twice)
    return numbers, codes, counts, again, np.frombuffer(hashes, np.int64) if len(hashes) else np.zeros(0, np.int64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside a window of three that comes twice or more."""
    h = hashes.view(np.uint64)
    if len(h) < 4:
        return 0
    keys = mix(mix(mix(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(3) + h[2:])
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    met = count[where] > 1
    inside = np.zeros(len(h), bool)
    for i in range(3):
        inside[i : len(h) - 2 + i] |= met
    return int(inside.sum())


def viterbi(unary: list, steps: np.ndarray) -> list[bool]:
    """The labels of a chain, True for content, of the highest sum of ``unary`` of content lines and ``steps``; ties go to content."""
    (s00, s01), (s10, s11) = steps.tolist()
    best0, best1, back = 0.0, 0.0, []
    for k, u in enumerate(unary):
        if k:
            from0, from1 = best1 + s10 >= best0 + s00, best1 + s11 >= best0 + s01  # whether the line before is content
            back.append((from0, from1))
            best0, best1 = (best1 + s10 if from0 else best0 + s00), (best1 + s11 if from1 else best0 + s01) + u
        else:
            best1 = u
    out = [best1 >= best0] if unary else []
    for from0, from1 in reversed(back):
        out.append(from1 if out[-1] else from0)
    return out[::-1]


def _chains(codes: list[np.ndarray], labels: list[np.ndarray], length: int):
    """(codes, labels, mask) of all lines in chains of ``length``, a row each."""
    pieces = [(c[i : i + length], y[i : i + length]) for c, y in zip(codes, labels) for i in range(0, len(c), length)]
    code, label, mask = (np.zeros((len(pieces), length), t) for t in (np.int64, np.int64, bool))
    for k, (c, y) in enumerate(pieces):
        code[k, : len(c)], label[k, : len(c)], mask[k, : len(c)] = c, y, True
    return code, label, mask


def _both(a: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exponentials over the last axis, of two."""
    top = a.max(axis=-1)
    return top + np.log1p(np.exp(-np.abs(a[..., 0] - a[..., 1])))


def learn(codes: list[np.ndarray], labels: list[np.ndarray], length: int = CHAIN) -> Model:
    """The model that makes the labels of all chains likeliest, less L2 times the squares: forward and backward sums, Adam's steps."""
    code, label, mask = _chains(codes, labels, length)
    found, where = np.unique(code, return_inverse=True)
    where, features, rows = where.reshape(code.shape), _spread(found), np.arange(len(code))
    total = max(1, int(mask.sum()))
    pairs = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:, :-1][pairs], label[:, 1:][pairs]), 1)
    weights = np.zeros(BITS + 1 + 4)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        steps = weights[-4:].reshape(2, 2)
        u = (features @ weights[:-4])[where] * mask
        ahead, behind = np.zeros((*code.shape, 2)), np.zeros((*code.shape, 2))
        ahead[:, 0, 1] = u[:, 0]
        for t in range(1, length):
            nxt = _both((ahead[:, t - 1, :, None] + steps).transpose(0, 2, 1))
            nxt[:, 1] += u[:, t]
            ahead[:, t] = np.where(mask[:, t, None], nxt, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            here = behind[:, t + 1].copy()
            here[:, 1] += u[:, t + 1]
            behind[:, t] = np.where(mask[:, t + 1, None], _both(here[:, None, :] + steps), behind[:, t + 1])
        whole = _both(ahead[rows, -1])
        content = np.exp(ahead[..., 1] + behind[..., 1] - whole[:, None]) * mask
        met = np.zeros((2, 2))
        for t in range(1, length):
            here = behind[:, t].copy()
            here[:, 1] += u[:, t]
            met += (np.exp(ahead[:, t - 1, :, None] + steps + here[:, None, :] - whole[:, None, None]) * mask[:, t, None, None]).sum(axis=0)
        gap = np.bincount(where.ravel(), ((label - content) * mask).ravel(), len(found))
        slope = np.append(features.T @ gap, (seen - met).ravel()) / total - 2 * L2 * weights / 10
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        weights = weights + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights[:-4], weights[-4:].reshape(2, 2))


def _codes(batches):
    for batch in batches:
        data, at = flat(batch.column("text"))
        data, at = data.tobytes(), at.tolist()
        found = pa.array([read_lines(data[a:b])[1] for a, b in zip(at, at[1:])], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("label"), found], names=["label", "codes"])


def _fit(batches):
    codes, labels = [], []
    for batch in batches:
        for label, found in zip(batch.column("label").to_pylist(), batch.column("codes")):
            codes.append(np.array(found.values.to_numpy(zero_copy_only=False), np.int64))
            labels.append(np.full(len(codes[-1]), label))
    model = PLAIN
    if {0, 1} <= {int(y[0]) for y in labels if len(y)}:
        alone = learn(codes, labels, 1)  # of lines by themselves
        labels = [y if len(y) and y[0] else (alone.scores(c) >= 0).astype(np.int64) for c, y in zip(codes, labels)]
        model = learn(codes, labels)
    yield pa.RecordBatch.from_arrays([pa.array([model.unary.tolist()]), pa.array([model.steps.ravel().tolist()])], names=["unary", "steps"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learned from at most ``sample`` rows of labels (doc_id, label: 1 for a good text), the least by a hash, and the texts of
    their doc_ids. Lines of good texts count as content; those of others as boilerplate, but for the ones that a model of lines by
    themselves takes for content. Lines are read where their texts are; one task learns from their features, a number a line.
    Rows without a label or doc_id are not used; unless there are lines of both labels, every line is content."""
    some = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    low = min((1 << 64) - 1, 2 * sample * (1 << 64) // max(1, some.count())) - (1 << 63)  # about twice the sample is ranked
    some = some.where(F.xxhash64("doc_id", "label") <= F.lit(low).cast("long")).orderBy(F.xxhash64("doc_id", "label"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", "text")  # at most ``sample`` rows of two numbers
    read = rows.mapInArrow(_codes, "label int, codes array<int>")
    read = read.orderBy(F.xxhash64("label", "codes"), "codes").limit(sample)
    found = read.coalesce(1).mapInArrow(_fit, "unary array<double>, steps array<double>").first()
    return Model(np.array(found[0]), np.array(found[1]).reshape(2, 2)) if found else PLAIN


def label_lines(docs: DataFrame, model: Model, share: float = SHARE) -> DataFrame:
    """Adds to all columns of docs what its whole texts are made of, and whether to keep them.

    n_words and word_chars (code points in words); n_symbols; n_dup_lines (with a word, equal to an earlier line);
    n_repeat_words (inside a window of three words that comes twice or more); boilerplate (numbers of lines, from 0, that Viterbi
    decoding marks so; lines without a word are not marked); content_words (in the other lines); base_failed (under MIN_WORDS words, or
    over REPEATED percent in repeated windows); kept: not base_failed, and ``share`` of the words are in lines of content.

    Null text is an empty one: base_failed. Equal rows fare alike. An empty table gives no rows. Columns of docs that have one of these
    names are replaced. A worker holds one text, its lines, and a number a word at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thirty numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            data, at = flat(batch.column("text"))
            data, at = data.tobytes(), at.tolist()
            out: dict[str, list] = {c: [] for c in (*COUNTS, "boilerplate", "base_failed", "kept")}
            for a, b in zip(at, at[1:]):
                text = data[a:b]
                numbers, codes, counts, again, hashes = read_lines(text)
                marks = viterbi(m.scores(np.array(codes, np.int64)).tolist(), m.steps) if codes else []
                bare = text.translate(None, BLANKS)
                n, repeated, content = len(hashes), repeated_words(hashes), sum(c for c, good in zip(counts, marks) if good)
                failed = n < MIN_WORDS or 100 * repeated > REPEATED * n
                told = (n, len(bare.translate(None, CONTINUED)), len(bare) - len(bare.translate(None, COUNTED)), sum(again), repeated, content)
                for c, value in zip(out, (*told, [k for k, good in zip(numbers, marks) if not good], failed, not failed and content >= share * n)):
                    out[c].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], batch.schema.field(c).type) if c in out else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    added = {c: F.lit(0).cast("long") for c in COUNTS} | {"boilerplate": F.lit(None).cast("array<int>"), "base_failed": F.lit(False), "kept": F.lit(False)}
    return map_batches(docs, run, added)
