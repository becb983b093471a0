"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Stash, shown, with_text

TOP = 300  # n-grams of a profile
LANGS = 256  # profiles in one broadcast
UND = "und"
PIECE = 1 << 19  # characters that arrays are made for at a time


@lru_cache(1)
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _count(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal n-grams; n-grams sorted."""
    if len(parts) == 1:
        return parts[0]
    found = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    unique, which = np.unique(found, return_inverse=True)
    return unique, np.bincount(which, counts, len(unique)).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of one to three letters, words padded by a blank, as numbers of 21 bits a letter."""
    parts, before = [], np.zeros(1, np.int64)  # the last two letters or blanks of the piece before
    for i in range(0, len(text or ""), PIECE):
        codes = _letters()[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "replace"), np.uint32)]
        c = codes[(codes > 0) | (np.append(before[-1], codes[:-1]) > 0)]  # a run of blanks counts once
        if i + PIECE >= len(text) and len(c) and c[-1] > 0:
            c = np.append(c, 0)
        s, n = np.concatenate([before, c]), len(before)
        one, two = c[c > 0], s[n - 1 : -1] << 42 | 0x1FFFFF << 21 | s[n:]
        three = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[s[1:-1] > 0]
        parts.append(np.unique(np.concatenate([one, two, three]), return_counts=True))
        before = s[-2:]
    return _count(parts)


def top(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TOP most frequent n-grams by falling count, ties by number."""
    return found[np.lexsort((found, -counts))[:TOP]]


def _tally(batches):
    """Counts of n-grams by language, added up before they leave a task."""
    sums: dict[str, list] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            own = sums.setdefault(lang, [])
            own.append(grams(text))
            if len(own) > 256:
                sums[lang] = [_count(own)]
    for lang, own in sums.items():
        found, counts = _count(own)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def fit_profiles(docs: DataFrame) -> DataFrame:
    """(lang, gram, rank): the TOP most frequent n-grams of each non-null lang over all rows of docs."""
    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sums = known.mapInArrow(_tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return sums.select("lang", "gram", rank.alias("rank")).where(F.col("rank") < TOP)


class _Profiles:
    def __init__(self, rows: list):
        self.langs = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), 2 * TOP, np.int64)
        self.ranks[np.searchsorted(self.grams, [r[1] for r in rows]), [number[r[0]] for r in rows]] = [r[2] for r in rows]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance (ties: least name) and 1 - its share of the most."""
        mine = top(*grams(text))
        if not len(mine):
            return UND, 0.0
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        at[self.grams[at] != mine] = len(self.grams)
        ranks = self.ranks[at]
        away = np.where(ranks == 2 * TOP, TOP, np.abs(ranks - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], 1 - float(away[best]) / (TOP * len(mine))


def identify(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to all columns of docs, from each whole text alone.

    A document's TOP most frequent n-grams are held against each profile: the distance adds up by
    how many places each n-gram's rank is off, TOP where the profile has none. The nearest language wins,
    ties by name. Null, empty and letterless texts, and all if there are no profiles: lang_pred
    "und", score 0. Profiles are broadcast LANGS languages at a time, one pass for each such block, written before
    the next. A worker holds one text with its n-grams, PIECE characters' worth at a time.
    Repeated rows get equal results. Empty docs: no rows. Columns of docs named lang_pred or score
    are replaced."""
    spark = docs.sparkSession
    at, columns = f"_{docs.columns.index('text')}", ("lang_pred", "score")
    out = with_text(docs).withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
    langs = sorted(r[0] for r in profiles.select("lang").distinct().collect())
    stash, shared, done = Stash(spark, "langid"), None, None
    for i in range(0, len(langs), LANGS):
        if shared is not None:  # what the block before found is written, so that one block is broadcast at a time
            before, out = done, stash.keep(out, "found")
            shared.destroy()
            if before is not None:
                stash.drop(before)
            done = out
        rows = profiles.where(F.col("lang").isin(langs[i : i + LANGS])).collect()  # TOP rows a language
        shared = spark.sparkContext.broadcast(_Profiles(rows))

        def run(batches, shared=shared, later=i > 0):
            model = shared.value
            for batch in batches:
                best = [model.nearest(t.as_py()) for t in batch.column("text")]
                if later:
                    before = zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist())
                    best = [b if n[0] == UND or (b[0] != UND and b[1] >= n[1]) else n for b, n in zip(before, best)]
                cols = {"lang_pred": pa.array([x for x, _ in best], pa.string()), "score": pa.array([y for _, y in best], pa.float64())}
                yield pa.RecordBatch.from_arrays([cols.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.withColumnRenamed("text", at).select(*shown(docs, but=columns), *columns)


def drop_unidentified(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The rows of docs in which a language was found, as they are."""
    found = identify(with_text(docs), profiles).where(F.col("lang_pred") != UND)
    return found.withColumnRenamed("text", f"_{docs.columns.index('text')}").select(*shown(docs))
