"""Text columns: tokens, shingles, fingerprints, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 60  # of a fingerprint
TOKEN = "[0-9a-zA-Z가-힣一-鿿]+"
# Phrases of pages that say they are missing.
MISSING = ["not found", "page not found", "no longer exists", "does not exist", "doesn't exist", "sorry, we can", "찾을 수 없", "존재하지 않", "페이지를 찾을", "삭제된 게시물", "ページが見つかり", "页面不存在", "未找到"]


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often, and in whatever lambda, it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(words: Column, size: int = 3) -> Column:
    """Runs of ``size`` words; of fewer words, all of them as one."""

    def cut(w: Column) -> Column:
        # single words by their place: a slice of an array would cost its whole length
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))).otherwise(F.array().cast("array<string>"))

    return bound(words, cut)


def md5_long(text: Column) -> Column:
    """The first 63 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def simhash(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, fingerprint): a bit is set where more shingles have it in their md5 than not. Rows are
    summed by key, so a long text is no single row's work."""
    hashed = df.select(key, F.explode(shingles(words)).alias("s")).select(key, md5_long("s").alias("h"))
    # two counters in each sum, as a text has fewer than 2 ** 30 words: of bit i, and of the one 30 above it
    half = BITS // 2
    both = F.lit(1 << half | 1).cast("long")
    sums = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftright("h", i).bitwiseAND(both)).alias(f"b{i}") for i in range(half)])
    value = F.lit(0).cast("long")
    for i in range(BITS):
        ones = F.shiftright(f"b{i - half}", half) if i >= half else F.col(f"b{i}").bitwiseAND(F.lit((1 << half) - 1).cast("long"))
        value = value.bitwiseOR(F.when(ones * 2 > F.col("n"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(key, value.alias("fingerprint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or zero, or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def says_missing(text: Column, limit: int = 160) -> Column:
    """A page without text, or with few words and a phrase that says it is missing."""
    low, hit = F.lower(text), F.lit(False)
    for phrase in MISSING:
        hit = hit | low.contains(phrase)
    return F.coalesce(F.trim(text) == "", F.lit(True)) | (hit & (F.size(tokens(text)) < limit))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 3)).otherwise(0.0)
