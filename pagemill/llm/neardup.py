"""MinHash near-duplicate groups: banding, verification, and components by alternating stars."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Stash, hidden, row_key, shown
from .words import mix, shingles, slices, word_hashes

WORDS = 5
WORD = r"[^\x20\x09-\x0D]"
BANDS, ROWS = 25, 5  # a pair of similarity 0.85 shares no band once in 2 million times


@lru_cache(2)
def family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """n members (a, b) of the multiply-add-shift family, universal for 32-bit keys."""
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(0, 1 << 63, (n, 1), dtype=np.uint64) for _ in range(2))
    return a * np.uint64(2) + np.uint64(1), b


def minima(keys: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n universal hashes over the keys, as 32-bit numbers."""
    a, b = family(n)
    x = keys >> np.uint64(32)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (a * x[i : i + 4096] + b).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(batches):
    """Per row: number of shingles, two order-free hashes of the set, and the signature."""
    n = BANDS * ROWS
    for batch in batches:
        out = []
        for i, j, data, at in slices(batch.column("text")):
            words, starts = word_hashes(data, at, "space")
            for k in range(j - i):
                s = shingles(words[starts[k] : starts[k + 1]], WORDS)
                if len(s):
                    f1, f2 = int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    out.append((len(s), np.uint64(f1).view(np.int64), np.uint64(f2).view(np.int64), minima(s, n)))
                else:
                    out.append((0, 0, 0, np.zeros(0, np.int32)))
        sizes = [len(x[3]) for x in out]
        sig = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([x[3] for x in out]) if out else np.zeros(0, np.int32), pa.int32()))
        cols = [pa.array([x[c] for x in out], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("doc_id"), *cols, sig], names=["k1", "k2", "doc_id", "n", "f1", "f2", "sig"])


def _sets(batches):
    """The shingle set of each text, as a list of longs."""
    for batch in batches:
        out = []
        for i, j, data, at in slices(batch.column("text")):
            words, starts = word_hashes(data, at, "space")
            out += [shingles(words[starts[k] : starts[k + 1]], WORDS) for k in range(j - i)]
        all_of = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
        sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in out])]), pa.int32()), pa.array(all_of, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), sets], names=["id", "set"])


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b), root being the component's least node.

    Alternates large-star (each node links its larger neighbours to its least one) and small-star
    (each node links its smaller neighbours and itself to the least of them) until neither changes
    an edge, written to the shared folder after each pair of steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select("b", "a"))
            least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return e.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a")
        return e.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    edges = stash.keep(edges, "edges")
    before = state(edges)
    while before[0]:
        after = stash.keep(star(star(edges, True), False), "edges")
        stash.drop(edges)
        edges, now = after, state(after)
        if tuple(now) == tuple(before):
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _prefix_pairs(apart: DataFrame, sets: DataFrame, wanted: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """Pairs (id, id2) of different roots among which every link is, by prefix filtering.

    With its shingles in one order for all, the rarest first, a set of n linked with one of n2 shares one of its
    first n - least + 1 shingles, least being the overlap that the threshold asks of such sizes. What
    only one root has among its first shingles is left out, and so are the pairs within the root that most
    members of a shingle belong to."""
    tokens = apart.join(sets, "id").select("id", "root", F.explode("set").alias("token"))
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token")) - 1
    placed = tokens.join(rare, "token").withColumn("place", place).join(wanted.select("id", "n"), "id")
    first = stash.keep(placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("token", "id", "root", "n", "place"), "first")
    # of a token's members those of its largest root need not meet each other, so the second side is without them
    sizes = first.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    met = sizes.groupBy("token").agg(F.max(F.struct("m", "root")).alias("big"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token", F.col("big.root").alias("big"))
    one = first.join(met, "token")
    two = one.where("root <> big").select("token", *[F.col(c).alias(f"{c}2") for c in ("id", "root", "n", "place")])
    least = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent) - 1e-9)
    near = ((F.col("root") == F.col("big")) | (F.col("root") < F.col("root2"))) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
    return one.join(two, "token").where(near & (F.col("place") <= F.col("n") - least) & (F.col("place2") <= F.col("n2") - least))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * |A and B| >= percent * |A or B| over sets of 5-word shingles.

    Words are runs without ASCII white space, A-Z folded. Rows of equal sets form one class first, so
    copies cost one row each. Classes meet where a band of ROWS minima agrees. In each band bucket
    all members are held against its most central one, by signature and then by full set, and
    linked ones merge. Members of buckets that still hold more than one component meet by the prefix filter,
    whatever the size of their bucket, which finds every link among them. So no pair that shares a band and is
    linked stays apart, yet a bucket of thousands of near copies costs about its size, not its square. The signature
    drops a pair only where six standard errors below the threshold leave no doubt.

    Returns one row per input row: k1, k2 (hash of doc_id and text), doc_id, n_shingles,
    component_id (least doc_id of the component), kept (doc_id = component_id), first (true for
    the rows of one (doc_id, text) per component). Null, empty or wordless texts: no shingles, linked
    with nothing, component_id their own doc_id, kept and first true. Null doc_id: last in order; a component of
    null ids only has component_id null and is kept. Repeated rows repeat. An empty table gives no
    rows; other columns are ignored."""
    stash = Stash(docs.sparkSession, "neardup")
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stash.keep(keyed.mapInArrow(_signed, "k1 long, k2 long, doc_id long, n long, f1 long, f2 long, sig array<int>"), "rows")
    named = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k1", "k2")
    classes = rows.where(F.col("n") > 0).groupBy("f1", "f2", "n").agg(F.min(named).alias("least"), F.first("sig").alias("sig"))
    # ids are given while this table is written, and read from it ever after
    classes = stash.keep(classes.select(F.monotonically_increasing_id().alias("id"), "f1", "f2", "n", "least", "sig"), "classes")

    band = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)])
    bands = classes.select(F.explode(band).alias("band"), "id")
    shared = bands.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where(F.col("lo") < F.col("hi")).select("band")
    members = stash.keep(bands.join(shared, "band"), "members")
    wanted = stash.keep(members.select("id").distinct().join(classes, "id").select("id", "n", "sig", F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2")), "wanted")
    # repeated rows become one in each task before they are brought together
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted.select("k1", "k2", "id"), ["k1", "k2"])
    sets = stash.keep(texts.select("id", "text").mapInArrow(_sets, "id long, set array<long>"), "sets")
    floor = int(np.floor(BANDS * ROWS * (percent / 100 - 6 * np.sqrt(percent * (100 - percent) / 1e4 / (BANDS * ROWS)))))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that pass the size bound, the signature and the full sets."""
        side = lambda x: wanted.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        alike = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        near = near.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (alike >= floor)).select("a", "b", "n_a", "n_b")
        full = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        both = F.size(F.array_intersect("set_a", "set_b"))
        return full.where(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent).select("a", "b")

    def pairs_of(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    # the member of each bucket that shares most buckets with most others is held against the rest
    sized = members.join(members.groupBy("band").agg(F.count(F.lit(1)).alias("m")), "band")
    central = members.join(sized.groupBy("id").agg(F.sum("m").alias("score")), "id")
    pivot = central.groupBy("band").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("p")).select("band", (-F.col("p.neg")).alias("pivot"))
    star = pairs_of(members.join(pivot, "band").where(F.col("id") != F.col("pivot")), "id", "pivot").distinct()
    links = stash.keep(linked(star), "links")
    roots = stash.keep(components(links, stash), "roots")
    tagged = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = tagged.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") < F.col("hi")).select("band")
    apart = stash.keep(tagged.join(apart, "band").select("id", "root").distinct(), "apart")
    todo = pairs_of(_prefix_pairs(apart, sets, wanted, percent, stash), "id", "id2").distinct()
    rest = stash.keep(linked(todo), "links")
    roots = stash.keep(components(rest.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), stash), "roots")
    stash.drop(sets, members)
    slim = classes.select("id", "f1", "f2", "n", "least").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    slim = slim.join(slim.groupBy("root").agg(F.min("least").alias("best")), "root").select("f1", "f2", "n", "best")
    out = rows.select("k1", "k2", "doc_id", "n", "f1", "f2").join(slim, ["f1", "f2", "n"], "left")
    lone = F.col("n") == 0
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    first = lone | ((F.col("best.k1") == F.col("k1")) & (F.col("best.k2") == F.col("k2")))
    return out.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row stays, that of the least
    doc_id (then of the least hash); documents without words all stay. Columns as in docs."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    found = near_duplicates(docs, percent).where("first AND n_shingles > 0").select("k1", "k2").distinct()
    text = f"_{docs.columns.index('text')}"
    plain, worded = hidden(docs, k1=k1, k2=k2), F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    # repeated rows become one in each task before they are brought together
    row = F.struct(*[f"_{i}" for i in range(len(docs.columns))])
    one = plain.where(worded).groupBy("k1", "k2").agg(F.min_by(row, F.col("_0")).alias("row")).join(found, ["k1", "k2"], "left_semi").select("row.*")
    return one.unionByName(plain.where(~worded).drop("k1", "k2")).select(*shown(docs))
