import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from pagemill.llm import chat, decontam, langid, licenses, media, mixing, neardup, quality, repeats, sharding, words


def by_row(rows, *cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


# --- words


@given(st.lists(st.text(st.sampled_from("aZé \t\x0b-1\x00ß"), max_size=40), max_size=8), st.sampled_from(["space", "alnum"]))
@settings(max_examples=60, deadline=None)
def test_words_and_spots(texts, kind):
    import re

    data, at = words.flat(pa.array(texts, pa.string()))
    hashes, starts, first, stop = words.word_hashes(data, at, kind, spots=True)
    word = r"[^\x20\x09-\x0D]+" if kind == "space" else r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = [re.findall(word, brute.fold(t)) for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert [brute.fold(data[a:b].tobytes().decode()) for a, b in zip(first, stop)] == flat
    assert len(set(zip(hashes.tolist(), flat))) == len(set(flat)) == len(set(hashes.tolist()))


def test_words_across_pieces(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)) + "x" * 300
    data = np.frombuffer(text.encode(), np.uint8)
    whole = words.word_hashes(data, np.array([0, len(data)]), "space")
    monkeypatch.setattr(words, "SLICE", 64)
    words.powers.cache_clear()
    pieces = words.word_hashes(data, np.array([0, len(data)]), "space")
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


# --- 1 licenses


def test_licenses(spark, odd_docs, no_docs):
    mit = licenses.TEMPLATES["MIT"][1]
    body = mit.split()
    body[10] = body[40] = "changed"
    texts = ["x y Released under the MIT License. z", "RELEASED under the mit license released under the MIT license", "Licensed under CC BY-NC 4.0.", "Released under the BSD License", " ".join(body), f"a {mit} b", "the " * 50, None, ""]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, licenses int")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert [[x.license for x in got[i]] for i in range(len(texts))] == [["MIT"], ["MIT", "MIT"], ["CC-BY-NC-4.0"], [], ["MIT"], ["MIT"], [], [], []]
    spot = got[0][0]
    assert texts[0].encode()[spot.start : spot.stop] == b"Released under the MIT License" and spot.coverage == 1
    assert 0.9 < got[4][0].coverage < 1
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count()
    assert licenses.scan_licenses(no_docs).count() == 0
    own = licenses.scan_licenses(docs, templates={"House": ["the house license of this corpus"]}).collect()
    assert not any(r.licenses for r in own)


def test_every_notice_is_found_as_itself(spark):
    forms = [(name, f) for name, fs in licenses.TEMPLATES.items() for f in fs]
    rng = random.Random(8)
    noise = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30))
    texts = [(i, f"{noise()} {f.upper() if i % 2 else f} {noise()}") for i, (_, f) in enumerate(forms)]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (name, form) in enumerate(forms):
        (one,) = got[i]
        assert (one.license, one.coverage) == (name, 1.0)
        assert texts[i][1].encode()[one.start : one.stop].decode().lower().startswith(form[:12].lower())


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
@settings(max_examples=200, deadline=None)
def test_patience_pairs_rise(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def plain_patience(a, b):
    """As the definition says it: equal heads, equal tails, then the longest rising run of words that both have once."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)] + [(len(a) - i, len(b) - i) for i in range(1, tail + 1)]
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    once = [(i, mid_b.index(w)) for i, w in enumerate(mid_a) if mid_a.count(w) == 1 and mid_b.count(w) == 1]
    best = []  # the longest rising run that ends at each pair
    for n, (_, y) in enumerate(once):
        runs = [best[m] for m in range(n) if once[m][1] < y]
        best.append(max(runs, key=len, default=[]) + [once[n]])
    anchors = max(best, key=len, default=[])
    edges = [(-1, -1), *anchors, (len(mid_a), len(mid_b))]
    inner = list(anchors)
    if anchors:
        for (p, q), (x, y) in zip(edges, edges[1:]):
            inner += [(p + 1 + i, q + 1 + k) for i, k in plain_patience(mid_a[p + 1 : x], mid_b[q + 1 : y])]
    return sorted(out + [(i + head, k + head) for i, k in inner])


def plain_notices(text, templates, coverage):
    """Each place of a text held against each template, without any test before the alignment."""
    import re

    spots = [(m[0], len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.fold(text))]
    own, found = [w for w, _, _ in spots], []
    for name, forms in sorted(templates.items()):
        for form in forms:
            t = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.fold(form))
            need, skip = -(-coverage * len(t) // 1), 0
            for p in range(len(own)):
                if p < skip:
                    continue
                for size in (2 * len(t), len(t) + len(t) // 4):
                    pairs = plain_patience(own[p : p + size], t)
                    if pairs and pairs[0][0] == 0 and len(pairs) >= need - 1e-9:
                        skip = p + pairs[-1][0] + 1
                        found.append((name, len(pairs) / len(t), len(pairs), spots[p][1], spots[skip - 1][2]))
                        break
    kept = []
    for x in sorted(found, key=lambda x: (x[3] - x[4], -x[2], -x[1], x[0], x[3])):
        if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[3])


def test_notices_as_by_holding_each_place_against_each_template(spark, tmp_path):
    """The query over texts made of notices, whole, cut, doubled, shuffled and edited, among words that templates are full of."""
    rng = random.Random(12)
    forms = [f for x in licenses.TEMPLATES.values() for f in x]
    common = "the of or to and software license a is this in any".split()
    texts = []
    for _ in range(24):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(forms).split()[:60]
            what = rng.random()
            if what < 0.3:
                words = [w if rng.random() > 0.1 else rng.choice(common) for w in words]
            elif what < 0.45:
                rng.shuffle(words)
            elif what < 0.6:
                words = words[: rng.randint(1, len(words))]
            parts += words + rng.choices(common, k=rng.randint(0, 20))
        texts.append(" ".join(parts))
    texts += [None, "", "the of or to " * 40, "é the MIT license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in __spark_entry__.queries()["op1_patience_licenses"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = plain_notices(t or "", licenses.TEMPLATES, licenses.COVERAGE)
        assert [(x.license, x.coverage, x.words, x.start, x.stop) for x in got[i].notices] == want
        assert (got[i].n_notices, got[i].licenses) == (len(want), ",".join(sorted({x[0] for x in want})))


def test_words_that_repeat_cost_their_length():
    """A long text of a template's common words holds no stretch of enough of its words, so nothing is aligned."""
    import time

    texts = pa.array(["the of or to and software " * 40_000])
    data, at = words.flat(texts)
    hashes, starts = words.word_hashes(data, at, "alnum")
    scanner = licenses._Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    began = time.perf_counter()
    assert list(scanner.scan(hashes, starts)) == [] and time.perf_counter() - began < 10


# --- 2 quality


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(5)
    texts = []
    for i in range(400):
        good = " ".join(rng.choices("alpha beta gamma delta".split(), k=20))
        texts.append((i, good if i % 4 else " ".join(w.upper() + "!!" for w in good.split()), int(i % 4 > 0)))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts if t[0] % 5] + [(None, 1), (3, None), (9999, 1)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    held = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all((held[i] >= 0.5) == bool(y) for i, _, y in texts if i % 5 == 0)
    odd = quality.score_quality(odd_docs, model)
    assert set(odd.columns) == set(odd_docs.columns) and odd.where("score between 0 and 1").count() == odd_docs.count()
    assert quality.score_quality(no_docs, model).count() == 0
    assert not quality.fit(no_docs, labels.where("false")).any()


# --- 3 mixing


def mix_rows(docs):
    return mixing.mix_sources(docs).documents.collect()


def test_mix(odd_docs, odd_rows, no_docs):
    import re

    rows = mix_rows(odd_docs)
    assert len(rows) == len(odd_rows)
    assert by_row(rows, "doc_id", "size") == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in odd_rows)
    of = defaultdict(list)
    for r in rows:
        assert r.taken <= 2 * r["size"]
        of[r.source_size].append(r)
    for size, own in of.items():
        assert sum(r["size"] for r in own) == size
        assert sum(r.taken for r in own) == int(own[0].target + 1e-6)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_rows(odd_docs.repartition(5))), key=str)
    out = mixing.mixed_documents(odd_docs, mixing.mix_sources(odd_docs))
    assert out.columns == odd_docs.columns
    assert by_row(out.collect(), "doc_id").total() == sum(len(r.slots) for r in rows)
    assert mix_rows(no_docs) == [] and mixing.mixed_documents(no_docs, mixing.mix_sources(no_docs)).count() == 0


def test_targets_refill(spark):
    sizes = [("a", 100), ("b", 5), ("c", 1000), ("d", 40), (None, 7), ("e", 0)]
    df = spark.createDataFrame([("s" + s if s else "n", s, n) for s, n in sizes], "key string, source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    size, total, open_, want = dict(sizes), 1.5 * sum(n for _, n in sizes), set(names), {}
    while open_:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ = open_ - over if over else set()
    assert got == pytest.approx(want)


def test_schedule_spreads_sources(spark, monkeypatch, tmp_path):
    """Any first slots, and any first rows of the mix, hold the sources as the whole does; a schedule that is spoilt shows."""
    docs = spark.createDataFrame([(i, f"w{i} " * 50, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    query = __spark_entry__.queries()["op3_mix_sources"]

    def furthest(keys, share):
        """The most that a first part of keys is off its share."""
        return max(abs(sum(k == key for k in keys[:n]) - part * n) for key, part in share.items() for n in range(10, len(keys), 10))

    def run():
        mix = mixing.mix_sources(docs)
        slots = [k for _, k in sorted((r.slot, r.key) for r in mix.schedule.collect())]
        out = [r.source for r in mixing.mixed_documents(docs, mix).collect()]
        share = lambda keys: {k: n / len(keys) for k, n in Counter(keys).items()}
        told = by_row(query(spark, str(tmp_path)).collect(), "doc_id", "taken", "first_slot", "second_slot")
        return furthest(slots, share(slots)), furthest(out, share(out)), told

    slots, rows, told = run()
    assert slots < 12 and rows < 12
    monkeypatch.setattr(mixing, "GOLDEN", 1)  # all points next to 0
    slots, rows, spoilt = run()
    assert slots > 100 and rows > 40 and told != spoilt


def test_mix_comes_in_the_order_of_its_slots(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 40), "abcd"[i % 3]) for i in range(400)], "doc_id long, text string, source string").repartition(4)
    mix = mixing.mix_sources(docs)
    want = sorted((slot, r["at"], r.doc_id) for r in mix.documents.collect() for slot in r.slots)
    assert [r.doc_id for r in mixing.mixed_documents(docs, mix).collect()] == [i for _, _, i in want]
    slots = defaultdict(list)  # with an order for each partition, every document's slots are met in it from the first on
    for slot, _, i in want:
        slots[i].append(slot)
    parts = mixing.mixed_documents(docs, mix, one_order=False).select("doc_id", F.spark_partition_id().alias("p")).collect()
    for p in {r.p for r in parts}:
        met = [slots[r.doc_id].pop(0) for r in parts if r.p == p]
        assert met == sorted(met)
    assert not any(slots.values())


# --- 4 repeats


def test_repeats(spark, odd_docs, odd_rows, no_docs):
    for depth, gram in ((400, 100), (60, 20)):
        got = repeats.remove_repeats(odd_docs, depth, gram)
        assert got.columns == [c for c in odd_docs.columns if c not in ("kept", "spans")] + ["kept", "spans"]
        rows = got.collect()
        want = Counter((i, t, k, n) for (i, t), (k, n) in zip(odd_rows, brute.repeat_cut([t for _, t in odd_rows], depth)))
        assert Counter((r.doc_id, r.text, bytes(r.kept), len(r.spans)) for r in rows) == want
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_of_edited_copies(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh é", k=1500))
    texts = [(0, base), (1, "zz" + base[5:]), (2, base[:700] + "Q" + base[701:])]
    for i in range(3, 40):
        a = rng.randrange(len(base))
        b = min(len(base), a + rng.randrange(30, 500))
        texts.append((i, "".join(rng.choices("uvwxyz", k=rng.randrange(80))) + base[a:b] + "".join(rng.choices("uvwxyz", k=rng.randrange(80)))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = dict(zip((i for i, _ in texts), brute.repeat_cut([t for _, t in texts], 60)))
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in repeats.remove_repeats(docs, 60, 20).collect()}
    assert got == want


@pytest.mark.parametrize("size", [500, 997])
def test_repeats_across_parts(spark, monkeypatch, size):
    """Texts read in parts: a run that spans a cut is one place; empty texts may fill a slice."""
    monkeypatch.setattr(repeats, "SLICE", size)
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh é", k=6000))
    texts = [None, "", long, "".join(rng.choices("abcdefgh é", k=3000)) + long[2400:3700], long[950:1010], long[:90] + "Q" + long[91:400]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = dict(enumerate(brute.repeat_cut(texts, 60)))
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in repeats.remove_repeats(docs, 60, 20).collect()}
    assert got == want


def test_runs_do_not_depend_on_parts():
    data = np.random.default_rng(3).integers(97, 123, 9000).astype(np.uint8)
    whole = repeats._anchored(data, np.array([0, len(data)]), 60, 20)
    for most in (64, 500, 997):
        assert all((a == b).all() for a, b in zip(whole, repeats._anchored(data, np.array([0, len(data)]), 60, 20, most)))
    assert [len(x) for x in repeats._anchored(data[:0], np.zeros(3, np.int64), 60, 20)] == [0] * 4


# --- 5 languages


def test_languages(spark, odd_docs, no_docs):
    rng = random.Random(1)
    make = {"aa": "ka lo mi tu".split(), "bb": "sche ung ich ver".split(), "cc": "д ле жи ну".split()}
    rows = [(i, " ".join("".join(rng.choices(make[x], k=3)) for _ in range(30)), x) for i, x in enumerate(sorted(make) * 12)]
    docs = spark.createDataFrame(rows + [(99, "12 34 --", "aa"), (100, None, "bb"), (101, "KALOMI", None)], "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(docs.where("doc_id % 5 != 1"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs.drop("lang"), profiles).collect()}
    assert all(got[i][0] == x and 0 < got[i][1] <= 1 for i, _, x in rows)
    assert got[99] == got[100] == ("und", 0.0) and got[101][0] == "aa"
    langid_one_at_a_time = langid.LANGS
    try:
        langid.LANGS = 1
        assert got == {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs.drop("lang"), profiles).collect()}
    finally:
        langid.LANGS = langid_one_at_a_time
    odd = langid.drop_unidentified(odd_docs, profiles)
    assert odd.columns == odd_docs.columns
    assert odd.count() == odd_docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert langid.identify(odd_docs, langid.fit_profiles(no_docs)).where("lang_pred != 'und'").count() == 0
    assert langid.identify(no_docs, profiles).count() == 0


@given(st.text(st.sampled_from("aBé 1-ß"), max_size=60))
@settings(max_examples=80, deadline=None)
def test_grams(text):
    low = [c.lower() if c.isalpha() else " " for c in text]
    spelled = " " + " ".join("".join(low).split()) + " " if "".join(low).strip() else ""
    want = Counter()
    for i, c in enumerate(spelled):
        if c != " ":
            want[c] += 1
        if i + 2 <= len(spelled):
            want[spelled[i : i + 2]] += 1
        if i + 3 <= len(spelled) and spelled[i + 1] != " ":
            want[spelled[i : i + 3]] += 1
    num = lambda g: {1: lambda a: a, 2: lambda a, b: a << 42 | 0x1FFFFF << 21 | b, 3: lambda a, b, c: a << 42 | b << 21 | c}[len(g)](*(0 if c == " " else ord(c) for c in g))
    whole = langid.grams(text)
    assert dict(zip(*map(np.ndarray.tolist, whole))) == {num(g): n for g, n in want.items()}
    piece, langid.PIECE = langid.PIECE, 5
    try:
        assert [x.tolist() for x in langid.grams(text)] == [x.tolist() for x in whole]
    finally:
        langid.PIECE = piece


# --- 6 shards


@given(st.lists(st.integers(1, 60), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing(sizes):
    got = sharding.best_fit_decreasing(sizes, 60)
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        want[i] = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(60)
        room[want[i]] -= sizes[i]
    assert got == want


def test_shards(spark, odd_docs, odd_rows, no_docs):
    rows = sharding.pack_shards(odd_docs, n_shards=5).collect()
    raw = [(i, (t or "").encode()) for i, t in odd_rows]
    assert by_row(rows, "doc_id", "size", "text_crc32") == Counter((i, len(b) + 8, zlib.crc32(b)) for i, b in raw)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    rng = random.Random(2)
    many = [(i, "copy " * 20 if i % 3 == 0 else "".join(rng.choices("abc ", k=rng.randint(1, 300)))) for i in range(4000)]
    rows = sharding.pack_shards(spark.createDataFrame(many, "doc_id long, text string"), n_shards=8).collect()
    load, shards = Counter(), defaultdict(set)
    text = dict(many)
    for r in rows:
        load[r.shard] += r["size"]
        shards[text[r.doc_id]].add(r.shard)
    assert max(load.values()) < 1.03 * sum(load.values()) / 8
    assert all(len(s) == 1 for t, s in shards.items() if not t.startswith("copy copy"))
    kept = sharding.pack_shards(odd_docs, n_shards=5, keep_text=True)
    assert set(odd_docs.columns) <= set(kept.columns) and len(set(kept.columns)) == len(kept.columns)
    assert by_row(kept.collect(), "doc_id", "text") == Counter(odd_rows)
    assert sharding.pack_shards(no_docs).count() == 0


def test_shards_keep_groups_whole_beside_a_large_document(spark):
    """A document above a shard's capacity is no reason to split groups that fit."""
    rows = [(0, "L" * 10_000)] + [(1 + 10 * g + i, f"{g}" * 60) for g in range(10) for i in range(10)]
    text, shards = dict(rows), defaultdict(set)
    for r in sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=4).collect():
        shards[text[r.doc_id]].add(r.shard)
    assert len(shards) == 11 and all(len(s) == 1 for s in shards.values())


def packed_plainly(rows, n, head):
    """{text: shard} by the rule of pack_shards, in plain Python; groups fit in a shard."""
    groups = Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 8
    digest = lambda t: b"" if t is None else hashlib.sha256(t.encode()).digest()[:16]
    size = lambda t: len((t or "").encode())
    room = -(-sum(groups.values()) // n)
    order = sorted(groups, key=lambda t: (-groups[t], digest(t)))
    room_of, out = [room] * n, {}
    while 0 < head < len(order) and groups[order[head - 1]] == groups[order[head]]:
        head -= 1  # groups of equal bytes all or none
    for t in order[:head]:
        fits = [(r, b) for b, r in enumerate(room_of) if r >= groups[t]]
        out[t] = min(fits)[1] if fits else max((r, b) for b, r in enumerate(room_of))[1]
        room_of[out[t]] -= groups[t]
    rest = sorted(order[head:], key=lambda t: (-size(t), digest(t)))
    filled, left = [room - r for r in room_of], sum(groups[t] for t in rest)
    height = next(h for h in range(max(filled) + left + 1) if sum(max(0, h - x) for x in filled) >= left)
    bins = sorted((b for b in range(n) if height > filled[b]), key=lambda b: (height - filled[b], b))
    done, k, upto = 0, 0, height - filled[bins[0]] if bins else 0
    for t in rest:
        while done >= upto and k + 1 < len(bins):
            k += 1
            upto += height - filled[bins[k]]
        out[t] = bins[k]
        done += groups[t]
    return out


@pytest.mark.parametrize("head", [1000, 40, 1])
def test_shards_against_plain_packing(spark, head):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abé ", k=rng.choice([3, 30, rng.randint(1, 400)]))) for _ in range(300)] + [None, ""]
    rows = [(i, rng.choice(texts)) for i in range(900)]
    got = {}
    found = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=6, head=head, keep_text=True).collect()
    for r in found:
        assert got.setdefault(r.text, r.shard) == r.shard  # equal texts together
    assert got == packed_plainly(rows, 6, head)
    load = Counter()
    for r in found:
        load[r.shard] += r["size"]
    largest = max(Counter({t: sum(len((t or "").encode()) + 8 for _, x in rows if x == t) for t in texts}).values())
    assert max(load.values()) - min(load.values()) <= 2 * largest


@pytest.mark.parametrize("head", [1000, 5])
def test_fewest_shards_of_a_capacity(spark, head):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(1, 90) + str(i % 150)) for i in range(400)] + [(900, "y" * 2000)]
    load, shards = Counter(), defaultdict(set)
    for r in sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), capacity=1500, head=head, keep_text=True).collect():
        load[r.shard] += r["size"]
        shards[r.text].add(r.shard)
    assert all(len(s) == 1 for s in shards.values()) and sorted(load) == list(range(len(load)))
    assert sorted(load.values())[-1] == 2008 and sorted(load.values())[-2] <= 1500
    assert len(load) <= 1 + 1.25 * (sum(load.values()) - 2008) / 1500 + 1


# --- 7 media


@given(st.binary(max_size=400) | st.integers(0, 3000).map(lambda n: bytes(i * 7 & 255 for i in range(n * 97))))
@settings(max_examples=60, deadline=None)
def test_stream_round_trip(payload):
    stream = media.mux(payload)
    assert len(stream) % 188 == 0 and stream[::188] == b"\x47" * (len(stream) // 188)
    got = media.demux(stream)
    assert got["payload"] == payload and got["continuity_errors"] == got["errors"] == 0
    assert [u["pts"] for u in got["units"]] == [i * media.TICKS for i in range(max(1, -(-len(payload) // media.UNIT)))]
    assert [u["random_access"] for u in got["units"]] == [i % media.GROUP == 0 for i in range(len(got["units"]))]


def test_stream_faults():
    stream = media.mux(b"x" * 50_000)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    lost = b"".join(packets[:10] + packets[11:])
    assert media.demux(lost)["continuity_errors"] == 1
    assert media.demux(b"".join(packets[:10] + packets[9:]))["payload"] == b"x" * 50_000
    assert media.demux(stream[:-5])["errors"] == 1
    assert media.demux(b"junk")["errors"] == 1 and media.demux(None)["payload"] == b""
    bad = bytearray(stream)
    bad[188 * 4] = 0
    assert media.demux(bytes(bad))["errors"] == 1


def table_packets(pid, sections, start=0):
    body = b"\0" + b"".join(sections)
    parts = [body[i : i + 184].ljust(184, b"\xff") for i in range(0, len(body), 184)]
    return [bytes([0x47, 0x40 * (not i) | pid >> 8, pid & 255, 0x10 | (start + i) & 15]) + p for i, p in enumerate(parts)]


def test_stream_tables_over_packets():
    payload = b"y" * 5000
    packets = [media.mux(payload)[i : i + 188] for i in range(0, len(media.mux(payload)), 188)]
    es = [x for x in packets if (x[1] & 0x1F) << 8 | x[2] == media.ES_PID]
    pat = table_packets(0, [media._section(0, 1, bytes([0, 1, 0xE1, 0])), media._section(0, 1, bytes([0, 2, 0xE1, 0x10]))])
    told = b"".join(bytes([6, 0xE0 | p >> 8, p & 255, 0xF0, 3, 1, 1, 0]) for p in [*range(0x200, 0x240), media.ES_PID])
    pmt = table_packets(media.PMT_PID, [media._section(2, 1, bytes([0xE1, 1, 0xF0, 0]) + told)])
    assert len(pmt) > 2
    got = media.demux(b"".join(pat + pmt[:1] + pmt[:1] + pmt[1:] + es))
    assert got["payload"] == payload and len(got["streams"]) == 65 and got["errors"] == 0
    assert [p["number"] for p in got["programs"]] == [1, 2]
    assert media.demux(b"".join(pat + pmt[:-1] + es))["errors"] == 1
    assert media.demux(b"".join(pat + pmt[:1] + pmt[2:] + es))["errors"] == 1
    wrong = pmt[0][:-1] + bytes([pmt[0][-1] ^ 1])
    assert media.demux(b"".join([*pat, wrong, *pmt[1:], *es]))["errors"] == 1


def test_media(odd_docs, odd_rows, no_docs):
    rows = media.read_media(media.store_media(odd_docs)).collect()
    want = Counter()
    for i, t in odd_rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert by_row(rows, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert media.read_media(media.store_media(no_docs)).count() == 0


# --- 8 near duplicates


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(odd_docs, odd_rows, no_docs, percent):
    component, sizes = brute.near_groups(odd_rows, percent)
    rows = neardup.near_duplicates(odd_docs, percent).collect()
    want = Counter((i, sizes[k], component[k]) for k, (i, _) in enumerate(odd_rows))
    assert by_row(rows, "doc_id", "n_shingles", "component_id") == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    if percent == 80:
        out = neardup.one_of_each(odd_docs, percent)
        assert out.columns == odd_docs.columns
        groups = {component[k] if i is not None else "none" for k, (i, _) in enumerate(odd_rows) if sizes[k]}
        worded = [r for r in out.collect() if (r.text or "").strip()]
        assert len(worded) == len(groups)
        assert out.count() - len(worded) == sum(not s for s in sizes)
        assert neardup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_one_template(spark):
    """Hundreds of near copies in few buckets, of which some link only through others."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(240):
        own = list(base)
        for p in rng.sample(range(120), rng.choice([1, 1, 2, 3, 4])):
            own[p] = f"e{i}_{p}"
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    component, _ = brute.near_groups(texts, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 85).collect()}
    assert got == {i: component[i] for i, _ in texts}


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    from pagemill.llm.storage import Stash

    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"), Stash(spark, "test")).collect()
    assert {r.node: r.root for r in got} == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


# --- 9 decontamination


def test_contamination(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    passage = odd_rows[8][1]
    items = [("b", passage), ("a", passage[50:]), (None, "one TWO"), ("c", "é"), ("d", None), ("e", ""), ("f", "?"), ("a", passage[50:]), ("g", "one two three four five six"), ("h", odd_rows[10][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = Counter((i, *brute.window_hits(t, items)[:2], ",".join(brute.window_hits(t, items)[2])) for i, t in odd_rows)
    for block in (decontam.BLOCK, 100):
        monkeypatch.setattr(decontam, "BLOCK", block)
        monkeypatch.setattr(decontam, "SEGMENT", block)
        out = decontam.find_contamination(odd_docs, bench)
        got = out.select("doc_id", "n_words", decontam.hit_words(F.col("spans")).alias("n_hit"), F.array_join("items", ",").alias("items")).collect()
        assert Counter(map(tuple, got)) == want
    for r in out.where("doc_id = 42").collect():
        assert [r.text[s.start : s.stop] for s in r.spans] == [r.text]
    clean = decontam.drop_contaminated(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    assert clean.count() == sum(n for (_, n_words, n_hit, _), n in want.items() if not (n_hit and 20 * n_hit >= n_words))
    assert decontam.find_contamination(no_docs, bench).count() == 0
    assert decontam.drop_contaminated(odd_docs, bench.where("false")).count() == len(odd_rows)


@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_fm_index(stretches):
    ids = np.array([x for s in stretches for x in s], np.int32)
    end = np.cumsum([len(s) for s in stretches])
    index = decontam.FMIndex(ids, end - [len(s) for s in stretches], end, 4)
    for n in (1, 2, 3):
        patterns = np.unique(np.array(np.meshgrid(*[[1, 2, 3, 4]] * n)).reshape(n, -1).T, axis=0)
        which, low, high = index.search(patterns)
        got = {tuple(patterns[w].tolist()): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
        want = defaultdict(list)
        for s, e in zip(stretches, end):
            for i in range(len(s) - n + 1):
                want[tuple(s[i : i + n])].append(int(e) - len(s) + i)
        assert got == dict(want)


# --- 10 chat


def test_trees(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|>\n", "a\\b\\", "<|turn|>x<|text|>", None, "", "<\\|end|>\n", "end<", "[[INST]]<<SYS>>"]
    nodes = [("t", f"n{i}", f"n{(i - 1) // 2}" if i else None, "assistant" if i % 2 else "user", said[i], float(i)) for i in range(9)]
    nodes += [(None, "z", "missing", None, "lone", None), ("loop", "p", "q", "user", "x", 1.0), ("loop", "q", "p", "user", "x", 1.0), ("loop", "r", "q", "assistant", "x", 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    out = chat.format_trees(df)
    rows = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    by = {n[1]: n for n in nodes}
    paths = {}
    for leaf in ("n4", "n5", "n6", "n7", "n8", "z"):
        path = [leaf]
        while by[path[0]][2] in by:
            path.insert(0, by[path[0]][2])
        paths[leaf] = [by[x] for x in path]
    assert {r.leaf: [(t.role, t.text) for t in r.turns] for r in rows} == {k: [(n[3] or "", n[4] or "") for n in p] for k, p in paths.items()}
    assert {r.leaf: r.loss for r in rows} == {k: "".join(n[4] or "" for n in p if n[3] == "assistant") for k, p in paths.items()}
    mean = {k: sum(n[5] or 0 for n in p) / len(p) for k, p in paths.items()}
    order = sorted((k for k in paths if k != "z"), key=lambda k: (-mean[k], k))
    assert {r.leaf: r.branch for r in rows if r.tree == "t"} == {k: i + 1 for i, k in enumerate(order)}
    best = chat.format_trees(df, branches=2).where("tree = 't'").collect()
    assert {r.leaf for r in best} == set(order[:2])
    assert chat.format_trees(df.where("false")).count() == 0


def test_conversations(spark):
    rows = [(1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, None, "system", "a"), (None, 1, "user", "x"), (None, 2, "assistant", None), (2, 1, "user", "same"), (2, 1, "user", "same"), (3, 5, None, None)]
    rows += [(4, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    out = chat.format_trees(chat.conversation_nodes(df))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in out.select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want[c].append((r or "", x or ""))
    assert got == dict(want)


def test_release_deletes_what_operators_wrote(spark, odd_docs, tmp_path):
    import os

    from pagemill.llm import storage

    storage.release(spark)
    root = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    mine = storage.Stash(spark, "mine")
    kept = mine.keep(odd_docs, "docs")
    sharding.pack_shards(odd_docs, n_shards=2).write.parquet(f"{tmp_path}/out")
    storage.release(spark, but=(mine,))
    assert kept.count() == odd_docs.count() and len(set(os.listdir(root)) - before) == 1
    storage.release(spark)
    assert set(os.listdir(root)) == before
