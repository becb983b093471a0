"""Filter audit, whitening and line rules, held against plain Python versions."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations, product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from pagemill.llm import audit, lines, whiten

WORD = r"[^\x20\x09-\x0D]+"


def plain_fails(rows):
    """Failed filters of each (doc_id, text), as letters."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t in rows:
        t, w = t or "", re.findall(WORD, t or "")
        told = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])
        out.append({f for f, x in zip("ABCDE", told) if x})
    return out


def plain_audit(parts, fails, good, toxic):
    out = []
    for part in set(parts):
        mine = [k for k, p in enumerate(parts) if p == part]
        whole, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                redundant = sum(f in fails[k] for k in mine) - len(gone)
                left = [k for k in left if f not in fails[k]]
                whole[f] += len(gone)
                alone = sum(fails[k] == {f} for k in mine)
                rows.append((part, "".join(order), step, len(left), len(gone), redundant, alone, sum(good[k] for k in gone), sum(toxic[k] for k in gone), f))
        out += [(*r[:-1], whole[r[-1]]) for r in rows]
    return Counter(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture
def marked(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [long, long + "$", " ".join(["a b"] * 130), long.upper(), "", None, "x " * 199, "x " * 200, long, long, "é" * 50 + "ABC", "A" * 3 + "b" * 97, "A" * 4 + "b" * 97, "a b " * 200]
    rows = [(i if i % 9 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(90)]
    rows += [(7, long, "en"), (7, long, "en"), (7, long, "fr"), (-4, long, "de")]
    return rows, [(i, i % 2, i % 3 == 0) for i in range(-10, 60)] + [(3, 0, True), (5, None, None), (None, 1, True), (4, 1, False), (4, 1, False)]


def test_audit_query(spark, marked, tmp_path):
    rows, labels = marked
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, bits string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = __spark_entry__.queries()["op11_filter_audit"](spark, str(tmp_path)).collect()
    flag = lambda k: {r[0] for r in labels if r[0] is not None and r[k]}
    good, toxic = flag(1), flag(2)
    want = plain_audit([g or "" for *_, g in rows], plain_fails([r[:2] for r in rows]), [r[0] in good for r in rows], [r[0] in toxic for r in rows])
    assert Counter(tuple(r[c] for c in AUDIT) for r in got) == want and max(want.values()) == 1


def test_audit_of_odd_documents(odd_docs, odd_rows, no_docs, monkeypatch):
    marked = audit.document_filters(odd_docs)
    want = Counter((i, "".join(sorted(f))) for (i, _), f in zip(odd_rows, plain_fails(odd_rows)))
    assert Counter((r.doc_id, "".join(f for f in "ABCDE" if r[f])) for r in marked.collect()) == want
    assert marked.columns == ["doc_id", "part", *"ABCDE"]
    assert audit.document_filters(no_docs).count() == 0
    flags = {f: F.col(f) for f in "ABCDE"}
    assert audit.filter_audit(audit.document_filters(no_docs), F.col("part"), flags, {}).count() == 0
    # tasks that hand on their counts early, and more parts than rows of some
    monkeypatch.setattr(audit, "PARTS", 2)
    by_id = marked.withColumn("part", F.coalesce(F.col("doc_id") % 7, F.lit(-1)).cast("string"))
    got = audit.filter_audit(by_id, F.col("part"), flags, {"good": F.lit(None).cast("boolean"), "toxic": F.col("doc_id") > 40})
    rows = by_id.collect()
    want = plain_audit([r.part for r in rows], [{f for f in "ABCDE" if r[f]} for r in rows], [False] * len(rows), [(r.doc_id or 0) > 40 for r in rows])
    assert Counter(tuple(r[c] for c in AUDIT) for r in got.collect()) == want


def test_audit_of_other_filters(spark):
    df = spark.createDataFrame([("p", 1), ("p", 3), ("p", 0), ("q", 2)], "part string, n int")
    got = audit.filter_audit(df, F.col("part"), {"odd": F.col("n") % 2 == 1, "big": F.col("n") > 2}, {"one": F.col("n") == 1}).where("part = 'p'")
    shown = {(r.filter_order, r.filter): (r.kept, r.removed, r.redundant, r.unique_fails, r.one_lost, r.shapley) for r in got.collect()}
    assert shown == {("oddbig", "odd"): (1, 2, 0, 1, 1, 3), ("oddbig", "big"): (1, 0, 1, 0, 0, 1), ("bigodd", "big"): (2, 1, 0, 0, 0, 1), ("bigodd", "odd"): (1, 1, 1, 1, 1, 3)}
    with pytest.raises(ValueError):
        audit.filter_audit(df, F.col("part"), {str(k): F.lit(True) for k in range(7)}, {})


@given(st.lists(st.text(st.sampled_from("aB $é\n"), max_size=60), max_size=3), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_pieces_cut_between_words(texts, most):
    for t in texts:
        data = t.encode()
        assert b"".join(audit.pieces(data, most)) == data and [w for p in audit.pieces(data, most) for w in p.split()] == data.split()


# --- whitening


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [0.5] * 5), (905, []), (906, [1e30] + [0.0] * 11), (None, [0.1] * 12), (7, rows[7][1]), (7, rows[8][1])]
    return rows + odd


def test_whitening_query(spark, vectors, tmp_path):
    kept = [(i, v) for i, v in vectors if v is not None and len(v) == 12 and all(c is not None and abs(c) < 1e20 for c in v)]
    spark.createDataFrame([(i, v, 1, "n") for i, v in vectors], "vec_id long, embedding array<float>, label int, vector string").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = __spark_entry__.queries()["op12_whiten_embeddings"](spark, str(tmp_path)).collect()
    x = np.floor(np.array([np.array(v, np.float32) for _, v in kept], float) * 1024).astype(int) + 100000
    n, sums = len(x), x.sum(axis=0)
    cov = np.cov(x.T, bias=True)
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1], parts[:, ::-1]
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({k: 8 * c for k, c in Counter((i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))) for (i, _), row in zip(kept, x)).items()})
    white = (x - sums / n) @ parts[:, :8] / np.sqrt(values[:8])
    by = defaultdict(list)
    for r in got:
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-8
        by[r.vec_id, r.component].append(r.whitened)
    for c in range(1, 9):  # up to one sign a component
        mine = [by[i, c] for i in range(20, 120)]
        theirs = np.array([white[i, c - 1] for i in range(20, 120)])
        flat = np.array([v[0] for v in mine])
        assert min(abs(flat - theirs).max(), abs(flat + theirs).max()) < 1e-7
    assert sorted(by[7, 1]) != sorted([by[7, 1][0]] * 3)  # rows of one id are told apart by their vectors


def test_whitening_of_little(spark):
    of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):  # nothing, or nothing that differs
        kept, d = whiten.usable(of(rows))
        assert whiten.whitened(kept, d, whiten.fit(kept, d)).count() == 0
    kept, d = whiten.usable(of([(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0])]))  # one direction
    got = whiten.whitened(kept, d, whiten.fit(kept, d)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9), round(r.explained, 9)) for r in got] == [(1, 1, 2, 2048**2, -1.0, 1.0), (2, 1, 2, 2048**2, 1.0, 1.0)]
    kept, d = whiten.usable(of([(1, [0.0]), (2, [2.0**29])]))  # a deviation above a long
    assert [r.deviation for r in whiten.whitened(kept, d, whiten.fit(kept, d)).collect()] == [None, None]


@given(st.lists(st.lists(st.integers(-(2**39), 2**39), min_size=3, max_size=3), min_size=1, max_size=30), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_merged_moments(rows, step):
    x = np.array(rows)
    total = whiten.NONE
    for i in range(0, len(x), step):
        total = whiten.merge(whiten.moments(x[i : i + step]), total)
    whole = whiten.moments(x)
    assert total.n == whole.n and [int(v) for v in total.sums] == [sum(r[k] for r in rows) for k in range(3)]
    assert np.allclose(total.scatter, whole.scatter, rtol=1e-9, atol=1e-6 * max(1, np.abs(whole.scatter).max()))


# --- lines


def plain_base(text):
    t = text or ""
    w = re.findall(WORD, t)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {k + i for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for i in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside), failed


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_rules(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(2)
    more = [(100 + i, "".join(rng.choices(["a ", "b ", "c\n", "a b c\n", "\t", "#x| ", "é", "<b>\n", " ", "\n"], k=rng.randint(0, 200)))) for i in range(60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"kept": F.lit("mine"), "n_words": F.lit("mine"), "extra": F.lit(1)})
    got = lines.label_lines(docs, lines.PLAIN).collect()
    want = [(i, *plain_base(t)) for i, t in [*odd_rows, *more]]
    assert Counter((r.doc_id, *[r[c] for c in BASE]) for r in got) == Counter(want)
    # a model without weights takes every line for content
    assert all(r.kept is not r.base_failed and r.content_words == r.n_words and r.boilerplate == [] and r.extra == 1 for r in got)
    assert lines.label_lines(no_docs, lines.PLAIN).count() == 0


@given(st.lists(st.integers(-3, 3), max_size=7), st.lists(st.integers(-3, 3), min_size=4, max_size=4))
@settings(max_examples=100, deadline=None)
def test_viterbi_finds_the_best_chain(unary, steps):
    steps = np.array(steps, float).reshape(2, 2)
    value = lambda y: sum(u * a for u, a in zip(unary, y)) + sum(steps[a, b] for a, b in zip(y, y[1:]))
    got = lines.viterbi([float(u) for u in unary], steps)
    assert len(got) == len(unary) and value([int(x) for x in got]) == max(map(value, product((0, 1), repeat=len(unary))))


def test_gradient_fits_what_can_be_counted():
    """With one feature that tells nothing, the best chain model gives pairs of labels their observed shares."""
    rng, labels = random.Random(1), []
    for _ in range(300):
        y = [rng.randint(0, 1)]
        while len(y) < 8:
            y.append(y[-1] if rng.random() < 0.9 else 1 - y[-1])
        labels.append(np.array(y))
    model = lines.learn([np.zeros(8, np.int64)] * 300, labels, 8)
    stay = model.steps[0, 0] + model.steps[1, 1] - model.steps[0, 1] - model.steps[1, 0]
    assert stay == pytest.approx(2 * np.log(9), abs=0.7)


def test_lines_learned_and_marked(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(n))
    menu = lambda n: "\n".join(" | ".join(word() for _ in range(3)) for _ in range(n))
    rows = [(i, prose(6)) for i in range(60)] + [(100 + i, menu(30) + "\n" + prose(1)) for i in range(60)]
    mixed = [(200, menu(4) + "\n\n" + prose(8)), (201, menu(40) + "\n" + prose(2)), (202, None), (203, "\n \n"), (204, "one line of few words.")]
    spark.createDataFrame(rows + mixed, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in __spark_entry__.queries()["op13_line_rules"](spark, str(tmp_path)).collect()}
    assert Counter((i, *[r[c] for c in BASE]) for i, r in got.items()) == Counter((i, *plain_base(t)) for i, t in rows + mixed)
    assert all(got[i].kept for i in range(60)) and not any(got[100 + i].kept for i in range(60))
    assert got[200].kept and got[200].n_boilerplate == 4 and not got[201].kept and got[201].n_boilerplate == 40
    assert [got[i].kept for i in (202, 203, 204)] == [False] * 3
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = lines.fit(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, label int"))  # one label only
    assert (model.unary == 0).all() and (model.steps == 0).all()
    again = lines.label_lines(docs.where("doc_id = 200"), lines.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", F.col("quality").alias("label")))).first()
    assert again.boilerplate == [0, 1, 2, 3]


def test_query_against_plain_decoding(spark, odd_docs, odd_rows):
    """The verdicts of a random model, with the best chain found by a plain recursion over lines."""
    rng = np.random.default_rng(8)
    model = lines.Model(rng.normal(size=lines.BITS + 1), rng.normal(size=(2, 2)))
    want = []
    for i, t in odd_rows:
        codes, sizes, seen = [], [], set()
        for k, line in enumerate((t or "").encode().split(b"\n")):
            w = line.split()
            if w:
                codes.append(lines.line_code(line, len(w), len(set(w)), line in seen, not codes))
                sizes.append(len(w))
                seen.add(line)
        best = {0: (0.0, 0), 1: (0.0, 0)}  # label of the last line: value, words of content
        for k, (c, n) in enumerate(zip(codes, sizes)):
            u = sum(model.unary[b] for b in range(lines.BITS) if c >> b & 1) + model.unary[-1]
            best = {y: max(((v + (model.steps[z, y] if k else 0) + u * y, words + n * y) for z, (v, words) in best.items()), key=lambda x: x[0]) for y in (0, 1)}
        n, *_, failed = plain_base(t)
        content = max(best.values(), key=lambda x: x[0])[1]
        want.append((i, content if codes else 0, not failed and content >= 0.5 * n))
    got = lines.label_lines(odd_docs, model).collect()
    assert Counter((r.doc_id, r.content_words, r.kept) for r in got) == Counter(want)


def test_wide_lines(monkeypatch):
    monkeypatch.setattr(lines, "PIECE", 7)
    text = "some words é of a line  that is\tcut\nin pieces".encode()
    assert [w for ws in lines.line_words(text.split(b"\n")[0]) for w in ws] == text.split(b"\n")[0].split()
    assert len(pa.array(lines.read_lines(text)[1])) == 2
