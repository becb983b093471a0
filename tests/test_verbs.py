import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.functions import dom, urls
from pagemill.operators import dedupe, filters, gate
from pagemill.plans import recipe, verbs
from pagemill.sources import web
from pagemill.streaming import crawl


def test_markup_reads_back():
    text = '<div class="a b"><p id="x">one &amp; <b>two</b></p><br><script>if (a < b) {}</script><i title="&quot;q&quot;"></i></div>'
    tree = dom.parse(text)
    (div,) = dom.select(tree, "div")
    assert div.markup() == text
    again = dom.parse(div.markup())
    assert again.children[0].markup() == text
    assert dom.parse('<a href=1 href=2>').children[0].attrs == {"href": "1"}


def test_unpacking_has_a_ceiling():
    packed = zlib.compressobj(9, zlib.DEFLATED, 31)
    body = packed.compress(b"0" * (1 << 22)) + packed.flush()
    assert len(web.unpacked(body)) == 1 << 22 and web.unpacked(b"plain") == b"plain"
    with pytest.raises(ValueError):
        web.unpacked(body, most=1 << 20)


def test_scopes():
    assert urls.checked_scope(("a.com", "b.co.uk", "10.0.0.1", "[::1]")) == ("a.com", "b.co.uk", "10.0.0.1", "::1")
    for bad in ((), ("",), ("https://a.com",), ("a.com/x",), ("co.uk",), ("com",)):
        with pytest.raises(ValueError):
            urls.checked_scope(bad)
    assert urls.narrowed(("a.com", "b.com"), ()) == ("a.com", "b.com")
    assert urls.narrowed(("shop.a.com", "b.com", "c.com"), ("a.com", "x.b.com")) == ("shop.a.com", "x.b.com")


def test_picks():
    with pytest.raises(ValueError):
        verbs.picked_recipe("x", "li", [("a", "b", "text"), ("a", "c", "text")])
    with pytest.raises(ValueError):
        verbs.picked_recipe("x", "li", [(" ", "b", "text")])
    assert [f.name for f in verbs.picked_recipe("x", "li", [("a", "b", "href"), ("", "c", "text")]).fields] == ["a"]


def test_nothing_repeats(spark):
    page = spark.createDataFrame([(1, "https://a.test/", "<title>T</title><p>one</p>")], "page_id long, url string, html string")
    keep = crawl.keeper(spark)
    row = verbs.inspect(page, keep).first()
    assert (row.title, row.container, row["count"], row.columns) == ("T", None, 0, [])
    assert verbs.adapt(page, keep) == (None, None)
    keep.release()


def test_quick_csv_keeps_first_seen_order_and_has_a_mark(spark, tmp_path):
    df = spark.createDataFrame([(2, '{"a": 1, "z": "x"}'), (1, '{"z": 1, "b": null}')], "seq long, data string")
    web.quick_csv(df.coalesce(1), "data", "seq", str(tmp_path / "csv"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert raw.startswith(b"\xef\xbb\xbfz,b,a\n") and raw.count(b"\n") >= 3
    with pytest.raises(ValueError):
        web.csv_cells(df, "data", ["seq"], most=2)


def test_near_pairs_finds_every_pair_once(spark):
    import random

    rng = random.Random(6)
    base = [rng.getrandbits(60) for _ in range(40)]
    prints = {i: v ^ sum(1 << b for b in rng.sample(range(60), rng.randint(0, 9))) for i, v in enumerate(base * 5)}
    unique = {v: k for k, v in sorted(prints.items(), reverse=True)}
    want = {(a, b, (x ^ y).bit_count()) for x, a in unique.items() for y, b in unique.items() if a < b and (x ^ y).bit_count() <= 6}
    got = dedupe.near_pairs(spark.createDataFrame([(k, v) for v, k in unique.items()], "k long, fingerprint long"), "k").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_leaders_follow_the_order(spark):
    """A long chain of near pages: each second one leads, as when they are read one by one."""
    import random

    rng, texts = random.Random(7), []
    words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    for i in range(12):
        texts.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(400)] = f"w{rng.randrange(10**9)}"
    df = spark.createDataFrame(texts, "k long, t string")
    keep = crawl.keeper(spark)
    prints = {r.k: r.fingerprint for r in dedupe.texts.simhash(df, "k", dedupe.texts.tokens(F.col("t"))).collect()}
    kept, want = [], {}
    for k in sorted(prints):
        lead = next((x for x in kept if (prints[x] ^ prints[k]).bit_count() <= 6), k)
        kept += [k] if lead == k else []
        want[k] = lead
    assert {r.k: r.leader for r in dedupe.near_leaders(df, "k", "t", keep).collect()} == want


def test_budget_with_earlier_rounds(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(3)], "pattern string, n long")
    used = spark.createDataFrame([("a", 1), ("b", 9)], "pattern string, n long")
    rows = gate.within_budget(df.withColumnRenamed("n", "i"), "pattern", ["i"], 3, used).collect()
    assert sorted((r.pattern, r.i) for r in rows if not r.over) == [("a", 0), ("a", 1)]


def test_vectors_of_a_cache(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "x")], "id long, t string")
    cache = spark.createDataFrame([("x", [1.0])], "text string, vector array<double>")
    assert {r.id: r.vector for r in filters.with_vectors(df, "t", cache).collect()} == {1: [1.0], 2: None, 3: None, 4: [1.0]}
    assert [r.text for r in filters.missing_vectors(df, "t", cache).collect()] == ["y"]


def test_fallback_reads_only_bare_pages(spark):
    kind = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, "u", "<li>a</li>"), (2, "u", "<p>"), (3, "u", None)], kind)
    rendered = spark.createDataFrame([(1, "u", "<li>never</li>"), (2, "u", "<li>b</li><li>c</li>")], kind)
    r = recipe.Recipe("r", container="li", fields=(recipe.Field("x", ""),))
    keep = crawl.keeper(spark)
    rows = recipe.with_fallback(r, pages, rendered, keep).collect()
    assert sorted((x.page_id, x.x, x.via) for x in rows) == [(1, "a", "http"), (2, "b", "rendered"), (2, "c", "rendered")]
