import pytest
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.operators import structure
from pagemill.streaming import crawl

CARD = '<li class="card col-{i} is-new"><h3><a href="/p/{i}">Thing number {i} with a name</a></h3><span class="price">${i}.00</span><p>some words that describe thing {i} at length</p></li>'
SHOP = "<html><body><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a><li><a href=/c>C</a></ul></nav><main><ul class=list>" + "".join(CARD.format(i=i) for i in range(6)) + "</ul></main></body></html>"


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(1, SHOP), (2, SHOP.replace("Thing", "Object").replace("<main>", "<main><p>x</p>")), (3, None), (4, ""), (5, "<p>a<p>b")], "page_id long, html string")
    return structure.containers(pages, crawl.keeper(spark)).cache()


def test_names():
    node = dom.Node("div", {"class": "product css-1x2 col-md-3 hover:red active p-2 card 123 text-lg list"}, None)
    assert structure.naming_classes(node) == ["card", "list", "product"]


def test_containers(found):
    rows = found.where("page_id = 1").orderBy("place").collect()
    best = rows[0]
    assert (best.place, best.selector, best.parent_selector, best["count"]) == (1, "li.card", "ul.list", 6)
    cols = {(c.path, c.kind): c for c in best.columns}
    assert set(cols) == {("h3", "text"), ("h3 > a", "href"), ("span.price", "text"), ("p", "text")}
    assert list(cols["span.price", "text"].samples) == ["$0.00", "$1.00", "$2.00"] and cols["p", "text"].fill_rate == 1.0
    assert all(r.selector == "li" for r in rows[1:])  # the menu, if it scores at all
    assert {r.page_id for r in found.collect()} == {1, 2}


def test_fingerprints(found):
    got = {r.page_id: r for r in structure.fingerprints(found).collect()}
    assert got[1].digest == got[2].digest and got[1].digest.startswith("fp1:") and len(got[1].digest) == 36
    assert any(f.startswith("c:ul.list>li.card@") for f in got[1].features)


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(structure.similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [0.333, 0.0]


def test_like_groups_are_held_against_the_last_kept(spark):
    """Best first: B is like A and goes; C is like B, but not like A, and stays; D is like C and goes; E of another count stays."""
    rows = [(1, "A", 9.0, ["1", "2", "3"]), (1, "B", 8.0, ["2", "3", "4"]), (1, "C", 7.0, ["3", "4", "5"]), (1, "D", 6.0, ["3", "4", "5", "6"]), (1, "F", 5.0, []), (2, "A", 1.0, ["1", "2", "3"])]
    table = [(p, i, sig, 3, score, i, seen) for i, (p, sig, score, seen) in enumerate(rows)] + [(1, 9, "E", 4, 1.0, 9, ["1", "2", "3"])]
    found = spark.createDataFrame(table, "page_id int, parent int, sig string, count long, score double, first int, seen array<string>").repartition(3)
    got = sorted((r.page_id, r.sig) for r in structure._unlike(found, "page_id").collect())
    assert got == [(1, "A"), (1, "C"), (1, "E"), (1, "F"), (2, "A")]
