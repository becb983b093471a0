import pytest
from pyspark.sql import functions as F

from pagemill.operators import discover, naming, reduce

HEAD = (
    '<head><title> A  page </title><link rel="alternate" type="application/RSS+xml" title=" News " href="/feed"><link rel=alternate type=application/json href=a.json>'
    '<link rel="alternate" type="application/atom+xml" href="/feed"><link rel="alternate" type="text/html" href="/en"><script id="__NEXT_DATA__" type="application/json">{"buildId": "b1"}</script></head>'
)


def test_endpoints(spark):
    pages = spark.createDataFrame([(1, "https://a.test/x/y/?q=1", HEAD), (2, "https://a.test", HEAD), (3, "https://a.test/z", None), (4, None, HEAD), (5, "https://a.test/z", "<p>none")], "page_id long, url string, html string")
    got = [(r.page_id, r.endpoint, r.kind, r.confidence, r.title) for r in discover.endpoints(pages).orderBy("page_id", "pos").collect()]
    assert got[:3] == [
        (1, "https://a.test/feed", "feed", "declared", "News"),
        (1, "https://a.test/x/y/a.json", "json_alternate", "declared", None),
        (1, "https://a.test/_next/data/b1/x/y.json", "next_data", "derived", None),
    ]
    assert got[-1][:3] == (2, "https://a.test/_next/data/b1/index.json", "next_data") and {r[0] for r in got} <= {1, 2, 4}


@pytest.mark.parametrize(("selector", "kind", "want"), [
    ("li > p.price_color", "text", "가격"), ("a.btn.add-to-cart", "href", "add to cart"), ("span > small.author", "text", "작성자"), ("h3 > a", "href", "링크"), ("div > h2", "text", "제목"), ("b.productTitle", "text", "제목"),
    ("div", "src", "이미지"), ("div", "attr:data-rating", "평점"), ("", "text", "항목"), (None, "text", "항목"),
])
def test_name(spark, selector, kind, want):
    df = spark.createDataFrame([(selector, kind)], "selector string, kind string")
    assert df.select(naming.name(F.col("selector"), F.col("kind")).alias("n")).first().n == want


def test_names_differ(spark):
    rows = [
        (1, [("a.hnuser", "text"), ("a.hnuser", "href"), ("a", "href"), ("p > a", "href"), ("b.x2", "text"), ("i.x", "text"), ("u.x", "text")]),
        (2, []),
        (3, None),
    ]
    df = spark.createDataFrame(rows, "k int, c array<struct<path: string, kind: string>>")
    got = {r.k: r.n for r in df.select("k", naming.names(F.col("c")).alias("n")).collect()}
    assert got[1] == ["hnuser", "hnuser 링크", "링크", "링크2", "x2", "x", "x3"]
    assert got[2] == [] and got[3] is None


def test_reduced(spark):
    cards = "".join(f'<li class="card" style="x"><h3>Thing {i}</h3><a href="/{"p" * 80}">go</a></li>' for i in range(9))
    shop = f"<html>{HEAD}<body><main id=m>hello<ul class=list>{cards}</ul><br></main></body></html>"
    deep = "<div>" * 3000 + "x"
    pages = spark.createDataFrame([(1, shop), (2, deep), (3, None), (4, " "), (5, "plain")], "page_id long, html string")
    got = {r.page_id: r for r in reduce.reduced(pages).collect()}
    lines = got[1].skeleton.split("\n")
    assert lines[:5] == ["<title>  A page", "<body>", '  <main id="m">  hello', '    <ul class="list">', "      [x9] li.card"]
    assert lines[5] == '        <li class="card">' and got[1].skeleton.count("<h3>") == 2 and f'href="/{"p" * 59}..."' in got[1].skeleton
    assert not got[1].truncated and 0 < got[1].tokens < got[1].original_tokens and got[1].ratio == round(got[1].tokens / got[1].original_tokens, 4)
    assert got[2].truncated and got[2].skeleton.endswith(reduce.CUT) and got[2].tokens < reduce.MAX_TOKENS + 100
    assert [(got[k].skeleton, got[k].truncated) for k in (3, 4)] == [("", False)] * 2 and got[5].skeleton == "<body>  plain"
