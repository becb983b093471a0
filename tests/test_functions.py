import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import dom, paths, texts, urls, values


def one(spark, column, **data):
    df = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} string" for k in data))
    return df.select(column.alias("x")).first().x


def each(spark, cases, column):
    """{input: output} of a column over texts."""
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    return [r.x for r in df.select(column(F.col("v")).alias("x")).collect()]


# --- transforms


@pytest.mark.parametrize(
    "step, cases",
    [
        ("trim", {" a ": "a", "　b　": "b", "": "", None: None}),
        ("normalize_ws", {" a \n\t b ": "a b"}),
        ("strip_html", {"<b>a</b> &amp; <i>b</i>": "a &amp; b"}),
        ("to_number", {"1,234.50": 1234.5, "1.234,5": 1234.5, "$12.50": 12.5, "12.345": 12345.0, "T-800": -800.0, "none": None, "3,5": 3.5}),
        ("to_int", {"12.9 kg": 12, "x": None}),
        ("duration_to_seconds", {"1:02:03": 3723, "04:05": 245, "PT1H2M": 3720, "pt3.7s": 3, "P": None, "PT": None, "P1Y": None, "x": None}),
        ("parse_date", {"2024-03-01": "2024-03-01T00:00:00", "2024-03-01T10:00:00Z": "2024-03-01T10:00:00+00:00", "2024/03/01": "2024-03-01T00:00:00+00:00", "soon": None}),
        ("split(/, 1)", {"a/b/c": "b", "a": None}),
        ("split(/, -1)", {"a/b/c": "c"}),
        ("regex_extract((\\d+)-(\\d+))", {"a 12-34": "12-34", "x": None}),
        ("regex_extract([)", {"a": None}),
        ("default(none)", {"": "none", None: "none", "x": "x"}),
    ],
)
def test_transforms(spark, step, cases):
    assert each(spark, list(cases), lambda v: values.chain(v, [step])) == list(cases.values())


def test_unknown_transform_is_an_error():
    with pytest.raises(ValueError, match="unknown transform"):
        values.check(["trim", "explode_it"])


def test_shapes(spark):
    assert each(spark, ["http://a", "/b", "1,200", "a" * 201, "word", "", None], values.shape) == ["url", "url", "numeric-text", "long-text", "text", "empty", "empty"]


# --- URLs


def test_normalize(spark):
    cases = {
        "HTTP://Example.COM:80/a/./b/../c//d/?utm_source=x&b=2&a=1#top": ("http://example.com/a/c/d/?b=2&a=1", "http://example.com/a/c/d?a=1&b=2"),
        "https://a.com": ("https://a.com/", "https://a.com/"),
        "https://a.com:8443/%7euser/%2f": ("https://a.com:8443/~user/%2F", "https://a.com:8443/~user/%2F"),
        " https://a.com/x\ty ": ("https://a.com/xy", "https://a.com/xy"),
        "https://a.com/?PHPSESSID=1&k=": ("https://a.com/?k", "https://a.com/?k"),
    }
    got = each(spark, list(cases), urls.normalize)
    assert [(r.url, r.dedupe_key) for r in got] == list(cases.values())
    assert each(spark, ["ftp://a.com/", "mailto:x@y", "", None, "https://a.com/\x01"], urls.normalize) == [None] * 5


def test_join(spark):
    cases = {"b": "https://a.com/x/b", "/b": "https://a.com/b", "?q": "https://a.com/x/y?q", "//b.org/": "https://b.org/", "http://c/": "http://c/", " ": None}
    assert each(spark, list(cases), lambda v: urls.join(F.lit("https://a.com/x/y?z"), v)) == list(cases.values())


def test_pattern_and_score(spark):
    shape = lambda v: urls.pattern(urls.normalize(v))
    cases = {"https://a.com/p/2024-01-02/123/item12345?b=1&a": "a.com/p/{date}/{n}/{id}?a={v}&b={v}", "https://a.com/u/00000000-0000-0000-0000-000000000000/x": "a.com/u/{uuid}/x"}
    assert each(spark, list(cases), shape) == list(cases.values())
    assert each(spark, ["https://a.com/product/1", "https://a.com/login?a=1&b=2", "https://a.com/"], lambda v: urls.score(v, F.lit(1))) == [1100, 480, 900]


def test_hosts(spark):
    assert each(spark, ["a.b.example.com", "x.co.uk", "co.uk", "127.0.0.1", "com"], urls.registrable_domain) == ["example.com", "x.co.uk", None, None, None]
    assert each(spark, ["example.com", "a.example.com", "badexample.com", "1.2.3.4"], lambda v: urls.in_scope(v, ["example.com", "1.2.3.4"])) == [True, True, False, True]
    assert each(spark, ["10.1.2.3", "8.8.8.8", "172.31.0.1", "x"], urls.denied_address) == ["private", None, "private", None]


# --- JSON


def test_json_path(spark):
    data = json.dumps({"a": {"b": [{"c": 1}]}, "many": [1, 2], "v": {"@value": "x"}, "lone": [{"n": "y"}]})
    want = {"a.b.c": "1", "a.b.0.c": "1", "many": None, "many.1": "2", "v": "x", "lone.n": "y", "none.at.all": None}
    assert {p: one(spark, paths.json_path(F.col("d"), p), d=data) for p in want} == want


def test_json_path_of_many_names(spark):
    names = "a.b.c.d.e.f.g.h"
    for lists in (set(), {"a"}, {"b", "f"}, set("abcdefgh")):
        for n in (1, 2):
            data = "x"
            for name in reversed(names.split(".")):
                data = {name: [data] * n if name in lists else data}
            want = "x" if n == 1 or not lists else None
            assert one(spark, paths.json_path(F.col("d"), names), d=json.dumps(data)) == want


@pytest.mark.parametrize(
    "payload, style, following",
    [
        ({"next": "https://a/2", "page": 1}, "next_url", "https://a/2"),
        ({"meta": {"next_cursor": "abc"}}, "cursor", "abc"),
        ({"page": 3, "total": 90}, "page", "4"),
        ({"offset": 20, "limit": 10}, "offset", "30"),
        ({"items": []}, "none", None),
    ],
)
def test_pagination(spark, payload, style, following):
    got = one(spark, paths.pagination(F.col("d")), d=json.dumps(payload))
    assert (got.style, got.next) == (style, following)


def test_with_parameter(spark):
    assert each(spark, ["https://a/x?page=1&q=z", "https://a/x"], lambda v: paths.with_parameter(v, "page", F.lit("2"))) == ["https://a/x?q=z&page=2", "https://a/x?page=2"]


# --- texts and documents


def test_simhash_is_near_for_near_texts(spark):
    base = [f"word{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:100] + ["other"] + base[101:])), (3, " ".join(f"else{i}" for i in range(200)))]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r.k: r.fingerprint for r in texts.simhash(df, "k", texts.tokens(F.col("text"))).collect()}
    assert (got[1] ^ got[2]).bit_count() <= 6 < (got[1] ^ got[3]).bit_count()


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0], [1.0]), ([1.0, 1.0], [-1.0, -1.0])], "a array<double>, b array<double>")
    assert [round(r.x, 6) for r in df.select(texts.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, -1.0]


def test_dom():
    tree = dom.parse("<html><body><ul id=u><li class='a b'>one<li class=a>two <b>bold</b></ul><p>x<p>y<br>z<script>no</script></body>")
    assert [dom.clean(n.text()) for n in dom.select(tree, "ul > li.a")] == ["one", "two bold"]
    assert [n.tag for n in dom.select(tree, "#u, p")] == ["ul", "p", "p"]
    assert dom.first(tree, "li.a.b") and dom.first(tree, "li[class~='b']") and dom.first(tree, "li.c") is None
    assert dom.clean(dom.first(tree, "body").text(dom.SILENT)) == "onetwo boldxyz"
    assert dom.parse(None).children == []
