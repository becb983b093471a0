"""Titles that were cut inside a reference, as those of the given pages are at 60 characters, read by the HTML standard: in text the
names below count without their semicolon, and what is left of a name is text. Literals, not the library's own table."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import nodes

WHOLE = {"amp": "&", "quot": '"', "lt": "<", "gt": ">", "copy": "©"}
CUTS = {f"a = &{name[:n]}": f"a = {c}" if n == len(name) else f"a = &{name[:n]}" for name, c in WHOLE.items() for n in range(len(name) + 1)}
CUTS |= {"a = &#39": "a = '", "a = &amp;quot": "a = &quot", "a = &quot;b&quot": 'a = "b"', "&quot": '"', "&amp;&amp": "&&"}


@pytest.fixture(scope="module")
def cut(spark):
    titles = list(CUTS)
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>" + "word " * 50 + "</p></article></body></html>"
    rows = [(i, "https://a.test/", page.format(t)) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), [(i, CUTS[t]) for i, t in enumerate(titles)]


def test_titles_of_records(cut):
    df, want = cut
    got = nodes.css_records(df, None, [{"name": "title", "selector": "article > h1"}, {"name": "head", "selector": "head title"}])
    assert sorted(got.select("page_id", "title").collect()) == want
    assert got.where(~F.col("title").eqNullSafe(F.col("head"))).count() == 0


def test_titles_of_articles(cut):
    df, want = cut
    assert sorted(nodes.articles(df, ["page_id"]).select("page_id", "title").collect()) == want
