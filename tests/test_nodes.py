"""Selectors and articles by joins and windows, held against walks of a page's tree."""

import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.operators import nodes

WORD = re.compile(nodes.ARTICLE_WORD)


def plain_value(n, kind, attr):
    if n is None:
        return None
    if kind == "html":
        return n.markup() if n.tag != "#root" else "".join(c.markup() if isinstance(c, dom.Node) else dom.escape(c, quote=False) for c in n.children)
    if kind in ("href", "attr"):
        return n.attrs.get("href" if kind == "href" else attr)
    if kind == "src":
        return n.attrs.get("data-src") or n.attrs.get("src")
    return dom.clean(n.text())


def plain_records(html, container, fields):
    tree, out = dom.parse(html), []
    for top in dom.select(tree, container) if container else [tree]:
        row = [plain_value(dom.first(top, f["selector"]) if f.get("selector") else top, f.get("type", "text"), f.get("attr")) for f in fields]
        if any(v not in (None, "") for v in row):
            out.append(tuple(row))
    return out


def plain_article(html):
    tree = dom.parse(html)
    body = dom.first(tree, "body") or tree
    bounds = {id(n) for n in body.walk() if n.tag in nodes.DROPPED}

    def kept(n):
        """Runs of text below, without those inside dropped elements."""
        for c in n.children:
            if isinstance(c, str):
                if c:
                    yield c
            elif id(c) not in bounds:
                yield from kept(c)

    def gone(n):
        while n is not None:
            if id(n) in bounds:
                return True
            n = n.parent
        return False

    count = lambda n: sum(len(WORD.findall(x)) for x in kept(n))
    hint = lambda words, marker: re.search(rf"(?i)(?:^|[-_\s])(?:{'|'.join(words)})", marker)
    best, score = None, 0.0
    for n in body.walk():
        if n.tag in nodes.BLOCKS and not gone(n) and (words := count(n)):
            links, todo = 0, [c for c in n.children if isinstance(c, dom.Node)]
            while todo:  # links that are in no other link
                c = todo.pop()
                if c.tag == "a":
                    links += 0 if gone(c) else count(c)
                else:
                    todo += [x for x in c.children if isinstance(x, dom.Node)]
            up, around = n.parent, False
            while up is not None:
                around, up = around or up.tag == "a", up.parent
            own = words * (1 - min((0 if around else links) / words, 1.0))
            marker = f"{n.attrs.get('class') or ''} {n.attrs.get('id') or ''}"
            own *= (0.25 if hint(nodes.FURNITURE, marker) else 1) * (1.6 if hint(nodes.CONTENT, marker) else 1) * (1.5 if n.tag == "article" else 1)
            if own > score:
                best, score = n, own
    if best is None:
        return None
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in kept(best))).strip()
    if len(WORD.findall(text)) < nodes.LEAST_WORDS:
        return None
    h1 = next((n for n in tree.walk() if n.tag == "h1" and not gone(n)), None) or next((n for n in tree.walk() if n.tag == "title" and not gone(n)), None)
    return ((h1.text().strip() or None) if h1 else None, text, len(WORD.findall(text)))


def made_page(rng):
    """Nested elements of a few names, with faults: unclosed, crossing, void, raw and empty ones."""
    tags = "div div section article main p a a ul li td table span nav aside script h1 b br header".split()
    classes = ["", "card", "card big", "nav-x", "post", "price", "main_menu", "x-content"]
    out, opened = ["<title>the title</title>" * rng.randint(0, 1)], []
    if rng.random() < 0.8:
        out.append("<body>")
    for _ in range(rng.randint(0, 70)):
        what = rng.random()
        if what < 0.5:
            tag = rng.choice(tags)
            attrs = "".join(f' {k}="{v}"' for k, v in (("class", rng.choice(classes)), ("id", rng.choice(["", "i1", "i2"])), ("href", f"/p?{rng.randint(0, 9)}&x"), ("data-src", rng.choice(["", "/d.png"])), ("src", "/s.png")) if rng.random() < 0.4)
            out.append(f"<{tag}{attrs}>")
            opened.append(tag)
        elif what < 0.75 and opened:
            out.append(f"</{opened.pop() if rng.random() < 0.9 else rng.choice(opened)}>")
        else:
            out.append(" ".join(rng.choice(["word", "zwei", "세", "é", "&amp;", "\n", " ", "\xa0", "<!-- c -->"]) for _ in range(rng.randint(1, 12))))
    return "".join(out)


FIELDS = [
    {"name": "own"}, {"name": "text", "selector": "span, b"}, {"name": "link", "selector": "li > a[href]", "type": "href"}, {"name": "pic", "selector": "[src]", "type": "src"}, {"name": "id", "selector": "div p", "type": "attr", "attr": "id"},
    {"name": "deep", "selector": "div.card > p span"}, {"name": "raw", "selector": "a", "type": "html"}, {"name": "any", "selector": "section *"}, {"name": "not", "selector": "video"}, {"name": "starts", "selector": 'a[href^="/p?1"]', "type": "href"},
]


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(6)
    html = [made_page(rng) for _ in range(60)] + [None, "", "just text", "<div>" * 30 + "deep" + "</div>" * 3, "<p>a<p>b<span> c\n d</span>"]
    rows = [(i if i % 7 else None, f"https://a.test/{i}", h) for i, h in enumerate(html)] + [(1, "https://a.test/1", html[1]), (1, "https://a.test/again", html[2])]  # null keys, repeats, one key twice
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).cache(), rows


@pytest.mark.parametrize("container, fields", [(None, FIELDS[:2]), ("div.card, li", FIELDS[2:5]), ("section > div", FIELDS[5:7]), ("[class~=big]", FIELDS[7:])])
def test_records_as_by_walking(many, container, fields):
    df, rows = many
    got = nodes.css_records(df, container, [f | {"transform": []} for f in fields]).collect()
    want = Counter((i, u, *r) for i, u, h in rows for r in plain_records(h, container, fields))
    assert Counter(map(tuple, got)) == want


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "u", "<li>x</li>", 5)], "node long, text string, html string, runs int")
    got = nodes.css_records(df, "li", [{"name": "parent"}, {"name": "row", "selector": "b"}], key="node", url="text").collect()
    assert [tuple(r) for r in got] == [(1, "u", "x", None)]
    assert nodes.css_records(df.limit(0), "li", [{"name": "parent"}], key="node", url="text").count() == 0


def test_articles_as_by_walking(spark, many):
    df, rows = many
    rng = random.Random(11)
    more = []
    for i in range(80):
        prose = lambda n: " ".join(rng.choice(["word", "zwei", "세", "don't"]) for _ in range(n))
        block = lambda depth: "".join(
            rng.choice([f"<p>{prose(rng.randint(5, 40))}", f"<a href=x>{prose(rng.randint(1, 20))}</a>", f"<nav>{prose(30)}</nav>", "\n<!-- x -->\n", f"<div class='{rng.choice(['', 'post-body', 'sidebar', 'x share'])}'>{block(depth - 1) if depth else prose(9)}</div>", f"<section id={rng.choice('a main story'.split())}>{block(depth - 1) if depth else ''}</section>", f"<h1> {prose(2)}</h1>", f"<a><div>{prose(50)}</div></a>"])
            for _ in range(rng.randint(1, 6))
        )
        more.append((1000 + i, "u", f"<title>t{i}</title>" + rng.choice(["<body>", ""]) + rng.choice(["<article>", ""]) + block(3)))
    got = nodes.articles(df.union(spark.createDataFrame(more, df.schema)), ["page_id", "url"]).collect()
    want = Counter((i, u, *a) for i, u, h in rows + more if (a := plain_article(h)))
    assert Counter(tuple(r) for r in got) == want and len(want) > 30


def test_depth_costs_its_length(spark):
    """Nested blocks with a word each, at three depths."""
    took = []
    for depth in (300, 600, 1200):
        page = "<body>" + "<div>word " * depth
        start = time.perf_counter()
        x = nodes._Pages(False)
        x.add(page)
        took.append(time.perf_counter() - start)
        assert x.numbers["last"][0] == depth + 1 and len(x.lists["runs"]) == depth
    df = spark.createDataFrame([(1, "<body>" + "<div>word " * 1200)], "page_id long, html string")
    rows = nodes.articles(df, ["page_id"]).collect()
    assert rows[0].word_count == 1200 and took[2] < 20 * took[0] + 0.5


@given(st.lists(st.sampled_from("<div> <p> <a> </div> </p> text <li> </li> <br> <b>".split()), max_size=40))
@settings(max_examples=60, deadline=None)
def test_regions_nest(parts):
    x = nodes._Pages(True)
    x.add("".join(parts))
    n = x.numbers
    for i, (parent, last, r0, r1) in enumerate(zip(n["parent"], n["last"], n["r0"], n["r1"])):
        assert i <= last and r0 <= r1
        assert parent == -1 or parent < i <= last <= n["last"][parent]
    assert "".join(x.lists["markup"]) == "".join(c.markup() if isinstance(c, dom.Node) else dom.escape(c, quote=False) for c in dom.parse("".join(parts)).children)


def test_only_the_parse_is_python(spark, many):
    df, _ = many
    took = nodes.parsed(df, ["page_id", "url"])
    plan = nodes.css_records(df, "div", FIELDS[:3], keep_table=lambda _: took)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan and "Window" in plan
    assert nodes.css_records(df, "li > a", [{"name": "x"}]).where(F.col("x").isNull()).count() == 0
