"""Skeletons against a walk of each page's tree."""

import random
import re

from pagemill.functions import dom
from pagemill.operators import reduce, structure


def cost(line):
    wide = len(re.findall(reduce.WIDE, line))
    return int((len(line) - wide) / 4 + wide / 1.5) + 1


def opening(n):
    told = [f'{k}="{v if len(v) <= 60 else v[:60] + "..."}"' for k in reduce.KEPT if (v := dom.clean(n.attrs.get(k) or ""))]
    own = dom.clean("".join(c for c in n.children if isinstance(c, str)))
    return f"<{' '.join([n.tag, *told])}>" + (f"  {own[:80]}" if own else "")


def outline(n, depth, out):
    out.append("  " * depth + opening(n))
    groups = {}
    for c in n.children:
        if isinstance(c, dom.Node) and c.tag not in reduce.DROPPED:
            groups.setdefault((c.tag, *structure.naming_classes(c)), []).append(c)
    for some in groups.values():
        more = len(some) >= 3
        if more:
            out.append("  " * (depth + 1) + f"[x{len(some)}] {'.'.join([some[0].tag, *structure.naming_classes(some[0])[:3]])}")
        for c in some[:2] if more else some:
            outline(c, depth + 1 + more, out)


def walked(html, most):
    if not html or not html.strip():
        return "", False
    tree = dom.parse(html)
    title, body = dom.first(tree, "title"), dom.first(tree, "body")
    if body is None:
        body = dom.Node("body", {}, None)
        body.children = [c for c in tree.children if not isinstance(c, dom.Node) or c.tag not in ("head", "title")]
    lines = [f"<title>  {(dom.clean(title.text()) or '')[:80]}"] if title else []
    outline(body, 0, lines)
    out, used = [], 0
    for line in lines:
        used += cost(line)
        if used > most:
            return "\n".join([*out, reduce.CUT]), True
        out.append(line)
    return "\n".join(out), False


def grown(rng, depth):
    tag = rng.choice(["div", "div", "ul", "li", "p", "span", "a", "script", "br", "svg", "section"])
    attrs = "".join(f' {k}="{v}"' for k, v in [("class", " ".join(rng.sample(["card", "b", "a", "mt-4", "active", "col-3", "é", "sc-x1"], rng.randint(0, 4)))), ("id", "i" * rng.choice([0, 3, 70])), ("style", "x")] if rng.random() < 0.5)
    inside = "".join(rng.choice(["", "text ", "  two\n words ", "가격 한국어", "&amp;"]) + (grown(rng, depth - 1) if depth else "") for _ in range(rng.randint(0, 7 if depth > 1 else 3)))
    return f"<{tag}{attrs}>{inside}" + ("" if tag in dom.VOID or rng.random() < 0.05 else f"</{tag}>")


def test_same_as_a_walk(spark):
    rng = random.Random(5)
    made = ["<html><head><title> A  b</title></head><body class='x'>" + grown(rng, 4) + "</body></html>" if i % 3 else grown(rng, 4) + grown(rng, 3) for i in range(90)]
    odd = [None, "", " \n ", "plain", "<!-- c -->", "<title>t</title><head><p>x</p></head><p>y", "<body><body><p>z</p></body>", "<svg><title>in</title></svg>", "<div>" * 300 + "deep", "<ul>" + "<li>x" * 500 + "</ul>", "<body>" + "".join(f"<p class=c{chr(97 + i % 26)}{chr(97 + i // 26)}>w</p>" for i in range(600))]
    pages = [(i, h) for i, h in enumerate(made + odd)]
    for most in (3000, 60):
        got = reduce.reduced(spark.createDataFrame([(i, h, "x") for i, h in pages], "page_id long, html string, row string"), max_tokens=most).collect()
        assert {r.page_id: (r.skeleton, r.truncated) for r in got} == {i: walked(h, most) for i, h in pages} and len(got) == len(pages)
    assert any(t for _, t in (walked(h, 60) for _, h in pages))
