"""A small document tree for the extractors: elements, text, and the selectors that recipes use."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import escape
from html.parser import HTMLParser

# Of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BOUND = {"li": {"ul", "ol"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
RAW = {"script", "style"}
SILENT = {"script", "style", "noscript", "template"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def pieces(self, skip=frozenset()):
        """Runs of text below, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in skip:
                todo += reversed(n.children)

    def text(self, skip=frozenset()) -> str:
        return "".join(self.pieces(skip))

    def markup(self) -> str:
        """The element with all below, written out: references in text and values, void elements without an end."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, Node):
                out.append("<" + n.tag + "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items()) + ">")
                if n.tag not in VOID:
                    todo.append(("</" + n.tag + ">",))
                    todo += [(c,) if n.tag in RAW and isinstance(c, str) else c for c in reversed(n.children)]
            else:
                out.append(n[0] if isinstance(n, tuple) else escape(n, quote=False))
        return "".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "td", "th", "table"})
        if tag in SAME:
            self._close(SAME[tag], BOUND.get(tag, {"table"}))
        node = Node(tag, {}, self.here)
        for k, v in attrs:  # of an attribute that repeats the first counts
            node.attrs.setdefault(k, v or "")
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, tags, bounds):
        n = self.here
        while n.parent is not None and n.tag not in bounds:
            if n.tag in tags:
                self.here = n.parent
            n = n.parent

    def handle_endtag(self, tag):
        n = self.here
        while n.parent is not None:
            if n.tag == tag:
                self.here = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def unlink(top: Node) -> Node:
    """The tree without the way up. Elements and their parents refer to each other, so that a tree that is merely dropped stays in memory until
    Python looks for such rings, which it does the more seldom the more a worker holds; without parents it goes with the last reference to it."""
    for n in top.walk():
        n.parent = None
    return top


def trees(pages: Iterable[str | None]) -> Iterator[Node]:
    """The tree of each page, one at a time: the way up is gone when the next one is asked for."""
    for html in pages:
        tree = parse(html)
        yield tree
        unlink(tree)


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:([*^$~]?=)[\"']?([^\]\"']*)[\"']?)?\]")


def _compile(selector: str) -> list[list]:
    """For each group, its steps from the last: (combinator to the left, tests)."""
    groups = []
    for group in selector.split(","):
        steps, lead = [], " "
        for token in re.findall(r"\[[^\]]*\][^\s>]*|>|[^\s>\[]+(?:\[[^\]]*\][^\s>\[]*)*", group.strip()):
            if token == ">":
                lead = ">"
            else:
                steps.append((lead, _SIMPLE.findall(token)))
                lead = " "
        groups.append(steps)
    return groups


def _passes(n: Node, tests: list) -> bool:
    for tag, cls, id_, attr, op, value in tests:
        if tag and tag not in ("*", n.tag) or cls and cls not in n.classes() or id_ and n.attrs.get("id") != id_:
            return False
        if attr:
            have = n.attrs.get(attr)
            if have is None:
                return False
            ok = {"": True, "=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value), "~=": value in have.split()}
            if not ok[op]:
                return False
    return True


def _fits(n: Node, steps: list, top: Node) -> bool:
    lead, tests = steps[-1]
    if not _passes(n, tests):
        return False
    if len(steps) == 1:
        return True
    up = n.parent
    while up is not None:
        if _fits(up, steps[:-1], top):
            return True
        if lead == ">":
            return False
        up = up.parent
    return False


def select(top: Node, selector: str) -> list[Node]:
    """Elements below that fit a selector, in document order."""
    groups = _compile(selector)
    return [n for n in top.walk() if any(_fits(n, s, top) for s in groups)]


def first(top: Node, selector: str) -> Node | None:
    groups = _compile(selector)
    return next((n for n in top.walk() if any(_fits(n, s, top) for s in groups)), None)


def clean(text: str) -> str | None:
    return " ".join(text.split()) or None
