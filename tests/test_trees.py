"""A worker holds the tree of one page at a time, whatever its batch has, and does not wait for rings of references to be found."""

import gc

import pyarrow as pa
import pytest

from pagemill.functions import dom
from pagemill.operators import extract, nodes, structure

PAGE = "<title>t</title><body>" + "<p><a href=/x>x</a></p>" * 20


@pytest.mark.parametrize("read", [lambda df: extract.extract(df, ["links", "title"]), lambda df: structure.elements(df), lambda df: nodes.parsed(df, ["page_id"], keep_table=lambda t: t)])
def test_the_tree_of_one_page_is_held_at_a_time(spark, read, monkeypatch):
    df = spark.createDataFrame([(1, "")], "page_id long, html string")
    used, plain = [], type(df).mapInArrow

    def kept(self, run, schema, *more):
        used.append((run, self.limit(0).toArrow().schema))
        return plain(self, run, schema, *more)

    monkeypatch.setattr(type(df), "mapInArrow", kept)
    read(df)
    run, schema = used[0]
    batch = pa.RecordBatch.from_arrays([pa.array([PAGE] * 50, f.type) if f.name in ("html", "_html") else pa.array(range(50), f.type) if pa.types.is_integer(f.type) else pa.nulls(50, f.type) for f in schema], schema=pa.schema([(f.name, f.type) for f in schema]))
    alive, most, node = [0], [0], dom.Node

    class Counted(node):
        __slots__ = ()

        def __init__(self, *a):
            super().__init__(*a)
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    monkeypatch.setattr(dom, "Node", Counted)
    a_page = sum(1 for _ in dom.parse(PAGE).walk()) + 1
    gc.collect()
    gc.disable()
    try:
        alive[0] = most[0] = 0
        assert sum(b.num_rows for b in run(iter([batch]))) == 50
        assert a_page <= most[0] <= 3 * a_page
        assert alive[0] == 0
    finally:
        gc.enable()


def test_trees_keep_the_way_up_while_they_are_asked():
    found = [len(dom.select(t, "p > a")) for t in dom.trees([PAGE, None, PAGE])]
    assert found == [20, 0, 20]
