"""Pages are worked on in pieces of bounded size, whatever the size of a batch."""

import pyarrow as pa
import pytest

from pagemill.functions import dom
from pagemill.functions.batches import slices
from pagemill.operators import extract, nodes, structure


def test_pieces_hold_all_rows_in_order():
    texts = ["a" * 400, None, "", "b" * 5000, "é" * 300, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "html"])
    got = list(slices([batch, batch.slice(0, 0), batch], "html", 1000))
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(6), *range(6)]
    assert [b.num_rows for b in got] == [3, 1, 2, 3, 1, 2]
    assert [x for b in slices([batch], 1, 0) for x in b.column(1).to_pylist()] == texts


@pytest.mark.parametrize("read", [lambda df: extract.extract(df, ["links", "title"]), lambda df: structure.elements(df), lambda df: nodes.parsed(df, ["page_id"], keep_table=lambda t: t)])
def test_pages_of_one_batch_are_parsed_piece_by_piece(spark, read, monkeypatch):
    """Of 500 pages of 29 KB in one batch some come out before most are parsed."""
    page, df = "<title>t</title><body>" + "<p><a href=/x>x</a></p>" * 1300, spark.createDataFrame([(1, "")], "page_id long, html string")
    used, plain = [], type(df).mapInArrow

    def kept(self, run, schema, *more):
        used.append((run, self.limit(0).toArrow().schema))
        return plain(self, run, schema, *more)

    monkeypatch.setattr(type(df), "mapInArrow", kept)
    read(df)
    run, schema = used[0]
    batch = pa.RecordBatch.from_arrays([pa.array([page] * 500, f.type) if f.name in ("html", "_html") else pa.array(range(500), f.type) if pa.types.is_integer(f.type) else pa.nulls(500, f.type) for f in schema], schema=pa.schema([(f.name, f.type) for f in schema]))
    parsed, parse = [], dom.parse
    monkeypatch.setattr(dom, "parse", lambda html: parsed.append(1) or parse(html))
    out = run(iter([batch]))
    assert 0 < next(out).num_rows == len(parsed) < 100
    assert sum(b.num_rows for b in out) + 0 < 500 and len(parsed) == 500
