"""Arrow batches in pieces that a worker can hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES = 1 << 20  # of text that is worked on at once; its trees take some fifty times as much


def slices(batches: Iterable[pa.RecordBatch], column: str | int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, cut so that a text column has at most ``most`` bytes in each piece, or a piece one row.

    A batch has up to 10,000 rows whatever their length; with a tree for each of them at once, a worker's memory grows with its task. Columns
    made for a piece go out before the next piece is read."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 64
        if start < batch.num_rows:
            yield batch.slice(start)
