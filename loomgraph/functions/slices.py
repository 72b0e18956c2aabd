"""Python work on single rows whose results may be long."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Values a task holds before it hands its rows on.
HELD = 20_000

#: Rows of a batch that are Python objects at a time.
ROWS = 16


def in_slices(batches: Iterator[pa.RecordBatch], row_of: Callable[[dict], dict], listed: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of ``row_of`` for each row; ``listed`` is the column whose lists decide when rows are handed on.

    What is held does not grow with the rows of a batch or of a task, only with the longest result.
    """
    rows, held = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for row in batch.slice(at, ROWS).to_pylist():
                rows.append(row_of(row))
                held += 1 + len(rows[-1][listed] or ())
                if held >= HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
