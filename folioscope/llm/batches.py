"""Arrow batches of bounded size, whatever the session's settings are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes that an operator works on at once, about; a batch has one row at least.
ROWS, BYTES = 512, 16 << 20


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, and so many that they hold about `size` bytes."""
    for batch in batches:
        step = max(1, min(rows, rows if batch.nbytes <= size else batch.num_rows * size // batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
