"""Arrow batches of texts in slices of bounded size, for operators that turn them into Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows that a task turns into strings at once; one larger text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1024


def text_slices(texts: pa.Array, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Begin and end of consecutive slices."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + most_rows, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield begin, end
        begin = end
