"""Arrow batches cut to a bounded number of text bytes, for the operators that need Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A task holds about this much text at a time, whatever the session's batch settings are. One
#: text larger than this is a batch of its own.
BATCH_BYTES = 3 << 20
BATCH_ROWS = 4000


def cut(batch: pa.RecordBatch, column: int, max_bytes: int = BATCH_BYTES, max_rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column`` holds at most ``max_bytes`` of text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and (held + size > max_bytes or at - start >= max_rows):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def training_span(text: Column, key: Column, chars: int, seed: int) -> Column:
    """``text``, or of one of more than ``chars`` code points the span of that length which the hash of ``key`` chooses."""
    text = text.cast("string")
    start = F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.length(text) - chars + 1, F.lit(1))).cast("int") + 1
    return F.when(F.length(text) <= chars, text).otherwise(F.substr(text, start, F.lit(chars)))


def map_texts(df: DataFrame, column: int, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply the function that ``work`` returns to every bounded slice of ``df``.

    ``work`` runs once per task, so tables and models are built once and not once per slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for piece in cut(batch, column):
                step = step or work()
                yield step(piece)

    return df.mapInArrow(run, schema)
