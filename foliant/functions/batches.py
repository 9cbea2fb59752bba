"""Cutting Arrow batches, so that a task's memory follows the work on some rows and not a whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are worked on at a time, if no single row has more.
WORDS = 1 << 18
#: Bytes of texts that are worked on at a time, if no single row has more.
BYTES = 1 << 22


def by_words(batch: pa.RecordBatch, words: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose lists ``words`` hold ``most`` words together (WORDS by default), or one row with more; at least one slice."""
    most = WORDS if most is None else most
    yield from _cut(batch, pc.list_value_length(batch.column(words)), most)


def by_bytes(batch: pa.RecordBatch, text: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """As by_words(), by the bytes of the strings ``text`` (BYTES by default)."""
    yield from _cut(batch, pc.binary_length(batch.column(text)), BYTES if most is None else most)


def _cut(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(pc.fill_null(sizes, 0)), dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n or at == n == 0:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
