"""Whole texts as byte blocks inside Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; a longer single text is a block of its own.
BLOCK_BYTES = 4 << 20


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column; null counts as empty.

    offsets has one entry more than there are rows and begins at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def text_slices(batch: pa.RecordBatch, text: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, so that Python strings stay bounded."""
    column = batch.column(text)
    sizes = np.zeros(len(column) + 1, np.int64)
    lengths = column.cast(pa.binary()).fill_null(b"") if column.null_count else column.cast(pa.binary())
    import pyarrow.compute as pc

    sizes[1:] = np.cumsum(pc.binary_length(lengths).to_numpy(zero_copy_only=False)) if len(column) else []
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(sizes, sizes[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield batch.slice(i, j - i)
        i = j


def give_back() -> None:
    """Gives freed memory of this worker back to the system: it waits for its next task with little of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map, after which the worker gives freed memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def released_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for the rows of a group."""

    def whole(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    return whole
