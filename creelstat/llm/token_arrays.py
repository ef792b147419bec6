"""Texts of an Arrow column cut into tokens as arrays: no Python object per token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_class(separators: bytes) -> np.ndarray:
    """A table of 256 flags: True for the bytes that stand inside tokens. Bytes over 0x7F always do."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


def string_column(column: pa.Array) -> pa.Array:
    """The column as 32-bit strings with empty texts for NULL."""
    if not (pa.types.is_string(column.type) and column.null_count == 0):
        column = pc.fill_null(column.cast(pa.string()), "")
    return column


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts with about ``limit`` bytes each; a longer text is alone."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def tokens(column: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All tokens of these texts in order, and for each text the number of its first token; one number more at the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    keep = inside[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    edges = offsets[:-1]
    edges = edges[(edges < len(data))]
    first[edges] = keep[edges]
    starts = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])  # bytes of tokens ahead of each place
    ends = np.append(before[starts], before[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[keep]))
    return words, np.searchsorted(starts, offsets)
