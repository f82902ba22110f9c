"""Compact binary form of arrays of small numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

_SQUEEZE, _UNFOLD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on: what tables and shuffles compress better than the numbers."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(numbers: np.ndarray) -> bytes:
    """planes(), compressed."""
    return _SQUEEZE.compress(planes(numbers))


def unpack(data: bytes) -> np.ndarray:
    return from_planes(_UNFOLD.decompress(data)).astype(np.int64)


def binaries(numbers: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """numbers[starts[i]:starts[i + 1]] for each i, as their bytes."""
    offsets = (starts * numbers.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, numbers): what binaries() was given; a null counts as empty."""
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    own = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return (offsets - offsets[0]) // np.dtype(kind).itemsize, own
