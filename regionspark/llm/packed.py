"""Integer arrays as compressed bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeeze(x: np.ndarray, sorted_keys: bool = False) -> bytes:
    """Bytes of an integer array: differences if sorted, planes of equal significance, zstd."""
    if sorted_keys and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, dtype: str, sorted_keys: bool = False) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    x = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
    return np.cumsum(x, dtype=dtype) if sorted_keys else x


def squeeze_signed(x: np.ndarray) -> bytes:
    """The same for 64-bit integers of either sign that are mostly near zero."""
    return squeeze(((x << 1) ^ (x >> 63)).view(np.uint64))


def expand_signed(data: bytes) -> np.ndarray:
    x = expand(data, "<u8")
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)
