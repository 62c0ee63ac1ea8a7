"""Arrays packed into binary columns, for messages between groups of a job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """An array as bytes: its smallest integer type, byte planes, compressed."""
    values = np.ascontiguousarray(values)
    if values.dtype.kind in "iu" and values.itemsize > 1 and len(values):
        values = values.astype(np.promote_types(np.min_scalar_type(values.min()), np.min_scalar_type(values.max())))
    if not len(values):
        return f"{values.dtype.str}:0:".encode()
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return f"{values.dtype.str}:{len(values)}:".encode() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind: str | None = None) -> np.ndarray:
    """The array again; ``kind`` is the type it is wanted in."""
    dtype, size, planes = blob.split(b":", 2)
    dtype, size = np.dtype(dtype.decode()), int(size)
    if not size:
        return np.empty(0, kind or dtype)
    flat = pa.decompress(planes, decompressed_size=size * dtype.itemsize, codec="zstd", asbytes=True)
    values = np.frombuffer(flat, np.uint8).reshape(dtype.itemsize, size).T.copy().view(dtype).reshape(size)
    return values.astype(kind) if kind else values
