"""Arrays of numbers as few bytes, for shuffles and stored tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeezed(*columns: np.ndarray) -> bytes:
    """Numbers as bytes: all their first bytes, all their second ones and so on, so that what is alike lies together."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns), codec="zstd", asbytes=True)


def opened(data: bytes, *columns: tuple[type, int]) -> list[np.ndarray]:
    """The arrays that squeezed() got, by their types and lengths."""
    widths = [np.dtype(kind).itemsize for kind, _ in columns]
    raw = np.frombuffer(pa.decompress(data, sum(w * n for w, (_, n) in zip(widths, columns)), codec="zstd"), np.uint8)
    found, at = [], 0
    for w, (kind, n) in zip(widths, columns):
        found.append(np.ascontiguousarray(raw[at : at + w * n].reshape(w, n).T).view(kind).ravel())
        at += w * n
    return found


def steps(ascending: np.ndarray) -> np.ndarray:
    """The first number and what each is more than the one before; np.cumsum() is the way back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))
