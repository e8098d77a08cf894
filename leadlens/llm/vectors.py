"""Integer vectors in blocks: reading float arrays from Arrow as whole numbers, and packing them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIMIT = float(1 << 62)


def whole_numbers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(takes part, floor(scale * x) per component) of a list column.  A null vector, or one that
    holds null or non-finite components, takes no part; a missing component of a shorter vector
    counts as 0; values beyond +-2^62 become that bound."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    vectors = vectors.cast(pa.list_(pa.float64()))
    good = np.asarray(pc.is_valid(vectors)).copy()
    n = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)).astype(np.int64)
    values = np.asarray(pc.fill_null(vectors.flatten(), float("nan"))).astype(float)
    row = np.repeat(np.arange(len(n)), n)
    good[row[~np.isfinite(values)]] = False
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.nan_to_num(np.floor(values * scale), nan=0.0), -_LIMIT, _LIMIT)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = whole.astype(np.int64)
    return good, out


def pack(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a value, values) in the smallest integer that holds them all."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return width, np.ascontiguousarray(x, f"<i{width}").tobytes()


def unpack(width: int, blob: bytes, rows: int) -> np.ndarray:
    """rows x dimensions, as int64."""
    flat = np.frombuffer(blob, f"<i{width}").astype(np.int64)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def widen(x: np.ndarray, dims: int) -> np.ndarray:
    """Rows with zeros up to ``dims`` dimensions."""
    return x if x.shape[1] == dims else np.concatenate((x, np.zeros((len(x), dims - x.shape[1]), x.dtype)), axis=1)


def stack(parts: list[np.ndarray]) -> np.ndarray:
    """Blocks of any width above each other."""
    dims = max((p.shape[1] for p in parts), default=0)
    return np.concatenate([widen(p, dims) for p in parts]) if parts else np.zeros((0, 0), np.int64)
