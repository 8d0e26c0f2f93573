"""Feature rows as numpy matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, ids: pa.Array | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; null rows and rows of another length are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    bad = np.flatnonzero((sizes < 0) | (sizes != sizes[:1]))
    if column.null_count or len(bad):
        at = int(np.flatnonzero(sizes < 0)[0]) if column.null_count else int(bad[0])
        name = f"row {at} of a batch" if ids is None else f"id {ids[at].as_py()}"
        raise ValueError(f"features of {name} are null or have another number of values than the first row")
    values = column.flatten()
    if values.null_count:
        raise ValueError("features hold a null value")
    return np.asarray(values).reshape(len(column), -1)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
    return np.maximum(d2, 0.0, out=d2)


def rough_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(d2, off, unit): squared distances over ``unit`` in single precision, and the most a row's are off by.

    A product in single precision takes half the time of one in double; whatever these bounds do not decide
    is to be measured from differences. Rows are moved to the middle of ``y`` and scaled by a power of two.
    """
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), np.float32), np.zeros(len(x), np.float32), 1.0
    dims, middle = x.shape[1], y.mean(axis=0)
    far = (x * x).sum(axis=1) + (y * y).sum(axis=1).max()
    x, y = x - middle, y - middle
    _, power = np.frexp(max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)))
    x, y, unit = np.ldexp(x, -power), np.ldexp(y, -power), float(np.ldexp(1.0, 2 * int(power)))
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    d2 = (-2.0 * x).astype(np.float32) @ y.astype(np.float32).T
    d2 += xx.astype(np.float32)[:, None]
    d2 += yy.astype(np.float32)
    rounding = 4.0 * (dims + 8)
    off = rounding * 2.0**-24 * (xx + yy.max()) + rounding * 2.0**-53 * far / unit
    return d2, (off * (1 + 1e-6) + 1e-30).astype(np.float32), unit


def rough_sides(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(u, v, unit): a value of u @ v.T is at most the squared distance of two rows over ``unit``.

    As :func:`rough_squares`, less what these may be off by, with the sums of squares in the product.
    """
    dims, middle = x.shape[1], y.mean(axis=0)
    far = (x * x).sum(axis=1) + (y * y).sum(axis=1).max()
    x, y = x - middle, y - middle
    _, power = np.frexp(max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)))
    x, y, unit = np.ldexp(x, -power), np.ldexp(y, -power), float(np.ldexp(1.0, 2 * int(power)))
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    rounding = 4.0 * (dims + 8)
    off = rounding * 2.0**-24 * (xx + yy.max()) + rounding * 2.0**-53 * far / unit
    off = off * (1 + 1e-6) + 1e-30
    u = np.concatenate([-2.0 * x, (xx - off)[:, None], np.ones((len(x), 1))], axis=1)
    v = np.concatenate([y, np.ones((len(y), 1)), yy[:, None]], axis=1)
    return u.astype(np.float32), v.astype(np.float32), unit


def exact_squares(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, values: int = 4_000_000) -> np.ndarray:
    """Squared distances of the rows x[i] and y[j] from differences, at most ``values`` of them held at a time."""
    out, step = np.empty(len(i)), max(1, values // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        out[part] = ((x[i[part]] - y[j[part]]) ** 2).sum(axis=1)
    return out
