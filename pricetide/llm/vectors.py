"""Whole-number vectors made from arrays of floats, and their packed form.

A component c becomes floor(scale * c). A packed vector is one byte for the width of its integers (1, 2, 4 or 8
bytes) and then the integers, little end first, without the zeros at its end: the narrowest width that holds them all,
so equal vectors have equal bytes and a column of them can be grouped, shuffled and counted as it is.

Vectors shorter than others count as if they had zeros at their end; a vector without components is all zeros. A
component beyond 64 bits becomes the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pricetide.llm.textbuf import text_bytes

#: Components that are handled as one matrix.
CELLS = 1 << 20

_WIDTHS = [(1, 127), (2, 32_767), (4, 2**31 - 1), (8, 2**63 - 1)]
_TOP = float(2**63)


def whole_numbers(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of runs of the rows that take part.

    A row that is null or holds a null, infinite or undefined component takes no part.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = np.asarray(column.is_valid()) & (bad[at[1:]] == bad[at[:-1]])
    rows = np.flatnonzero(fine)
    with np.errstate(over="ignore"):
        scaled = np.floor(float(scale) * np.where(np.isfinite(values), values, 0.0)) + 0.0
    low, high = scaled < -_TOP, scaled >= _TOP
    numbers = np.where(low | high, 0.0, scaled).astype(np.int64)
    numbers[low], numbers[high] = -(2**63 - 1), 2**63 - 1
    width = max(1, int(lengths[rows].max(initial=0)))
    step = max(1, CELLS // width)
    for first in range(0, len(rows), step):
        some = rows[first:first + step]
        wide = lengths[some]
        out = np.zeros((len(some), int(wide.max(initial=0))), np.int64)
        if len(np.unique(wide)) == 1:
            out[:] = numbers[at[some][:, None] + np.arange(out.shape[1])]
        else:
            for k, row in enumerate(some):
                out[k, :wide[k]] = numbers[at[row]:at[row + 1]]
        yield some, out


def packed(matrix: np.ndarray) -> list[bytes]:
    """The packed form of each row."""
    n, dims = matrix.shape
    if not dims:
        return [b"\1"] * n
    used = matrix != 0
    last = np.where(used.any(axis=1), dims - used[:, ::-1].argmax(axis=1), 0)
    peak = np.abs(matrix).max(axis=1)
    kind = np.searchsorted([top for _, top in _WIDTHS], peak)
    out: list[bytes] = [b""] * n
    for k, (width, _) in enumerate(_WIDTHS):
        rows = np.flatnonzero(kind == k)
        body, head = matrix[rows].astype(f"<i{width}").tobytes(), bytes([width])
        for i, (row, end) in enumerate(zip(rows.tolist(), last[rows].tolist())):
            begin = i * dims * width
            out[row] = head + body[begin:begin + end * width]
    return out


def unpacked(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """The matrix of packed vectors, ``dims`` wide or as wide as the longest."""
    body, at = text_bytes(column)
    sizes = np.diff(at)
    widths = body[at[:-1]].astype(np.int64)
    lengths = (sizes - 1) // np.maximum(widths, 1)
    out = np.zeros((len(sizes), int(lengths.max(initial=0)) if dims is None else dims), np.int64)
    shapes = widths << 40 | sizes
    for shape in np.unique(shapes):
        rows = np.flatnonzero(shapes == shape)
        width, size = int(shape >> 40), int(shape & ((1 << 40) - 1))
        raw = np.ascontiguousarray(body[at[rows][:, None] + np.arange(1, size)])
        out[rows, :(size - 1) // width] = raw.view(f"<i{width}") if size > 1 else 0
    return out


def peak(matrix: np.ndarray) -> int:
    """The largest absolute entry."""
    return int(np.abs(matrix).max(initial=0))


def exact_products(left: np.ndarray, right: np.ndarray, bound: int) -> np.ndarray:
    """left @ right for whole numbers, exact, where no sum of absolute products is above ``bound``."""
    if bound < 1 << 24:
        return (left.astype(np.float32) @ right.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return left.astype(np.int64) @ right.astype(np.int64)
    return left.astype(object) @ right.astype(object)
