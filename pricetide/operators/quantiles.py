"""Exact quantiles of whole columns by counting, without sorting or gathering a column.

Doubles are put into the order of whole numbers by their bits. A pass counts values by the next `DIGIT` bits below
each range that a wanted rank lies in; the counts say which smaller range holds the rank. Ranges shrink until they
hold at most `FEW` values, which are then read and ranked, or a single number however often it occurs. Two passes do
for some millions of values, six for any number.

Tasks count in numpy and send only counts, at most ``2 ** DIGIT`` per column and wanted rank; they are summed on Spark
and read to the driver. No pass depends on how values are spread: equal values fall into one range together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..session import ship

DIGIT = 11
#: Values of one range that are read and ranked on the driver.
FEW = 1024

QUANTILES = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("quantiles", T.ArrayType(T.DoubleType())),
])

_SIGN = np.uint64(1 << 63)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = np.ascontiguousarray(values, np.float64).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _number(order: int) -> float:
    bits = order & ~(1 << 63) if order >> 63 else ~order & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """One row per column: ``column``, ``n`` and ``quantiles`` (linear interpolation between ranks).

    Missing values (NULL or NaN) are ignored; a column without values has no row. ``df`` is read
    three times or more, so pass a stored table.
    """
    spark = df.sparkSession
    ship(spark)
    values = df.select(*[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])
    counts = _counts(values, {k: [0] for k in range(len(columns))}, 0, DIGIT)
    sizes = {k: sum(counts[k, 0].digits.values()) for k in range(len(columns)) if (k, 0) in counts}
    # Wanted ranks: (column, rank) -> (range so far, its bits, rank inside it, values in it).
    open_ = {(k, r): (0, 0, r, n) for k, n in sizes.items()
             for p in probabilities for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
    found: dict[tuple[int, int], float] = {}
    depth = 0
    while open_:
        width = min(DIGIT, 64 - depth)
        if depth:
            counts = _counts(values, _ranges(open_), depth, width)
        shrunk = {}
        for (k, r), (prefix, _, rank, _) in open_.items():
            part = counts[k, prefix]
            if part.low == part.high:
                found[k, r] = part.low
                continue
            for digit, n in sorted(part.digits.items()):
                if rank < n:
                    shrunk[k, r] = (prefix << width | digit, depth + width, rank, n)
                    break
                rank -= n
        depth += width
        if depth == 64:
            found |= {key: _number(prefix) for key, (prefix, *_) in shrunk.items()}
            break
        open_ = shrunk
        few = {key: part for key, part in open_.items() if part[3] <= FEW}
        if len(few) == len(open_):
            held = _values(values, _ranges(few), depth)
            found |= {(k, r): sorted(held[k, prefix])[rank] for (k, r), (prefix, _, rank, _) in few.items()}
            break
    rows = []
    for k, n in sizes.items():
        at = [(n - 1) * p for p in probabilities]
        low = [found[k, math.floor(x)] for x in at]
        high = [found[k, math.ceil(x)] for x in at]
        rows.append((columns[k], n, [a if a == b else a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, at)]))
    return spark.createDataFrame(rows, QUANTILES)


@dataclass
class _Range:
    """Counts by digit of a range's values, and the least and largest of them."""

    digits: dict[int, int] = field(default_factory=dict)
    low: float = 0.0
    high: float = 0.0


def _ranges(parts: dict) -> dict[int, list[int]]:
    wanted: dict[int, set[int]] = {}
    for (k, _), (prefix, *_) in parts.items():
        wanted.setdefault(k, set()).add(prefix)
    return {k: sorted(v) for k, v in wanted.items()}


def _inside(column: pa.Array, prefixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order numbers of the values inside the ranges, and the range of each."""
    x = column.to_numpy(zero_copy_only=False)
    keys = _ordered(x[~np.isnan(x)])
    if not depth:
        return keys, np.zeros(len(keys), np.int64)
    top = keys >> np.uint64(64 - depth)
    place = np.minimum(np.searchsorted(prefixes, top), len(prefixes) - 1)
    hit = prefixes[place] == top
    return keys[hit], place[hit]


def _counts(values: DataFrame, ranges: dict[int, list[int]], depth: int, width: int) -> dict[tuple[int, int], _Range]:
    """Counts by the next ``width`` bits of the values in each range."""
    wanted = {k: np.array(v, np.uint64) for k, v in ranges.items()}
    shift, mask = np.uint64(64 - depth - width), np.uint64((1 << width) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: np.zeros(len(v) << width, np.int64) for k, v in wanted.items()}
        low, high = ({k: np.full(len(v), x) for k, v in wanted.items()} for x in (np.inf, -np.inf))
        for batch in batches:
            for k, prefixes in wanted.items():
                keys, place = _inside(batch.column(k), prefixes, depth)
                for i in range(len(prefixes)):
                    mine = keys[place == i]
                    if len(mine):
                        low[k][i], high[k][i] = min(low[k][i], _number(int(mine.min()))), max(high[k][i], _number(int(mine.max())))
                made[k] += np.bincount(place << width | (keys >> shift & mask).astype(np.int64), minlength=len(made[k]))
        for k, total in made.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k, np.int32)), pa.array((used >> width).astype(np.int32)),
                 pa.array((used & ((1 << width) - 1)).astype(np.int32)), pa.array(total[used]),
                 pa.array(low[k][used >> width]), pa.array(high[k][used >> width])],
                names=["column", "range", "digit", "n", "low", "high"])

    found = values.mapInArrow(count, "column int, range int, digit int, n long, low double, high double").groupBy(
        "column", "range", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[tuple[int, int], _Range] = {}
    for r in found.collect():
        part = out.setdefault((r.column, ranges[r.column][r.range]), _Range(low=r.low, high=r.high))
        part.digits[r.digit] = r.n
        part.low, part.high = min(part.low, r.low), max(part.high, r.high)
    return out


def _values(values: DataFrame, ranges: dict[int, list[int]], depth: int) -> dict[tuple[int, int], list[float]]:
    """The values in each range; `FEW` at most are in one."""
    wanted = {k: np.array(v, np.uint64) for k, v in ranges.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, prefixes in wanted.items():
                keys, place = _inside(batch.column(k), prefixes, depth)
                if len(keys):
                    x = np.where(keys & _SIGN, keys & ~_SIGN, ~keys).astype(np.uint64).view(np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), k, np.int32)), pa.array(place.astype(np.int32)), pa.array(x)],
                        names=["column", "range", "value"])

    out: dict[tuple[int, int], list[float]] = {}
    for r in values.mapInArrow(read, "column int, range int, value double").collect():
        out.setdefault((r.column, ranges[r.column][r.range]), []).append(r.value)
    return out
