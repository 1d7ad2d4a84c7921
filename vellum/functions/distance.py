"""Edit distance of sequences of any length: bit-parallel columns in a band that grows.

One integer holds the vertical differences of a column of the table, a bit for each row of the band around the main diagonal, so a
column is a handful of operations on one integer. The band gives the cost of a real path; if that is no more than the band's reach,
it is the distance, else the next band reaches as far as it has to, at most as far as that path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: The first band's reach, by how much the next one's grows, and the product of lengths up to which the built-in distance is used.
FIRST, GROWTH, SHORT = 64, 4, 1_000_000
#: Bands from which the places of common symbols are worked out once, and the memory for that.
WIDE, MASK_BYTES = 8192, 32 << 20


def _bits(where: np.ndarray) -> int:
    return int.from_bytes(np.packbits(where, bitorder="little").tobytes(), "little")


def _common(rows: np.ndarray, y: np.ndarray) -> dict[int, int]:
    """Where the commonest symbols of ``y`` stand in ``rows``, a bit for each row, in MASK_BYTES in all; the others are looked for in each column."""
    symbols, counts = np.unique(y, return_counts=True)
    most = max(1, 8 * MASK_BYTES // len(rows))
    return {int(s): _bits(rows == s) for s in symbols[np.argsort(-counts, kind="stable")][:most]}


def _banded(x: np.ndarray, y: np.ndarray, k: int) -> int:
    """Cost of the best path from (0, 0) to the end that keeps within ``k`` of the main diagonal; k is at least the difference of lengths."""
    m, n = len(x), len(y)
    width = 2 * k + 1
    ones, top = (1 << width) - 1, 1 << 2 * k
    # bit b of column j is row j - k + b; rows above the first mirror those below it, so that row 0 costs j in column j
    down, up = ones ^ ((1 << k + 1) - 1), (1 << k + 1) - 1
    padded = np.full(m + n + 2 * k + 2, -1, np.int64)  # rows from 1 - k on, none beyond the ends
    padded[k : k + m] = x
    whole = _common(padded, y) if width > WIDE else {}
    on_diagonal, middle = 0, 1 << k
    for j, symbol in enumerate(y.tolist()):
        down, up = down >> 1 | top, up >> 1
        equal = whole[symbol] >> j & ones if symbol in whole else _bits(padded[j : j + width] == symbol)
        level = (((equal & down) + down) ^ down | equal | up) & ones  # the cell costs as much as its upper left neighbour
        more, less = (up | ones & ~(level | down)) << 1 | 1, (level & down) << 1
        down, up = (less | ones & ~(level | more)) & ones, more & level & ones
        on_diagonal += not level & middle
    rows = ((1 << abs(m - n)) - 1) << k + 1 + min(0, m - n)  # between the diagonal's end and the last row
    step = (down & rows).bit_count() - (up & rows).bit_count()
    return on_diagonal + (step if m > n else -step)


def edit_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Fewest insertions, deletions and replacements that turn ``x`` into ``y``; both hold non-negative integers. Memory is linear."""
    same = min(len(x), len(y))
    differ = np.flatnonzero(x[:same] != y[:same])
    start = int(differ[0]) if len(differ) else same
    x, y = x[start:], y[start:]
    same = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:same] != y[::-1][:same])
    stop = int(differ[0]) if len(differ) else same
    x, y = x[: len(x) - stop], y[: len(y) - stop]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    if len(x) < len(y):
        x, y = y, x
    x, y = x.astype(np.int64), y.astype(np.int64)
    k = max(FIRST, len(x) - len(y))
    while (cost := _banded(x, y, min(k, len(x)))) > k:
        k = min(GROWTH * k, cost)
    return cost


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@F.pandas_udf(IntegerType())
def _char_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(_points(x), _points(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(IntegerType())
def _word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> int | None:
        if x is None or y is None:
            return None
        number: dict[str, int] = {}
        return edit_distance(*(np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in (x, y)))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def char_distance(a: Column, b: Column) -> Column:
    """Edit distance over characters (code points). Short pairs never leave the JVM; null if either is null."""
    long = F.length(a).cast("long") * F.length(b) > SHORT
    return F.when(long, _char_edits(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(a, b))


def list_distance(a: Column, b: Column) -> Column:
    """Edit distance over the entries of two arrays of strings; null if either is null."""
    return _word_edits(a, b)
