"""Unrestricted Damerau-Levenshtein distance, batch-wise over Arrow: bounded, many pairs at once.

Spark has only plain Levenshtein. One Damerau-Levenshtein step is two plain ones at most, so
``levenshtein(a, b, 2k) >= 0`` drops no pair within k; what is left comes here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and transpositions, edited stretches free to be edited again."""
    if a == b:
        return 0
    top = len(a) + len(b)
    last_row: dict[str, int] = {}
    table = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last_col = 0
        for j, y in enumerate(b, 1):
            r, c = last_row.get(y, 0), last_col
            same = x == y
            if same:
                last_col = j
            table[i + 1][j + 1] = min(table[i][j] + (not same), table[i + 1][j] + 1, table[i][j + 1] + 1, table[r][c] + (i - r - 1) + 1 + (j - c - 1))
        last_row[x] = i
    return table[-1][-1]


#: Pairs that are measured side by side.
TOGETHER = 8192


def bounded(a: list[str], b: list[str], most: int) -> np.ndarray:
    """The distance of each pair ``a[n], b[n]`` where it is ``most`` at most, else -1; pairs of like length side by side."""
    out = np.full(len(a), -1, np.int64)
    sizes = np.array([list(map(len, a)), list(map(len, b))]).reshape(2, len(a))
    near = np.flatnonzero(abs(sizes[0] - sizes[1]) <= most)
    near = near[np.argsort(sizes[0][near], kind="stable")]
    for at in range(0, len(near), TOGETHER):
        own = near[at : at + TOGETHER]
        out[own] = _band([a[n] for n in own], [b[n] for n in own], *sizes[:, own], most)
    return out


def _codes(texts: list[str], width: int, blank: int) -> np.ndarray:
    """Characters, a row for each text between two blanks and more."""
    flat = np.frombuffer("".join([t.ljust(width, "\0") for t in texts]).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(texts), width)
    inside = np.arange(width) < np.array(list(map(len, texts)))[:, None]
    out = np.full((len(texts), width + 2), blank, np.int32)
    out[:, 1:-1] = np.where(inside, flat, blank)
    return out


def _band(a: list[str], b: list[str], na: np.ndarray, nb: np.ndarray, most: int) -> np.ndarray:
    """Of each row of the table only the cells by the diagonal, ``most`` to either side, for all pairs at once; a pair whose cells are all over it stops.

    Cell (i, j) is at place j - i + most of row i. A transposition joins letters that stand i - r and j - c apart, the letters between them edited:
    none that costs more than ``most`` matters, so only rows near by are looked at.
    """
    result = np.full(len(a), -1, np.int64)
    width, over = int(max(na.max(), nb.max())) + most, most + 1
    x, y = _codes(a, width, -1), _codes(b, width, -2)
    live = np.arange(len(a))
    place = np.arange(2 * most + 1)
    row = np.where(place >= most, place - most, over)[None, :].repeat(len(a), axis=0)  # row 0
    rows = [row]
    for i in range(int(na.max()) + 1):
        if i:
            row = np.full((len(live), 2 * most + 1), over)
            for d in place:
                j = i + d - most
                if j < 0:
                    continue
                if j == 0:
                    row[:, d] = i
                    continue
                cost = rows[-1][:, d] + (x[:, i] != y[:, j])
                if d < 2 * most:
                    cost = np.minimum(cost, rows[-1][:, d + 1] + 1)
                if d:
                    cost = np.minimum(cost, row[:, d - 1] + 1)
                for up in range(1, min(most, i) + 1):  # r = i - up, c = j - left
                    for left in range(1, min(most - up + 1, j) + 1):
                        swap = (x[:, i - up] == y[:, j]) & (x[:, i] == y[:, j - left])
                        to = d - left + up  # of the cell before both letters, in the row before r
                        if up < len(rows) and 0 <= to <= 2 * most:
                            cost = np.where(swap, np.minimum(cost, rows[-1 - up][:, to] + up + left - 1), cost)
                row[:, d] = np.minimum(cost, over)
            rows = [*rows[-most - 1 :], row]
        done = na[live] == i
        if done.any():
            end = row[done, (nb[live] - na[live] + most)[done]]
            result[live[done]] = np.where(end <= most, end, -1)
        keep = ~done & (np.min([r.min(axis=1) for r in rows], axis=0) <= most)
        if not keep.any():
            break
        if keep.sum() * 4 < len(live) * 3:  # what is done leaves, once it is a quarter
            live, x, y, rows = live[keep], x[keep], y[keep], [r[keep] for r in rows]
    return result


@F.pandas_udf(IntegerType())
def _bounded(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    there = (a.notna() & b.notna() & most.notna()).to_numpy()
    k = most[there].to_numpy(np.int64)
    got = bounded(a[there].tolist(), b[there].tolist(), int(k.max(initial=0)))
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    out[there] = pd.array(np.where((got >= 0) & (got <= k), got, -1), dtype="Int32")
    return out.where(out >= 0)


# a filter on the distance would else be moved below it, and the distance measured on either side
_bounded = _bounded.asNondeterministic()


def distance_within(a: Column, b: Column, most: Column) -> Column:
    """The distance where it is ``most`` at most, else null. Costs grow with ``most``, not with the product of the lengths."""
    return _bounded(a, b, most)


def maybe_within(a: Column, b: Column, most: Column, map_a: Column | None = None, map_b: Column | None = None) -> Column:
    """True for every pair within ``most`` edits and for few others; stays in the JVM."""
    near = F.abs(F.length(a) - F.length(b)) <= most
    if map_a is not None:
        near = near & (F.bit_count(map_a.bitwiseXOR(map_b)) <= 2 * most)
    return near & (F.levenshtein(a, b) <= 2 * most)
