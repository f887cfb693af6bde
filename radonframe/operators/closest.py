"""The nearest row by two differences in turn, by searches in sorted values: no pairs are listed.

Differences are those of the machine's numbers, as a query would take them: rows whose first differences round to the same are equal in it. As
rounding keeps order, they lie next to each other around the place of the value, and are gone through from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, and whether they are there."""
    there = column.is_valid().to_numpy()
    return column.fill_null(pa.scalar(0, column.type)).to_numpy(), there


def _place(values: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each x the first place in [lo, hi) whose value is not less, or hi."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        less = open_ & (values[np.where(open_, mid, 0)] < x)
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def _tied(values: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of x, places): all places in [lo, hi), which are not empty and ascend, at the least distance from x, each x at most once a time."""
    p = _place(values, x, lo, hi)
    below, above = (np.abs(x - values[np.clip(k, lo, hi - 1)]) for k in (p - 1, p))
    least = np.where((p > lo) & ((p == hi) | (below <= above)), below, above)
    for step, k in ((-1, p - 1), (1, p)):
        rows = np.arange(len(x))
        while len(rows):
            inside = (k >= lo[rows]) & (k < hi[rows])
            rows, k = rows[inside], k[inside]
            near = np.abs(x[rows] - values[k]) == least[rows]
            rows, k = rows[near], k[near]
            if len(rows):
                yield rows, k
            k = k + step


class _Groups:
    """Rows in groups, to find in a group the row whose second value is nearest; ties by rank. Without a second value on either side: the least rank, after all others."""

    def __init__(self, rows: np.ndarray, group: np.ndarray, n: int, second: np.ndarray, there: np.ndarray, rank: np.ndarray) -> None:
        self.rank = rank
        order = np.lexsort((rank[rows], group))
        self.first = rows[order][np.searchsorted(group[order], np.arange(n))]  # of least rank
        rows, group = rows[there[rows]], group[there[rows]]
        order = np.lexsort((rank[rows], second[rows], group))
        rows, group = rows[order], group[order]
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[rows[1:]] != second[rows[:-1]])
        self.runs, self.values = rows[new], second[rows[new]]  # of equal seconds, the one of least rank
        self.lo, self.hi = (np.searchsorted(group[new], np.arange(n), side) for side in ("left", "right"))

    def find(self, group: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, second difference, whether there is one) for each group and second value asked."""
        out, d, known = self.first[group], np.zeros(len(y), np.abs(y[:0] - self.values[:0]).dtype), there & (self.lo[group] < self.hi[group])
        asked = np.flatnonzero(known)
        rank = np.full(len(asked), len(self.rank) + 1)
        for rows, k in _tied(self.values, y[asked], self.lo[group[asked]], self.hi[group[asked]]):
            better = self.rank[self.runs[k]] < rank[rows]
            rows, k = rows[better], k[better]
            rank[rows], out[asked[rows]], d[asked[rows]] = self.rank[self.runs[k]], self.runs[k], np.abs(y[asked[rows]] - self.values[k])
        return out, d, known


def closest(left: pa.Table, right: pa.Table, first: tuple[str, str], second: tuple[str, str], tie: str) -> np.ndarray:
    """For each left row the number of the right row with the least (difference of the first columns, of the second, ``tie``).

    First differences that are not numbers come after all others, those with a null last; a second difference that is null or not finite, and a null tie, come last.
    """
    x, x_there = _numbers(left[first[0]])
    f, f_there = _numbers(right[first[1]])
    (y, y_there), (s, s_there) = _numbers(left[second[0]]), _numbers(right[second[1]])
    y_there, s_there = y_there & np.isfinite(y), s_there & np.isfinite(s)
    rank = pc.rank(right[tie].combine_chunks() if right.num_rows else right[tie], sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64)
    every, number = np.arange(right.num_rows), f_there & ~np.isnan(f)
    out = np.zeros(left.num_rows, np.int64)

    def of_all(asked: np.ndarray, *choices: np.ndarray) -> None:
        """All first differences are equal: of the first choice of right rows that has any, by the second."""
        asked = np.flatnonzero(asked)
        rows = every[next(c for c in (*choices, np.ones(len(every), bool)) if c.any())]
        none = np.zeros(len(rows), np.int64)
        out[asked] = _Groups(rows, none, 1, s, s_there, rank).find(np.zeros(len(asked), np.int64), y[asked], y_there[asked])[0]

    finite = x_there & np.isfinite(x)
    of_all(~x_there)
    of_all(x_there & np.isnan(x), f_there)
    for end in (np.inf, -np.inf):
        of_all(x_there & (x == end), number & (f != end), f_there)
    if not number.any():
        of_all(finite, f_there)
        return out
    values, group = np.unique(f[number], return_inverse=True)
    groups = _Groups(every[number], group, len(values), s, s_there, rank)
    asked = np.flatnonzero(finite)
    best: list[np.ndarray] | None = None
    zero = np.zeros(len(asked), np.int64)
    for rows, k in _tied(values, x[asked], zero, zero + len(values)):
        row, d, known = groups.find(k, y[asked[rows]], y_there[asked[rows]])
        if best is None:
            best = [zero - 1, np.zeros(len(asked), d.dtype), np.zeros(len(asked), bool)]
        old, old_d, old_known = (b[rows] for b in best)
        lower = rank[row] < rank[old]
        better = (old < 0) | (known & ~old_known) | (known & old_known & ((d < old_d) | ((d == old_d) & lower))) | (~known & ~old_known & lower)
        for b, new in zip(best, (row, d, known), strict=True):
            b[rows[better]] = new[better]
    if best is not None:
        out[asked] = best[0]
    return out
