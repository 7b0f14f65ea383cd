"""A grid of terms and documents as a compressed quadtree whose cells hold the largest impact below them, and its joint descent."""

from __future__ import annotations

import numpy as np

#: Cells that one step of a descent looks at, and that may wait in a queue before the deepest are taken first.
STEP, WAITING = 1 << 13, 1 << 22


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31 with a gap behind each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _height(n: int) -> int:
    return max(int(n) - 1, 0).bit_length()


class Treap:
    """Points ``(row, column, impact)`` of a grid; a cell is a quarter of the one above it and is kept only if it has points.

    ``bits`` has four entries per inner cell, in the order of levels: which quarters have points. The number of set bits before one is the
    number of the quarter's own cell, less one. ``most`` is the largest impact in each cell. Rows lie in the upper bits of their coordinate, columns
    in the lower, so that a path has settled on its row while its range of columns is still wide.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray, rows: int, columns: int):
        self.height = max(_height(rows), _height(columns))
        self.shift = self.height - _height(rows)
        codes = (_spread(row << self.shift) << np.uint64(1)) | _spread(column)
        order = np.argsort(codes)
        codes, most = codes[order], impact[order]
        bits, maxima = [], [most]
        for _ in range(self.height):  # from the leaves up
            above = codes >> np.uint64(2)
            first = np.flatnonzero(np.diff(above, prepend=~above[:1]) != 0)
            there = np.zeros(4 * len(first), bool)
            there[4 * np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes)))) + (codes & np.uint64(3)).astype(np.int64)] = True
            most = np.maximum.reduceat(most, first) if len(first) else most
            codes = above[first]
            bits.append(there)
            maxima.append(most)
        bits = np.concatenate(bits[::-1]) if bits else np.zeros(0, bool)
        # A quarter's own cell, or the last entry, which is an empty cell without impact.
        cells = np.cumsum(bits)
        self.below = np.where(bits, cells, -1).astype(np.int64 if len(bits) > 2**31 else np.int32)
        self.most = np.append(np.concatenate(maxima[::-1]), 0)
        self.empty = not len(row)

    def best(self, rows: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns with the ``k`` largest sums of impacts in ``rows``, all that are level with the last included, and those sums; only sums from ``least`` (at least 1) on.

        The paths of all rows go down together. A range of columns cannot have more than the sum of the maxima of its cells; the ranges
        with the largest such sums are split first, and those below ``least`` or the k-th best sum so far are left out.
        """
        least, found_at, found = max(least, 1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.empty or not len(rows):
            return found_at[0], found[0]
        rows = rows.astype(np.int64) << self.shift
        bound, level, column = np.array([self.most[0] * len(rows)]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells = np.zeros((1, len(rows)), self.below.dtype)
        step = max(1, STEP // len(rows))
        while len(bound):
            if len(bound) > step:
                deep = len(bound) * len(rows) > WAITING
                pick = np.argpartition(-(level if deep else bound), step - 1)
                now, later = pick[:step], pick[step:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            now, later = now[bound[now] >= least], later[bound[later] >= least]
            leaf = level[now] == self.height
            if leaf.any():
                found_at.append(column[now[leaf]])
                found.append(bound[now[leaf]])
                sums = np.concatenate(found)
                if len(sums) >= k:
                    least = max(least, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
                    keep = sums >= least
                    found_at, found = [np.concatenate(found_at)[keep]], [sums[keep]]
                now = now[~leaf]
            now, later = now[bound[now] >= least], later[bound[later] >= least]
            turn = self.height - 1 - level[now]
            quarter = 4 * cells[now] + 2 * ((rows[None, :] >> turn[:, None]) & 1)
            nothing = cells[now] < 0
            parts = [(bound[later], level[later], column[later], cells[later])]
            for half in (0, 1):
                child = self.below[quarter + half] if len(now) else cells[:0]
                child[nothing] = -1
                most = self.most[child].sum(1)
                keep = most >= least
                parts.append((most[keep], level[now][keep] + 1, 2 * column[now][keep] + half, child[keep]))
            bound, level, column, cells = (np.concatenate(p) for p in zip(*parts))
        return np.concatenate(found_at), np.concatenate(found)
