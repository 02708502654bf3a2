"""Runs (maximal repetitions) of an integer sequence.

Phase one of Baier's suffix sorter groups suffixes by a growing common prefix; when the
groups have been taken from the greatest to the least, each suffix's prefix is its longest Lyndon word.
Done for an order and for its reverse (the end of the text least in both), this gives a Lyndon
root of every run; longest common extensions to both sides turn roots into runs.
"""

from __future__ import annotations

import numpy as np

#: Moduli and bases of the two polynomial hashes behind common extensions.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1299709001)


def lyndon_lengths(ranks: list[int], size: int) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of ``ranks``
    (numbers below ``size``), by Baier's grouping.  Linear time.

    ``up`` and ``down`` chain the groups not yet taken in ascending order; ``taken`` marks suffixes
    of this and of greater groups, so the nearest suffix of a lesser group to the left is found by
    stepping over taken ones along ``left``.
    """
    n = len(ranks)
    groups: list[list[int]] = [[] for _ in range(size)]
    for i, r in enumerate(ranks):
        groups[r].append(i)
    group_of, length = list(ranks), [1] * n
    left, taken = [-1] * n, bytearray(n)
    down, up = list(range(-1, size - 1)), [*range(1, size), -1]
    top = size - 1
    while top >= 0:
        members = [i for i in groups[top] if group_of[i] == top]
        groups[top] = []
        below = down[top]
        if below >= 0:
            up[below] = -1
        top = below
        if not members:
            continue
        add = length[members[0]]
        for i in members:
            taken[i] = 1
        # pointers to the left never cross, so equal ones follow each other
        hits: list[tuple[int, int]] = []
        last, count = -1, 0
        for i in members:
            j = i - 1
            while j >= 0 and taken[j]:
                j = left[j]
            left[i] = j
            if j == last:
                count += 1
            else:
                if last >= 0:
                    hits.append((count, last))
                last, count = j, 1
        if last >= 0:
            hits.append((count, last))
        if not hits:
            continue
        # most pointers first: each new group goes right above its old one
        hits.sort(key=lambda x: (-x[0], x[1]))
        made: dict[int, int] = {}
        before = 0
        for count, j in hits:
            if count != before:
                made, before = {}, count
            old = group_of[j]
            new = made.get(old)
            if new is None:
                new = made[old] = len(groups)
                groups.append([])
                above = up[old]
                up.append(above)
                down.append(old)
                up[old] = new
                if above >= 0:
                    down[above] = new
                else:
                    top = new
            groups[new].append(j)
            group_of[j] = new
            length[j] += count * add
    return length


class Extensions:
    """Longest common extensions of pairs of places, for whole arrays of pairs at
    once: binary search over polynomial hashes of prefixes.  Equal stretches have equal hashes, so a
    length is never too small; ``runs`` checks what it reports word by word."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.tables = []
        values = x.astype(np.uint64) + np.uint64(1)
        for m, base in zip(MODULI, BASES):
            m = np.uint64(m)
            powers = np.ones(self.n + 1, np.uint64)
            known, step = 1, np.uint64(base)
            while known <= self.n:
                more = min(known, self.n + 1 - known)
                powers[known:known + more] = powers[:more] * step % m
                step = step * step % m
                known += more
            prefix = np.zeros(self.n + 1, np.uint64)
            # a residue is below 2^31, so sums of up to 2^32 of them fit
            prefix[1:] = np.cumsum(values % m * powers[:-1] % m, dtype=np.uint64) % m
            self.tables.append((m, powers, prefix))

    def equal(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the ``k`` words from ``a`` are those from ``b`` (a <= b)."""
        out = np.ones(len(a), bool)
        for m, powers, prefix in self.tables:
            left = (prefix[a + k] + m - prefix[a]) % m * powers[b - a] % m
            out &= left == (prefix[b + k] + m - prefix[b]) % m
        return out

    def longest(self, a: np.ndarray, b: np.ndarray, room: np.ndarray, ahead: bool) -> np.ndarray:
        """Longest common extension of places a < b, at most ``room``: of what starts
        there (``ahead``), or of what ends before them."""
        low, high = np.zeros_like(room), room.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) >> 1
            back = 0 if ahead else middle
            same = self.equal(a[open_] - back, b[open_] - back, middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1


def _exact(x: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """Start and end of the stretch of period ``p`` around i, word by word."""
    start, end = i, i + p
    while start > 0 and x[start - 1] == x[start - 1 + p]:
        start -= 1
    while end < len(x) and x[end] == x[end - p]:
        end += 1
    return start, end


def runs(x: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of all runs of ``x`` (small numbers from 0) of length
    max(``least``, 2 * period) and more, by start, then period."""
    n, size = len(x), int(x.max()) + 1 if len(x) else 0
    found = []
    ext = None
    for ranks in (x, size - 1 - x) if n else ():
        p = np.array(lyndon_lengths(ranks.tolist(), size), np.int64)
        i = np.arange(n, dtype=np.int64)
        ahead, back = i + p < n, i > 0
        ahead[ahead] = x[i[ahead]] == x[(i + p)[ahead]]
        back[back] = x[i[back] - 1] == x[(i + p)[back] - 1]
        keep = np.flatnonzero(ahead | back)
        if not len(keep):
            continue
        i, p = keep, p[keep]
        ext = ext or Extensions(x)
        right = ext.longest(i, i + p, n - i - p, True)
        left = ext.longest(i, i + p, i, False)
        size_ = left + p + right
        good = (size_ >= least) & (size_ >= 2 * p)
        found.append(np.stack([i - left, size_, p, i], 1)[good])
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    _, first = np.unique(rows[:, [0, 2]], axis=0, return_index=True)
    rows, sure = rows[first], []
    for start, length, p, i in rows.tolist():
        end = start + length
        if (not np.array_equal(x[start:end - p], x[start + p:end]) or start and x[start - 1] == x[start - 1 + p]
                or end < n and x[end] == x[end - p]):
            start, end = _exact(x, i, p)
        sure.append((start, end - start, p))
    sure = np.array(sorted({(s, k, p) for s, k, p in sure if k >= max(least, 2 * p)},
                           key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    return sure
