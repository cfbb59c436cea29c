"""Free stretches of a resource during waits, for many resources and days at once, without pairing waits and intervals.

An instant y ends a free stretch of a wait [b, e] if nothing that counts for the wait lies in (y - gap, y).
Intervals that began before b and end after e do not count, all others that reach into the wait do. So with A(y),
the latest start among intervals that reach into that stretch, y is one if A(y) < b, and if no interval that
began before b ends within (y - gap, e]. Both are searches for the next value below a bound, in arrays ordered by time.
"""

from __future__ import annotations

import numpy as np

#: Times of a group are shifted by its number times a span; beyond this groups are taken in turns.
_MOST = 1 << 62


def next_below(values: np.ndarray, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each at and bound the first index from at on with a value below bound, or the number of values."""
    n = len(values)
    none = np.iinfo(np.int64).max
    levels = [values]
    while len(levels[-1]) > 1:
        low = levels[-1]
        low = np.append(low, none) if len(low) % 2 else low
        levels[-1] = low
        levels.append(np.minimum(low[::2], low[1::2]))
    found = np.full(len(at), n, np.int64)
    level = np.full(len(at), -1, np.int8)
    node = np.zeros(len(at), np.int64)
    rows, place = np.arange(len(at)), at.astype(np.int64)
    # Upwards: a right child is looked at by itself, a left one with its sibling, as their parent.
    for k, mins in enumerate(levels):
        left = place < len(mins)
        rows, place = rows[left], place[left]
        look = (place & 1 == 1) | (k == len(levels) - 1)
        hit = np.zeros(len(rows), bool)
        hit[look] = mins[place[look]] < bound[rows[look]]
        level[rows[hit]], node[rows[hit]] = k, place[hit]
        rows, place = rows[~hit], (place[~hit] + (place[~hit] & 1)) >> 1
    for k in range(len(levels) - 1, 0, -1):
        rows = np.flatnonzero(level >= k)
        child = node[rows] * 2
        node[rows] = np.where(levels[k - 1][child] < bound[rows], child, child + 1)
    found[level >= 0] = node[level >= 0]
    return found


def last_below(values: np.ndarray, before: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each the last index below `before` with a value below bound, or -1."""
    n = len(values)
    return n - 1 - next_below(values[::-1], n - before, bound) if n else np.full(len(before), -1, np.int64)


def _largest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The largest of values[lo:hi], or none where there is none."""
    out, some = none.copy(), lo < hi
    size = np.where(some, np.frexp((hi - lo).astype(np.float64))[1] - 1, -1)
    table = values
    for k in range(int(size.max(initial=-1)) + 1):
        if k:
            table = np.maximum(table[: -(1 << k - 1)], table[1 << k - 1 :])
        rows = np.flatnonzero(size == k)
        out[rows] = np.maximum(out[rows], np.maximum(table[lo[rows]], table[hi[rows] - (1 << k)]))
    return out


def _at(values: np.ndarray, index: np.ndarray, none: np.ndarray) -> np.ndarray:
    """values[index], none where the index is -1."""
    return np.where(index >= 0, values[index], none) if len(values) else none


def free_times(group: np.ndarray, day: np.ndarray, s: np.ndarray, t: np.ndarray, of: np.ndarray, b: np.ndarray, e: np.ndarray, off_group: np.ndarray, off_lo: np.ndarray, off_hi: np.ndarray, gap: int, length: int) -> dict[str, np.ndarray]:
    """What each wait's day has: first (end of the first free stretch), lo (where it begins), hi (end of the last), end (what ends last) and z (the last end of the day).

    Groups are a resource's days, numbered from 0; day has each one's start, `length` is that of a day. Intervals
    [s, t] are in `group` if they reach into its day or end less than gap before it, waits [b, e] in `of` if they
    meet its day, off-duty stretches like intervals. first, lo and hi are within the day. A smallest integer is none.
    """
    none = np.iinfo(np.int64).min
    out = {k: np.full(len(b), none, np.int64) for k in ("first", "lo", "hi", "end", "z")}
    if not len(b):
        return out
    times = [x for x in (day, s, t, b, e, off_lo, off_hi) if len(x)]
    base = min(int(x.min()) for x in times) - gap - 2
    span = max(int(x.max()) for x in times) + max(gap, length) + 2 - base
    each = max(_MOST // span, 1)
    for first in range(0, len(day), each):
        mine = [(x >= first) & (x < first + each) for x in (group, of, off_group)]
        up = lambda g, x: (g - first) * span + (x - base)  # noqa: B023, E731
        part = _free(
            up(np.arange(first, min(first + each, len(day))), day[first : first + each]), np.arange(min(each, len(day) - first)) * span, of[mine[1]] - first,
            up(group, s)[mine[0]], up(group, t)[mine[0]], up(of, b)[mine[1]], up(of, e)[mine[1]], up(off_group, off_lo)[mine[2]], up(off_group, off_hi)[mine[2]], gap, length,
        )
        back = base - (of[mine[1]] - first) * span
        for k, x in part.items():
            out[k][mine[1]] = np.where(x == none, none, x + back)
    return out


def _free(day, floor, of, s, t, b, e, off_lo, off_hi, gap, length) -> dict[str, np.ndarray]:
    """free_times on times that grow from group to group, so that no search ends inside another group with an answer; floor lies below all times of a group."""
    none = np.iinfo(np.int64).min
    order = np.lexsort((t, s))
    by_start, its_end = s[order], t[order]
    order = np.argsort(t, kind="stable")
    by_end, its_start = t[order], s[order]
    ends = np.sort(np.concatenate([t, off_hi]))
    order = np.argsort(off_lo, kind="stable")
    off_from, off_until = off_lo[order], np.maximum.accumulate(off_hi[order])

    def on_duty(y):
        """No off-duty stretch reaches into (y - gap, y)."""
        return _at(off_until, np.searchsorted(off_from, y) - 1, np.zeros_like(y)) <= y - gap

    def latest(y, low):
        """The latest start before y of intervals that end after y - gap."""
        return _at(by_start, last_below(-its_end, np.searchsorted(by_start, y), gap - y), low)

    d0, low = day[of], floor[of]
    d1 = d0 + length
    # Ends of free stretches: starts within a day of intervals and of off-duty stretches.
    y = np.unique(np.concatenate([s, off_lo]))
    place = np.searchsorted(floor, y, "right") - 1
    keep = (y >= day[place]) & (y < day[place] + length)
    y, place = y[keep], place[keep]
    keep = on_duty(y)
    y, place = y[keep], place[keep]
    a = latest(y, floor[place])
    reached = np.maximum(b, _at(by_end, last_below(its_start, np.searchsorted(by_end, e, "right"), b), b)) + gap
    i = next_below(a, np.searchsorted(y, reached), b) if len(y) else np.zeros(len(b), np.int64)
    first = np.append(y, 0)[i]
    found = (i < len(y)) & (first < e)
    first = np.where(found, first, none)
    j = last_below(a, np.searchsorted(y, e), b)
    hi = _at(y, j, low)
    hi = np.where((j >= 0) & (hi >= reached), hi, none)
    # The end of the wait ends a free stretch too.
    own = (e < d1) & (e >= reached) & (latest(e, low) < b) & on_duty(e)
    first, hi = np.where(own & ~found, e, first), np.where(own, e, hi)
    lo = np.where(first == none, none, np.maximum(b, _at(ends, np.searchsorted(ends, first - gap, "right") - 1, b)))
    end = _largest(its_end, np.searchsorted(by_start, np.maximum(b, d0)), np.searchsorted(by_start, np.minimum(e, d1)), e)
    z = _at(ends, np.searchsorted(ends, d1, "right") - 1, low)
    return {"first": first, "lo": lo, "hi": hi, "end": end, "z": np.where((e >= d1) & (z > b), z, none)}
