"""Greedy one-to-one matching of two point sets, nearest pairs first, without the list of all pairs."""

from __future__ import annotations

from itertools import groupby

import numpy as np

PAIRS = 1 << 21  #: pairs of places looked at in one band of distances, where that can be had
CHUNK = 1 << 18  #: pairs of places whose distance is computed, or that are gone through, at once
_ROW = 1 << 32


class _Places:
    """The distinct places of a point set, each with its ids in order."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, y, x))
        x, y, self.ids = x[order], y[order], ids[order].tolist()
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(x) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.x, self.y = x[first], y[first]
        self.head, self.end = first.tolist(), [*first[1:].tolist(), len(x)]
        self.free = np.ones(len(first), bool)
        self.taken: set[int] = set()
        self.unique = len(set(self.ids)) == len(self.ids)

    def next(self, place: int) -> int | None:
        """The first free id of a place; None if there is none."""
        at, end = self.head[place], self.end[place]
        while at < end and self.ids[at] in self.taken:
            at += 1
        self.head[place] = at
        if at < end:
            return self.ids[at]
        self.free[place] = False
        return None


def nearest_first(tx, ty, track, px, py, point, radius: float) -> list[tuple[int, int]]:
    """Matches (track, point) within the radius, taken in the order of (squared distance, track, point). track and point
    are whole numbers; rows of one number are one track or point. Rows that are not finite match nothing.

    Equal places count once. Bands of distance follow each other; a band holds about PAIRS pairs of places that still have
    something free, found by a grid as wide as the band's outer radius. Only more than PAIRS pairs of places at exactly one
    distance make a band larger."""
    t, p = (_Places(*(c[np.isfinite(x) & np.isfinite(y)] for c in (x, y, i))) for x, y, i in ((tx, ty, track), (px, py, point)))
    found: list[tuple[int, int]] = []
    most, low, reach = radius * radius, -1.0, radius
    while low < most and radius >= 0:
        a, b = np.flatnonzero(t.free), np.flatnonzero(p.free)
        if not len(a) or not len(b):
            break
        reach = min(reach, radius)
        while True:
            strips, n = _strips(t, a, p, b, reach)
            if n <= PAIRS or (reach / 2) ** 2 <= low or reach < 1e-9:
                break
            reach /= 2
        high = most if reach >= radius else reach * reach
        d, i, j, full = _band(t, p, strips, low, high)
        at = 0
        while at < len(d):
            end = int(np.searchsorted(d, d[min(at + CHUNK, len(d)) - 1], "right"))  # pairs of one distance stay together
            still = t.free[i[at:end]] & p.free[j[at:end]]
            _take(t, p, d[at:end][still], i[at:end][still], j[at:end][still], found)
            at = end
        low, reach = full, reach * 2 if full == high else reach
    return found


def _strips(t: _Places, a: np.ndarray, p: _Places, b: np.ndarray, reach: float) -> tuple[list, int]:
    """For each of three rows of cells: places a, and from where to where in the sorted b their neighbours lie. And how many pairs that makes."""
    width = max(reach, 1e-9) * (1 + 1e-6)
    cell = lambda v: np.clip(np.floor(v / width), -(1 << 29), 1 << 29).astype(np.int64)
    key = cell(p.y[b]) * _ROW + cell(p.x[b])
    order = np.argsort(key, kind="stable")
    b, key, mine = b[order], key[order], cell(t.y[a]) * _ROW + cell(t.x[a])
    strips = [(a, b, np.searchsorted(key, mine + dy * _ROW - 1, "left"), np.searchsorted(key, mine + dy * _ROW + 1, "right")) for dy in (-1, 0, 1)]
    return strips, sum(int((end - at).sum()) for _, _, at, end in strips)


def _band(t: _Places, p: _Places, strips: list, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(squared distance, place of t, place of p) in the order of distance, of all pairs with low < distance <= the last value
    returned, which is high, or less where more than 2 * PAIRS pairs would be held."""
    kept, held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for a, b, at, end in strips:
        ends = np.cumsum(end - at)
        for k in range(0, int(ends[-1]), CHUNK):
            n = np.arange(k, min(k + CHUNK, int(ends[-1])))
            row = np.searchsorted(ends, n, "right")
            i, j = a[row], b[end[row] - (ends[row] - n)]
            dx, dy = t.x[i] - p.x[j], t.y[i] - p.y[j]
            d = dx * dx + dy * dy
            keep = (d > low) & (d <= high)
            kept.append((d[keep], i[keep], j[keep]))
            held += len(kept[-1][0])
            if held > 2 * PAIRS:
                d, i, j = (np.concatenate(c) for c in zip(*kept))
                high = float(np.partition(d, len(d) // 2)[len(d) // 2])
                keep = d <= high
                kept = [(d[keep], i[keep], j[keep])]
                held = len(kept[0][0])
    d, i, j = (np.concatenate(c) for c in zip(*kept))
    order = np.argsort(d, kind="stable")
    return d[order], i[order], j[order], high


def _take(t: _Places, p: _Places, d: np.ndarray, i: np.ndarray, j: np.ndarray, found: list) -> None:
    """Match along pairs of places in the order of distance."""
    if not len(d):
        return
    first = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d)).tolist()
    i, j = i.tolist(), j.tolist()
    one_each = t.unique and p.unique
    for at, end in zip(first, first[1:]):
        if end - at == 1 or one_each and len(set(i[at:end])) == end - at == len(set(j[at:end])):
            for a, b in zip(i[at:end], j[at:end]):
                if not (t.free[a] and p.free[b]):
                    continue
                while (x := t.next(a)) is not None and (y := p.next(b)) is not None:
                    t.taken.add(x)
                    p.taken.add(y)
                    found.append((x, y))
            continue
        near: dict[int, list[int]] = {}
        for a, b in zip(i[at:end], j[at:end]):
            if t.free[a] and p.free[b]:
                near.setdefault(a, []).append(b)
        rows = sorted((x, a) for a in near if t.next(a) is not None for x in t.ids[t.head[a] : t.end[a]])
        for x, group in groupby(rows, lambda r: r[0]):
            if x in t.taken:
                continue
            free = []
            for _, a in group:
                near[a] = [b for b in near[a] if p.next(b) is not None]
                free += map(p.next, near[a])
            if free:
                y = min(free)
                t.taken.add(x)
                p.taken.add(y)
                found.append((x, y))
        for a in near:
            t.next(a)
