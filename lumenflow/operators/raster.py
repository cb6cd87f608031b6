"""The same raster operators on dense frames, in numpy, for Arrow-fed Python operators."""

from __future__ import annotations

import numpy as np

from ..config import Config
from ..functions.background import advance
from .pixels import ellipse


def gray(frame: np.ndarray) -> np.ndarray:
    if frame.ndim == 2:
        return frame
    b, g, r = (frame[..., i].astype(np.int64) for i in range(3))
    return ((b * 3735 + g * 19235 + r * 9798 + 16384) >> 15).astype(np.uint8)


def _area_weights(old: int, new: int) -> np.ndarray:
    """Share of each old pixel in each new one, by the length they have in common."""
    edge, at = np.arange(new + 1) * (old / new), np.arange(old)
    w = np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None)
    return w / w.sum(1, keepdims=True)


def _linear_weights(old: int, new: int) -> np.ndarray:
    """Weights of the two old pixels around each new pixel's centre; at the border the last one counts alone."""
    x = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
    i = x.astype(int)
    w = np.zeros((new, old))
    np.add.at(w, (np.arange(new), i), 1 - (x - i))
    np.add.at(w, (np.arange(new), np.minimum(i + 1, old - 1)), x - i)
    return w


def resize(frame: np.ndarray, height: int | None) -> np.ndarray:
    """The frame at another height with its aspect kept: area means when it shrinks, linear when it grows.
    None or the frame's own height change nothing. Halves round to even."""
    if height is not None and height <= 0:
        raise ValueError("height must be positive")
    h, w = frame.shape[:2]
    if height is None or height == h:
        return frame
    width, weights = max(1, round(w * (height / h))), _area_weights if height < h else _linear_weights
    x = (weights(h, height) @ frame.reshape(h, -1)).reshape(height, w, -1)
    x = np.einsum("nw,hwc->hnc", weights(w, width), x)
    return np.clip(np.rint(np.round(x, 9)), 0, 255).astype(np.uint8).reshape(height, width, *frame.shape[2:])


def static_mask(h: int, w: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """False inside the box (x1, y1, x2, y2), given as shares of width and height."""
    keep = np.ones((h, w), bool)
    keep[int(h * box[1]) : int(h * box[3]), int(w * box[0]) : int(w * box[2])] = False
    return keep


def morph(a: np.ndarray, k: int, biggest: bool) -> np.ndarray:
    out = None
    c = k
    padded = np.pad(a, c, constant_values=0 if biggest else 255)
    for dy, dx in ellipse(k):
        x = padded[c + dy : c + dy + a.shape[0], c + dx : c + dx + a.shape[1]]
        out = x.copy() if out is None else (np.maximum if biggest else np.minimum)(out, x)
    return out


def clean(a: np.ndarray, k: int) -> np.ndarray:
    if k <= 1:
        return a
    if k // 3 > 1:
        a = morph(morph(a, k // 3, False), k // 3, True)
    a = morph(morph(a, k, True), k, False)
    return morph(morph(a, k, True), k, True)


class Background:
    """State of the adaptive background, float32 as accumulated."""

    def __init__(self, config: Config):
        self.config, self.mean = config, None

    def diff(self, g: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Distance of a gray frame to the background after the update."""
        c = self.config
        if c.alpha >= 1 and not c.adaptive:
            return np.zeros_like(g)
        if self.mean is None:
            self.mean = g.astype(np.float32)
            return np.zeros_like(g)
        self.mean = advance(self.mean, g.astype(np.float32), c)
        d = np.abs(g.astype(np.int16) - self.mean.astype(np.uint8).astype(np.int16)).astype(np.uint8)
        return d if mask is None else np.where(mask, d, 0).astype(np.uint8)


def label(on: np.ndarray, eight: bool) -> tuple[np.ndarray, int]:
    """Connected components, numbered from 1 in row-major order of their first pixel. Works on runs of rows."""
    h, w = on.shape
    p = np.zeros((h, w + 2), np.int8)
    p[:, 1:-1] = on
    d = np.diff(p, axis=1)
    row, start = np.nonzero(d == 1)
    end = np.nonzero(d == -1)[1]
    first = np.searchsorted(row, np.arange(h + 1))
    root, reach = list(range(len(row))), int(eight)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    out, names = np.zeros(h * w, np.int64), {}
    if len(row):
        of = np.array([names.setdefault(find(i), len(names) + 1) for i in range(len(row))])
        n = end - start
        at = np.repeat(row * w + start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        out[at] = np.repeat(of, n)
    return out.reshape(h, w), len(names)


def polygon_area(on: np.ndarray) -> float:
    """Area of the polygon through the border pixels' centres of a filled blob, from 2 x 2 windows."""
    p = np.pad(on.astype(int), 1)
    q = p[:-1, :-1] + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]
    return float((q == 4).sum() + 0.5 * (q == 3).sum())


def polygon_centroid(on: np.ndarray) -> tuple[float, float]:
    """(x, y) of that polygon's centre of gravity: squares count at their centres, triangles, half as much, at theirs."""
    p = np.pad(on.astype(int), 1)
    corners = [(dy, dx, p[dy : p.shape[0] - 1 + dy, dx : p.shape[1] - 1 + dx]) for dy in (0, 1) for dx in (0, 1)]
    n = sum(c for _, _, c in corners)
    weight = np.where(n == 4, 1.0, np.where(n == 3, 0.5, 0.0))
    row, col = np.indices(n.shape) - 1
    share = weight / np.maximum(n, 1)
    total = weight.sum()
    return float(sum((share * c * (col + dx)).sum() for _, dx, c in corners) / total), float(sum((share * c * (row + dy)).sum() for dy, _, c in corners) / total)


def detections(d: np.ndarray, config: Config) -> list[tuple[float, float, float]]:
    """(x, y, area) of each outer blob of the cleaned difference, in order of first pixels."""
    d = clean(d, config.kernel)
    on = d > config.diff_threshold
    if not on.any():
        return []
    outside, _ = label(~np.pad(on, 1), False)  # background that reaches the frame's border
    filled = (outside != outside[0, 0])[1:-1, 1:-1]
    blobs, n = label(filled, True)
    ys, xs = np.nonzero(blobs)
    order = np.argsort(blobs[ys, xs], kind="stable")  # keeps row-major order within a blob
    ys, xs = ys[order], xs[order]
    cut = np.searchsorted(blobs[ys, xs], np.arange(1, n + 2))
    out = []
    for a, b in zip(cut, cut[1:]):
        y, x = ys[a:b], xs[a:b]
        blob = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        blob[y - y.min(), x - x.min()] = True
        area = polygon_area(blob)
        v = d[y, x]
        if area < config.min_area:
            continue
        if v.max() > 0:
            best = int(np.argmax(v))  # the first of equal peaks
            out.append((float(x[best]), float(y[best]), area))
        elif area:  # no peak: the centre of gravity; a blob without area has none
            cx, cy = polygon_centroid(blob)
            out.append((cx + float(x.min()), cy + float(y.min()), area))
    return out
