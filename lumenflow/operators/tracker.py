"""The tracker: one step function on plain state, run per stream in batch or in a stream."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .nearest import nearest_first

EVENTS = "stream string, emit_frame long, emit_seq int, frame_number long, track_id long, x double, y double"


@dataclass(slots=True)
class Track:
    track_id: int
    x: float
    y: float
    area: float = 0.0
    hits: int = 1
    misses: int = 0
    confirmed: bool = False
    pending: list = field(default_factory=list)


@dataclass
class State:
    tracks: list[Track] = field(default_factory=list)  # in the order in which they were born or taken over
    next_id: int = 1

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> State:
        return cls([Track(**{**t, "pending": [tuple(p) for p in t["pending"]]}) for t in d["tracks"]], d["next_id"])


def assign(tracks: list[Track], points: list[tuple], most: float) -> dict[int, int]:
    """Greedy one-to-one match, nearest first; ties by track order, then point order."""
    if not tracks or not points:
        return {}
    t, p = np.array([(t.x, t.y) for t in tracks]), np.array([(p[0], p[1]) for p in points])
    return dict(nearest_first(t[:, 0], t[:, 1], np.arange(len(t)), p[:, 0], p[:, 1], np.arange(len(p)), most))


def _span_ok(track: Track, config: Config, size: float | None) -> bool:
    if len(track.pending) < 2 or size is None:
        return True
    xs, ys = [p[1] for p in track.pending], [p[2] for p in track.pending]
    return max(max(xs) - min(xs), max(ys) - min(ys)) >= config.min_span_ratio * size


class _Lost:
    """Where a confirming track finds the lost one that it takes over. `slots`: the frame's tracks as they stand, a track that was
    taken over replaced by its successor, whose own slot is None. A lost track has not moved in this frame, so places are indexed once."""

    def __init__(self, slots: list[Track | None], config: Config):
        self.slots, self.before, self.config = slots, list(slots), config
        self.radius = config.max_distance if config.merge_radius_sq is None else config.merge_radius_sq
        self.width = max(math.sqrt(max(self.radius, 0.0)), 1e-9) * (1 + 1e-6)
        self.cells: dict | None = None

    def _cell(self, v: float) -> int:
        return math.floor(min(max(v / self.width, -(1 << 29)), 1 << 29))

    def _near(self, x: float, y: float) -> Iterator[list[int]]:
        if self.cells is None:
            self.cells = defaultdict(list)
            for k, t in enumerate(self.before):
                if t.confirmed:
                    self.cells[self._cell(t.x), self._cell(t.y)].append(k)
        a, b = self._cell(x), self._cell(y)
        return (self.cells[c] for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (c := (a + dx, b + dy)) in self.cells)

    def slot(self, track: Track) -> int | None:
        """The first slot in order whose track fits; with merge_scan "first_track" only the first is looked at."""
        _, x, y = track.pending[0]

        def fits(k: int) -> bool:
            t = self.slots[k]
            return t is self.before[k] and t is not track and t.confirmed and 1 <= t.misses <= self.config.max_missed and (t.x - x) ** 2 + (t.y - y) ** 2 <= self.radius

        if self.config.merge_scan == "first_track":
            return 0 if fits(0) else None  # the first never leaves its slot: it could only merge with itself
        if not math.isfinite(self.width):
            return next(filter(fits, range(len(self.slots))), None)
        best = len(self.slots)
        for ks in self._near(x, y):
            for k in ks:
                if k >= best:
                    break
                if fits(k):
                    best = k
                    break
        return best if best < len(self.slots) else None


def _merge_target(tracks: list[Track], track: Track, config: Config) -> Track | None:
    k = _Lost(tracks, config).slot(track)
    return None if k is None else tracks[k]


def step(state: State, frame: int, points: list[tuple], config: Config, size: float | None = None) -> list[tuple]:
    """Advance by one frame; points are (x, y, area). Events are (frame, track id or None, x, y); a
    confirmation replays the pending frames; a frame without events gives one null event."""
    events: list[tuple] = []
    match = assign(state.tracks, points, config.max_distance) if points else {}
    slots = list(state.tracks)
    lost = _Lost(slots, config)
    for i, track in enumerate(state.tracks):
        j = match.get(i)
        if j is not None:
            x, y, area = points[j]
            if ((track.x - x) ** 2 + (track.y - y) ** 2) ** 0.5 < config.min_distance:
                j = None  # a point that hardly moved is a miss, and stays taken
        if j is None:
            track.hits, track.misses = 0, track.misses + 1
            continue
        track.x, track.y, track.area, track.hits, track.misses = x, y, area, track.hits + 1, 0
        if track.confirmed:
            events.append((frame, track.track_id, x, y))
            continue
        track.pending.append((frame, x, y))
        if track.hits < config.min_consecutive or not _span_ok(track, config, size):
            continue
        k = lost.slot(track)
        if k is not None:
            track.track_id = slots[k].track_id
            slots[k], slots[i] = track, None
        track.confirmed = True
        events += [(f, track.track_id, px, py) for f, px, py in track.pending]
        track.pending = []
    state.tracks = [t for t in slots if t is not None and t.misses <= 2 * config.max_missed]
    taken = set(match.values())
    for j, (x, y, area) in enumerate(points):
        if j in taken:
            continue
        track = Track(state.next_id, x, y, area, pending=[(frame, x, y)])
        state.next_id += 1
        if config.min_consecutive <= 1:
            track.confirmed, track.pending = True, []
            events.append((frame, track.track_id, x, y))
        state.tracks.append(track)
    return events or [(frame, None, None, None)]


def track(detections: DataFrame, config: Config, frames: DataFrame | None = None, size: float | None = None) -> DataFrame:
    """Events of (stream, frame, x, y, area), points of a frame in the order of y, x. `frames` (stream, frame) names
    all frames, those without points included; without it a stream's frames are its first to its last. A stream is one
    task, as each frame depends on the one before, but its rows are sorted by Spark and consumed batch by batch: a task
    holds the tracks and one frame. Points with a null are left out."""
    rows = detections.select("stream", "frame", "x", "y", "area")
    spine = frames is not None
    if spine:
        rows = frames.select("stream", "frame").distinct().join(rows, ["stream", "frame"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, points, out = None, State(), [], []

        def close() -> None:
            out.extend((*key, n, *e) for n, e in enumerate(step(state, key[1], points, config, size)))

        for b in batches:
            for s, f, x, y, a in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key is None or (s, f) != key:
                    if key is not None:
                        close()
                    if key is None or s != key[0]:
                        state = State()
                    elif not spine:
                        for gap in range(key[1] + 1, f):
                            key, points = (s, gap), []
                            close()
                    key, points = (s, f), []
                if None not in (x, y, a) and x == x and y == y and a == a:
                    points.append((float(x), float(y), float(a)))
            yield batch(out)
            out = []
        if key is not None:
            close()
            yield batch(out)

    names = [f.split()[0] for f in EVENTS.split(", ")]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names)

    rows = rows.select(F.col("stream").cast("string").alias("stream"), F.col("frame").cast("long").alias("frame"), "x", "y", "area").repartition("stream").sortWithinPartitions("stream", "frame", "y", "x")
    return rows.mapInArrow(run, EVENTS)
