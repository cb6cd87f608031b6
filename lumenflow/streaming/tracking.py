"""The tracker and the dense detector in Structured Streaming: the same step function over per-stream state.

Frames may arrive out of order within and across micro-batches: the state keeps points of frames ahead and steps only
over a gap-free prefix. A frame is complete when its row with `points` (an array of x, y, area) is there."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..operators.tracker import EVENTS, State, step
from ..operators.video import EVENT_COLUMNS, Detector, image_of


def track_stream(frames: DataFrame, config: Config, first: int = 0, size: float | None = None) -> DataFrame:
    """Events of a streaming (stream, frame, points)."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, due, ahead = State(), first, {}
        if state.exists:
            raw, due, held = state.get
            tracker, ahead = State.from_dict(json.loads(raw)), {int(k): v for k, v in json.loads(held).items()}
        for pdf in pdfs:
            for f, points in zip(pdf["frame"], pdf["points"]):
                ahead.setdefault(int(f), [[p["x"], p["y"], p["area"]] for p in points])
        out = []
        while due in ahead:
            points = sorted((tuple(p) for p in ahead.pop(due)), key=lambda p: (p[1], p[0]))
            out += [(key[0], due, i, *e) for i, e in enumerate(step(tracker, due, points, config, size))]
            due += 1
        state.update((json.dumps(tracker.to_dict()), due, json.dumps({k: v for k, v in ahead.items() if k >= due})))
        yield pd.DataFrame(out, columns=EVENT_COLUMNS).astype({"track_id": "Int64"})

    return frames.groupBy("stream").applyInPandasWithState(run, EVENTS, "tracker string, due long, ahead string", "append", GroupStateTimeout.NoTimeout)


def detect_stream(frames: DataFrame, config: Config, mask: tuple[float, float, float, float] | None = None, target_height: int | None = None, first: int = 0) -> DataFrame:
    """Events of streaming dense frames (stream, frame, height, width, channels, data). The state is one background, the
    tracks, and the frames that came too early; a frame that comes twice counts once."""
    Detector(config, mask, target_height)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector, due, ahead = Detector(config, mask, target_height), first, {}
        if state.exists:
            detector, due, ahead = pickle.loads(state.get[0])  # written by this function alone
        out = []

        def go_on():
            nonlocal due
            while due in ahead:
                out.extend((key[0], due, i, *e) for i, e in enumerate(detector.advance(due, ahead.pop(due))))
                due += 1

        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                if r.frame >= due:
                    ahead.setdefault(int(r.frame), image_of(r))
            go_on()
        state.update((pickle.dumps((detector, due, ahead)),))
        yield pd.DataFrame(out, columns=EVENT_COLUMNS).astype({"track_id": "Int64"})

    return frames.select("stream", "frame", "height", "width", "channels", "data").groupBy("stream").applyInPandasWithState(run, EVENTS, "detector binary", "append", GroupStateTimeout.NoTimeout)
