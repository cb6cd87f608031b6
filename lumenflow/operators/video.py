"""Dense frames (stream, frame, height, width, channels, data) to detections and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Config
from . import raster
from .tracker import EVENTS, State, step

PANELS = "stream string, frame long, height int, width int, channels int, data binary"

EVENT_COLUMNS = ["stream", "emit_frame", "emit_seq", "frame_number", "track_id", "x", "y"]


class DebugSink(Protocol):
    """Told of each frame before its events are given out: the masked image, the difference, and the frame's events."""

    def emit(self, frame: int, image: np.ndarray, diff: np.ndarray, events: list[tuple]) -> None: ...

    def close(self) -> None: ...


class NullSink:
    def emit(self, frame: int, image: np.ndarray, diff: np.ndarray, events: list[tuple]) -> None:
        pass

    def close(self) -> None:
        pass


class Detector:
    """One stream's background and tracks; `advance` takes its frames in order."""

    def __init__(self, config: Config, mask: tuple[float, float, float, float] | None = None, target_height: int | None = None, sink: DebugSink | None = None):
        if target_height is not None and target_height <= 0:
            raise ValueError("target_height must be positive")
        self.config, self.mask, self.target_height = config, mask, target_height
        self.state, self.background, self.size = State(), raster.Background(config), None
        self.sink = sink or NullSink()

    def advance(self, frame: int, image: np.ndarray) -> list[tuple]:
        """Resized, masked, compared with the background, and tracked: the frame's events."""
        image = raster.resize(image, self.target_height)
        keep = None if self.mask is None else raster.static_mask(*image.shape[:2], self.mask)
        if keep is not None:
            image = np.where(keep if image.ndim == 2 else keep[..., None], image, 0).astype(np.uint8)
        g = raster.gray(image)
        if self.size is None:
            self.size = float(max(g.shape))
        diff = self.background.diff(g, keep)
        events = step(self.state, frame, raster.detections(diff, self.config), self.config, self.size)
        self.sink.emit(frame, image, diff, events)
        return events


def image_of(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape((row.height, row.width, row.channels) if row.channels > 1 else (row.height, row.width))


def detect(frames: DataFrame, config: Config, mask: tuple[float, float, float, float] | None = None, target_height: int | None = None, sink: Callable[[str], DebugSink] | None = None) -> DataFrame:
    """Events of every stream. Rows of a stream are sorted by Spark and consumed one Arrow batch at a time, so a
    task holds one background and one batch, not a stream. mask: a box (x1, y1, x2, y2) of the resized frame that is left out.
    sink: gives a stream's debug sink, in the task that reads it."""
    Detector(config, mask, target_height)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, detector = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if detector is None or r.stream != stream:
                    if detector is not None:
                        detector.sink.close()
                    stream, detector = r.stream, Detector(config, mask, target_height, sink(r.stream) if sink else None)
                out += [(stream, r.frame, i, *e) for i, e in enumerate(detector.advance(int(r.frame), image_of(r)))]
            yield pd.DataFrame(out, columns=EVENT_COLUMNS).astype({"track_id": "Int64"})
        if detector is not None:
            detector.sink.close()

    ordered = frames.select("stream", "frame", "height", "width", "channels", "data").repartition("stream").sortWithinPartitions("stream", "frame")
    return ordered.mapInPandas(run, EVENTS)


def bgr(image: np.ndarray) -> np.ndarray:
    """A gray image with its channel three times; a colour one as it is."""
    return image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)


def panels(frames: DataFrame, config: Config, mask: tuple[float, float, float, float] | None = None, target_height: int | None = None) -> DataFrame:
    """The debug view's images, one a frame: the masked input (not the background) above the difference, in colour. What is
    drawn on them is `debug.draw_list`."""
    Detector(config, mask, target_height)

    class Stack(NullSink):
        def __init__(self):
            self.view = None

        def emit(self, frame, image, diff, events):
            self.view = np.vstack([bgr(image), bgr(diff)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, detector, sink = None, None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if detector is None or r.stream != stream:
                    sink = Stack()
                    stream, detector = r.stream, Detector(config, mask, target_height, sink)
                detector.advance(int(r.frame), image_of(r))
                yield pd.DataFrame([(stream, r.frame, *sink.view.shape, sink.view.tobytes())], columns=["stream", "frame", "height", "width", "channels", "data"])

    ordered = frames.select("stream", "frame", "height", "width", "channels", "data").repartition("stream").sortWithinPartitions("stream", "frame")
    return ordered.mapInPandas(run, PANELS)
