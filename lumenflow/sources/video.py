"""Videos as frames: anything that opens to a capture (read() gives a flag and an image, release() ends it) is a source.

No decoder is installed here; `opener` names one as "module:callable". The default is OpenCV's, if it can be imported."""

from __future__ import annotations

import os
from collections.abc import Iterator
from importlib import import_module
from itertools import count
from typing import Protocol

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..operators import raster
from .frames import FRAMES, SUFFIXES, check_video_path

OPENER = "cv2:VideoCapture"


class Capture(Protocol):
    def read(self) -> tuple[bool, np.ndarray | None]: ...

    def release(self) -> None: ...


class FrameSource(Protocol):
    def open(self) -> Capture: ...


def opener_of(name: str):
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


class FileSource:
    """A video file with a known suffix. One that the decoder cannot open has no frames."""

    def __init__(self, path: str, opener: str = OPENER):
        self.path, self.opener = check_video_path(path), opener

    def open(self) -> Capture:
        return opener_of(self.opener)(str(self.path))


class CameraSource:
    """A device of the machine it is opened on."""

    def __init__(self, index: int = 0, opener: str = OPENER):
        self.index, self.opener = index, opener

    def open(self) -> Capture:
        return opener_of(self.opener)(self.index)


class NpyCapture:
    """Frames of a .npy file, whatever its suffix, as a capture."""

    def __init__(self, path: str):
        self.images = iter(np.load(path, allow_pickle=False))

    def read(self):
        image = next(self.images, None)
        return image is not None, image

    def release(self) -> None:
        self.images = iter(())


def _images(source: FrameSource) -> Iterator[np.ndarray]:
    capture = source.open()
    try:
        while True:
            ok, image = capture.read()
            if not ok:  # the first failed read is the end
                return
            yield image
    finally:
        capture.release()


def stream_frames(source: FrameSource, mask: tuple[float, float, float, float] | None = None, target_height: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number, image) of a source: resized, and zero inside the mask's box (x1, y1, x2, y2 as shares of the frame)."""
    if target_height is not None and target_height <= 0:
        raise ValueError("target_height must be positive")
    keep = None
    if mask is not None:  # its size comes from a frame of a separate opening
        for image in _images(source):
            keep = raster.static_mask(*raster.resize(image, target_height).shape[:2], mask)
            break
    numbers = count()

    def run() -> Iterator[tuple[int, np.ndarray]]:
        for image in _images(source):
            image = raster.resize(image, target_height)
            if keep is not None:
                image = np.where(keep if image.ndim == 2 else keep[..., None], image, 0).astype(np.uint8)
            yield next(numbers), image

    return run()


def stream_frames_from_file(path: str, *, target_height: int | None = None, opener: str = OPENER) -> Iterator[tuple[int, np.ndarray]]:
    return stream_frames(FileSource(path, opener), target_height=target_height)


def decodable(source: FrameSource, tries: int = 10) -> bool:
    """Whether one of the first reads gives a frame."""
    capture = source.open()
    try:
        return any(capture.read()[0] for _ in range(tries))
    finally:
        capture.release()


def _row(stream: str, number: int, image: np.ndarray) -> tuple:
    image = np.ascontiguousarray(image)
    return stream, number, image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, image.tobytes()


class VideoFrames(DataSource):
    """spark.read.format("video_frames").load(dir): the frames of each video file below a folder, one task a file.
    readStream reads a camera of the driver's machine instead: option camera (its index, 0 by default), frames_per_batch.
    Options mask ("x1,y1,x2,y2"), target_height and opener hold for both."""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema):
        return _Files(self.options)

    def simpleStreamReader(self, schema):
        return _Camera(self.options)


def _settings(options) -> dict:
    mask, height = options.get("mask"), options.get("target_height")
    return {"mask": tuple(map(float, mask.split(","))) if mask else None, "target_height": int(height) if height else None}


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Files(DataSourceReader):
    def __init__(self, options):
        self.root, self.opener, self.settings = options["path"], options.get("opener", OPENER), _settings(options)

    def partitions(self):
        found = [self.root] if os.path.isfile(self.root) else [os.path.join(self.root, n) for n in sorted(os.listdir(self.root))]
        return [_File(p) for p in found if os.path.splitext(p)[1] in SUFFIXES] or [_File("")]

    def read(self, part: _File):
        if part.path:
            for number, image in stream_frames(FileSource(part.path, self.opener), **self.settings):
                yield _row(os.path.splitext(os.path.basename(part.path))[0], number, image)


class _Camera(SimpleDataSourceStreamReader):
    """A device cannot be read twice, so frames are held until their batch is committed."""

    def __init__(self, options):
        self.index, self.opener, self.settings = int(options.get("camera", "0")), options.get("opener", OPENER), _settings(options)
        self.most, self.frames, self.held = int(options.get("frames_per_batch", "30")), None, {}

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict):
        if self.frames is None:
            self.frames = stream_frames(CameraSource(self.index, self.opener), **self.settings)
        at = start["frame"]
        for _ in range(self.most):
            got = next(self.frames, None)
            if got is None:
                break
            self.held[at] = _row(f"camera{self.index}", at, got[1])
            at += 1
        return iter([self.held[i] for i in range(start["frame"], at)]), {"frame": at}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([self.held[i] for i in range(start["frame"], end["frame"]) if i in self.held])

    def commit(self, end: dict) -> None:
        self.held = {i: r for i, r in self.held.items() if i >= end["frame"]}
