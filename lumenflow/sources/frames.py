"""Frame sources: synthetic scenes, and a Data Source for raw frame files."""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FRAMES = "stream string, frame long, height int, width int, channels int, data binary"
SUFFIXES = (".mkv", ".mp4")


def check_video_path(path: str) -> str:
    """An existing file whose suffix is exactly .mkv or .mp4."""
    if not os.path.isfile(path):
        raise ValueError(f"no such file: {path}")
    if os.path.splitext(path)[1] not in SUFFIXES:
        raise ValueError(f"not one of {SUFFIXES}: {path}")
    return path


def moving_spot(streams: DataFrame, h: int, w: int, blank: int = 40, motion: int = 30, round_: bool = True) -> DataFrame:
    """Frames for (stream, radius, noise): blank, a spot from a third to two thirds of the width, blank. Noise is
    seeded by stream and frame, below `noise`; the spot is drawn over it."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            yy, xx = np.mgrid[:h, :w]
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng([zlib.crc32(str(r.stream).encode()), int(r.noise), int(r.frame)])
                a = rng.integers(0, r.noise, (h, w)).astype(np.uint8) if r.noise else np.zeros((h, w), np.uint8)
                i = r.frame - blank
                if 0 <= i < motion:
                    t = i / (motion - 1) if motion > 1 else 0.0
                    x, y = int(w / 3 + t * (2 * w / 3 - w / 3)), h // 2
                    spot = (xx - x) ** 2 + (yy - y) ** 2 <= r.radius**2 if round_ else np.maximum(abs(xx - x), abs(yy - y)) <= r.radius
                    a[spot] = 255
                rows.append((r.stream, r.frame, h, w, 1, a.tobytes()))
            yield pd.DataFrame(rows, columns=["stream", "frame", "height", "width", "channels", "data"])

    every = streams.select("stream", "radius", "noise", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * blank + motion - 1).cast("long"))).alias("frame"))
    return every.repartition("stream", "frame").mapInPandas(run, FRAMES)


class NpyFrames(DataSource):
    """spark.read.format("npy_frames").load(dir): one .npy file a stream, shape (frames, height, width[, 3]), uint8.
    readStream takes the files up as they come, and further frames of files that have grown. Write a file under
    another suffix and rename it."""

    @classmethod
    def name(cls) -> str:
        return "npy_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema):
        return _NpyReader(self.options)

    def streamReader(self, schema):
        return _NpyStream(self.options)


class _Chunk(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("frames_per_task", "256"))

    def partitions(self):
        out = []
        for name in sorted(os.listdir(self.path)):
            if name.endswith(".npy"):
                p = os.path.join(self.path, name)
                n = np.load(p, mmap_mode="r").shape[0]
                out += [_Chunk(p, i, min(i + self.step, n)) for i in range(0, n, self.step)]
        return out or [_Chunk("", 0, 0)]

    def read(self, part: _Chunk):
        if not part.path:
            return
        a = np.load(part.path, mmap_mode="r")
        name = os.path.splitext(os.path.basename(part.path))[0]
        for i in range(part.start, part.stop):
            f = np.ascontiguousarray(a[i])
            yield name, i, f.shape[0], f.shape[1], f.shape[2] if f.ndim == 3 else 1, f.tobytes()


class _NpyStream(_NpyReader, DataSourceStreamReader):
    """An offset is the number of frames of each file."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        names = sorted(n for n in os.listdir(self.path) if n.endswith(".npy"))
        return {n: int(np.load(os.path.join(self.path, n), mmap_mode="r").shape[0]) for n in names}

    def partitions(self, start: dict, end: dict):
        out = []
        for name, n in end.items():
            out += [_Chunk(os.path.join(self.path, name), i, min(i + self.step, n)) for i in range(start.get(name, 0), n, self.step)]
        return out or [_Chunk("", 0, 0)]
