"""Raster operators over the pixel relation (stream, frame, y, x, g): masks, scaling, differences, morphology."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.background import advance

KEY = ["stream", "frame"]


def ellipse(k: int) -> list[tuple[int, int]]:
    """(dy, dx) of an elliptic structuring element of k x k."""
    c = k // 2
    out = []
    for i in range(k):
        dy = i - c
        w = round(c * math.sqrt(max(0.0, 1 - dy * dy / (c * c)))) if c and abs(dy) <= c else 0
        out += [(dy, dx) for dx in range(-w, w + 1) if c + dx < k]
    return out


def mask_rect(pixels: DataFrame, h: int, w: int, rect: tuple[float, float, float, float]) -> DataFrame:
    """Zero inside the rectangle x1, y1, x2, y2 (shares of the frame)."""
    x1, y1, x2, y2 = rect
    inside = (F.col("y") >= int(h * y1)) & (F.col("y") < int(h * y2)) & (F.col("x") >= int(w * x1)) & (F.col("x") < int(w * x2))
    return pixels.withColumn("g", F.when(inside, 0).otherwise(F.col("g")))


def shrink(pixels: DataFrame, ratio: int) -> DataFrame:
    """Area mean over ratio x ratio cells; halves round to even."""
    cell = [F.floor(F.col(c) / ratio).cast("int").alias(c) for c in ("y", "x")]
    return pixels.groupBy(*KEY, *cell).agg(F.bround(F.avg("g")).cast("int").alias("g"))


def threshold(pixels: DataFrame, most: float) -> DataFrame:
    return pixels.where(F.col("g") > most)


def background_differences(pixels: DataFrame, config: Config) -> DataFrame:
    """pixels plus d: the distance of each pixel to its background, which takes the frame up first, in single precision,
    and is cut to whole numbers; 0 in a pixel's first frame. Pixels are dealt by their place, so a stream spreads over
    many tasks; a task holds one number a pixel and steps frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, places, states = object(), None, None
        for b in batches:
            at = np.flatnonzero(_new_frames(b))
            out, ends = np.zeros(b.num_rows, np.int32), np.append(at[1:], b.num_rows)
            names = b.column(0).take(pa.array(at)).to_pylist()
            place = (b.column(2).to_numpy().astype(np.int64) << 32) | b.column(3).to_numpy()
            g = b.column(4).to_numpy()
            for name, i, j in zip(names, at, ends):
                if name != stream:
                    stream, places, states = name, np.zeros(0, np.int64), np.zeros(0, np.float32)
                if not np.array_equal(places, place[i:j]):  # other places than before: their backgrounds wait, new ones begin
                    every = np.union1d(places, place[i:j])
                    mean = np.full(len(every), np.nan, np.float32)
                    mean[np.searchsorted(every, places)] = states
                    places, states = every, mean
                here = np.searchsorted(places, place[i:j])
                mean, f = states[here], g[i:j].astype(np.float32)
                states[here] = np.where(np.isnan(mean), f, advance(mean, f, config))
                out[i:j] = np.where(np.isnan(mean), 0, np.abs(g[i:j] - states[here].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "d"])

    rows = pixels.select("stream", "frame", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("g").cast("int").alias("g"))
    rows = rows.repartition("stream", "y", "x").sortWithinPartitions("stream", "frame", "y", "x")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("d", T.IntegerType())]))


def _new_frames(b: pa.RecordBatch) -> np.ndarray:
    """Whether a row is the first one of its stream and frame in the batch."""
    new = np.ones(b.num_rows, bool)
    new[1:] = False
    for i in (0, 1):
        v = b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _morph(pixels: DataFrame, offsets, pick) -> DataFrame:
    """Every pixel goes to its neighbours, each of which keeps the extreme; nothing outside the frame takes part."""
    off = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    # map-side combine works on the scattered rows, so the shuffle carries one row a pixel and task
    s = pixels.select(*KEY, "y", "x", "g", F.explode(off).alias("o"))
    s = s.select(*KEY, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "g")
    return s.groupBy(*KEY, "y", "x").agg(pick("g").alias("g")).join(pixels.select(*KEY, "y", "x"), [*KEY, "y", "x"], "left_semi")


def dilate(pixels: DataFrame, k: int, times: int = 1) -> DataFrame:
    for _ in range(times):
        pixels = _morph(pixels, ellipse(k), F.max)
    return pixels


def erode(pixels: DataFrame, k: int) -> DataFrame:
    return _morph(pixels, ellipse(k), F.min)


def opening(pixels: DataFrame, k: int) -> DataFrame:
    return dilate(erode(pixels, k), k)


def closing(pixels: DataFrame, k: int) -> DataFrame:
    return erode(dilate(pixels, k), k)


def clean(pixels: DataFrame, k: int) -> DataFrame:
    """Opening with a third of the kernel, closing, two dilations; nothing for kernels of 1 or less."""
    if k <= 1:
        return pixels
    if k // 3 > 1:
        pixels = opening(pixels, k // 3)
    return dilate(closing(pixels, k), k, 2)
