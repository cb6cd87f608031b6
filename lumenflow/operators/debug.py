"""What a debug view shows: active centroids, trajectories, patched frames, stacked panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draw import box, track_colour


def null_events(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Every frame of the spine without an event gets a null event."""
    return frames.select("stream", "frame").join(events.select("stream", "frame").distinct(), ["stream", "frame"], "left_anti")


def trajectories(points: DataFrame) -> DataFrame:
    """Ordered points of each stream as text."""
    p = points.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("frame", "i", "x", "y"))).alias("p"))
    return p.select("stream", F.array_join(F.transform("p", lambda z: F.concat(z["frame"], F.lit(":"), F.floor(z["x"]), F.lit(","), F.floor(z["y"]))), " ").alias("path"))


def patched(buffer: DataFrame, late: DataFrame) -> DataFrame:
    """Late (stream, frame, track, x, y) override or extend the centroids of buffered frames; others drop."""
    frames = buffer.select("stream", "frame").distinct()
    late = late.join(frames, ["stream", "frame"], "left_semi")
    both = buffer.select("stream", "frame", "track", "x", "y", F.lit(0).alias("p")).unionByName(late.select("stream", "frame", "track", "x", "y", F.lit(1).alias("p")))
    return both.groupBy("stream", "frame", "track").agg(F.max_by(F.struct("x", "y"), "p").alias("c")).select("stream", "frame", "track", "c.x", "c.y")


def shown(events: DataFrame, buffer: int = 0) -> DataFrame:
    """(stream, frame, track, x, y) of the boxes in a view that is written `buffer` frames late: what an event says of an
    earlier frame counts while that frame is held, and the last word on a track stands. Up to 1 nothing is held."""
    held = events.where(F.col("track_id").isNotNull() & (F.col("emit_frame") - F.col("frame_number") < max(buffer, 1)))
    last = held.groupBy("stream", F.col("frame_number").alias("frame"), F.col("track_id").alias("track")).agg(F.max_by(F.struct("x", "y"), F.struct("emit_frame", "emit_seq")).alias("c"))
    return last.select("stream", "frame", "track", "c.x", "c.y")


def visible_segments(events: DataFrame, buffer: int = 0) -> DataFrame:
    """(stream, track, x1, y1, x2, y2, visible_from) of the lines between a track's successive live points; replayed
    points draw none. A view written late shows what came before it was written, so a line appears `buffer` frames early."""
    order = W.partitionBy("stream", "track_id").orderBy("emit_frame", "emit_seq")
    live = events.where(F.col("track_id").isNotNull() & (F.col("emit_frame") == F.col("frame_number")))
    live = live.select("stream", F.col("track_id").alias("track"), F.lag(F.col("x").cast("int")).over(order).alias("x1"), F.lag(F.col("y").cast("int")).over(order).alias("y1"),
                       F.col("x").cast("int").alias("x2"), F.col("y").cast("int").alias("y2"), (F.col("emit_frame") - (buffer if buffer > 1 else 0)).alias("visible_from"))
    return live.where("x1 IS NOT NULL")


def draw_list(events: DataFrame, buffer: int = 0, half: int = 50) -> DataFrame:
    """(stream, frame, kind, track, x1, y1, x2, y2, visible_from, b, g, r): the boxes of each view, and the lines with the first
    frame they are seen in (null for boxes; a line has no frame of its own, it stays)."""
    colour = lambda d: d.withColumn("c", track_colour(F.col("track"))).select("stream", "frame", "kind", "track", "x1", "y1", "x2", "y2", "visible_from", "c.b", "c.g", "c.r")
    boxes = shown(events, buffer).select("stream", "frame", F.lit("box").alias("kind"), "track", box(F.col("x"), F.col("y"), half).alias("v")).select("stream", "frame", "kind", "track", "v.*", F.lit(None).cast("long").alias("visible_from"))
    lines = visible_segments(events, buffer).select("stream", F.lit(None).cast("long").alias("frame"), F.lit("line").alias("kind"), "track", "x1", "y1", "x2", "y2", "visible_from")
    return colour(boxes).unionByName(colour(lines))


def segments(points: DataFrame) -> DataFrame:
    """Whole-pixel line segments between a stream's successive points."""
    order = W.partitionBy("stream").orderBy("frame", "i")
    cut = points.select("stream", "frame", "i", F.col("x").cast("int").alias("x1"), F.col("y").cast("int").alias("y1"))
    return cut.withColumn("x2", F.lead("x1").over(order)).withColumn("y2", F.lead("y1").over(order)).where("x2 IS NOT NULL")


def stacked(top: DataFrame, bottom: DataFrame, h: int) -> DataFrame:
    """One panel above the other."""
    return top.select("stream", "frame", "y", "x", "g").unionByName(bottom.select("stream", "frame", (F.col("y") + h).alias("y"), "x", "g"))


def output_name(path: str, video: str, kind: str) -> str:
    """Where a result goes: a directory or a suffix-less path takes the file, of a file name only the folder counts,
    the video's own folder by default."""
    from pathlib import Path

    v = Path(video)
    folder = v.parent if not path else Path(path) if Path(path).is_dir() or not Path(path).suffix else Path(path).parent
    return str(folder / f"{v.stem}_filtered.{kind}")
