"""Drawing helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Track colours as blue, green, red: fixed values.
PALETTE = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (128, 0, 255), (255, 128, 0))


def track_colour(track_id: Column) -> Column:
    colours = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(g).alias("g"), F.lit(r).alias("r")) for b, g, r in PALETTE])
    return F.element_at(colours, (F.pmod(track_id, F.lit(len(PALETTE))) + 1).cast("int"))


def box(x: Column, y: Column, half: int) -> Column:
    """Corners of the box around a centre cut to whole pixels."""
    cx, cy = x.cast("int"), y.cast("int")
    return F.struct((cx - half).alias("x1"), (cy - half).alias("y1"), (cx + half).alias("x2"), (cy + half).alias("y2"))


def resized_width(w: Column, h: Column, height: int) -> Column:
    """Width that keeps the aspect at a new height; halves round to even."""
    return F.greatest(F.lit(1), F.bround(w * (F.lit(float(height)) / h)).cast("int"))


def gray(b: Column, g: Column, r: Column) -> Column:
    """Eight-bit luma in fixed point."""
    return F.shiftright(b * 3735 + g * 19235 + r * 9798 + 16384, 15)
