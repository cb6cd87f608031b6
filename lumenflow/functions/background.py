"""Per-pixel background folds: a numpy step, and column expressions for series of up to some hundred values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config


def advance(mean: np.ndarray, frame: np.ndarray, config: Config) -> np.ndarray:
    """The float32 background after a further frame, pixel by pixel."""
    if config.adaptive:
        small, large = config.rates
        rate = np.where(np.abs(frame - mean) <= config.change_threshold, np.float32(small), np.float32(large))
    else:
        rate = np.float32(config.alpha)
    return (np.float32(1) - rate) * mean + rate * frame


def running_background(values: Column, small: float, large: float, change: float) -> Column:
    """Background after each value of an ordered array: the first value, then an exponential mean whose
    rate depends on the distance to the background before the update."""
    step = lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + (v - F.element_at(acc, -1)) * F.when(F.abs(v - F.element_at(acc, -1)) <= change, small).otherwise(large))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1), step)


def final_background(values: Column, small: float, large: float, change: float) -> Column:
    """The background after the last value only."""
    step = lambda acc, v: acc + (v - acc) * F.when(F.abs(v - acc) <= change, small).otherwise(large)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), step)
