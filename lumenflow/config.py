"""Detector settings: library preset, command-line preset, and the background rates derived from them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    alpha: float = 0.1
    adaptive: bool = True
    change_threshold: int = 10
    alpha_small: float | None = None
    alpha_large: float | None = None
    diff_threshold: int = 25
    min_area: float = 5
    kernel: int = 5
    min_consecutive: int = 3
    max_distance: float = 100.0
    min_distance: float = 5.0
    max_missed: int = 2
    min_span_ratio: float = 0.05
    #: Squared radius within which a confirming track takes over a lost one; None: max_distance itself.
    merge_radius_sq: float | None = None
    #: "first_eligible": the first track that fits; "first_track": only the first track is looked at.
    merge_scan: str = "first_eligible"

    @property
    def rates(self) -> tuple[float, float]:
        """Rates for small and for large changes, each in 0..1, the larger one for small changes."""
        a = self.alpha if self.alpha_small is None else self.alpha_small
        b = self.alpha * 0.2 if self.alpha_large is None else self.alpha_large
        a, b = min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)
        return max(a, b), min(a, b)



@dataclass(frozen=True)
class View:
    """How frames are taken in and shown: height, masked box (x1, y1, x2, y2 as shares), and the debug view's settings."""

    target_height: int | None = None
    mask: tuple[float, float, float, float] | None = None
    fps: int = 30
    box: int = 50
    #: Frames a view is held back, so that replayed points still reach it; up to 1 nothing is held.
    buffer: int = 0


LIBRARY = Config()
LIBRARY_VIEW = View()
COMMAND_LINE = Config(alpha=0.5, diff_threshold=20, min_area=20, min_consecutive=6, max_distance=10.0, min_distance=2.0, min_span_ratio=0.02)
#: The box is where the camera prints its time.
COMMAND_LINE_VIEW = View(target_height=1080, mask=(0.8, 0.8, 1, 1), buffer=COMMAND_LINE.min_consecutive)
