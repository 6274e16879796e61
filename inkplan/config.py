"""Parameters of the layout pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LayoutConfig:
    heading_font_factor: float = 1.2
    paragraph_gap_factor: float = 1.5
    line_tolerance_factor: float = 0.6
    #: Off: the letter o at the start of a line counts as a bullet, too.
    strict_bullets: bool = False
    scanned_share: float = 0.95
