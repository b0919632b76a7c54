"""Parameters of the jobs. Defaults are the values the published method uses."""

from __future__ import annotations

import math
from dataclasses import dataclass

SEASON_MONTHS = (5, 6, 7, 8, 9)
PRIOR_WINDOWS = (1, 2, 3, 4, 5, 6, 7)
LONG_WINDOWS = (14, 21, 30)
MAX_BACK_DAYS = 30

#: Key columns shared by every day-level and cell-level table.
DAY_KEYS = ["measure", "pct", "d"]
SERIES_KEYS = ["measure", "pct"]


@dataclass(frozen=True)
class GridShape:
    """Number of grid rows (latitudes) and columns (longitudes)."""

    ny: int
    nx: int


@dataclass(frozen=True)
class DetectParams:
    """Spatial gates and persistence rule of the heat-wave detector."""

    region_area_km2: float
    pixel_size_km: float = 0.8
    min_area_km2: float = 1000.0
    hull_gate_km2: float = 1000.0
    min_hot_cells: int = 90
    cluster_cutoff_km: float = 1000.0
    min_duration: int = 3
    grace_days: int = 1
    tile: int = 256

    @property
    def pixel_area_km2(self) -> float:
        return self.pixel_size_km**2

    @property
    def min_pixels(self) -> int:
        return math.ceil(self.min_area_km2 / self.pixel_area_km2)


@dataclass(frozen=True)
class Measure:
    """Names that go with one exceedance measure."""

    kind: str
    variable: str
    index_name: str
    source_label: str


MEASURES = {
    "t": Measure("t", "T_EXCDMAG", "HSCI", "daily maximum temperature"),
    "hi": Measure("hi", "HI_EXCDMAG", "HSCI-H", "heat index"),
}


def check_percentile(pct: float) -> float:
    if not 0 < float(pct) < 100:
        raise ValueError(f"percentile must lie strictly between 0 and 100, got {pct}")
    return float(pct)


def percentile_tag(pct: float) -> str:
    """``90.0`` -> ``90``, ``97.5`` -> ``97.5``; used in output folder names."""
    return f"{float(pct):g}"
