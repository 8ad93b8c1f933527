"""Constants of the trajectory engine."""

from __future__ import annotations

from typing import NamedTuple


class Rect(NamedTuple):
    """A rectangle in degrees."""

    x_min: float
    y_min: float
    x_max: float
    y_max: float

    @property
    def center(self) -> tuple[float, float]:
        return (self.x_min + self.x_max) / 2, (self.y_min + self.y_max) / 2

    def meets(self, other: Rect) -> bool:
        """True unless the rectangles are apart; touching ones meet."""
        return not (other.x_min > self.x_max or other.x_max < self.x_min or other.y_min > self.y_max or other.y_max < self.y_min)

    def expanded(self, ratio: float) -> Rect:
        """Wider by a share of each span on every side."""
        dx, dy = (self.x_max - self.x_min) * ratio, (self.y_max - self.y_min) * ratio
        return Rect(self.x_min - dx, self.y_min - dy, self.x_max + dx, self.y_max + dy)

    def clipped(self, to: Rect) -> Rect:
        return Rect(max(self.x_min, to.x_min), max(self.y_min, to.y_min), min(self.x_max, to.x_max), min(self.y_max, to.y_max))

    def padded(self, ratio: float = 0.06) -> Rect:
        return self.expanded(ratio).clipped(BOUNDS)


# Fixed values of the model.
BOUNDS = Rect(116.0, 39.4, 117.0, 40.1)
VALID_BOX = Rect(115.5, 39.0, 117.5, 41.0)
GRID_SIZE = 100
DENSITY_SIZE = 100
ROAD_GRID_SIZE = 500
EXPAND_RATIOS = (0.05, 0.10, 0.15)
DEFAULT_EXPAND_RATIO = 0.10
POINT_STRIDE = 15
TRAJECTORY_STRIDE = 5
TRAJECTORY_POINTS = 3000
TRAJECTORY_VEHICLES = 30
NODE_STRIDE = 3
TRIP_GAP_US = 300_000_000
SAMPLE_SECONDS = (1, 300)
SAMPLES_NEEDED = 3
SAMPLE_CAP_SECONDS = 600.0
DEFAULT_SPEEDS = {0: 8.0, 1: 8.0, 2: 15.0}
EARTH_RADIUS = 6_371_000.0
NODE_BUCKET = 0.01
PATH_DEPTH_BETWEEN = 15
EXEMPLAR_POINTS = 800
ARC_CAP = 300
REGION_NEAREST = 8
COMPARE_NEAREST = 5
SNAP_KEYFRAME, SNAP_SEGMENTS = 10, 100
DISPLAY_CAP = 120
DEFAULT_VIEW = (116.51, 39.92, 11.0)
PATH_COLORS = [(255, 100, 50, 200), (100, 150, 255, 200), (50, 200, 100, 200), (255, 200, 50, 200), (200, 50, 150, 200), (50, 150, 200, 200)]
PERIODS = {0: "morning peak", 1: "evening peak", 2: "off-peak"}
PERIOD_PARAMS = {"all": None, "morning": 0, "evening": 1, "offpeak": 2}


def period_from_param(value: str | int | None) -> int | None:
    """A period number, or None for all; unknown names mean all."""
    if value is None:
        return None
    text = str(value).lower()
    return int(text) if text in ("0", "1", "2") else PERIOD_PARAMS.get(text)


def normalized_ratio(value: float | None) -> float:
    """The supported expansion ratio that ``value`` is, or the default one."""
    for r in EXPAND_RATIOS:
        if value is not None and abs(value - r) < 1e-9:
            return r
    return DEFAULT_EXPAND_RATIO
