"""Axes: the calibration of one dimension, kept on the driver and never in rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """coordinate = offset + scale * index."""

    name: str
    size: int
    scale: float = 1.0
    offset: float = 0.0
    units: str = "px"

    def coordinate(self, index: Column) -> Column:
        return F.lit(self.offset) + F.lit(self.scale) * index

    def nearest(self, coordinate: Column) -> Column:
        """The nearest index, halves to even, clipped into the axis."""
        i = F.rint((coordinate - F.lit(self.offset)) / F.lit(self.scale))
        return F.greatest(F.lit(0), F.least(F.lit(self.size - 1), i)).cast("int")

    def bounds(self, start: int, stop: int) -> tuple[int, int]:
        """A half-open range clipped into the axis, at least one wide."""
        a = min(max(0, start), self.size - 1)
        return a, min(max(a + 1, stop), self.size)

    def cropped(self, start: int, stop: int) -> Axis:
        a, b = self.bounds(start, stop)
        return replace(self, size=b - a, offset=self.offset + a * self.scale)

    def rebinned(self, factor: int) -> Axis:
        """Bins of factor pixels; a bin's coordinate is the mean of its pixels'."""
        if factor < 1 or self.size % factor:
            raise ValueError(f"axis {self.name} of {self.size} can't be divided by {factor}")
        return replace(self, size=self.size // factor, scale=self.scale * factor, offset=self.offset + self.scale * (factor - 1) / 2)


def chunk_edge(n_nav: int, frame_bytes: int, target: int = 64 << 20) -> int:
    """The largest e with e ** n_nav * frame_bytes <= target, at least 1."""
    e = 1
    while n_nav and (e + 1) ** n_nav * frame_bytes <= target:
        e += 1
    return e


def nearest_node(root: Axis, node: Axis, index: Column) -> Column:
    """The node's index that lies nearest to a root index, when the two grids differ."""
    return node.nearest(root.coordinate(index))


def is_movie(nav: list[Axis], frame_pixels: int, large: int = 1 << 20) -> bool:
    """A stack along one axis is a movie if the axis is named or measured like time, or its frames are large."""
    timed = len(nav) == 1 and (nav[0].name.lower() in ("t", "time") or nav[0].units in SECONDS)
    return timed or (len(nav) == 1 and frame_pixels >= large)


#: Seconds in each unit of time.
SECONDS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "min": 60.0, "h": 3600.0}
