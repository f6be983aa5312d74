"""Regions of interest as predicates. Boundary rules differ on purpose and are stated at each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Disk:
    """Vectors within r_outer (boundary included) and, if r_inner > 0, outside r_inner (boundary excluded)."""

    cx: float
    cy: float
    r_outer: float
    r_inner: float = 0.0

    def predicate(self, kx: Column, ky: Column) -> Column:
        d2 = (kx - self.cx) * (kx - self.cx) + (ky - self.cy) * (ky - self.cy)
        inside = d2 <= self.r_outer * self.r_outer
        return inside & (d2 > self.r_inner * self.r_inner) if self.r_inner > 0 else inside


@dataclass(frozen=True)
class Rectangle:
    """Half-open on both axes; reversed corners are swapped."""

    x0: float
    y0: float
    x1: float
    y1: float

    def predicate(self, kx: Column, ky: Column) -> Column:
        (xa, xb), (ya, yb) = sorted((self.x0, self.x1)), sorted((self.y0, self.y1))
        return (kx >= xa) & (kx < xb) & (ky >= ya) & (ky < yb)


@dataclass(frozen=True)
class PixelRing:
    """Detector pixels from r_inner to r_outer, both boundaries included."""

    cx: float
    cy: float
    r_outer: float
    r_inner: float = 0.0

    def predicate(self, kx: Column, ky: Column) -> Column:
        d2 = (kx - self.cx) * (kx - self.cx) + (ky - self.cy) * (ky - self.cy)
        return (d2 <= self.r_outer * self.r_outer) & (d2 >= self.r_inner * self.r_inner)

    def pixels(self, width: int, height: int) -> list[int]:
        """Row-major indices of the mask's pixels; an empty mask is an error."""
        at = [y * width + x for y in range(height) for x in range(width) if self.r_inner**2 <= (x - self.cx) ** 2 + (y - self.cy) ** 2 <= self.r_outer**2]
        if not at:
            raise ValueError("the mask holds no pixel")
        return at


@dataclass(frozen=True)
class Box:
    """Within h of a centre on both axes, boundary included."""

    cx: float
    cy: float
    h: float

    def predicate(self, kx: Column, ky: Column) -> Column:
        return (F.abs(kx - self.cx) <= self.h) & (F.abs(ky - self.cy) <= self.h)


def corner_blocks(ny: int, nx: int, fraction: float, least: int = 2):
    """The four corner blocks of a scan: each a fraction of its own axis, at least `least` wide."""
    f = min(max(fraction, 1e-6), 0.5)
    by, bx = (min(n, max(least, int(round(f * n)))) for n in (ny, nx))
    return lambda y, x: ((y < by) | (y >= ny - by)) & ((x < bx) | (x >= nx - bx))


def inscribed_circle(height: int, width: int) -> PixelRing:
    """The largest circle inside a detector."""
    return PixelRing((width - 1) / 2, (height - 1) / 2, (min(height, width) - 1) / 2)


def channel_ranges(mask: list[bool]) -> list[tuple[int, int]]:
    """A channel mask as half-open ranges."""
    out, start = [], None
    for i, m in enumerate([*mask, False]):
        if m and start is None:
            start = i
        elif not m and start is not None:
            out.append((start, i))
            start = None
    return out


def in_ranges(channel: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((channel >= a) & (channel < b))
    return out
