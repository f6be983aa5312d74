"""Operators that change an array's shape: crop, rebin, downsample, fold, stack, align."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..axes import Axis


def crop(df: DataFrame, axes: dict[str, Axis], ranges: dict[str, tuple[int, int]]) -> tuple[DataFrame, dict[str, Axis]]:
    """Rows of long-form data inside half-open ranges, indices counted from each range's start; and the axes, their offsets moved along."""
    out = dict(axes)
    for name, (a, b) in ranges.items():
        a, b = axes[name].bounds(a, b)
        df = df.where((F.col(name) >= a) & (F.col(name) < b)).withColumn(name, F.col(name) - a)
        out[name] = axes[name].cropped(a, b)
    return df, out


def crop_frame(frame: str, width: int, x0: int, y0: int, x1: int, y1: int) -> Column:
    """A frame's rectangle [x0, x1) x [y0, y1), row-major."""
    return F.flatten(F.transform(F.sequence(F.lit(y0), F.lit(y1 - 1)), lambda r: F.slice(F.col(frame), r * width + x0 + 1, x1 - x0)))


def movie_box(box: tuple | None, width: int, height: int) -> tuple[int, int, int, int]:
    """A crop box clipped into the frame; a malformed or empty one means the whole frame."""
    try:
        x0, y0, x1, y1 = (int(v) for v in box)
    except (TypeError, ValueError):
        return 0, 0, width, height
    x0, x1, y0, y1 = max(0, x0), min(width, x1), max(0, y0), min(height, y1)
    return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else (0, 0, width, height)


def rebin(df: DataFrame, axes: dict[str, Axis], factors: dict[str, int], value: str = "value") -> tuple[DataFrame, dict[str, Axis]]:
    """Sums over bins of whole factors; a factor that doesn't divide its axis is an error that names it."""
    out = {n: a.rebinned(factors.get(n, 1)) for n, a in axes.items()}
    keys = [F.floor(F.col(n) / factors.get(n, 1)).cast("int").alias(n) for n in axes]
    return df.groupBy(*keys).agg(F.sum(value).alias(value)), out


def downsample(df: DataFrame, y: str, x: str, ny: int, nx: int, k: int, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """k x k means after cropping to multiples of k."""
    rows = df.where((F.col(y) < ny // k * k) & (F.col(x) < nx // k * k))
    cell = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return rows.groupBy(*keys, cell(y), cell(x)).agg(F.avg(value).alias(value))


def fold(df: DataFrame, nx: int, index: str = "i") -> DataFrame:
    """A flat stack as a scan: y = i div nx, x = i mod nx."""
    return df.withColumn("y", F.floor(F.col(index) / nx).cast("int")).withColumn("x", (F.col(index) % nx).cast("int")).drop(index)


def stack(members: list[DataFrame], sizes: list[dict[str, int]], name: str = "t") -> DataFrame:
    """Members on a new slowest axis, each cropped to the smallest size of every axis."""
    if not members or any(set(s) != set(sizes[0]) for s in sizes):
        raise ValueError("members must have the same axes")
    least = {k: min(s[k] for s in sizes) for k in sizes[0]}
    cut = [reduce(lambda d, k: d.where(F.col(k) < least[k]), least, m).withColumn(name, F.lit(i)) for i, m in enumerate(members)]
    return reduce(DataFrame.unionByName, cut)


def common_region(offsets: list[tuple[int, int]], sizes: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """The region (y0, x0, y1, x1) of the reference grid that all members cover, each shifted by its integer offset."""
    y0, x0 = max(0, *(-o[0] for o in offsets)), max(0, *(-o[1] for o in offsets))
    y1 = min(s[0] - o[0] for s, o in zip(sizes, offsets, strict=True))
    x1 = min(s[1] - o[1] for s, o in zip(sizes, offsets, strict=True))
    if y1 <= y0 or x1 <= x0:
        raise ValueError("the members have no common region")
    return y0, x0, y1, x1


def aligned(member: DataFrame, offset: tuple[int, int], region: tuple[int, int, int, int], y: str = "y", x: str = "x") -> DataFrame:
    """A member's rows inside the common region, with the region's indices."""
    (oy, ox), (y0, x0, y1, x1) = offset, region
    ry, rx = F.col(y) - oy, F.col(x) - ox
    return member.where((ry >= y0) & (ry < y1) & (rx >= x0) & (rx < x1)).withColumn(y, ry - y0).withColumn(x, rx - x0)


def sum_members(members: list[DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """The aligned members' elementwise sum, in a type that can't overflow. A position that a member lacks, as in a scan's last row filled in part, has none."""
    kind = "long" if dict(members[0].dtypes)[value] in ("int", "smallint", "tinyint", "bigint") else "double"
    rows = reduce(DataFrame.unionByName, [m.withColumn("__member", F.lit(i)) for i, m in enumerate(members)])
    sums = rows.groupBy(*keys).agg(F.sum(F.col(value).cast(kind)).alias(value), F.size(F.collect_set("__member")).alias("__n"))
    return sums.where(F.col("__n") == len(members)).drop("__n")


def to_long(frames: DataFrame, width: int, frame: str = "frame") -> DataFrame:
    """Frames as one row for each pixel: (…, ky, kx, value)."""
    keep = [c for c in frames.columns if c != frame]
    rows = frames.select(*keep, F.posexplode(frame).alias("__p", "value"))
    return rows.select(*keep, F.floor(F.col("__p") / width).cast("int").alias("ky"), (F.col("__p") % width).cast("int").alias("kx"), "value")


def to_frames(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows as frames, row-major; pixels that are missing are left out, so the rows must be complete."""
    pixels = F.array_sort(F.collect_list(F.struct("ky", "kx", "value")))
    return df.groupBy(*keys).agg(F.transform(pixels, lambda p: p["value"]).alias("frame"))


def overlay(reference: dict[str, Axis], shift: dict[str, int]) -> dict[str, Axis]:
    """Axes of a composed member: the origin moves by the overlap's start."""
    from dataclasses import replace

    return {n: replace(a, offset=a.offset + shift.get(n, 0) * a.scale) for n, a in reference.items()}


def tiled(df: DataFrame, sizes: dict[str, int], times: dict[str, int]) -> DataFrame:
    """A scan repeated so many times along each axis."""
    for name, n in times.items():
        df = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(name, (F.col(name) + F.col("__k") * sizes[name]).cast("int")).drop("__k")
    return df


def overlap_of(members: DataFrame, ny: int, nx: int) -> DataFrame:
    """(y0, x0, y1, x1): the region that members (oy, ox) of one size have in common, of a table of members."""
    zero = F.lit(0)
    return members.agg(F.greatest(zero, F.max(-F.col("oy"))).alias("y0"), F.greatest(zero, F.max(-F.col("ox"))).alias("x0"), F.min(ny - F.col("oy")).alias("y1"), F.min(nx - F.col("ox")).alias("x1"))
