"""Virtual images: a region of the detector reduced to one value at each position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roi import PixelRing
from .grid import grid_complete


def virtual_image(vectors: DataFrame, roi, sizes: dict[str, int], weighted: bool = True, time: int | None = None) -> DataFrame:
    """(positions..., value): the intensity (or number) of the vectors inside roi; 0 where there are none."""
    rows = vectors if time is None else vectors.where(F.col("time") == time)
    rows = rows.where(roi.predicate(F.col("kx"), F.col("ky")))
    value = F.sum(F.col("intensity").cast("double")) if weighted else F.count("*")
    return grid_complete(rows.groupBy(*sizes).agg(value.alias("value")), sizes, ("value",))


def virtual_series(vectors: DataFrame, roi, sizes: dict[str, int], weighted: bool = True) -> DataFrame:
    """Virtual images of all times in one pass; sizes has time first."""
    return virtual_image(vectors, roi, sizes, weighted)


def region_profile(vectors: DataFrame, width: int, height: int, radius: float, scale: float, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """(ky, kx, value): vectors drawn as in `rendered`, summed over positions."""
    return rendered(vectors, width, height, radius, scale, keys).groupBy("ky", "kx").agg(F.sum("value").alias("value"))


def rendered(vectors: DataFrame, width: int, height: int, radius: float, scale: float, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """(keys..., ky, kx, value): each vector drawn as a flat disk on the detector; at each position the largest value of a pixel counts.

    A vector's disk is exploded to its pixels, so rows grow with the disk's area only.
    """
    r = int(radius)
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius])
    px = F.rint((F.col("kx") + 1) / scale).cast("int")
    py = F.rint((F.col("ky") + 1) / scale).cast("int")
    drawn = vectors.select(*keys, "intensity", py.alias("py"), px.alias("px"), F.explode(steps).alias("o"))
    drawn = drawn.select(*keys, "intensity", (F.col("py") + F.col("o.dy")).alias("ky"), (F.col("px") + F.col("o.dx")).alias("kx"))
    drawn = drawn.where(F.col("kx").between(0, width - 1) & F.col("ky").between(0, height - 1))
    return drawn.groupBy(*keys, "ky", "kx").agg(F.max("intensity").alias("value"))


def pick(frame: str, pixels: list[int]) -> Column:
    """The frame's values at some row-major pixels."""
    return F.transform(F.array(*map(F.lit, pixels)), lambda i: F.get(F.col(frame), i))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))


def frame_image(frames: DataFrame, mask: PixelRing, width: int, height: int, mean: bool = False, frame: str = "frame") -> DataFrame:
    """frames' positions with value: the sum (or mean) of the masked pixels. Only the mask's pixels are touched."""
    pixels = mask.pixels(width, height)
    value = total(pick(frame, pixels))
    return frames.select(*[c for c in frames.columns if c != frame], (value / len(pixels) if mean else value).alias("value"))


def navigator(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """The sum over each frame."""
    return frames.select(*[c for c in frames.columns if c != frame], total(F.col(frame)).alias("value"))


def top_navigator(frames: DataFrame, lead: str, frame: str = "frame") -> DataFrame:
    """The deep navigator summed over real space, a value for each index of the leading axis."""
    return navigator(frames, frame).groupBy(lead).agg(F.sum("value").alias("value"))


def region_mean(frames: DataFrame, where: Column, integer: bool, frame: str = "frame") -> DataFrame:
    """(pixel, value): the mean frame over some positions; of integer frames rounded halves to even. Repeated positions count as often as they stand."""
    pixels = frames.where(where).select(F.posexplode(frame).alias("pixel", "v"))
    mean = F.avg(F.col("v").cast("double"))
    return pixels.groupBy("pixel").agg((F.rint(mean) if integer else mean).alias("value"))


def brightness(frames: DataFrame, mask: PixelRing, width: int, height: int, frame: str = "frame") -> DataFrame:
    """(…, value): mean inside the mask over the frame's mean."""
    pixels = mask.pixels(width, height)
    inside, whole = total(pick(frame, pixels)) / len(pixels), total(F.col(frame)) / F.size(frame)
    return frames.select(*[c for c in frames.columns if c != frame], F.when(whole != 0, inside / whole).alias("value"))


def centre_of_mass(frames: DataFrame, width: int, height: int, cx: float, cy: float, frame: str = "frame") -> DataFrame:
    """(…, sx, sy): centre minus centre of mass; null where the frame's total isn't positive. One fold gathers the three moments."""
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"), F.lit(0).alias("i"))

    def step(a: Column, v: Column) -> Column:
        w = v.cast("double")
        return F.struct((a["m"] + w).alias("m"), (a["mx"] + w * (a["i"] % width)).alias("mx"), (a["my"] + w * F.floor(a["i"] / width)).alias("my"), (a["i"] + 1).alias("i"))

    rows = frames.withColumn("__m", F.aggregate(frame, start, step))
    ok = F.col("__m.m") > 0
    return rows.select(
        *[c for c in frames.columns if c != frame], F.when(ok, F.lit(cx) - F.col("__m.mx") / F.col("__m.m")).alias("sx"), F.when(ok, F.lit(cy) - F.col("__m.my") / F.col("__m.m")).alias("sy")
    )


def robust_levels(df: DataFrame, column: str, symmetric: bool = False) -> DataFrame:
    """(low, high): the 2nd and 98th percentiles; with symmetric, plus and minus the 98th of the absolute values."""
    if symmetric:
        high = F.percentile(F.abs(F.col(column)), F.lit(0.98))
        return df.agg((-high).alias("low"), high.alias("high"))
    return df.agg(F.percentile(column, F.lit(0.02)).alias("low"), F.percentile(column, F.lit(0.98)).alias("high"))
