"""Operators over each position's neighbours on the scan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.kernels import total_variation
from .grid import EIGHT, FOUR, neighbours


def _derivative(column: str, along: str, across: str, spacing: float) -> Column:
    """Central difference; one-sided at the ends, null where a row has one position only."""
    w = Window.partitionBy(across).orderBy(along)
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    own = F.col(column)
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * spacing)).when(after.isNotNull(), (after - own) / spacing).when(before.isNotNull(), (own - before) / spacing)


def div_curl(field: DataFrame, dy: float = 1.0, dx: float = 1.0) -> DataFrame:
    """(y, x, div, curl) of a dense field (fx, fy)."""
    fx_x, fy_y = _derivative("fx", "x", "y", dx), _derivative("fy", "y", "x", dy)
    fy_x, fx_y = _derivative("fy", "x", "y", dx), _derivative("fx", "y", "x", dy)
    return field.select("y", "x", (fx_x + fy_y).alias("div"), (fy_x - fx_y).alias("curl"))


def orientation_similarity(best: DataFrame, column: str = "matches") -> DataFrame:
    """(y, x, value): the mean share of a position's best matches (a list without repeats) that its 4-neighbours have too."""
    near = neighbours(best, [column])
    both = best.select("y", "x", column).join(near, ["y", "x"])
    share = F.size(F.array_intersect(column, f"n_{column}")) / F.size(column)
    return both.groupBy("y", "x").agg(F.avg(share).alias("value"))


def unit(frame: Column) -> Column:
    """A frame less its mean, of norm 1."""
    add = lambda a, v: a + v
    values = F.transform(frame, lambda v: v.cast("double"))
    centred = let(let(values, lambda f: F.struct(f.alias("f"), (F.aggregate(f, F.lit(0.0), add) / F.size(f)).alias("m"))), lambda s: F.transform(s["f"], lambda v: v - s["m"]))
    normed = let(centred, lambda f: F.struct(f.alias("f"), F.sqrt(F.aggregate(f, F.lit(0.0), lambda a, v: a + v * v)).alias("n")))
    return let(normed, lambda s: F.transform(s["f"], lambda v: F.when(s["n"] > 0, v / s["n"]).otherwise(F.lit(0.0))))


def average_dot_product(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """(y, x, value): the mean normalised dot product with the 4-neighbours."""
    units = frames.select("y", "x", unit(F.col(frame)).alias("u"))
    both = units.join(neighbours(units, ["u"]), ["y", "x"])
    dot = F.aggregate(F.zip_with("u", "n_u", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return both.groupBy("y", "x").agg(F.avg(dot).alias("value"))


def poor_fits(fits: DataFrame, factor: float = 2.0) -> DataFrame:
    """fits with poor: not converged, or chisq over factor times the median of at least two converged neighbours."""
    near = neighbours(fits.where("converged"), ["chisq"]).groupBy("y", "x").agg(F.percentile("n_chisq", F.lit(0.5)).alias("__m"), F.count("*").alias("__n"))
    out = fits.join(near, ["y", "x"], "left")
    poor = ~F.col("converged") | F.coalesce((F.col("__n") >= 2) & (F.col("chisq") > factor * F.col("__m")), F.lit(False))
    return out.select(*fits.columns, poor.alias("poor"))


def persistent(peaks: DataFrame, tolerance: float, least: int) -> DataFrame:
    """The peaks (y, x, py, px, ord) that at least `least` of the four neighbouring frames have within tolerance; frames with fewer neighbours are not filtered.

    Peaks meet in cells as wide as the tolerance, so the join is on equality;
    equal peaks of a frame are one point for it.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    frames = peaks.select("y", "x").distinct()
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in FOUR])
    count = frames.select((F.col("y")).alias("fy"), F.col("x").alias("fx"), F.explode(steps).alias("o")).select("fy", "fx", (F.col("fy") + F.col("o.dy")).alias("y"), (F.col("fx") + F.col("o.dx")).alias("x")).join(frames, ["y", "x"]).groupBy("fy", "fx").agg(F.count("*").alias("frames"))
    # each neighbour's peaks, with the number of the offset they came by
    numbered = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for k, (a, b) in enumerate(FOUR)])
    points = peaks.select("y", "x", "py", "px").distinct()
    near = points.select("py", "px", "y", "x", F.explode(numbered).alias("o")).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.k").alias("k"), F.col("py").alias("n_py"), F.col("px").alias("n_px"))
    near = near.withColumn("cy", F.floor(F.col("n_py") / tolerance).cast("long")).withColumn("cx", F.floor(F.col("n_px") / tolerance).cast("long"))
    spread = points.withColumn("__c", F.explode(around)).withColumn("cy", cell("py") + F.col("__c.a")).withColumn("cx", cell("px") + F.col("__c.b")).drop("__c")
    d2 = (F.col("py") - F.col("n_py")) ** 2 + (F.col("px") - F.col("n_px")) ** 2
    hits = spread.join(near, ["y", "x", "cy", "cx"]).where(d2 <= tolerance * tolerance).groupBy("y", "x", "py", "px").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, k)"))).alias("hits"))
    out = peaks.join(hits, ["y", "x", "py", "px"], "left").join(count.withColumnRenamed("fy", "y").withColumnRenamed("fx", "x"), ["y", "x"], "left")
    keep = (F.coalesce("frames", F.lit(0)) < least) | (F.coalesce("hits", F.lit(0)) >= least)
    return out.where(keep).select(*peaks.columns)


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights from -ceil(3 sigma) to ceil(3 sigma), of sum 1."""
    r = int(np.ceil(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-12)) ** 2)
    return (w / w.sum()).tolist()


def blur(values: DataFrame, sigma: float, ny: int, nx: int, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """A separable Gaussian over the scan axes; edges are reflected (the edge row is repeated).

    Each row is handed to the positions within reach, an axis at a time, and
    weights are summed there: partial sums before the shuffle, no window over a
    whole row of the scan.
    """
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    if r == 0:
        return values
    weights = F.array(*[F.struct(F.lit(k - r).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(kernel)])

    def along(df: DataFrame, axis: str, n: int, other: str) -> DataFrame:
        # a position's own index is reached from its mirror images beyond the edges too
        images = F.array(F.col(axis), -F.col(axis) - 1, 2 * n - F.col(axis) - 1)
        spread = df.withColumn("__i", F.explode(images)).withColumn("__k", F.explode(weights))
        at = F.col("__i") + F.col("__k.d")
        spread = spread.where((at >= 0) & (at < n)).withColumn(axis, at.cast("int"))
        return spread.groupBy(*keys, axis, other).agg(F.sum(F.col(value) * F.col("__k.w")).alias(value))

    if r > min(ny, nx):
        raise ValueError("sigma is too wide for the scan")
    return along(along(values, "y", ny, "x"), "x", nx, "y")


def median_filter(values: DataFrame, value: str = "value") -> DataFrame:
    """(y, x, value): the median of a position and its 8 neighbours; a missing value stays missing and counts nowhere."""
    rows = values.select("y", "x", value)
    around = rows.select("y", "x", F.col(value).alias("n")).union(neighbours(rows, [value], EIGHT).select("y", "x", F.col(f"n_{value}").alias("n")))
    medians = around.where(F.col("n").isNotNull()).groupBy("y", "x").agg(F.percentile("n", F.lit(0.5)).alias("__m"))
    return rows.join(medians, ["y", "x"], "left").select("y", "x", F.when(F.col(value).isNotNull(), F.col("__m")).alias(value))


def smoothed_strain(strains: DataFrame, components: tuple[str, ...] = ("exx", "eyy", "exy")) -> DataFrame:
    """(y, x, components...) with each component's 3 x 3 median; missing positions stay missing. One pass over the neighbours for all components."""
    rows = strains.select("y", "x", *components)
    around = rows.union(neighbours(rows, list(components), EIGHT))
    medians = around.groupBy("y", "x").agg(*[F.percentile(c, F.lit(0.5)).alias(f"__{c}") for c in components])
    return rows.join(medians, ["y", "x"], "left").select("y", "x", *[F.when(F.col(c).isNotNull(), F.col(f"__{c}")).alias(c) for c in components])


def denoised_strain(strains: DataFrame, tile: int = 64, depth: int = 16, weight: float = 0.03, components: tuple[str, ...] = ("exx", "eyy", "exy")) -> DataFrame:
    """Total-variation denoising of each component, tile by tile with a halo of depth; missing positions stay missing. The prior acts over a few positions, so a halo of 16 leaves no seams."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        out = rows[["y", "x"]].copy()
        for c in components:
            a = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), np.nan)
            a[y - y.min(), x - x.min()] = rows[c].to_numpy(float)
            out[c] = total_variation(a, weight)[y - y.min(), x - x.min()]
        return out[~rows["halo"].to_numpy(bool)]

    cols = strains.select("y", "x", *[F.col(c).cast("double").alias(c) for c in components])
    out = map_tiles(cols, run, "y int, x int, " + ", ".join(f"{c} double" for c in components), depth, tile)
    return out.select("y", "x", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in components])


def coarse_nodes(n: int, stride: int) -> list[int]:
    """Every stride-th index, the last one always."""
    return sorted({*range(0, n, stride), n - 1})


def nearest_coarse(axis: Column, nodes: list[int]) -> Column:
    """The nearest coarse index; the lower one where two are as near."""
    lists = F.array(*map(F.lit, nodes))
    return F.element_at(F.transform(F.array_sort(F.transform(lists, lambda c: F.struct(F.abs(axis - c).alias("d"), c.alias("c")))), lambda s: s["c"]), 1)


def with_halo(df: DataFrame, depth: int, tile: int, y: str = "y", x: str = "x") -> DataFrame:
    """df with (tile_y, tile_x): each row in its own tile, and in the neighbouring ones within depth of it, marked by halo."""
    if depth > tile:
        raise ValueError("the halo is deeper than a tile")
    steps = F.array(*[F.struct(F.lit(a * depth).alias("a"), F.lit(b * depth).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = df.withColumn("__s", F.explode(steps))
    ty, tx = F.floor((F.col(y) + F.col("__s.a")) / tile).cast("int"), F.floor((F.col(x) + F.col("__s.b")) / tile).cast("int")
    own = (ty == F.floor(F.col(y) / tile)) & (tx == F.floor(F.col(x) / tile))
    out = spread.withColumn("tile_y", ty).withColumn("tile_x", tx).withColumn("halo", ~own).drop("__s")
    return out.dropDuplicates([y, x, "tile_y", "tile_x"])


def map_tiles(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, depth: int, tile: int) -> DataFrame:
    """f of each tile with its halo; f must return rows of the tile's own positions only (halo is a column)."""
    return with_halo(df, depth, tile).groupBy("tile_y", "tile_x").applyInPandas(f, schema)
