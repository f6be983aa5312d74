"""Reference lattices and phases: families, consensus, ring matching, band simulation, compositions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import working_dir
from .dominance import grouped


def snapped(reference: DataFrame, families: list[float], tolerance: float) -> DataFrame:
    """Reference vectors (ref, gx, gy) stretched to their nearest family's length where its relative error is within the tolerance; the others are left out."""
    from .matching import nearest_family

    r = reference.withColumn("magnitude", F.hypot("gx", "gy")).where("magnitude > 0")
    near = nearest_family(r, families, tolerance)
    k = F.col("family") / F.col("magnitude")
    return near.select("ref", (F.col("gx") * k).alias("gx"), (F.col("gy") * k).alias("gy"))


def consensus(vectors: DataFrame, cell: float, least_share: float, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """(ref, gx, gy): mean vectors of the cells that at least a share of the positions of a region fill; refs from the most filled one on."""
    total = vectors.select(*keys).distinct().agg(F.count("*").alias("__t"))
    at = [F.floor(F.col(c) / cell + 0.5).cast("long").alias(n) for c, n in (("kx", "cx"), ("ky", "cy"))]
    got = vectors.groupBy(*at).agg(F.count_distinct(*keys).alias("n"), F.avg("kx").alias("gx"), F.avg("ky").alias("gy"))
    got = got.crossJoin(F.broadcast(total)).where(F.col("n") >= least_share * F.col("__t"))
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "cx", "cy")
    return got.select((F.row_number().over(order) - 1).alias("ref"), "gx", "gy", "n")


def ball_consensus(vectors: DataFrame, radius: float, least_share: float, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """(ref, gx, gy, n): the spots of a region that at least a share of its positions (two at least) hold; refs from the densest on.

    The vector with the most others within the radius takes them all, then the
    densest of those left, and so on (ties: the smaller kx, then ky); a spot lies
    at its vectors' median. Balls follow the vectors, so a spot is whole wherever
    it lies. Equal vectors count together as one point. Vectors without a place
    are in no spot. Pairs within the radius are counted: the region should be the
    neighbourhood of a reference position, not a whole scan of fine vectors.
    """
    working_dir(vectors.sparkSession)
    known = vectors.where(F.col("kx").isNotNull() & F.col("ky").isNotNull()).select(*keys, "kx", "ky")
    order = ["kx", "ky"]
    points = known.groupBy(*order).agg(F.count("*").alias("times")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()).checkpoint()
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    placed = points.select("ord", "kx", "ky", "times", cell("kx").alias("cx"), cell("ky").alias("cy"))
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = placed.withColumn("__a", F.explode(steps)).withColumn("__b", F.explode(steps)).select(F.col("kx").alias("ox"), F.col("ky").alias("oy"), "times", (F.col("cx") + F.col("__a")).alias("cx"), (F.col("cy") + F.col("__b")).alias("cy"))
    near = placed.drop("times").join(around, ["cx", "cy"]).where((F.col("kx") - F.col("ox")) ** 2 + (F.col("ky") - F.col("oy")) ** 2 <= radius**2)
    dense = near.groupBy("ord", "kx", "ky").agg(F.sum("times").alias("intensity"))
    spots = grouped(dense.select(F.col("ky").alias("py"), F.col("kx").alias("px"), "intensity", "ord"), radius, []).select((-F.col("own.o")).alias("ord"), F.col("head.s").alias("density"), (-F.col("head.o")).alias("head"))
    members = known.join(points.select("kx", "ky", "ord"), ["kx", "ky"]).join(spots, "ord")
    total = known.select(*keys).distinct().agg(F.count("*").alias("__t"))
    found = members.groupBy("head", "density").agg(F.count_distinct(*keys).alias("n"), F.percentile("kx", F.lit(0.5)).alias("gx"), F.percentile("ky", F.lit(0.5)).alias("gy"))
    # one row; then a row a spot
    kept = found.crossJoin(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(least_share * F.col("__t"))))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("density"), "head")) - 1
    return kept.select(number.alias("ref"), "gx", "gy", "n")


def match_rings(measured: list[float], phases: dict[str, list[float]], tolerance: float = 0.03) -> list[tuple[str, float, float, int]]:
    """(phase, scale, residual, matched), best first: ring radii assigned one to one to a phase's reflections.

    Every ring and every reflection is tried as the anchor that sets the scale;
    rings then take their nearest free reflection, and the anchoring with most
    matches, then the least mean relative error, counts.
    """
    out = []
    for name, lines in phases.items():
        best: tuple | None = None
        for m0 in measured:
            for g0 in lines:
                scale, free, errors = g0 / m0, list(lines), []
                for m in measured:
                    if not free:
                        break
                    g = min(free, key=lambda v: abs(v - m * scale))
                    if abs(g - m * scale) <= tolerance * g:
                        errors.append(abs(g - m * scale) / g)
                        free.remove(g)
                key = (-len(errors), float(np.mean(errors)) if errors else np.inf)
                if best is None or key < best[0]:
                    best = (key, scale)
        if best:
            out.append((name, float(best[1]), float(best[0][1]), -best[0][0]))
    return sorted(out, key=lambda r: (-r[3], r[2], r[0]))


def band_image(rays: DataFrame, bands: list[tuple[float, float, float, float, float]]) -> DataFrame:
    """(y, x, value): the intensities of all bands (normal, half width as a sine, intensity) that a pixel's ray lies in."""
    value: Column = F.lit(0.0)
    for nx, ny, nz, half, intensity in bands:
        n = float(np.sqrt(nx * nx + ny * ny + nz * nz))
        dot = (F.col("rx") * nx + F.col("ry") * ny + F.col("rz") * nz) / n
        value = value + F.when(F.abs(dot) <= half, float(intensity)).otherwise(0.0)
    return rays.select("y", "x", value.alias("value"))


def strongest(bands: DataFrame, n: int) -> DataFrame:
    return bands.orderBy(F.desc("intensity"), "id").limit(n)


def euler_grid(spark, step: float) -> DataFrame:
    """(id, phi1, big_phi, phi2) in degrees over the cubic range, 0 to 90 in all."""
    k = int(np.floor(90 / step)) + 1
    i = F.col("id")
    return spark.range(k**3).select("id", (F.floor(i / (k * k)) * step).alias("phi1"), (F.floor(i / k) % k * step).alias("big_phi"), (i % k * step).alias("phi2"))


def exchangeable(components: DataFrame) -> DataFrame:
    """(signature, members, n) of components (name, kind, parameters, free) that are alike in kind, parameter names and free pattern, and more than one."""
    sign = F.concat_ws("|", "kind", F.concat_ws(",", "parameters"), F.concat_ws(",", F.transform("free", lambda f: f.cast("string"))))
    return components.groupBy(sign.alias("signature")).agg(F.array_sort(F.collect_list("name")).alias("members"), F.count("*").alias("n")).where("n > 1")


def composition_elements(phases: DataFrame) -> DataFrame:
    """(elements): all phases' elements (phase, elements, trace) without repeats, in the order of the phases; trace elements are left out."""
    rows = phases.select("phase", F.posexplode(F.array_except("elements", "trace")).alias("i", "element"))
    first = rows.groupBy("element").agg(F.min(F.struct("phase", "i")).alias("f"))
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "element"))), lambda s: s["element"]).alias("elements"))


def zone_pairs(normals: list[tuple[float, float, float]]) -> list[tuple[int, int]]:
    """Pairs of bands that aren't parallel."""
    return [(i, j) for (i, a), (j, b) in combinations(enumerate(normals), 2) if np.linalg.norm(np.cross(a, b)) > 1e-9]
