"""Orientations: Euler angles, pole figures, dictionary indexing, phases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import compared
from .grid import EIGHT, neighbours

#: Scores that a task of the exhaustive search holds at a time, and values of a tile of templates.
SCORES, TILE_VALUES = 1 << 20, 1 << 21


def euler_matrix(phi1: Column, big_phi: Column, phi2: Column) -> list[list[Column]]:
    """Bunge z-x-z, sample to crystal."""
    c1, s1, c, s, c2, s2 = F.cos(phi1), F.sin(phi1), F.cos(big_phi), F.sin(big_phi), F.cos(phi2), F.sin(phi2)
    return [[c1 * c2 - s1 * s2 * c, s1 * c2 + c1 * s2 * c, s2 * s], [-c1 * s2 - s1 * c2 * c, -s1 * s2 + c1 * c2 * c, c2 * s], [s1 * s, -c1 * s, c]]


def matrix_euler(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Angles of a matrix, from 0 to 2 pi; at the poles phi2 is 0."""
    tau = F.lit(2 * np.pi)
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[2][2]))
    polar = F.abs(c) > 1 - 1e-12
    phi1 = F.when(polar, F.atan2(m[0][1], m[0][0])).otherwise(F.atan2(m[2][0], -m[2][1]))
    phi2 = F.when(polar, 0.0).otherwise(F.atan2(m[0][2], m[1][2]))
    return F.pmod(phi1, tau), F.acos(c), F.pmod(phi2, tau)


def quaternion_rotate(q: list[Column], v: list[float]) -> list[Column]:
    """A unit quaternion (w, x, y, z) applied to a vector."""
    w, x, y, z = q
    m = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return [sum((m[r][k] * float(v[k]) for k in range(1, 3)), m[r][0] * float(v[0])) for r in range(3)]


def cubic_fold(v: list[Column]) -> list[Column]:
    """A direction in the cubic fundamental sector, 0 <= x <= z and y <= x: absolute components in order (middle, least, greatest)."""
    s = F.array_sort(F.array(*[F.abs(c) for c in v]))
    return [F.element_at(s, 2), F.element_at(s, 1), F.element_at(s, 3)]


def stereographic(v: list[Column]) -> tuple[Column, Column]:
    return v[0] / (1 + v[2]), v[1] / (1 + v[2])


def ipf(df: DataFrame, q: tuple[str, str, str, str], direction: tuple[float, float, float] = (0, 0, 1)) -> DataFrame:
    """With (px, py), the folded direction's projection, and (r, g, b), weights of the three corners scaled to the largest."""
    x, y, z = cubic_fold(quaternion_rotate([F.col(c) for c in q], list(direction)))
    px, py = stereographic([x, y, z])
    # distance from each edge of the sector
    red, green, blue = z - x, x - y, y
    top = F.greatest(red, green, blue)
    c = {n: F.when(top > 0, v / top).otherwise(0.0) for n, v in zip("rgb", (red, green, blue), strict=True)}
    return df.withColumns({"px": px, "py": py} | c)


def pole_density(points: DataFrame, bins: int, low: float = 0.0, high: float = 0.5) -> DataFrame:
    """(iy, ix, n): projected directions counted in a raster."""
    at = lambda c: F.floor((F.col(c) - low) / (high - low) * bins).cast("int")
    return points.groupBy(at("py").alias("iy"), at("px").alias("ix")).agg(F.count("*").alias("n"))


def normalised(a: np.ndarray) -> np.ndarray:
    a = a - a.mean(axis=1, keepdims=True)
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n > 0, n, 1)


def dictionary_index(patterns: DataFrame, dictionary: DataFrame, k: int, tile: int = 16_384) -> DataFrame:
    """(id, rank, template, score): each pattern's k best templates by normalised cross-correlation, ties to the smaller template.

    Patterns and templates meet in a grid of blocks: a task keeps a tile of
    templates as one matrix, multiplies it with the patterns that stream past and
    passes on k rows for each; the tiles' lists are merged by a ranking. A tile
    holds fewer templates if they are long, and as many patterns are scored at a time as
    fill SCORES scores, so a task's memory depends on neither table's size.
    """
    longest = dictionary.agg(F.max(F.size("pattern"))).first()[0] or 1
    tile = max(1, min(tile, TILE_VALUES // max(1, longest)))

    def run(templates: pd.DataFrame, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = templates.sort_values("id", kind="stable")
        names, t = templates["id"].to_numpy(), normalised(np.stack(templates["pattern"].to_numpy()).astype(float)).T
        step = max(1, SCORES // len(names))
        del templates
        for b in batches:
            for at in range(0, len(b), step):
                rows = b.iloc[at : at + step]
                s = np.round(normalised(np.stack(rows["pattern"].to_numpy()).astype(float)) @ t, 12)
                if k < s.shape[1]:  # partition selection; among equals of the last place the smaller templates stay
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    free = k - (s > least).sum(axis=1, keepdims=True)
                    keep = (s > least) | ((s == least) & (np.cumsum(s == least, axis=1) <= free))
                else:
                    keep = np.ones_like(s, bool)
                r, c = np.nonzero(keep)
                yield pd.DataFrame({"id": rows["id"].to_numpy()[r], "template": names[c], "score": s[r, c]})

    lists = compared(dictionary.select("id", "pattern"), patterns.select("id", "pattern"), "id", "pattern", tile, run, "id long, template long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "template"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "template", "score")


def best_match(matches: DataFrame) -> DataFrame:
    """(id, template, score): the first of each list."""
    return matches.where(F.col("rank") == 1).select("id", "template", "score")


def with_templates(matches: DataFrame, templates: DataFrame) -> DataFrame:
    """matches (…, template) with their template's quaternion and phase, of templates (template, qw, qx, qy, qz, phase)."""
    return matches.join(templates.select("template", "qw", "qx", "qy", "qz", "phase"), "template")


def cubic_group() -> list[tuple[float, float, float, float]]:
    """The 24 rotations of a cube as quaternions: four about nothing or a half turn, eight about body diagonals, twelve quarter turns and edge turns."""
    h, r = 0.5, float(np.sqrt(0.5))
    units = [tuple(float(i == k) for i in range(4)) for k in range(4)]
    halves = [(h, a * h, b * h, c * h) for a in (1, -1) for b in (1, -1) for c in (1, -1)]
    pairs = [tuple(r if i == a else s * r if i == b else 0.0 for i in range(4)) for a in range(4) for b in range(a + 1, 4) for s in (1, -1)]
    return units + halves + pairs


def quaternion_product(a: list[Column], b: list[Column | float]) -> list[Column]:
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def _variant_of(own: list[Column], other: list[Column], names: list[str]) -> Callable[[Column], Column]:
    """For a symmetry rotation s: other's variant by it, turned to own's sign, and how near it is."""

    def variant(s: Column) -> Column:
        v = quaternion_product([s[i] for i in range(4)], other)
        dot = sum((a * b for a, b in zip(own[1:], v[1:], strict=True)), own[0] * v[0])
        turn = F.when(dot < 0, -1.0).otherwise(1.0)
        return F.struct(F.abs(dot).alias("dot"), *[(c * turn).alias(n) for c, n in zip(v, names, strict=True)])

    return variant


def smoothed_orientations(fits: DataFrame, symmetries: dict[int, list[tuple[float, float, float, float]]], threshold_degrees: float = 5.0, rounds: int = 2) -> DataFrame:
    """fits (y, x, phase, weight, qw, qx, qy, qz) with each position's weighted mean of itself and its eight neighbours of the same phase and grain.

    A neighbour counts in its symmetric variant nearest the position, of either
    sign, and only within the threshold. A position without weight (null, or not
    positive) is neither changed nor counted. symmetries: the rotations of each
    phase; a phase without an entry has none but the identity.
    """
    q = ["qw", "qx", "qy", "qz"]
    keep = [c for c in fits.columns if c not in q]
    table = F.lit(None).cast("array<array<double>>")
    for phase, group in symmetries.items():
        table = F.when(F.col("phase") == phase, F.array(*[F.array(*map(F.lit, map(float, s))) for s in group])).otherwise(table)
    table = F.coalesce(table, F.array(F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)])))
    ok = F.coalesce(F.col("weight") > 0, F.lit(False))
    out = fits
    for _ in range(rounds):
        near = neighbours(out.where(ok), ["phase", "weight", *q], EIGHT)
        both = out.where(ok).select("y", "x", "phase", *q, table.alias("group")).join(near.withColumnRenamed("n_phase", "other"), ["y", "x"]).where(F.col("phase") == F.col("other"))
        own, other = [F.col(c) for c in q], [F.col(f"n_{c}") for c in q]

        both = both.withColumn("v", F.array_max(F.transform("group", _variant_of(own, other, q))))
        degrees = F.degrees(2 * F.acos(F.least(F.lit(1.0), F.col("v.dot"))))
        sums = both.where(degrees <= threshold_degrees).groupBy("y", "x").agg(*[F.sum(F.col("n_weight") * F.col(f"v.{c}")).alias(f"s_{c}") for c in q])
        joined = out.join(sums, ["y", "x"], "left")
        total = {c: F.col(c) * F.col("weight") + F.coalesce(f"s_{c}", F.lit(0.0)) for c in q}
        norm = F.sqrt(sum((total[c] * total[c] for c in q[1:]), total["qw"] * total["qw"]))
        out = joined.select(*keep, *[F.when(ok & (norm > 0), total[c] / norm).otherwise(F.col(c)).alias(c) for c in q])
    return out.select(*fits.columns)


def merge_phases(scores: DataFrame, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """(keys..., phase, score): the best phase of each position, the lowest id among equals."""
    return scores.groupBy(*keys).agg(F.max_by(F.struct("phase", "score"), F.struct("score", -F.col("phase"))).alias("b")).select(*keys, "b.phase", "b.score")


def phase_ranking(residuals: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("residual", "phase")
    return residuals.withColumn("rank", F.row_number().over(w))


def d_spacings(spark, a: float, b: float, c: float, n: int, both_signs: bool = False) -> DataFrame:
    """(h, k, l, d) of an orthogonal cell for all indices up to n, one of each opposite pair (as for bands) or both (as for spots)."""
    rng = spark.range((2 * n + 1) ** 3)
    w = 2 * n + 1
    i = F.col("id")
    hkl = rng.select((F.floor(i / (w * w)) - n).alias("h"), (F.floor(i / w) % w - n).alias("k"), (i % w - n).alias("l"))
    first = (F.col("h") > 0) | ((F.col("h") == 0) & ((F.col("k") > 0) | ((F.col("k") == 0) & (F.col("l") > 0))))
    d = 1 / F.sqrt((F.col("h") / a) ** 2 + (F.col("k") / b) ** 2 + (F.col("l") / c) ** 2)
    some = (F.col("h") != 0) | (F.col("k") != 0) | (F.col("l") != 0)
    return hkl.where(some if both_signs else first).withColumn("d", d)


def friedel_half(vectors: DataFrame, columns: tuple[str, str] = ("kx", "ky")) -> DataFrame:
    """One of each pair of opposite vectors: the canonical sign, then distinct."""
    x, y = (F.col(c) for c in columns)
    turn = F.when((x < 0) | ((x == 0) & (y < 0)), -1.0).otherwise(1.0)
    # 0.0 is added so that -0.0 and 0.0 are one value
    return vectors.select((x * turn + 0.0).alias(columns[0]), (y * turn + 0.0).alias(columns[1])).distinct()


def detector_rays(grid: DataFrame, pc: tuple[float, float, float], ny: int, nx: int, tilt: float) -> DataFrame:
    """(y, x, rx, ry, rz): unit directions from the source to each pixel of a tilted screen; pc is the pattern centre in screen widths."""
    gx = (F.col("x") + 0.5) / nx - pc[0]
    gy = pc[1] - (F.col("y") + 0.5) / ny
    t = float(np.radians(tilt))
    vy, vz = gy * np.cos(t) - pc[2] * np.sin(t), gy * np.sin(t) + pc[2] * np.cos(t)
    n = F.sqrt(gx * gx + vy * vy + vz * vz)
    return grid.select("y", "x", (gx / n).alias("rx"), (vy / n).alias("ry"), (vz / n).alias("rz"))


def zone_axes(bands: DataFrame, least: int, most: int) -> DataFrame:
    """(u, v, w, n): cross products of pairs of band normals (id, nx, ny, nz), folded to one sign and rounded, that at least `least` bands lie on; the richest first. A pattern has tens of bands."""
    a, b = bands.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "nx", "ny", "nz")]), bands.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "nx", "ny", "nz")])
    p = a.join(b, F.col("a_id") < F.col("b_id"))
    c = lambda i, j: F.col(f"a_n{i}") * F.col(f"b_n{j}") - F.col(f"a_n{j}") * F.col(f"b_n{i}")
    u, v, w = c("y", "z"), c("z", "x"), c("x", "y")
    n = F.sqrt(u * u + v * v + w * w)
    turn = F.when((w < -1e-9) | ((F.abs(w) <= 1e-9) & ((v < -1e-9) | ((F.abs(v) <= 1e-9) & (u < 0)))), -1.0).otherwise(1.0)
    axes = p.withColumn("n", n).where(F.col("n") > 1e-9).select("a_id", "b_id", *[(F.round(e * turn / n, 4) + 0.0).alias(name) for name, e in zip("uvw", (u, v, w), strict=True)])
    ends = axes.select("u", "v", "w", F.explode(F.array("a_id", "b_id")).alias("id"))
    return ends.groupBy("u", "v", "w").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "u", "v", "w").limit(most)
