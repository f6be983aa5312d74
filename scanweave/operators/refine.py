"""Refining positions: centre of mass in a box, two-dimensional Gaussians, centres from opposite pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import halo


def com_in_box(image: np.ndarray, points: np.ndarray, half: int, rounds: int = 2) -> np.ndarray:
    """Points (y, x) moved to the centre of mass of their box, its least value taken off, a few times."""
    out = points.astype(float).copy()
    for _ in range(rounds):
        for i, (y, x) in enumerate(out):
            cy, cx = int(round(y)), int(round(x))
            y0, x0 = max(0, cy - half), max(0, cx - half)
            b = image[y0 : cy + half + 1, x0 : cx + half + 1]
            b = b - b.min()
            if b.size and b.sum() > 0:
                yy, xx = np.mgrid[: b.shape[0], : b.shape[1]]
                out[i] = y0 + (b * yy).sum() / b.sum(), x0 + (b * xx).sum() / b.sum()
    return out


def gaussians_in_box(image: np.ndarray, points: np.ndarray, half: int, rounds: int = 40) -> np.ndarray:
    """(rows of A, cx, cy, sigma_x, sigma_y): a Gaussian of volume A over a constant in each point's box, fitted to all points together by damped steps."""
    n, size = len(points), 2 * half + 1
    p = np.pad(image.astype(float), half, mode="edge")
    corner = np.rint(points).astype(int)
    boxes = np.stack([p[y : y + size, x : x + size] for y, x in corner]) if n else np.zeros((0, size, size))
    yy, xx = (a.ravel().astype(float) - half for a in np.mgrid[:size, :size])
    d = boxes.reshape(n, -1)
    low = d.min(axis=1, initial=np.inf)
    s0 = half / 2
    q = np.column_stack([np.maximum((d - low[:, None]).sum(axis=1), 1e-6), points[:, 1] - corner[:, 1], points[:, 0] - corner[:, 0], np.full(n, s0), np.full(n, s0), low])

    def model(q: np.ndarray) -> np.ndarray:
        a, cx, cy, sx, sy, c = (q[:, [k]] for k in range(6))
        return a / (2 * np.pi * sx * sy) * np.exp(-((xx - cx) ** 2) / (2 * sx * sx) - (yy - cy) ** 2 / (2 * sy * sy)) + c

    cost, damp = ((d - model(q)) ** 2).sum(axis=1), np.full(n, 1e-2)
    for _ in range(rounds):
        base = model(q)
        jac = np.stack([(model(q + h * np.eye(6)[k]) - base) / h for k, h in enumerate([1e-4 * max(1.0, float(np.abs(q[:, 0]).max(initial=1))), 1e-5, 1e-5, 1e-5, 1e-5, 1e-5])], axis=1)
        a = jac @ jac.transpose(0, 2, 1)
        g = (jac @ (d - base)[:, :, None])[:, :, 0]
        a = a + np.eye(6) * (damp[:, None] * (np.einsum("ijj->ij", a) + 1e-12))[:, :, None]
        t = q + np.linalg.solve(a, g[:, :, None])[:, :, 0]
        t[:, 3:5] = np.clip(np.abs(t[:, 3:5]), 0.2, 3 * half)
        t[:, 1:3] = np.clip(t[:, 1:3], -half, half)
        new = ((d - model(t)) ** 2).sum(axis=1)
        better = new < cost
        q[better], cost[better] = t[better], new[better]
        damp = np.where(better, damp * 0.3, damp * 5)
    return np.column_stack([q[:, 0], corner[:, 1] + q[:, 1], corner[:, 0] + q[:, 2], q[:, 3], q[:, 4]])


def refined_atoms(images: DataFrame, points: DataFrame, shape: tuple[int, int], half: int, gaussian: bool = True) -> DataFrame:
    """(image, id, x, y, A, sigma_x, sigma_y) of points (image, id, y, x) in their image (image, frame); A and sigmas are null without gaussian. An image's points come together as one array."""
    lists = points.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("id", "y", "x"))).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for image, f, p in rows[["image", "frame", "p"]].itertuples(index=False):
                a, ids = np.asarray(f, float).reshape(shape), [q["id"] for q in p]
                at = com_in_box(a, np.array([(q["y"], q["x"]) for q in p], float), half)
                if gaussian:
                    g = gaussians_in_box(a, at, half)
                    yield pd.DataFrame({"image": image, "id": ids, "x": g[:, 1], "y": g[:, 2], "A": g[:, 0], "sigma_x": g[:, 3], "sigma_y": g[:, 4]})
                else:
                    yield pd.DataFrame({"image": image, "id": ids, "x": at[:, 1], "y": at[:, 0], "A": None, "sigma_x": None, "sigma_y": None})

    return images.select("image", "frame").join(lists, "image").mapInPandas(run, "image int, id long, x double, y double, A double, sigma_x double, sigma_y double")


def _bump(q: np.ndarray, yy: np.ndarray, xx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (n, pixels) of Gaussians (rows of volume, x, y, sigma_x, sigma_y) and their derivatives (n, 5, pixels)."""
    a, x, y, sx, sy = (q[:, [k]] for k in range(5))
    dx, dy = xx - x, yy - y
    unit = np.exp(-(dx * dx) / (2 * sx * sx) - dy * dy / (2 * sy * sy)) / (2 * np.pi * sx * sy)
    v = a * unit
    return v, np.stack([unit, v * dx / sx**2, v * dy / sy**2, v * (dx * dx / sx**3 - 1 / sx), v * (dy * dy / sy**3 - 1 / sy)], axis=1)


def pairs_in_box(boxes: np.ndarray, start: np.ndarray, sigma: float, rounds: int = 80) -> np.ndarray:
    """(rows of two Gaussians' volume, x, y, sigma_x, sigma_y): both atoms of each box (n, side, side) fitted together, so that each explains the other's tail; start is (n, 4), x and y of the one and the other from the box's corner. Pixels that aren't finite don't count."""
    n, side = boxes.shape[:2]
    yy, xx = (a.ravel().astype(float) for a in np.mgrid[:side, :side])
    d = boxes.reshape(n, side * side)
    seen = np.isfinite(d)
    d = np.where(seen, d, 0.0)
    size = np.maximum(np.where(seen, d, -np.inf).max(axis=1, initial=-np.inf) / 2, 1e-9) * 2 * np.pi * sigma * sigma
    width = np.full(n, float(sigma))
    q = np.column_stack([size, start[:, 0], start[:, 1], width, width, size, start[:, 2], start[:, 3], width, width])

    def left(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, j1 = _bump(q[:, :5], yy, xx)
        two, j2 = _bump(q[:, 5:], yy, xx)
        return (d - one - two) * seen, np.concatenate([j1, j2], axis=1) * seen[:, None]

    r, jac = left(q)
    cost, damp = (r * r).sum(axis=1), np.full(n, 1e-2)
    for _ in range(rounds):
        a = jac @ jac.transpose(0, 2, 1)
        a = a + np.eye(10) * (damp[:, None] * (np.einsum("ijj->ij", a) + 1e-12) + 1e-15)[:, :, None]
        t = q + np.linalg.solve(a, jac @ r[:, :, None])[:, :, 0]
        t[:, [3, 4, 8, 9]] = np.clip(np.abs(t[:, [3, 4, 8, 9]]), 0.3, side)
        new_r, new_jac = left(t)
        new = (new_r * new_r).sum(axis=1)
        better = new < cost
        gain = np.where(better, cost - new, 0.0)
        q[better], r[better], jac[better], cost[better] = t[better], new_r[better], new_jac[better], new[better]
        damp = np.clip(np.where(better, damp * 0.3, damp * 5), 1e-9, 1e9)
        if (gain <= 1e-12 * cost).all() and (damp > 1e3).all():
            break
    return q


def refined_pairs(pixels: DataFrame, atoms: DataFrame, pairs: DataFrame, shape: tuple[int, int], sigma: float = 2.5, margin: float = 3.0, tile: int = 256, batch: int = 256) -> DataFrame:
    """(image, a, b, ax, ay, bx, by, a_A, a_sigma_x, a_sigma_y, b_A, b_sigma_x, b_sigma_y, separation, fitted) of pairs (image, a, b) of atoms (image, id, y, x).

    Both atoms are fitted in one box as two Gaussians: apart, each would be drawn to the other.
    The box holds half the median separation of all pairs (to a hundredth of a pixel) and
    margin sigmas on each side of a pair's middle, and is moved inside the image.
    pixels (image, y, x, value) come in tiles with a halo of half a box, so no
    image is in one task, and any tile gives the same result. Pixels that are null
    or absent don't count. An atom that would leave the box stays where it was;
    fitted tells whether neither did. A pair without a pixel, or with fewer than ten, isn't fitted, and one whose
    atoms aren't both given, or lack a coordinate, gives no row.
    """
    end = lambda n: atoms.where("x IS NOT NULL AND y IS NOT NULL").select("image", F.col("id").alias(n), F.col("x").cast("double").alias(f"{n}x"), F.col("y").cast("double").alias(f"{n}y"))
    both = pairs.select("image", "a", "b").join(end("a"), ["image", "a"]).join(end("b"), ["image", "b"])
    # distances in hundredths have few distinct values, so that an exact median is cheap
    apart = both.agg(F.percentile(F.round(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), 2), F.lit(0.5))).first()[0] or 0.0
    half = int(round(apart / 2 + margin * sigma))
    if 2 * half + 1 > min(shape):
        raise ValueError(f"a box of {2 * half + 1} pixels doesn't fit into the image")
    inside = lambda m, n: F.least(F.greatest(F.rint(m).cast("int"), F.lit(half)), F.lit(n - half - 1))
    placed = both.withColumn("cy", inside((F.col("ay") + F.col("by")) / 2, shape[0])).withColumn("cx", inside((F.col("ax") + F.col("bx")) / 2, shape[1]))
    placed = placed.withColumn("ty", F.floor(F.col("cy") / tile).cast("int")).withColumn("tx", F.floor(F.col("cx") / tile).cast("int"))
    names = ["a_A", "a_sigma_x", "a_sigma_y", "b_A", "b_sigma_x", "b_sigma_y"]
    schema = "image int, a long, b long, ax double, ay double, bx double, by double, " + ", ".join(f"{n} double" for n in names) + ", separation double, fitted boolean"

    def fit(key: tuple, seen: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        top, left, side = int(key[1]) * tile - half, int(key[2]) * tile - half, tile + 2 * half
        whole = np.full((side, side), np.nan)
        whole[seen["y"].to_numpy() - top, seen["x"].to_numpy() - left] = seen["value"].to_numpy(dtype=float, na_value=np.nan)
        rows = rows.sort_values(["a", "b"])
        corner = rows[["cx", "cy"]].to_numpy() - half
        at = rows[["ax", "ay", "bx", "by"]].to_numpy(dtype=float)
        q = np.full((len(rows), 10), np.nan)
        step = np.arange(2 * half + 1)
        for i in range(0, len(rows), batch):
            c = corner[i : i + batch]
            boxes = whole[(c[:, 1] - top)[:, None, None] + step[:, None], (c[:, 0] - left)[:, None, None] + step]
            enough = np.isfinite(boxes).sum(axis=(1, 2)) >= 10
            q[i : i + batch][enough] = pairs_in_box(boxes[enough], (at[i : i + batch] - np.tile(c, 2))[enough], sigma)
        new = q[:, [1, 2, 6, 7]] + np.tile(corner, 2)
        near = np.isfinite(new) & (np.abs(new - at) <= half)
        stays = near.reshape(-1, 2, 2).all(axis=2)
        new = np.where(np.repeat(stays, 2, axis=1), new, at)
        out = pd.DataFrame({"image": rows["image"].to_numpy(), "a": rows["a"].to_numpy(), "b": rows["b"].to_numpy(), "ax": new[:, 0], "ay": new[:, 1], "bx": new[:, 2], "by": new[:, 3]})
        for n, k in zip(names, (0, 3, 4, 5, 8, 9), strict=True):
            out[n] = q[:, k]
        return out.assign(separation=np.hypot(new[:, 2] - new[:, 0], new[:, 3] - new[:, 1]), fitted=stays.all(axis=1))

    tiles = halo.tiled(pixels.where("value IS NOT NULL").select("image", "y", "x", F.col("value").cast("double").alias("value")), half, tile)
    keys = ["image", "ty", "tx"]
    return tiles.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(fit, schema)


def nearest_opposites(points: np.ndarray, centre: np.ndarray, most: float, rows: int = 512) -> np.ndarray:
    """(pairs of places): points that are each other's nearest opposite about a centre, at most `most` apart from it. Distances are taken a block of rows at a time; the first of equals counts."""
    near, dist = np.zeros(len(points), int), np.zeros(len(points))
    for a in range(0, len(points), rows):
        d = ((points[None] - (2 * centre - points[a : a + rows])[:, None]) ** 2).sum(-1)
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        d = np.round(d, 12)
        near[a : a + rows] = d.argmin(axis=1)
        dist[a : a + rows] = d.min(axis=1)
    i = np.arange(len(points))
    good = (near[near] == i) & (i < near) & (dist <= most * most)
    return np.column_stack([i[good], near[good]])


def opposite_pairs(points: np.ndarray, centre: np.ndarray, most: float) -> np.ndarray:
    """(pairs of places): opposites paired one to one, the nearest first. Points that are each other's nearest are such pairs; those that are left are searched again."""
    left, out = np.arange(len(points)), [np.zeros((0, 2), int)]
    while len(left) > 1:
        pairs = nearest_opposites(points[left], centre, most)
        if not len(pairs):
            break
        out.append(left[pairs])
        left = np.delete(left, pairs.ravel())
    return np.concatenate(out)


def friedel_centre(points: np.ndarray, tolerances: tuple[float, ...] = (2.0, 1.0, 0.1, 0.1)) -> np.ndarray:
    """The centre of a pattern of opposite points: from the mean on, opposites are paired within each tolerance (of the median distance from the mean) in turn, and the median of their midpoints is the next centre."""
    c = points.mean(axis=0)
    if len(points) < 2:
        return c
    scale = float(np.median(np.hypot(*(points - c).T))) or 1.0
    for tol in tolerances:
        pairs = opposite_pairs(points, c, tol * scale)
        if len(pairs):
            c = np.median((points[pairs[:, 0]] + points[pairs[:, 1]]) / 2, axis=0)
    return c


def friedel_centres(vectors: DataFrame, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """(keys..., cx, cy) of each position's pattern. Equal vectors count once; a position's distinct vectors, which its detector bounds, come as one row, many positions in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            c = np.array([friedel_centre(np.array(p.tolist(), float)) for p in rows["p"]]).reshape(-1, 2)
            yield rows[list(keys)].assign(cx=c[:, 0], cy=c[:, 1])

    lists = vectors.select(*keys, "kx", "ky").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(F.array("kx", "ky"))).alias("p"))
    return lists.mapInPandas(run, ", ".join(f"{k} int" for k in keys) + ", cx double, cy double")


def decoded(heat: np.ndarray, offsets: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """(rows of y, x, confidence): peaks of a heat map (greatest of 3 x 3, at least the threshold), the `most` strongest, moved by their offsets (2, h, w)."""
    p = np.pad(heat, 1, constant_values=-np.inf)
    top = np.max([p[a : a + heat.shape[0], b : b + heat.shape[1]] for a in range(3) for b in range(3)], axis=0)
    at = np.argwhere((heat >= top) & (heat >= threshold))
    at = at[np.argsort(-heat[at[:, 0], at[:, 1]], kind="stable")[:most]]
    return np.column_stack([at + offsets[:, at[:, 0], at[:, 1]].T, heat[at[:, 0], at[:, 1]]]) if len(at) else np.zeros((0, 3))


def decoded_peaks(heat: DataFrame, shape: tuple[int, int], threshold: float, most: int) -> DataFrame:
    """(y, x, py, px, confidence) of heat maps (y, x, frame, off_y, off_x), peak by peak."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for y, x, f, oy, ox in rows[["y", "x", "frame", "off_y", "off_x"]].itertuples(index=False):
                p = decoded(np.asarray(f, float).reshape(shape), np.stack([np.asarray(o, float).reshape(shape) for o in (oy, ox)]), threshold, most)
                yield pd.DataFrame({"y": y, "x": x, "py": p[:, 0], "px": p[:, 1], "confidence": p[:, 2]})

    return heat.select("y", "x", "frame", "off_y", "off_x").mapInPandas(run, "y int, x int, py double, px double, confidence double")
