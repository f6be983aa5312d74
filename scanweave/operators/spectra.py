"""Spectra: fits for each position, backgrounds, element maps and fractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import Model
from ..sources.store import working_dir
from .grid import grid_complete, neighbours

FIT = "y int, x int, parameters array<double>, converged boolean, chisq double, n_iter int"


def levenberg_marquardt(model: Model, x: np.ndarray, data: np.ndarray, start: np.ndarray | None = None, weights: np.ndarray | str | None = None, iterations: int = 60, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, converged, chisq, iterations) for many spectra at once: every step solves all rows' damped normal equations together.

    Fixed parameters stay, bounds are kept by clipping, channels outside the
    model's ranges weigh nothing; weights "poisson" are 1 / max(counts, 1).
    """
    n, m = data.shape
    p = np.tile(model.values(), (n, 1)) if start is None else start.astype(float).copy()
    free, (low, high) = np.flatnonzero(model.free()), model.bounds()
    w = np.ones((n, m)) if weights is None else 1 / np.maximum(data, 1) if isinstance(weights, str) else np.broadcast_to(weights, (n, m)).copy()
    if model.channel_ranges:
        inside = np.zeros(m, bool)
        for a, b in model.channel_ranges:
            inside[a:b] = True
        w = w * inside
    p = np.clip(p, low, high)
    cost = lambda q: (w * (data - model.curve(x, q)) ** 2).sum(axis=1)
    chi, damp, done, used = cost(p), np.full(n, 1e-3), np.zeros(n, bool), np.zeros(n, int)
    for _ in range(iterations):
        live = np.flatnonzero(~done)
        if not len(live) or not len(free):
            done[:] = True
            break
        q = p[live]
        base = model.curve(x, q)
        jac = model.jacobian(x, q)[:, free]
        wj = jac * w[live][:, None, :]
        a = wj @ jac.transpose(0, 2, 1)
        g = (wj @ (data[live] - base)[:, :, None])[:, :, 0]
        scale = np.einsum("ijj->ij", a)
        diag = np.maximum(scale, 1e-12 * np.maximum(1e-30, scale.max(axis=1, keepdims=True)))
        a = a + np.eye(len(free)) * (damp[live][:, None] * diag)[:, :, None]
        step = np.linalg.solve(a + np.eye(len(free)) * 1e-300, g[:, :, None])[:, :, 0] if np.all(np.abs(np.linalg.det(a)) > 0) else (np.linalg.pinv(a) @ g[:, :, None])[:, :, 0]
        trial = p[live].copy()
        trial[:, free] += step
        trial = np.clip(trial, low, high)
        full = p.copy()
        full[live] = trial
        new = cost(full)[live]
        better = new < chi[live]
        small = np.abs(chi[live] - new) <= tolerance * np.maximum(chi[live], 1e-30)
        p[live[better]] = trial[better]
        chi[live[better]] = new[better]
        damp[live] = np.where(better, damp[live] * 0.3, damp[live] * 8)
        used[live] += 1
        done[live] = small | (damp[live] > 1e12)
    return p, done, chi, used


def fit(spectra: DataFrame, model: Model, axis: tuple[float, float], weights: str | None = None, start: str | None = None) -> DataFrame:
    """(y, x, parameters, converged, chisq, n_iter): the model fitted at every position, batch by batch, without a shuffle.

    spectra has y, x, spectrum; axis is (offset, scale); start names a column of
    starting parameters.
    """
    offset, scale = axis

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                data = np.array(rows["spectrum"].tolist(), float)
                x = offset + scale * np.arange(data.shape[1])
                s = np.array(rows[start].tolist(), float) if start else None
                p, ok, chi, n = levenberg_marquardt(model, x, data, s, weights)
                yield pd.DataFrame({"y": rows["y"], "x": rows["x"], "parameters": list(p), "converged": ok, "chisq": chi, "n_iter": n})

    return spectra.select("y", "x", "spectrum", *([start] if start else [])).mapInPandas(run, FIT)


def seeded_fit(spectra: DataFrame, model: Model, axis: tuple[float, float], ny: int, nx: int, stride: int = 4, weights: str | None = None) -> DataFrame:
    """A coarse fit on a strided grid, then all positions from their nearest coarse node's result (or from the model where that didn't converge)."""
    from .neighbourhood import coarse_nodes, nearest_coarse

    ys, xs = coarse_nodes(ny, stride), coarse_nodes(nx, stride)
    coarse = fit(spectra.where(F.col("y").isin(ys) & F.col("x").isin(xs)), model, axis, weights).where("converged")
    seeds = coarse.select(F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("parameters").alias("__p"))
    own = F.array(*map(F.lit, model.values().tolist()))
    near = spectra.withColumn("__cy", nearest_coarse(F.col("y"), ys)).withColumn("__cx", nearest_coarse(F.col("x"), xs))
    near = near.join(seeds, (F.col("__cy") == F.col("__y")) & (F.col("__cx") == F.col("__x")), "left")
    return fit(near.select("y", "x", "spectrum", F.coalesce("__p", own).alias("seed")), model, axis, weights, "seed")


def polish(spectra: DataFrame, fits: DataFrame, model: Model, axis: tuple[float, float], passes: int = 2, factor: float = 2.0, weights: str | None = None) -> DataFrame:
    """Poor fits tried again from their best neighbour's parameters; a result stays only if it is better, and passes end when none is."""
    from .neighbourhood import poor_fits

    working_dir(spectra.sparkSession)
    for _ in range(passes):
        poor = poor_fits(fits, factor).where("poor").select("y", "x")
        near = neighbours(fits.where("converged"), ["parameters", "chisq"]).groupBy("y", "x").agg(F.min_by("n_parameters", "n_chisq").alias("seed"))
        again = fit(spectra.join(poor, ["y", "x"], "left_semi").join(near, ["y", "x"]), model, axis, weights, "seed")
        new = again.select("y", "x", F.struct("parameters", "converged", "chisq", "n_iter").alias("__n"))
        both = fits.join(new, ["y", "x"], "left").withColumn("__b", F.coalesce(F.col("__n.chisq") < F.col("chisq"), F.lit(False)))
        fits = both.select("y", "x", *[F.when(F.col("__b"), F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) for c in ("parameters", "converged", "chisq", "n_iter")], "__b").checkpoint()
        gain = not fits.where("__b").isEmpty()
        fits = fits.drop("__b")
        if not gain:
            break
    return fits


def relabel(fits: DataFrame, slices: list[tuple[int, int]]) -> DataFrame:
    """Exchangeable components (slices of the parameters) in one order everywhere: by the parameter whose values are most disjoint, the gap between one component's 95th and the next one's 5th percentile over the spread."""
    width = slices[0][1] - slices[0][0]
    comps = [F.slice("parameters", a + 1, b - a) for a, b in slices]
    sorted_by = lambda k: F.array_sort(F.transform(F.array(*comps), lambda c: F.struct(F.element_at(c, k + 1).alias("v"), c.alias("c"))))
    best, most = 0, -np.inf
    for k in range(width):
        cols = fits.select(*[F.element_at(sorted_by(k), i + 1)["v"].alias(f"v{i}") for i in range(len(slices))])
        q = cols.agg(*[F.percentile(f"v{i}", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias(f"q{i}") for i in range(len(slices))]).first()
        if q is None or q[0] is None:
            continue
        gap = min(q[i + 1][0] - q[i][2] for i in range(len(slices) - 1))
        spread = np.median([abs(v[2] - v[0]) for v in q]) + 1e-12
        if gap / spread > most:
            best, most = k, gap / spread
    order = sorted_by(best)
    out, at = F.slice("parameters", 1, slices[0][0]), slices[0][0]
    for i, (a, b) in enumerate(slices):
        out = F.concat(out, F.slice("parameters", at + 1, a - at), F.element_at(order, i + 1)["c"])
        at = b
    return fits.withColumn("parameters", F.concat(out, F.slice("parameters", at + 1, F.size("parameters") - at)))


def line_fit(spectra: DataFrame, first: int, last: int, axis: tuple[float, float], spectrum: str = "spectrum") -> DataFrame:
    """(y, x, slope, intercept): the least-squares line over channels [first, last), without Python. At least four channels are needed."""
    if last - first < 4:
        raise ValueError("a background window has at least four channels")
    offset, scale = axis
    xs = [offset + scale * i for i in range(first, last)]
    n, sx, sxx = len(xs), sum(xs), sum(v * v for v in xs)
    part = F.slice(spectrum, first + 1, last - first)
    s = F.aggregate(F.arrays_zip(part.alias("v"), F.array(*map(F.lit, xs)).alias("x")), F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("xy")), lambda a, c: F.struct((a["y"] + c["v"]).alias("y"), (a["xy"] + c["v"] * c["x"]).alias("xy")))
    got = spectra.withColumn("__s", s)
    slope = (n * F.col("__s.xy") - sx * F.col("__s.y")) / (n * sxx - sx * sx)
    return got.select("y", "x", slope.alias("slope"), ((F.col("__s.y") - slope * sx) / n).alias("intercept"))


def remove_line(spectra: DataFrame, first: int, last: int, axis: tuple[float, float]) -> DataFrame:
    """Spectra less the line through a window, over the whole axis."""
    line = line_fit(spectra, first, last, axis)
    value = F.transform("spectrum", lambda v, i: v - (F.col("slope") * (F.lit(axis[0]) + F.lit(axis[1]) * i) + F.col("intercept")))
    return spectra.join(line, ["y", "x"]).select("y", "x", value.alias("spectrum"))


def remove_background(spectra: DataFrame, component: Model, first: int, last: int, axis: tuple[float, float]) -> DataFrame:
    """Spectra less one fitted component (a power law, say), fitted in the window and subtracted everywhere."""
    if last - first < 4:
        raise ValueError("a background window has at least four channels")
    offset, scale = axis
    model = Model(component.components, [(first, last)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                data = np.array(rows["spectrum"].tolist(), float)
                x = offset + scale * np.arange(data.shape[1])
                p = levenberg_marquardt(model, x, data)[0]
                yield pd.DataFrame({"y": rows["y"], "x": rows["x"], "spectrum": list(data - model.curve(x, p))})

    return spectra.select("y", "x", "spectrum").mapInPandas(run, "y int, x int, spectrum array<double>")


def power_law_seeds(spectra: DataFrame, first: int, last: int, axis: tuple[float, float], spectrum: str = "spectrum") -> DataFrame:
    """(y, x, A, r): a power law through the sums of the two halves of a window, without Python: r = 2 ln(I1 / I2) / ln(E3 / E1), and A from the first half's area. Null where a half isn't positive."""
    offset, scale = axis
    middle = (first + last) // 2
    low, mid, high = (offset + scale * i for i in (first, middle, last))
    if low <= 0 or not first < middle < last:
        raise ValueError("the window lies at positive energies and has at least two channels")
    add = lambda a, b: F.aggregate(F.slice(spectrum, a + 1, b - a), F.lit(0.0), lambda s, v: s + v) * scale
    one, two = add(first, middle), add(middle, last)
    r = 2 * F.ln(F.col("__1") / F.col("__2")) / float(np.log(high / low))
    e = 1 - F.col("r")
    area = F.when(F.abs(e) > 1e-9, (F.pow(F.lit(mid), e) - F.pow(F.lit(low), e)) / e).otherwise(float(np.log(mid / low)))
    rows = spectra.select("y", "x", one.alias("__1"), two.alias("__2"))
    ok = (F.col("__1") > 0) & (F.col("__2") > 0)
    return rows.withColumn("r", F.when(ok, r)).select("y", "x", F.when(ok, F.col("__1") / area).alias("A"), "r")


def element_maps(lines: DataFrame) -> DataFrame:
    """(y, x, element, intensity) of lines (y, x, component, intensity) named Element_Line: negative intensities count as 0."""
    element = F.regexp_extract("component", "^([A-Z][a-z]?)_", 1)
    return lines.where(element != "").groupBy("y", "x", element.alias("element")).agg(F.sum(F.greatest("intensity", F.lit(0.0))).alias("intensity"))


def quantify(maps: DataFrame, method: str = "relative", factors: dict[str, float] | None = None) -> DataFrame:
    """maps with fraction and defaulted: shares of each position's total; null where that isn't positive. Elements without a factor have 1 and are marked."""
    if method not in ("relative", "cliff_lorimer", "eels"):
        raise ValueError("method is relative, cliff_lorimer or eels")
    given = factors or {}
    k: Column = F.lit(1.0)
    for name, v in given.items():
        k = F.when(F.col("element") == name, F.lit(float(v))).otherwise(k)
    weighted = {"relative": F.col("intensity"), "cliff_lorimer": F.col("intensity") * k, "eels": F.col("intensity") / k}[method]
    out = maps.withColumn("__w", weighted)
    total = F.sum("__w").over(Window.partitionBy("y", "x"))
    out = out.withColumn("__t", total)
    defaulted = F.lit(method != "relative") & ~F.col("element").isin(list(given)) if given else F.lit(method != "relative")
    return out.withColumn("fraction", F.when(F.col("__t") > 0, F.col("__w") / F.col("__t"))).withColumn("defaulted", defaulted).drop("__w", "__t")


def curve_area(spectra: DataFrame, scale: float, spectrum: str = "spectrum") -> DataFrame:
    """(y, x, area): trapezoids under a curve."""
    area = F.aggregate(spectrum, F.lit(0.0), lambda a, v: a + v) - (F.element_at(spectrum, 1) + F.element_at(spectrum, -1)) / 2
    return spectra.select("y", "x", (area * scale).alias("area"))


def edges_in_range(edges: DataFrame, low: float, high: float, elements: list[str]) -> DataFrame:
    """Edges whose onset lies inside the axis, with suggested: its element is in the sample."""
    return edges.where(F.col("onset").between(low, high)).withColumn("suggested", F.col("element").isin(elements))


def parameter_maps(fits: DataFrame, names: list[str], sizes: dict[str, int]) -> DataFrame:
    """A dense map for each parameter."""
    return grid_complete(fits.select(*sizes, *[F.element_at("parameters", i + 1).alias(n) for i, n in enumerate(names)]), sizes)


def convergence(fits: DataFrame) -> DataFrame:
    return fits.agg(F.avg(F.col("converged").cast("int")).alias("rate"), F.count("*").alias("n"))
