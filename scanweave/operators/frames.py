"""Operators that run a kernel on every frame, a batch of rows at a time, without a shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions import kernels
from ..sources.store import working_dir
from . import halo

VECTORS = "time double, nav_y int, nav_x int, kx double, ky double, intensity double, confidence double, sigma double, ord long, disk_mean double"
DEFAULT_THRESHOLD = {"nxcorr": 0.5, "dog": 10.0}


def map_frames(frames: DataFrame, shape: tuple[int, int], *functions: Callable[..., np.ndarray], depth: int = 0) -> DataFrame:
    """frames with functions applied to each one after the other, in a single pass to Python and back.

    With a depth, a function gets a block (rows, columns, *shape) of frames with
    as many more on each side, and the map of the positions that have a frame;
    see halo.map_blocks. The depth must do for all the functions together.
    """
    if depth:

        def in_turn(block: np.ndarray, there: np.ndarray) -> np.ndarray:
            for g in functions:
                block = g(block, there)
            return block

        return halo.map_blocks(frames, shape, in_turn, depth)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for f in rows["frame"]:
                a = np.asarray(f, float).reshape(shape)
                for g in functions:
                    a = g(a)
                out.append(a.ravel())
            yield rows.assign(frame=out)

    schema = ", ".join(f"`{n}` {'array<double>' if n == 'frame' else t}" for n, t in frames.dtypes)
    return frames.mapInPandas(run, schema)


def find_vectors(frames: DataFrame, shape: tuple[int, int], radius: float, method: str = "nxcorr", threshold: float | None = None, distance: float | None = None, ky: Axis | None = None, kx: Axis | None = None, beam_stop: np.ndarray | None = None, nav_sigma: float = 0.0) -> DataFrame:
    """Vectors of (y, x, frame): peaks in calibrated coordinates, strongest first at each position; ord has 21 bits each for y, x and the peak's place, and more is an error.

    nav_sigma: frames are blurred along the scan first, each with those around it.
    """
    if method not in DEFAULT_THRESHOLD:
        raise ValueError("method is nxcorr or dog")
    bar, apart = DEFAULT_THRESHOLD[method] if threshold is None else threshold, 2 * radius if distance is None else distance
    ay, ax = ky or Axis("ky", shape[0]), kx or Axis("kx", shape[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = []
            for y, x, f in rows[["y", "x", "frame"]].itertuples(index=False):
                p = kernels.find_peaks(np.asarray(f, float).reshape(shape), method, radius, bar, apart, beam_stop)
                n = len(p)
                parts.append(pd.DataFrame({"time": np.full(n, -1.0), "nav_y": y, "nav_x": x, "kx": ax.offset + ax.scale * p[:, 1], "ky": ay.offset + ay.scale * p[:, 0], "intensity": p[:, 2], "confidence": p[:, 3], "sigma": None, "ord": numbered(y, x, n), "disk_mean": p[:, 4]}))
            if parts:
                yield pd.concat(parts)

    return halo.nav_blur(frames.select("y", "x", "frame"), shape, nav_sigma).mapInPandas(run, VECTORS)


#: The share of the median sharpness below which a frame is kept out of a running reference, and the steps to a doubling in which sharpness is counted for that median.
CREDIBLE, STEPS = 0.25, 128


def numbered(y: int, x: int, n: int) -> np.ndarray:
    """Ordinals of a position's peaks in the order of positions."""
    if max(y, x, n - 1) >= 1 << 21 or min(y, x) < 0:
        raise ValueError("a position or its number of peaks is beyond 21 bits")
    return ((int(y) << 42) | (int(x) << 21)) + np.arange(n)


def binned_median(sharps: Counter) -> float:
    """The median of values counted by their rounded logarithms."""
    left = (sum(sharps.values()) - 1) // 2
    for k in sorted(sharps):
        left -= sharps[k]
        if left < 0:
            return 2.0 ** (k / STEPS)
    raise ValueError("there is no value")


def drift(frames: DataFrame, shape: tuple[int, int], reference: str | int = "first", upsample: int = 8, most: float = 32.0, least: float = 0.0, region: tuple[int, int, int, int] | None = None, reject: bool = True) -> DataFrame:
    """(t, dy, dx, sharpness) of a movie (t, frame): each frame's displacement, measured in a region (y0, x0, height, width) if one is given.

    With a fixed reference ("first", or a frame's t) every frame is solved on its
    own. "sequential" compares each frame with the one before and adds up: pairs
    are solved apart, and the sums run over one small row a frame. "running"
    compares with the mean of the frames aligned so far, and (with reject) keeps
    frames out of it whose sharpness is under a quarter of the median of those in
    it (to half a percent); frames are moved back in Fourier space. It is serial by nature: the frames stream
    in order through one task that holds one sum and a histogram, however long the movie. Steps under `least` count as none.
    Rows without t or frame give none with it.
    """
    schema = "t int, dy double, dx double, sharpness double"
    quiet = lambda v: 0.0 if abs(v) < least else v
    y0, x0, h, w = region or (0, 0, *shape)
    if y0 < 0 or x0 < 0 or min(h, w) < 2 or y0 + h > shape[0] or x0 + w > shape[1]:
        raise ValueError("the region isn't inside the frame")
    seen = lambda f: np.asarray(f, float).reshape(shape)[y0 : y0 + h, x0 : x0 + w]
    if reference == "sequential":
        # a row of two numbers a frame
        order = frames.select("t").withColumn("__before", F.lag("t").over(Window.partitionBy(F.lit(0)).orderBy("t")))
        pairs = frames.select("t", "frame").join(order, "t").join(frames.select(F.col("t").alias("__before"), F.col("frame").alias("__old")), "__before", "left").select("t", "frame", "__old")

        def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                got = [(0.0, 0.0, np.inf) if old is None else kernels.shift_between(seen(old), seen(f), upsample, most) for f, old in rows[["frame", "__old"]].itertuples(index=False)]
                yield pd.DataFrame({"t": rows["t"], "dy": [quiet(g[0]) for g in got], "dx": [quiet(g[1]) for g in got], "sharpness": [g[2] for g in got]})

        upto = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return pairs.mapInPandas(steps, schema).select("t", F.sum("dy").over(upto).alias("dy"), F.sum("dx").over(upto).alias("dx"), "sharpness")
    if reference == "running":
        fy, fx = np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, :]

        def serial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n, sharps = np.zeros((h, w), complex), 0, Counter()
            for rows in batches:
                out = []
                for t, f in rows.itertuples(index=False):
                    a = seen(f)
                    dy, dx, s = kernels.shift_between(np.fft.ifft2(total / n).real, a, upsample, most) if n else (0.0, 0.0, np.inf)
                    if not reject or not sharps or s >= CREDIBLE * binned_median(sharps):
                        total, n = total + np.fft.fft2(a) * np.exp(2j * np.pi * (fy * dy + fx * dx)), n + 1
                        if np.isfinite(s) and s > 0:
                            sharps[round(np.log2(s) * STEPS)] += 1
                    out.append((t, quiet(dy), quiet(dx), s))
                yield pd.DataFrame(out, columns=["t", "dy", "dx", "sharpness"])

        return frames.where("t IS NOT NULL AND frame IS NOT NULL").select("t", "frame").repartition(1).sortWithinPartitions("t").mapInPandas(serial, schema)
    first = frames.agg(F.min("t")).first()[0] if reference == "first" else int(reference)
    row = frames.where(F.col("t") == first).select("frame").first()
    if row is None:
        raise ValueError("there is no such reference frame")
    ref = seen(row[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [kernels.shift_between(ref, seen(f), upsample, most) for f in rows["frame"]]
            yield pd.DataFrame({"t": rows["t"], "dy": [quiet(g[0]) for g in got], "dx": [quiet(g[1]) for g in got], "sharpness": [g[2] for g in got]})

    return frames.select("t", "frame").mapInPandas(run, schema)


def corrected(frames: DataFrame, shifts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(t, frame) moved back by its drift; what comes from outside is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [kernels.shifted(np.asarray(f, float).reshape(shape), -dy, -dx).ravel() for f, dy, dx in rows[["frame", "dy", "dx"]].itertuples(index=False)]
            yield pd.DataFrame({"t": rows["t"], "frame": out})

    return frames.select("t", "frame").join(shifts.select("t", "dy", "dx"), "t").mapInPandas(run, "t int, frame array<double>")


def sharpness_gain(frames: DataFrame, shifts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(before, after): the variance of the mean frame without and with drift correction."""
    mean = lambda df: df.select(F.posexplode("frame").alias("i", "v")).where(~F.isnan("v")).groupBy("i").agg(F.avg("v").alias("m")).agg(F.var_pop("m").alias("v"))
    plain = frames.select("t", F.transform("frame", lambda v: v.cast("double")).alias("frame"))
    return mean(plain).select(F.col("v").alias("before")).crossJoin(mean(corrected(frames, shifts, shape)).select(F.col("v").alias("after")))


def lab_to_sample(points: DataFrame, shifts: DataFrame, back: bool = False) -> DataFrame:
    """(t, y, x) points with the drift of their frame taken off (or added)."""
    sign = 1 if back else -1
    s = shifts.select("t", "dy", "dx")
    return points.join(s, "t").withColumn("y", F.col("y") + sign * F.col("dy")).withColumn("x", F.col("x") + sign * F.col("dx")).drop("dy", "dx")


def static_background(frames: DataFrame) -> DataFrame:
    """Frames less the mean frame; the mean is one row, joined once."""
    mean = frames.select(F.posexplode("frame").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    whole = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("__m"))
    return frames.crossJoin(F.broadcast(whole)).withColumn("frame", F.zip_with("frame", "__m", lambda a, b: a - b)).drop("__m")


def dynamic_background(frames: DataFrame, shape: tuple[int, int], sigma: float) -> DataFrame:
    return map_frames(frames, shape, lambda a: a - kernels.gaussian_filter(a, sigma))


def preprocessed(frames: DataFrame, shape: tuple[int, int], sigma: float = 8.0) -> DataFrame:
    """log(1 + x), less its blur, over its robust deviation."""

    def standard(a: np.ndarray) -> np.ndarray:
        a = np.log1p(np.maximum(a, 0))
        a = a - kernels.gaussian_filter(a, sigma)
        mad = 1.4826 * np.median(np.abs(a - np.median(a)))
        return (a - np.median(a)) / (mad if mad > 0 else a.std() or 1.0)

    return map_frames(frames, shape, standard)


def line_profiles(frames: DataFrame, shape: tuple[int, int], start: tuple[float, float], end: tuple[float, float], width: int = 1) -> DataFrame:
    return map_frames(frames, shape, lambda a: kernels.line_profile(a, start, end, width))


def merged_peaks(proposals: DataFrame, tolerance: float, w_conf: float = 0.5, w_persist: float = 0.25, w_friedel: float = 0.25, keep: float = 0.5) -> DataFrame:
    """Proposals (…, confidence, persistence, friedel) whose weighted score reaches keep."""
    score = w_conf * F.col("confidence") + w_persist * F.col("persistence") + w_friedel * F.col("friedel").cast("double")
    return proposals.withColumn("score", score).where(F.col("score") >= keep)


def local_maxima(frames: DataFrame, shape: tuple[int, int], reach: int, threshold: float) -> DataFrame:
    """(y, x, py, px, value): pixels of at least the threshold that no pixel within reach exceeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for y, x, f in rows[["y", "x", "frame"]].itertuples(index=False):
                a = np.asarray(f, float).reshape(shape)
                at = kernels.local_maxima(a, reach, threshold)
                yield pd.DataFrame({"y": y, "x": x, "py": at[:, 0], "px": at[:, 1], "value": a[at[:, 0], at[:, 1]]})

    return frames.select("y", "x", "frame").mapInPandas(run, "y int, x int, py int, px int, value double")


def beam_stop(frames: DataFrame, shape: tuple[int, int], level: float = 0.15, grow: int = 2) -> DataFrame:
    """(py, px): pixels of the mean frame darker than level times its mean, grown; none if they are under 0.1 % or over 45 % of the detector."""
    h, w = shape
    mean = frames.select(F.posexplode("frame").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    # a row for each pixel of the detector
    bar = mean.agg((F.avg("m") * level).alias("bar"))
    dark = mean.crossJoin(F.broadcast(bar)).where(F.col("m") < F.col("bar")).select("i")
    share = dark.agg((F.count("*") / (h * w)).alias("share"))
    dark = dark.crossJoin(F.broadcast(share)).where(F.col("share").between(0.001, 0.45)).select(F.floor(F.col("i") / w).cast("int").alias("py"), (F.col("i") % w).cast("int").alias("px"))
    reach = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-grow, grow + 1) for b in range(-grow, grow + 1) if abs(a) + abs(b) <= grow])
    grown = dark.withColumn("o", F.explode(reach)).select((F.col("py") + F.col("o.a")).alias("py"), (F.col("px") + F.col("o.b")).alias("px"))
    return grown.where(F.col("py").between(0, h - 1) & F.col("px").between(0, w - 1)).distinct()


def judged(found: DataFrame, truth: DataFrame, tolerance: float, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """(n_found, n_true, n_hit): peaks (keys..., py, px) against the true ones; a true peak is hit if any found one of its frame lies within the tolerance."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    t = truth.select(*keys, F.col("py").alias("ty"), F.col("px").alias("tx"), F.explode(around).alias("s")).select(*keys, "ty", "tx", (cell("ty") + F.col("s.a")).alias("cy"), (cell("tx") + F.col("s.b")).alias("cx"))
    f = found.select(*keys, "py", "px", cell("py").alias("cy"), cell("px").alias("cx"))
    hit = t.join(f, [*keys, "cy", "cx"]).where(F.hypot(F.col("py") - F.col("ty"), F.col("px") - F.col("tx")) <= tolerance).select(*keys, "ty", "tx").distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(found, "n_found").crossJoin(count(truth, "n_true")).crossJoin(count(hit, "n_hit"))


def clusters(vectors: DataFrame, eps: float = 0.02, least: int = 5) -> DataFrame:
    """(kx, ky, n, cluster_kx, cluster_ky): density clusters of all vectors' (kx, ky), named after their least core; null for noise.

    Points are counted by value first. Cores and their links come from a cell
    join, and clusters are components of the linked cores: each takes the least
    name around it and then that name's own, so rounds grow with the logarithm of
    a cluster's width.
    """
    working_dir(vectors.sparkSession)
    p = vectors.groupBy("kx", "ky").agg(F.count("*").alias("n")).withColumn("id", F.struct("kx", "ky")).checkpoint()
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = p.select(F.col("id").alias("o"), F.col("n").alias("on"), F.col("kx").alias("ox"), F.col("ky").alias("oy"), F.explode(steps).alias("s"))
    other = other.select("o", "on", "ox", "oy", (F.floor(F.col("ox") / eps).cast("long") + F.col("s.a")).alias("cx"), (F.floor(F.col("oy") / eps).cast("long") + F.col("s.b")).alias("cy"))
    near = p.withColumn("cx", cell("kx")).withColumn("cy", cell("ky")).join(other, ["cx", "cy"]).where((F.col("kx") - F.col("ox")) ** 2 + (F.col("ky") - F.col("oy")) ** 2 <= eps * eps).select("id", "o", "on").checkpoint()
    core = near.groupBy("id").agg(F.sum("on").alias("m")).where(F.col("m") >= least).select("id").checkpoint()
    links = near.join(core, "id", "left_semi").select(F.col("id").alias("a"), F.col("o").alias("b")).checkpoint()
    label = core.select("id", F.col("id").alias("label"))
    while True:
        around = links.join(label, links["a"] == label["id"]).groupBy("b").agg(F.min("label").alias("label")).select(F.col("b").alias("id"), "label").join(core, "id", "left_semi")
        further = around.select(F.col("id").alias("via"), F.col("label").alias("l2"))
        new = around.join(further, around["label"] == further["via"]).select("id", F.least("label", "l2").alias("label")).checkpoint()
        if new.join(label.withColumnRenamed("label", "old"), "id").where(F.col("label") < F.col("old")).isEmpty():
            break
        label = new
    border = links.join(label, links["a"] == label["id"]).groupBy("b").agg(F.min("label").alias("label")).select(F.col("b").alias("id"), "label")
    return p.join(border, "id", "left").select("kx", "ky", "n", F.col("label.kx").alias("cluster_kx"), F.col("label.ky").alias("cluster_ky"))
