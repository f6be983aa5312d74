"""Joins by distance: nearest within a radius, pairs, k nearest, greedy matches."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import working_dir
from .dominance import best_pairs, separated
from .grid import nav_grid

#: A reference side is sent to every executor only up to this many rows.
MOST_REFERENCES = 10_000


def zero_beam_filtered(reference: DataFrame) -> DataFrame:
    """Reference vectors (gx, gy) longer than a quarter of the median of the non-zero lengths."""
    mag = F.hypot("gx", "gy")
    # one number is broadcast
    bar = reference.agg((0.25 * F.percentile(F.when(mag > 0, mag), F.lit(0.5))).alias("__bar"))
    return reference.crossJoin(F.broadcast(bar)).where(mag > F.coalesce("__bar", F.lit(0.0))).drop("__bar")


def nearest_within(vectors: DataFrame, reference: DataFrame, tolerance: float, both_signs: bool = True) -> DataFrame:
    """vectors joined with (ref, gx, gy): the nearest reference vector (or its opposite) closer than the tolerance; others are left out.

    reference has ref, gx, gy. Both sides are dealt into cells as wide as the
    tolerance, the reference into the nine around its own, so the join is on
    equality and grows with neither side's square; Catalyst broadcasts the
    reference if it is small. The smaller ref wins among equals, then the sign +.
    """
    ref = reference.select("ref", "gx", "gy", F.lit(0).alias("neg"))
    if both_signs:
        ref = ref.union(reference.select("ref", -F.col("gx"), -F.col("gy"), F.lit(1)))
    cell = lambda c: F.floor(c / tolerance).cast("long")
    ref = ref.withColumn("__s", F.explode(_around())).select("ref", "gx", "gy", "neg", (cell(F.col("gx")) + F.col("__s.a")).alias("__cx"), (cell(F.col("gy")) + F.col("__s.b")).alias("__cy"))
    # a vector meets one row, its cell's, so the best is picked without a shuffle of candidates
    cells = ref.groupBy("__cx", "__cy").agg(F.collect_list(F.struct("ref", "neg", "gx", "gy")).alias("__r"))
    own = vectors.withColumn("__cx", cell(F.col("kx"))).withColumn("__cy", cell(F.col("ky")))
    far = lambda r: F.hypot(F.col("kx") - r["gx"], F.col("ky") - r["gy"])
    best = F.array_min(F.transform("__r", lambda r: F.struct(far(r).alias("distance"), r["ref"].alias("ref"), r["neg"].alias("neg"), r["gx"].alias("gx"), r["gy"].alias("gy"))))
    out = own.join(cells, ["__cx", "__cy"]).withColumn("__b", best).where(F.col("__b.distance") < tolerance)
    return out.select(*vectors.columns, *[F.col(f"__b.{c}").alias(c) for c in ("ref", "gx", "gy", "distance")])


def _around() -> Column:
    """The steps to a cell and its eight neighbours."""
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])


def one_per_reference(matched: DataFrame, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """At each position the nearest vector of each reference only."""
    rest = [c for c in matched.columns if c not in (*keys, "ref")]
    # combined in each task before the shuffle
    best = matched.groupBy(*keys, "ref").agg(F.min_by(F.struct(*rest), F.struct("distance", "ord")).alias("__b"))
    return best.select(*keys, "ref", "__b.*").select(*matched.columns)


def coverage(matched: DataFrame, n_reference: int, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    return matched.groupBy(*keys).agg((F.count_distinct("ref") / n_reference).alias("coverage"))


def nearest_family(values: DataFrame, families: list[float], tolerance: float, column: str = "magnitude") -> DataFrame:
    """values with family: the nearest magnitude, the first where two are as near, if its relative error is at most the tolerance; others are left out."""
    if len(families) > MOST_REFERENCES:
        raise ValueError("too many families for a literal list")
    m = F.col(column)
    near = F.array_min(F.transform(F.array(*map(F.lit, families)), lambda f: F.struct(F.abs(f - m).alias("d"), f.alias("f"))))
    return values.withColumn("__f", near).where(F.col("__f.d") <= tolerance * F.col("__f.f")).withColumn("family", F.col("__f.f")).drop("__f")


def friedel_pairs(vectors: DataFrame, tolerance: float, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """vectors with paired: whether the same position has another vector within the tolerance of its opposite.

    Equal vectors of a position are one point for the join, which keeps the least
    and the greatest ord of what it meets: a vector is paired unless that is itself.
    """
    cell = lambda c: F.floor(c / tolerance).cast("long")
    points = vectors.groupBy(*keys, "kx", "ky").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    other = points.select(*keys, (-F.col("kx")).alias("okx"), (-F.col("ky")).alias("oky"), "lo", "hi", F.explode(_around()).alias("s"))
    other = other.select(*keys, "okx", "oky", "lo", "hi", (cell(F.col("okx")) + F.col("s.a")).alias("cx"), (cell(F.col("oky")) + F.col("s.b")).alias("cy"))
    own = points.drop("lo", "hi").withColumn("cx", cell(F.col("kx"))).withColumn("cy", cell(F.col("ky")))
    near = own.join(other, [*keys, "cx", "cy"]).where(F.hypot(F.col("kx") - F.col("okx"), F.col("ky") - F.col("oky")) <= tolerance)
    met = near.groupBy(*keys, "kx", "ky").agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    paired = F.coalesce((F.col("__lo") != F.col("ord")) | (F.col("__hi") != F.col("ord")), F.lit(False))
    return vectors.join(met, [*keys, "kx", "ky"], "left").select(*vectors.columns, paired.alias("paired"))


def k_nearest(points: DataFrame, k: int, cell: float, keys: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
    """(id, rank, n_id, distance, nx, ny): the k nearest other points (id, x, y), nearest first, among those within a cell's width; ties to the smaller id.

    Points meet in cells; the searching points go to the nine around their own,
    `among` (by default all points) stay in theirs. Where a point finds fewer than
    k within the width, widen it; `k_nearest_all` does.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    other = (points if among is None else among).select(*keys, F.col("id").alias("n_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), at("x").alias("cx"), at("y").alias("cy"))
    own = points.select(*keys, "id", "x", "y", F.explode(_around()).alias("s")).select(*keys, "id", "x", "y", (at("x") + F.col("s.a")).alias("cx"), (at("y") + F.col("s.b")).alias("cy"))
    d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
    pairs = own.join(other.hint("merge"), [*keys, "cx", "cy"]).where(F.col("id") != F.col("n_id")).withColumn("distance", d).where(F.col("distance") <= cell)
    rank = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("distance", "n_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "id", "rank", "n_id", "distance", "nx", "ny")


def fitting_width(points: DataFrame, cell: float, most: float) -> float:
    """The cell's width, halved until points (x, y) share their cell with no more than `most` on average, themselves counted: then a join of cells grows with the points, not with their square."""
    at = lambda c, w: F.floor(F.col(c) / w).cast("long")
    while True:
        cells = points.groupBy(at("x", cell).alias("cx"), at("y", cell).alias("cy")).agg(F.count("*").cast("double").alias("n"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far"))
        n, far = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.max("far")).first()
        # cells narrower than what floating-point numbers tell apart part nothing more
        if n is None or n <= most or cell <= far * 2.0**-50:
            return cell
        cell /= 2.0 ** max(1, ceil(log2(n / most) / 2))


def _nearest_lists(places: DataFrame, among: DataFrame, want: int, cell: float) -> DataFrame:
    """(x, y, near): for places (x, y) the first `want` points among (id, x, y) by distance and id; places with fewer within the cell's width are left out."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    other = among.select(F.col("id").alias("n_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), at("x").alias("cx"), at("y").alias("cy"))
    own = places.select("x", "y", F.explode(_around()).alias("s")).select("x", "y", (at("x") + F.col("s.a")).alias("cx"), (at("y") + F.col("s.b")).alias("cy"))
    pairs = own.join(other.hint("merge"), ["cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))).where(F.col("distance") <= cell)
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("distance", "n_id"))
    first = pairs.withColumn("rank", rank).where(F.col("rank") <= want)
    return first.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("distance", "n_id", "nx", "ny"))).alias("near")).where(F.size("near") >= want)


def k_nearest_all(points: DataFrame, k: int, cell: float) -> DataFrame:
    """k_nearest of every point: those that found fewer than k search again with twice the width, until all have k or all others.

    Equal points search once, and the k + 1 smallest ids of a place stand for all
    of it, since no list can hold more of them besides the searching point. The
    first width is the cell's, or less where points lie so dense that a cell would
    hold many. Later rounds join only places that still search, and few of those
    can lie near each other; so the work grows with the points. Each round's result is written
    to the checkpoint folder. Joins are merges: a table of keys is so small on disk
    that Catalyst would send it to every executor through the driver. Points
    without an id or finite coordinates take no part.
    """
    working_dir(points.sparkSession)
    finite = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("id").isNotNull()).select("id", "x", "y")
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    among = finite.withColumn("place", place).where(F.col("place") <= k + 1).checkpoint()
    want = min(k + 1, among.count())
    if want < 2:
        return k_nearest(finite.where("false"), k, cell)
    cell = fitting_width(among, cell, 4 * (k + 1))
    todo, lists = among.where("place = 1").select("x", "y"), []
    while True:
        got = _nearest_lists(todo, among, want, cell).checkpoint()
        lists.append(got)
        todo = todo.join(got.select("x", "y").hint("merge"), ["x", "y"], "left_anti").checkpoint()
        if todo.isEmpty():
            break
        cell *= 2
    own = finite.join(reduce(DataFrame.union, lists).hint("merge"), ["x", "y"])
    near = F.slice(F.filter("near", lambda n: n["n_id"] != F.col("id")), 1, k)
    return own.select("id", F.posexplode(near).alias("rank", "n")).select("id", (F.col("rank") + 1).alias("rank"), "n.n_id", "n.distance", "n.nx", "n.ny")


def greedy_one_to_one(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys..., a, b, distance) of each group matched one to one, best distance first; ties to the smaller a, then b."""
    return best_pairs(candidates, keys)


def min_separation(peaks: DataFrame, distance: float, strict: bool = True, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Peaks (keys..., py, px, intensity, ord) of each frame at least the distance apart, the strongest first."""
    return separated(peaks, distance, strict, keys)


def far_from_kept(points: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the points, in row order, that are farther than the threshold from every earlier one kept."""
    keep: list[int] = []
    for i, p in enumerate(points):
        if not keep or (((points[keep] - p) ** 2).sum(axis=1) > threshold**2).all():
            keep.append(i)
    return np.array(keep, int)


def rings(magnitudes: np.ndarray, tolerance: float = 0.06) -> list[np.ndarray]:
    """Ascending magnitudes in clusters: a value joins while it is within the tolerance of the running mean of its cluster."""
    out: list[list[float]] = []
    for m in np.sort(magnitudes):
        if out and abs(m - np.mean(out[-1])) <= tolerance * np.mean(out[-1]):
            out[-1].append(m)
        else:
            out.append([m])
    return [np.array(c) for c in out]


def shells(tilts: list[float], tolerance: float) -> list[int]:
    """A shell number for each tilt: ascending, a shell holds what is within the tolerance of its first member."""
    number, anchor, out = -1, None, {}
    for i in sorted(range(len(tilts)), key=lambda i: (tilts[i], i)):
        if anchor is None or tilts[i] - anchor > tolerance:
            number, anchor = number + 1, tilts[i]
        out[i] = number
    return [out[i] for i in range(len(tilts))]


def interpolated(times: DataFrame, trace: DataFrame, ranges: int | None = None) -> DataFrame:
    """(t, value): a trace (t, value) at other times, linear between its points and constant beyond its ends.

    Times fall into ranges of about as many points of the trace each (by default
    as many as there are shuffle partitions, 64 at most). The last point before and the first one
    after a time come from its own range, or from what the ranges beside it hand
    on: one row a range.
    """
    points = trace.where(F.col("t").isNotNull() & F.col("value").isNotNull()).groupBy("t").agg(F.avg("value").alias("value"))
    n = ranges or min(64, int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set((points.agg(F.percentile_approx("t", [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else None) or []))
    at = sum(((F.col("t") >= e).cast("int") for e in edges), F.lit(0)).alias("r")
    asked = times.select("t").distinct()
    marks = points.select("t", F.struct("t", "value").alias("p"), at).union(asked.select("t", F.lit(None).cast("struct<t:double,value:double>"), at))
    before = Window.partitionBy("r").orderBy("t", F.col("p").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("r").orderBy("t", F.col("p").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = marks.withColumn("b", F.last("p", ignorenulls=True).over(before)).withColumn("a", F.first("p", ignorenulls=True).over(after)).where("p IS NULL")
    # a row for each range
    ends = nav_grid(times.sparkSession, r=len(edges) + 1).join(points.withColumn("r", at).groupBy("r").agg(F.min(F.struct("t", "value")).alias("first"), F.max(F.struct("t", "value")).alias("last")), "r", "left")
    line = Window.partitionBy(F.lit(0)).orderBy("r")
    ends = ends.select("r", F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("b0"), F.first("first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("a0"))
    rows = rows.join(ends, "r").select("t", F.coalesce("b", "b0").alias("p"), F.coalesce("a", "a0").alias("n"))
    slope = F.when(F.col("n.t") > F.col("p.t"), F.col("p.value") + (F.col("n.value") - F.col("p.value")) * (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t")))
    found = rows.select("t", F.coalesce(slope, F.col("p.value"), F.col("n.value")).alias("value"))
    return times.select("t").join(found, "t")


def shift_vectors(vectors: DataFrame, shifts: DataFrame, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """Every vector less its position's shift (sx, sy); a position without one is left as it is."""
    s = shifts.select(*keys, F.col("sx").alias("__sx"), F.col("sy").alias("__sy"))
    out = vectors.join(s, list(keys), "left")
    return out.withColumn("kx", F.col("kx") - F.coalesce("__sx", F.lit(0.0))).withColumn("ky", F.col("ky") - F.coalesce("__sy", F.lit(0.0))).drop("__sx", "__sy")


def beam_contrast(vectors: DataFrame, box, radius: float, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """(value): the median over positions of the brightest vector in the box over the brightest farther than the radius from it; positions without either are skipped."""
    inside = vectors.where(box.predicate(F.col("kx"), F.col("ky")))
    top = inside.groupBy(*keys).agg(F.max_by(F.struct("kx", "ky", "intensity"), F.struct("intensity", -F.col("ord"))).alias("b"))
    far = F.hypot(F.col("kx") - F.col("b.kx"), F.col("ky") - F.col("b.ky")) > radius
    both = vectors.join(top, list(keys)).groupBy(*keys).agg(F.first("b.intensity").alias("inner"), F.max(F.when(far, F.col("intensity"))).alias("outer"))
    return both.where(F.col("outer").isNotNull()).agg(F.percentile(F.col("inner") / F.col("outer"), F.lit(0.5)).alias("value"))


def positions_with(vectors: DataFrame, least: int, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """The vectors of positions that have at least `least`."""
    enough = vectors.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*keys)
    return vectors.join(enough, list(keys), "left_semi")


def ring_histogram(vectors: DataFrame, bin_width: float, most: float) -> DataFrame:
    """(bin, n) of vector lengths from 0 to most; the last edge belongs to the last bin."""
    r, bins = F.hypot("kx", "ky"), int(np.ceil((most + bin_width) / bin_width - 1e-9)) - 1
    at = F.when(r == bins * bin_width, bins - 1).otherwise(F.floor(r / bin_width))
    return vectors.withColumn("bin", at.cast("int")).where(F.col("bin") < bins).groupBy("bin").agg(F.count("*").alias("n"))


def ring_peaks(histogram: DataFrame, prominence: float, n_rings: int, bins: int) -> DataFrame:
    """(bin, n): local maxima of at least prominence times the greatest count, the n_rings strongest, in order of radius. The histogram has a row a bin at most."""
    from .grid import grid_complete

    full = grid_complete(histogram, {"bin": bins}, ("n",))
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    left, right = F.coalesce(F.lag("n").over(w), F.lit(0)), F.coalesce(F.lead("n").over(w), F.lit(0))
    peaks = full.withColumn("l", left).withColumn("r", right).withColumn("top", F.max("n").over(Window.partitionBy(F.lit(0))))
    peaks = peaks.where((F.col("n") > F.col("l")) & (F.col("n") >= F.col("r")) & (F.col("n") >= prominence * F.col("top")))
    return peaks.select("bin", "n").orderBy(F.desc("n"), "bin").limit(n_rings).orderBy("bin")


def in_any_circle(points: DataFrame, circles: list[tuple[float, float, float]]) -> Column | None:
    """Whether (px, py) is in any circle (cx, cy, r), boundary included; None without circles."""
    if not circles:
        return None
    out = F.lit(False)
    for cx, cy, r in circles:
        out = out | ((F.col("px") - cx) ** 2 + (F.col("py") - cy) ** 2 <= r * r)
    return out
