"""Vector fields on the scan: planes, references, rotation, units."""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import electric_field
from .neighbourhood import div_curl


def solve3(a: list[Column], b: list[Column]) -> list[Column]:
    """The symmetric 3 x 3 system a = (a00, a01, a02, a11, a12, a22), b, by Cramer's rule; null where it is singular."""
    a00, a01, a02, a11, a12, a22 = a

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    m = [[a00, a01, a02], [a01, a11, a12], [a02, a12, a22]]
    d = det(m)
    return [F.when(F.abs(d) > 1e-12, det([[b[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]) / d) for k in range(3)]


def plane_fit(df: DataFrame, value: str, where: Column | None = None, y: str = "y", x: str = "x", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., a, b, c): the least-squares plane a * x + b * y + c through the values that aren't missing.

    Under three points it is their mean, with none 0: nine sums, one pass.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.where(v.isNotNull() & (where if where is not None else F.lit(True)))
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    terms = {"n": F.lit(1.0), "sx": xx, "sy": yy, "sxx": xx * xx, "sxy": xx * yy, "syy": yy * yy, "sv": v, "sxv": xx * v, "syv": yy * v}
    sums = [F.coalesce(F.sum(t), F.lit(0.0)).alias(n) for n, t in terms.items()]
    got = rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)
    c = F.col
    a, b, k = solve3([c("sxx"), c("sxy"), c("sx"), c("syy"), c("sy"), c("n")], [c("sxv"), c("syv"), c("sv")])
    enough, mean = c("n") >= 3, F.when(c("n") > 0, c("sv") / c("n")).otherwise(0.0)
    return got.select(*keys, F.when(enough, F.coalesce(a, F.lit(0.0))).otherwise(0.0).alias("a"), F.when(enough, F.coalesce(b, F.lit(0.0))).otherwise(0.0).alias("b"), F.when(enough, F.coalesce(k, mean)).otherwise(mean).alias("c"))


def minus_plane(field: DataFrame, where: Column | None = None, columns: tuple[str, str] = ("fx", "fy")) -> DataFrame:
    """The field less the plane through each component (over where only, as for corners)."""
    out = field
    for name in columns:
        p = plane_fit(field, name, where).select(*[F.col(k).alias(f"__{k}") for k in "abc"])
        # one row: a broadcast of three numbers
        out = out.crossJoin(F.broadcast(p)).withColumn(name, F.col(name) - (F.col("__a") * F.col("x") + F.col("__b") * F.col("y") + F.col("__c"))).drop("__a", "__b", "__c")
    return out


def centring_report(field: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(component, mean, ramp, centred): each component's mean, and the plane's range over the whole field."""
    out = None
    for name in ("fx", "fy"):
        p = plane_fit(field, name)
        at = field.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(name).alias("v")).crossJoin(F.broadcast(p))
        height = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")
        row = at.agg(F.avg(F.nanvl("v", F.lit(None).cast("double"))).alias("mean"), (F.max(height) - F.min(height)).alias("ramp")).select(F.lit(name).alias("component"), "mean", "ramp", (F.abs("mean") <= tolerance).alias("centred"))
        out = row if out is None else out.union(row)
    return out


def rotated(fx: Column, fy: Column, degrees: float, flip: bool = False, reverse: bool = False) -> tuple[Column, Column]:
    """The vector, its components swapped if flip, then turned; reverse turns by 180 degrees more."""
    if flip:
        fx, fy = fy, fx
    t = radians(degrees + 180.0 * reverse)
    return fx * cos(t) - fy * sin(t), fx * sin(t) + fy * cos(t)


def rotate_field(field: DataFrame, degrees: float, flip: bool = False, reverse: bool = False) -> DataFrame:
    fx, fy = rotated(F.col("fx"), F.col("fy"), degrees, flip, reverse)
    return field.withColumns({"fx": fx, "fy": fy})


def rotation_estimate(field: DataFrame, mode: str = "electric", step: float = 0.5, dy: float = 1.0, dx: float = 1.0) -> DataFrame:
    """(angle, flip, score, baseline): the rotation that makes the curl (electric) or the divergence (magnetic) least.

    Turning the field mixes its divergence and curl, so the mean square at any
    angle follows from three moments: one pass over the field for each
    handedness, then a sweep over a sequence of angles.
    """
    if mode not in ("electric", "magnetic"):
        raise ValueError("mode is electric or magnetic")
    sweeps = None
    for flip in (False, True):
        f = field.select("y", "x", F.col("fy").alias("fx"), F.col("fx").alias("fy")) if flip else field
        m = div_curl(f, dy, dx).where("div IS NOT NULL AND curl IS NOT NULL").agg(F.avg(F.col("div") ** 2).alias("dd"), F.avg(F.col("div") * F.col("curl")).alias("dc"), F.avg(F.col("curl") ** 2).alias("cc"))
        sweep = m.select(F.lit(flip).alias("flip"), "dd", "dc", "cc", F.explode(F.sequence(F.lit(0), F.lit(int(360 / step) - 1))).alias("k"))
        sweeps = sweep if sweeps is None else sweeps.union(sweep)
    angle = F.col("k") * step
    s, c = F.sin(F.radians(angle)), F.cos(F.radians(angle))
    a, b = (s, c) if mode == "electric" else (c, -s)
    rms = F.sqrt(F.greatest(F.lit(0.0), a * a * F.col("dd") + 2 * a * b * F.col("dc") + b * b * F.col("cc")))
    curve = sweeps.select(angle.alias("angle"), "flip", rms.alias("score"))
    return curve.agg(F.min_by(F.struct("angle", "flip", "score"), F.struct(F.round("score", 12), "flip", "angle")).alias("b"), F.max(F.when(~F.col("flip") & (F.col("angle") == 0), F.col("score"))).alias("baseline")).select("b.angle", "b.flip", "b.score", "baseline")


def magnitude_phase(field: DataFrame) -> DataFrame:
    """With magnitude, and phase: atan2(fx, fy) less 30 degrees, from 0 to 2 pi."""
    return field.withColumn("magnitude", F.hypot("fx", "fy")).withColumn("phase", F.pmod(F.atan2("fx", "fy") - pi / 6, F.lit(2 * pi)))


def dpc_map(field: DataFrame, degrees: float = 0.0, flip: bool = False, corners: Column | None = None, mrad_per_px: float | None = None, thickness_nm: float | None = None, energy_kev: float | None = None) -> DataFrame:
    """Measured shifts, centred by a plane (over corners if given), turned, calibrated where all constants are known; with magnitude, phase, divergence and curl."""
    out = rotate_field(minus_plane(field.select("y", "x", "fx", "fy"), corners), degrees, flip)
    if mrad_per_px and thickness_nm and energy_kev:
        factor = electric_field(mrad_per_px, thickness_nm, energy_kev)
        out = out.withColumns({"fx": F.col("fx") * factor, "fy": F.col("fy") * factor})
    return magnitude_phase(out).join(div_curl(out), ["y", "x"])


def resample_plane(plane: DataFrame, grid: DataFrame, ky: float, kx: float) -> DataFrame:
    """A plane's values on another grid, whose index times (ky, kx) is the plane's own."""
    return grid.crossJoin(F.broadcast(plane)).select("y", "x", (F.col("a") * F.col("x") * kx + F.col("b") * F.col("y") * ky + F.col("c")).alias("value"))


def magnitude_ceiling(field: DataFrame, sigma: float = 4.0) -> DataFrame:
    """(ceiling): the magnitude at the rim of a colour wheel, sigma deviations over the mean but no more than the greatest; missing values count as 0, and null stands for no scale."""
    v = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)).otherwise(0.0)
    m = field.select(F.hypot(F.coalesce(v("fx"), F.lit(0.0)), F.coalesce(v("fy"), F.lit(0.0))).alias("m"))
    top = m.agg(F.least(F.max("m"), F.avg("m") + sigma * F.stddev_pop("m")).alias("c"))
    return top.select(F.when(F.col("c") > 0, F.col("c")).alias("ceiling"))
