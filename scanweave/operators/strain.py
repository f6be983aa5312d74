"""Strain from matched lattice vectors."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from .fields import solve3
from .grid import grid_complete
from .matching import nearest_within, one_per_reference

RESULT = ("exx", "eyy", "exy", "omega")


def decomposed(t00: Column, t01: Column, t10: Column, t11: Column) -> dict[str, Column]:
    """Strain and rotation of g_measured = T g_reference: the real-space gradient is T's inverse transpose, its right stretch less 1 the strain. Null where T is singular."""
    det = t00 * t11 - t01 * t10
    ok = F.abs(det) >= 1e-12
    f00, f01, f10, f11 = t11 / det, -t10 / det, -t01 / det, t00 / det
    m00, m01, m11 = f00 * f00 + f10 * f10, f00 * f01 + f10 * f11, f01 * f01 + f11 * f11
    root = F.sqrt(F.greatest(F.lit(0.0), m00 * m11 - m01 * m01))
    trace = F.sqrt(F.greatest(F.lit(0.0), m00 + m11 + 2 * root))  # of the stretch
    u00, u01, u11 = (m00 + root) / trace, m01 / trace, (m11 + root) / trace
    # F U^-1 is the rotation
    r00, r10 = f00 * u11 - f01 * u01, f10 * u11 - f11 * u01
    return {"exx": F.when(ok, u00 - 1), "eyy": F.when(ok, u11 - 1), "exy": F.when(ok, u01), "omega": F.when(ok, F.atan2(r10, r00))}


def affine(matched: DataFrame, keys: tuple[str, ...] = ("nav_y", "nav_x"), weight: str | None = None) -> DataFrame:
    """(keys..., t00, t01, t10, t11, tx, ty, n_matched): the least-squares map from (gx, gy) to (kx, ky), by sums of moments in one aggregation."""
    w = F.col(weight) if weight else F.lit(1.0)
    gx, gy, kx, ky = (F.col(c) for c in ("gx", "gy", "kx", "ky"))
    terms = {"xx": gx * gx, "xy": gx * gy, "x": gx, "yy": gy * gy, "y": gy, "n": F.lit(1.0), "xu": gx * kx, "yu": gy * kx, "u": kx, "xv": gx * ky, "yv": gy * ky, "v": ky}
    got = matched.groupBy(*keys).agg(*[F.sum(w * t).alias(f"s_{n}") for n, t in terms.items()], F.count("*").alias("n_matched"))
    s = lambda *names: [F.col(f"s_{n}") for n in names]
    a = s("xx", "xy", "x", "yy", "y", "n")
    rows = solve3(a, s("xu", "yu", "u")) + solve3(a, s("xv", "yv", "v"))
    return got.select(*keys, *[c.alias(n) for c, n in zip(rows, ("t00", "t01", "tx", "t10", "t11", "ty"), strict=True)], "n_matched")


def aligned_matches(vectors: DataFrame, reference: DataFrame, tolerance: float, keys: tuple[str, ...] = ("nav_y", "nav_x")) -> DataFrame:
    """nearest_within for each position's better alignment, with a column raw.

    Raw takes vectors as they are; the other takes each position's vectors and
    the reference about their centroids, which a badly centred pattern needs and
    one with missing spots doesn't stand. A position keeps the alignment that
    matches more of its vectors, the centred one where both match as many; kx, ky
    and gx, gy are those of the alignment. A null component matches nothing.
    """
    middle = vectors.groupBy(*keys).agg(F.avg("kx").alias("__mx"), F.avg("ky").alias("__my"))
    about = vectors.join(middle, list(keys)).withColumns({"kx": F.col("kx") - F.col("__mx"), "ky": F.col("ky") - F.col("__my")}).drop("__mx", "__my").select(vectors.columns)
    # one row
    means = reference.agg(F.avg("gx").alias("__gx"), F.avg("gy").alias("__gy"))
    centred = reference.crossJoin(F.broadcast(means)).select("ref", (F.col("gx") - F.col("__gx")).alias("gx"), (F.col("gy") - F.col("__gy")).alias("gy"))
    both = nearest_within(vectors, reference, tolerance).withColumn("raw", F.lit(True)).unionByName(nearest_within(about, centred, tolerance).withColumn("raw", F.lit(False)))
    n_raw, n_centred = F.count_if("raw"), F.count_if(~F.col("raw"))
    choice = both.groupBy(*keys).agg((n_raw > n_centred).alias("raw"))
    return both.join(choice, [*keys, "raw"], "left_semi")


def _matches(vectors: DataFrame, reference: DataFrame, tolerance: float, keys: tuple[str, ...], alignment: str) -> DataFrame:
    if alignment not in ("raw", "best"):
        raise ValueError("alignment is raw or best")
    return one_per_reference(aligned_matches(vectors, reference, tolerance, keys) if alignment == "best" else nearest_within(vectors, reference, tolerance), keys)


def strain_map(vectors: DataFrame, reference: DataFrame, tolerance: float, sizes: dict[str, int], n_reference: int, weight: str | None = None, least: int = 3, alignment: str = "raw") -> DataFrame:
    """(positions..., exx, eyy, exy, omega, coverage, residual, n_matched), dense: null strain where fewer than `least` vectors match. alignment: raw, or best (see aligned_matches)."""
    keys = tuple(sizes)
    m = _matches(vectors, reference, tolerance, keys, alignment)
    # a match with -g is the opposite vector: gx, gy carry the sign already
    t = affine(m, keys, weight)
    r2 = (F.col("kx") - (F.col("t00") * F.col("gx") + F.col("t01") * F.col("gy") + F.col("tx"))) ** 2 + (F.col("ky") - (F.col("t10") * F.col("gx") + F.col("t11") * F.col("gy") + F.col("ty"))) ** 2
    rest = m.join(t, list(keys)).groupBy(*keys).agg(F.sqrt(F.avg(r2)).alias("residual"), (F.count_distinct("ref") / n_reference).alias("coverage"))
    ok = F.col("n_matched") >= least
    parts = {n: F.when(ok, c) for n, c in decomposed(*(F.col(c) for c in ("t00", "t01", "t10", "t11"))).items()}
    out = t.withColumns(parts).join(rest, list(keys)).select(*keys, *RESULT, "coverage", "residual", "n_matched")
    return grid_complete(out, sizes, ("coverage", "n_matched"))


def vector_weights(vectors: DataFrame, floor: float) -> DataFrame:
    """vectors with weight: confidence / (sigma^2 + floor^2); the median of the known ones where either is missing; null if none is known."""
    known = F.col("confidence").isNotNull() & (F.col("sigma") > 0)
    w = vectors.withColumn("weight", F.when(known, F.col("confidence") / (F.col("sigma") ** 2 + floor**2)))
    mid = w.agg(F.percentile("weight", F.lit(0.5)).alias("__m"))
    return w.crossJoin(F.broadcast(mid)).withColumn("weight", F.coalesce("weight", "__m")).drop("__m")


def _median(values: Column) -> Column:
    """Of an array that isn't empty."""
    at = lambda v, i: F.get(v, i.cast("int"))
    return let(F.sort_array(values), lambda v: (at(v, F.floor((F.size(v) - 1) / 2)) + at(v, F.floor(F.size(v) / 2))) / 2)


def robust_affine(matches: Column, rounds: int = 10, cut: float = 4.685) -> Column:
    """struct<t00, t01, tx, t10, t11, ty> of an array of struct<kx, ky, gx, gy, w>: the map from (gx, gy) to (kx, ky) by reweighted least squares with Tukey's biweight; null fields under three matches.

    A round sums the moments under the present weights, solves them, and turns
    down what lies far by the residuals' median. Rounds end early, in effect, where the fit is
    exact or fewer than three weights would be left: the weights stay as they are.
    """
    names = ("xx", "xy", "x", "yy", "y", "n", "xu", "yu", "u", "xv", "yv", "v")

    def solved(w: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            m, wi = F.get(matches, i), F.get(w, i)
            gx, gy, kx, ky = (m[c] for c in ("gx", "gy", "kx", "ky"))
            terms = (gx * gx, gx * gy, gx, gy * gy, gy, F.lit(1.0), gx * kx, gy * kx, kx, gx * ky, gy * ky, ky)
            return F.struct(*[(s[n] + wi * t).alias(n) for n, t in zip(names, terms, strict=True)])

        def fields(s: Column) -> Column:
            a = [s[n] for n in names[:6]]
            rows = solve3(a, [s[n] for n in ("xu", "yu", "u")]) + solve3(a, [s[n] for n in ("xv", "yv", "v")])
            return F.struct(*[c.alias(n) for c, n in zip(rows, ("t00", "t01", "tx", "t10", "t11", "ty"), strict=True)])

        zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
        return let(F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, add), fields)

    def step(w: Column) -> Column:
        def reweighted(r: Column) -> Column:
            def next_weights(scale: Column) -> Column:
                ratio = lambda x: F.greatest(F.lit(0.0), 1 - (x / (cut * F.greatest(scale, F.lit(1e-12)))) ** 2)
                new = F.zip_with(matches, r, lambda m, x: m["w"] * ratio(x) ** 2)
                return let(new, lambda v: F.when((scale >= 1e-12) & (F.size(F.filter(v, lambda x: x > 0)) >= 3), v).otherwise(w))

            return let(1.4826 * _median(r), next_weights)

        far = lambda t: F.transform(matches, lambda m: F.hypot(m["kx"] - (t["t00"] * m["gx"] + t["t01"] * m["gy"] + t["tx"]), m["ky"] - (t["t10"] * m["gx"] + t["t11"] * m["gy"] + t["ty"])))
        return let(solved(w), lambda t: F.when(t["t00"].isNull(), w).otherwise(let(far(t), reweighted)))

    first = F.transform(matches, lambda m: m["w"])
    last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds - 1)), first, lambda w, _: step(w)) if rounds > 1 else first
    return F.when(F.size(matches) >= 3, let(last, solved))


def robust_strain_map(vectors: DataFrame, reference: DataFrame, tolerance: float, sizes: dict[str, int], weight: str | None = None, alignment: str = "raw") -> DataFrame:
    """strain_map's strains with outliers turned down: a position's matches, one a reference vector, are an array, and the rounds of reweighting one expression over it."""
    keys = tuple(sizes)
    m = _matches(vectors, reference, tolerance, keys, alignment)
    lists = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kx", "ky", "gx", "gy", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")))).alias("m"))
    parts = lambda t: F.struct(*[c.alias(n) for n, c in decomposed(*(t[c] for c in ("t00", "t01", "t10", "t11"))).items()])
    return grid_complete(lists.select(*keys, let(robust_affine(F.col("m")), parts).alias("d")).select(*keys, "d.*"), sizes)


def rotate_tensor(df: DataFrame, degrees: float, flip: bool = False) -> DataFrame:
    """The strain in a turned basis (x and y swapped first if flip, which reverses the rotation's sense)."""
    xx, yy, xy = (F.col("eyy"), F.col("exx"), F.col("exy")) if flip else (F.col("exx"), F.col("eyy"), F.col("exy"))
    c, s = cos(radians(degrees)), sin(radians(degrees))
    new = {"exx": c * c * xx - 2 * c * s * xy + s * s * yy, "eyy": s * s * xx + 2 * c * s * xy + c * c * yy, "exy": c * s * (xx - yy) + (c * c - s * s) * xy}
    return df.withColumns(new | ({"omega": -F.col("omega")} if flip else {}))


def principal(df: DataFrame) -> DataFrame:
    """With e1 >= e2, the principal strains, and theta, the direction of e1."""
    mid, diff = (F.col("exx") + F.col("eyy")) / 2, (F.col("exx") - F.col("eyy")) / 2
    r = F.sqrt(diff * diff + F.col("exy") * F.col("exy"))
    return df.withColumns({"e1": mid + r, "e2": mid - r, "theta": F.atan2(2 * F.col("exy"), F.col("exx") - F.col("eyy")) / 2})


def strain_of_pairs(pairs: DataFrame, keys: tuple[str, ...], least: int = 4) -> DataFrame:
    """(keys..., a00.., well): the linear map from simulated (sx, sy) to measured (qx, qy) vectors by weight w; well: the smaller eigenvalue of the simulated vectors' moments is over a twentieth of the larger."""
    w, sx, sy, qx, qy = (F.col(c) for c in ("w", "sx", "sy", "qx", "qy"))
    terms = {"xx": sx * sx, "xy": sx * sy, "yy": sy * sy, "ux": qx * sx, "uy": qx * sy, "vx": qy * sx, "vy": qy * sy}
    m = pairs.groupBy(*keys).agg(*[F.sum(w * t).alias(n) for n, t in terms.items()], F.count("*").alias("n"))
    xx, xy, yy = F.col("xx"), F.col("xy"), F.col("yy")
    det = xx * yy - xy * xy
    ok = (F.col("n") >= least) & (F.abs(det) > 1e-12)
    half, r = (xx + yy) / 2, F.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    of = lambda u, v, k: F.when(ok, (F.col(u) * yy - F.col(v) * xy) / det if k == 0 else (F.col(v) * xx - F.col(u) * xy) / det)
    return m.select(*keys, of("ux", "uy", 0).alias("a00"), of("ux", "uy", 1).alias("a01"), of("vx", "vy", 0).alias("a10"), of("vx", "vy", 1).alias("a11"), (half - r > 0.05 * (half + r)).alias("well"), "n")
