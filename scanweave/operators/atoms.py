"""Atom columns: properties, neighbours, dumbbells."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import working_dir
from .matching import fitting_width, greedy_one_to_one, k_nearest_all


def shape_properties(atoms: DataFrame) -> DataFrame:
    """With ellipticity (larger over smaller width, null for none) and angle (0 if at least as wide in x, else pi / 2)."""
    sx, sy = F.abs("sigma_x"), F.abs("sigma_y")
    small = F.least(sx, sy)
    return atoms.withColumn("ellipticity", F.when(small > 0, F.greatest(sx, sy) / small)).withColumn("angle", F.when(sx >= sy, 0.0).otherwise(pi / 2))


def neighbour_distance(atoms: DataFrame, k: int, cell: float) -> DataFrame:
    """(id, distance): the mean distance to the k nearest."""
    return k_nearest_all(atoms.select("id", "x", "y"), k, cell).groupBy("id").agg(F.avg("distance").alias("distance"))


def displacement(atoms: DataFrame, k: int, cell: float) -> DataFrame:
    """(id, dx, dy): an atom's offset from the centroid of its k nearest."""
    near = k_nearest_all(atoms.select("id", "x", "y"), k, cell).groupBy("id").agg(F.avg("nx").alias("mx"), F.avg("ny").alias("my"))
    return atoms.select("id", "x", "y").join(near.hint("merge"), "id").select("id", (F.col("x") - F.col("mx")).alias("dx"), (F.col("y") - F.col("my")).alias("dy"))


def dumbbell_vector(atoms: DataFrame, cell: float, most: float | None = None) -> DataFrame:
    """(vx, vy): the median step to the nearest neighbour, folded into one half-plane."""
    near = k_nearest_all(atoms.select("id", "x", "y"), 1, cell)
    d = atoms.select("id", "x", "y").join(near.hint("merge"), "id").select((F.col("nx") - F.col("x")).alias("dx"), (F.col("ny") - F.col("y")).alias("dy"), "distance")
    if most is not None:
        d = d.where(F.col("distance") <= most)
    turn = F.when((F.col("dx") < 0) | ((F.col("dx") == 0) & (F.col("dy") < 0)), -1).otherwise(1)
    return d.agg(F.percentile(F.col("dx") * turn, F.lit(0.5)).alias("vx"), F.percentile(F.col("dy") * turn, F.lit(0.5)).alias("vy"))


def _steps_apart(a: DataFrame, b: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """(keys..., a, b, distance): pairs of a (keys..., a, ex, ey) and b (keys..., b, x, y) within reach."""
    cell = lambda c: F.floor(c / reach).cast("long")
    steps = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    own = a.withColumn("s", F.explode(steps)).select(*a.columns, (cell(F.col("ex")) + F.col("s.a")).alias("cx"), (cell(F.col("ey")) + F.col("s.b")).alias("cy"))
    other = b.select(*b.columns, cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    d = F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"))
    return own.join(other.hint("merge"), [*keys, "cx", "cy"]).where(F.col("a") != F.col("b")).select(*keys, "a", "b", d.alias("distance")).where(F.col("distance") <= reach)


def dumbbell_pairs(atoms: DataFrame, vx: float, vy: float, tolerance: float) -> DataFrame:
    """(a, b, distance): atoms one vector apart within tolerance times its length, one to one, best first.

    Pairs exactly one vector apart come first: atoms of a place are paired with those of
    its opposite in order of their ids, which needs no list of candidates. The rest
    are candidates of a cell join, and are matched in rounds of local
    dominance; where atoms lie dense, within a small reach first, which is doubled for those that are left.
    Without a column `image` all atoms are of one image.
    """
    working_dir(atoms.sparkSession)
    most = tolerance * (vx * vx + vy * vy) ** 0.5
    if "image" not in atoms.columns:
        return dumbbell_pairs(atoms.withColumn("image", F.lit(0)), vx, vy, tolerance).drop("image")
    a = atoms.select("image", F.col("id").alias("a"), (F.col("x") + vx).alias("ex"), (F.col("y") + vy).alias("ey")).where("a IS NOT NULL")
    b = atoms.select("image", F.col("id").alias("b"), "x", "y").where("b IS NOT NULL")
    taken = []
    if vx or vy:
        turn = lambda *c: F.row_number().over(Window.partitionBy("image", *c[:2]).orderBy(c[2])).alias("turn")
        same = ["image", "ex", "ey", "turn"]
        taken.append(a.select("*", turn("ex", "ey", "a")).join(b.select("image", "b", F.col("x").alias("ex"), F.col("y").alias("ey"), turn("x", "y", "b")).hint("merge"), same).select("image", "a", "b", F.lit(0.0).alias("distance")).checkpoint())
    reach = None
    while True:
        if taken:
            a = a.join(taken[-1].select("image", "a").hint("merge"), ["image", "a"], "left_anti").checkpoint()
            b = b.join(taken[-1].select("image", "b").hint("merge"), ["image", "b"], "left_anti").checkpoint()
        reach = min(most, 2 * reach if reach else fitting_width(b.select("image", "x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct(), most, 16))
        taken.append(greedy_one_to_one(_steps_apart(a, b, ["image"], reach).checkpoint(), ["image"]))
        if reach >= most:
            return reduce(DataFrame.union, taken)


def unpaired(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    return atoms.join(ends, "id", "left_anti")


def dumbbell_properties(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, separation, angle, centre_x, centre_y, ratio); the angle lies within a half turn, the ratio is null where the first intensity isn't positive."""
    one = atoms.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("intensity").alias("ai"))
    two = atoms.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("intensity").alias("bi"))
    p = pairs.select("a", "b").join(one, "a").join(two, "b")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    angle = F.pmod(F.atan2(dy, dx) + pi / 2, F.lit(pi)) - pi / 2
    return p.select("a", "b", F.hypot(dx, dy).alias("separation"), angle.alias("angle"), ((F.col("ax") + F.col("bx")) / 2).alias("centre_x"), ((F.col("ay") + F.col("by")) / 2).alias("centre_y"), F.when(F.col("ai") > 0, F.col("bi") / F.col("ai")).alias("ratio"))


def to_map(atoms: DataFrame, value: str, ny: int, nx: int) -> DataFrame:
    """(y, x, value): atoms' values at their nearest pixels; those outside are dropped, the last id wins."""
    px, py = F.rint("x").cast("int"), F.rint("y").cast("int")
    rows = atoms.select(py.alias("y"), px.alias("x"), "id", F.col(value).alias("v")).where(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1))
    return rows.groupBy("y", "x").agg(F.max_by("v", "id").alias("value"))
