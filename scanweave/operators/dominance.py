"""Greedy rules in parallel rounds of local dominance.

A serial rule goes through items from the strongest down and takes each that no
item taken before rules out. The same items are taken by rounds: whoever is the
strongest among the undecided that it competes with settles at once, what it
rules out leaves, and the next round begins. Each round's state is written, so
no plan grows and a lost executor costs a round. The rounds are as many as the
longest chain of ever stronger rivals, a few in practice, and no group, however
large, is one task's work.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import working_dir


def _without(left: DataFrame, out: DataFrame, names: list[str]) -> DataFrame:
    """Rows of left whose names are in no row of out, null being equal to null."""
    gone = out.select(*[F.col(n).alias(f"__{n}") for n in names]).distinct()
    return left.join(gone.hint("merge"), reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]), "left_anti")


def best_pairs(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys..., a, b, distance) of each group matched one to one, best distance first; ties to the smaller a, then b. Of repeated candidates one is taken; an empty table gives an empty result.

    A pair settles if it is the best of both its ends: two aggregations a round,
    combined in each task before they are shuffled. Nothing is broadcast: keys are so
    small in a shuffle that a great many would pass through the driver.
    """
    working_dir(candidates.sparkSession)
    rest = [c for c in candidates.columns if c not in (*keys, "a", "b", "distance")]
    left, taken = candidates, []
    while True:
        best = lambda end, other: left.groupBy(*keys, end).agg(F.min(F.struct("distance", other, *rest)).alias("m"))
        one = best("a", "b").select(*keys, "a", "m.*")
        two = best("b", "a").select(*[F.col(k).alias(f"__{k}") for k in [*keys, "b"]], F.col("m.a").alias("__a"))
        both = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in [*keys, "a", "b"]])
        pairs = one.join(two.hint("merge"), both, "left_semi").select(*candidates.columns).checkpoint()
        if pairs.isEmpty():
            return reduce(DataFrame.union, taken, pairs)
        taken.append(pairs)
        for end in ("a", "b"):
            left = _without(left, pairs, [*keys, end])
        left = left.checkpoint()


def _near(points: DataFrame, others: DataFrame, keys: list[str], distance: float, strict: bool) -> DataFrame:
    """Pairs of others (each handed to the cells around its own) and points within the distance, columns o_... and p_...; cells are so small that few points share one."""
    reach = F.sequence(F.lit(-2), F.lit(2))
    spread = others.withColumn("__y", F.explode(reach)).withColumn("__x", F.explode(reach))
    spread = spread.withColumns({"cy": F.col("cy") + F.col("__y"), "cx": F.col("cx") + F.col("__x")}).drop("__y", "__x")
    p, o = points.select([F.col(c).alias(f"p_{c}") for c in points.columns]), spread.select([F.col(c).alias(f"o_{c}") for c in spread.columns])
    at = reduce(lambda a, b: a & b, [p[f"p_{n}"].eqNullSafe(o[f"o_{n}"]) for n in keys] + [p[f"p_{n}"] == o[f"o_{n}"] for n in ("cy", "cx")])
    d2 = (F.col("p_py") - F.col("o_py")) ** 2 + (F.col("p_px") - F.col("o_px")) ** 2
    return p.join(o, at).where((d2 < distance**2) if strict else (d2 <= distance**2))


def _ranked(peaks: DataFrame, distance: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """peaks with a number for each row, and (keys, row, py, px, rank, cy, cx) of those with a place, by strength: intensity, then ord, then row."""
    side = distance / sqrt(2) if distance > 0 else 1.0
    rows = peaks.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    placed = rows.where(F.col("py").isNotNull() & F.col("px").isNotNull() & ~F.isnan(F.col("py").cast("double")) & ~F.isnan(F.col("px").cast("double")))
    rank = F.struct(F.col("intensity").alias("s"), (-F.col("ord")).alias("o"), (-F.col("__row")).alias("r"))
    return rows, placed.select(*keys, F.col("__row").alias("row"), "py", "px", rank.alias("rank"), cell("py").alias("cy"), cell("px").alias("cx"))


def _settled(placed: DataFrame, keys: list[str], distance: float, strict: bool) -> DataFrame:
    """(row): the points that the greedy rule takes out."""
    left, gone = placed, []
    while True:
        # each small cell's strongest undecided point; a point meets at most 25 of them, however many share its cell
        top = left.groupBy(*keys, "cy", "cx").agg(F.max_by(F.struct("row", "py", "px", "rank"), "rank").alias("t")).select(*keys, "t.*", "cy", "cx").checkpoint()
        met = _near(left, top, keys, distance, strict).where(F.col("p_row") != F.col("o_row")).select("p_row", "o_row", (F.col("p_rank") > F.col("o_rank")).alias("stronger")).checkpoint()
        beaten = met.where("stronger").select(F.col("o_row").alias("row")).distinct()
        kept = top.join(beaten, "row", "left_anti").select("row").checkpoint()
        out = met.join(kept, met["o_row"] == kept["row"], "left_semi").select(F.col("p_row").alias("row")).distinct().checkpoint()
        gone.append(out)
        left = left.join(kept, "row", "left_anti").join(out, "row", "left_anti").checkpoint()
        if left.isEmpty():
            return reduce(DataFrame.union, gone)


def separated(peaks: DataFrame, distance: float, strict: bool = True, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Peaks (keys..., py, px, intensity, ord) of each frame at least the distance apart (strict: d < distance is too near, else d <= distance), the strongest first, ties to the smaller ord. Peaks without a place rule nothing out and stay."""
    working_dir(peaks.sparkSession)
    rows, placed = _ranked(peaks, distance, list(keys))
    out = _settled(placed, list(keys), distance, strict)
    return rows.join(out, rows["__row"] == out["row"], "left_anti").drop("__row")


def grouped(peaks: DataFrame, distance: float, keys: list[str]) -> DataFrame:
    """(keys..., py, px, own, head): the strongest free peak takes all free ones within the distance (at most), and so on down; own and head are structs of s, the intensity, and o, less the ord. Peaks without a place take part in no group."""
    working_dir(peaks.sparkSession)
    _, placed = _ranked(peaks, distance, keys)
    placed = placed.checkpoint()
    out = _settled(placed, keys, distance, strict=False)
    heads = placed.join(out, "row", "left_anti").checkpoint()
    # a peak belongs to the strongest head near it: that one took it first
    near = _near(placed, heads, keys, distance, strict=False)
    first = [F.first(f"p_{c}").alias(n) for c, n in [*((k, k) for k in keys), ("py", "py"), ("px", "px"), ("rank", "own")]]
    return near.groupBy("p_row").agg(*first, F.max("o_rank").alias("head")).drop("p_row")


def merged(peaks: DataFrame, distance: float, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """(keys..., py, px, intensity, ord, n): proposals of one spot as one. The strongest free proposal takes all free ones within the distance (at most), and so on down.

    A spot lies at the mean of its proposals weighted by their intensity (negative
    ones count 0; all alike if none is positive), has the intensity and ord of the
    strongest, and n proposals. Proposals without a place take part in none.
    """
    w = F.greatest(F.coalesce(F.col("own.s").cast("double"), F.lit(0.0)), F.lit(0.0))
    total = F.sum(w)
    mean = lambda c: F.when(total > 0, F.sum(w * F.col(c)) / total).otherwise(F.avg(c))
    spots = grouped(peaks, distance, list(keys)).groupBy("head", *keys).agg(mean("py").alias("py"), mean("px").alias("px"), F.count("*").alias("n"))
    return spots.select(*keys, "py", "px", F.col("head.s").alias("intensity"), (-F.col("head.o")).alias("ord"), "n")
