"""Scans of one area under several tilts: offsets to a reference member, shells, composites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.store import working_dir
from .matching import shells

#: What images are registered on, and how: every setting is tried in this order, and the last prefilter with the first solver is the default.
PREFILTERS = {"local contrast": kernels.local_contrast, "high pass": kernels.high_pass, "raw": lambda a: a}
SOLVERS = ({"tapered": True, "whitened": True}, {"tapered": False, "whitened": False}, {"tapered": True, "whitened": False}, {"tapered": False, "whitened": True})
DEFAULT_SETTING = (len(PREFILTERS) - 1) * len(SOLVERS)
#: How far, relative to the default's, a score must lie above it to overrule it.
DECISIVE = 0.1


def solve_offsets(images: DataFrame, shape: tuple[int, int], reference: int, most: float = 32.0) -> DataFrame:
    """(member, oy, ox, ry, rx): each member's displacement from the reference member, rounded to whole pixels, and what rounding left. images is (member, frame); members are solved apart."""
    row = images.where(F.col("member") == reference).select("frame").first()
    if row is None:
        raise ValueError("there is no such reference member")
    ref = np.asarray(row[0], float).reshape(shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = np.array([kernels.shift_between(ref, np.asarray(f, float).reshape(shape), most=most)[:2] for f in rows["frame"]]).reshape(-1, 2)
            whole = np.rint(got)
            yield pd.DataFrame({"member": rows["member"], "oy": whole[:, 0].astype(int), "ox": whole[:, 1].astype(int), "ry": got[:, 0] - whole[:, 0], "rx": got[:, 1] - whole[:, 1]})

    return images.select("member", "frame").mapInPandas(run, "member int, oy int, ox int, ry double, rx double")


def candidate_offsets(images: DataFrame, shape: tuple[int, int], reference: int, most: float = 32.0) -> DataFrame:
    """(member, setting, prefilter, tapered, whitened, oy, ox, ry, rx): each member's displacement as every setting finds it, in one pass over the images (member, frame)."""
    row = images.where(F.col("member") == reference).where("frame IS NOT NULL").select("frame").first()
    if row is None:
        raise ValueError("there is no such reference member")
    ref = np.asarray(row[0], float).reshape(shape)
    schema = "member int, setting int, prefilter string, tapered boolean, whitened boolean, oy int, ox int, ry double, rx double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = {n: f(ref) for n, f in PREFILTERS.items()}
        for rows in batches:
            out = []
            for member, frame in rows.itertuples(index=False):
                a = np.asarray(frame, float).reshape(shape)
                for i, (name, f) in enumerate(PREFILTERS.items()):
                    b = f(a)
                    for j, how in enumerate(SOLVERS):
                        got = (0.0, 0.0) if member == reference else kernels.shift_between(refs[name], b, most=most, **how)[:2]
                        whole = [int(np.rint(v)) for v in got]
                        out.append((member, i * len(SOLVERS) + j, name, how["tapered"], how["whitened"], *whole, got[0] - whole[0], got[1] - whole[1]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return images.where("frame IS NOT NULL AND member IS NOT NULL").select("member", "frame").mapInPandas(run, schema)


def alignment_scores(images: DataFrame, offsets: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(setting, score): the structure of the members' sum over the region they have in common, each at its offset (member, setting, oy, ox), over that of the sum without offsets.

    Sums are made a pixel a group, so no member is held with another; a summed
    image is a row. Scores are rounded to nine digits, so that equal offsets score alike. A setting whose members have no common region has no score, nor
    has any where the plain sum holds no structure.
    """
    h, w = shape
    members = images.where("frame IS NOT NULL AND member IS NOT NULL").select("member", "frame")
    plain = members.select("member", F.lit(-1).alias("setting"), F.lit(0).alias("oy"), F.lit(0).alias("ox"))
    at = offsets.select("member", "setting", "oy", "ox").unionByName(plain)
    zero = F.lit(0)
    region = at.groupBy("setting").agg(F.greatest(zero, F.max(-F.col("oy"))).alias("y0"), F.greatest(zero, F.max(-F.col("ox"))).alias("x0"), F.least(F.lit(h), F.min(h - F.col("oy"))).alias("y1"), F.least(F.lit(w), F.min(w - F.col("ox"))).alias("x1"))
    cut = at.join(region.where("y1 > y0 AND x1 > x0"), "setting").join(members, "member")
    line = F.slice("frame", (F.col("y") + F.col("oy")) * w + F.col("x0") + F.col("ox") + 1, F.col("x1") - F.col("x0"))
    lines = cut.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1))).select("setting", "y", line.alias("line"))
    summed = lines.select("setting", "y", F.posexplode("line").alias("x", "v")).groupBy("setting", "y", "x").agg(F.sum(F.col("v").cast("double")).alias("v"))
    whole = summed.groupBy("setting").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"), F.countDistinct("y").alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"setting": rows["setting"], "s": [kernels.structure(np.asarray(v, float).reshape(n, -1)) for v, n in rows[["v", "rows"]].itertuples(index=False)]})

    got = whole.select("setting", F.col("p.v").alias("v"), "rows").mapInPandas(run, "setting int, s double")
    base = got.where("setting = -1").select(F.col("s").alias("plain"))
    return got.where("setting >= 0").crossJoin(F.broadcast(base)).select("setting", F.when(F.col("plain") > 0, F.round(F.col("s") / F.col("plain"), 9)).alias("score"))


def scored_offsets(images: DataFrame, shape: tuple[int, int], reference: int, most: float = 32.0, margin: float = DECISIVE) -> DataFrame:
    """(member, oy, ox, ry, rx, setting, prefilter, tapered, whitened, score, decisive): the offsets of the setting whose sum is sharpest.

    Every setting (PREFILTERS x SOLVERS) is scored on the images as they are. The
    default (raw, tapered, whitened) is overruled only by a score beyond it by margin times its size
    (the first of equal ones), or by any where it has no score; where nothing has a
    score it stands, with a null one. A null frame is no member; of repeated members the
    least frame counts. The decision takes one row a setting. A missing reference is an error.
    """
    working_dir(images.sparkSession)
    members = images.where("frame IS NOT NULL AND member IS NOT NULL").groupBy("member").agg(F.min("frame").alias("frame")).checkpoint()
    offsets = candidate_offsets(members, shape, reference, most).checkpoint()
    scores = alignment_scores(members, offsets, shape).where("score IS NOT NULL").checkpoint()
    best = scores.agg(F.max(F.struct("score", -F.col("setting"))).alias("b"), F.max(F.when(F.col("setting") == DEFAULT_SETTING, F.col("score"))).alias("own"))
    wins = F.col("b").isNotNull() & (F.col("own").isNull() | (F.col("b.score") > F.col("own") + margin * F.abs("own")))
    one = best.select(F.when(wins, -F.col("b.col2")).otherwise(DEFAULT_SETTING).alias("setting"), F.when(wins, F.col("b.score")).otherwise(F.col("own")).alias("score"), wins.alias("decisive"))
    return offsets.join(F.broadcast(one), "setting").select("member", "oy", "ox", "ry", "rx", "setting", "prefilter", "tapered", "whitened", "score", "decisive")


def patch_votes(images: DataFrame, shape: tuple[int, int], reference: int, patch: int, stride: int, most: float = 8.0) -> DataFrame:
    """(member, oy, ox, agree_y, agree_x): offsets voted by overlapping patches, the median of each axis, and the share of patches within half a pixel of it."""
    row = images.where(F.col("member") == reference).select("frame").first()
    if row is None:
        raise ValueError("there is no such reference member")
    ref = np.asarray(row[0], float).reshape(shape)
    places = [(y, x) for y in range(0, shape[0] - patch + 1, stride) for x in range(0, shape[1] - patch + 1, stride)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for m, f in rows[["member", "frame"]].itertuples(index=False):
                a = np.asarray(f, float).reshape(shape)
                out += [(m, *kernels.shift_between(ref[y : y + patch, x : x + patch], a[y : y + patch, x : x + patch], most=most)[:2]) for y, x in places]
            yield pd.DataFrame(out, columns=["member", "dy", "dx"])

    votes = images.select("member", "frame").mapInPandas(run, "member int, dy double, dx double")
    mid = votes.groupBy("member").agg(F.percentile("dy", F.lit(0.5)).alias("oy"), F.percentile("dx", F.lit(0.5)).alias("ox"))
    near = lambda a, b: F.avg((F.abs(F.col(a) - F.col(b)) <= 0.5).cast("int"))
    return votes.join(mid, "member").groupBy("member", "oy", "ox").agg(near("dy", "oy").alias("agree_y"), near("dx", "ox").alias("agree_x"))


def with_shells(members: DataFrame, tolerance: float) -> DataFrame:
    """members (member, tilt, …) with shell: ascending tilts, a shell within the tolerance of its first one. A dataset has tens of members; they are numbered as one ordered group."""
    schema = ", ".join(f"`{n}` {t}" for n, t in members.dtypes) + ", shell int"
    return members.withColumn("g", F.col("tilt").isNull()).groupBy("g").applyInPandas(lambda rows: rows.drop(columns="g").assign(shell=shells(rows["tilt"].tolist(), tolerance)), schema)


def shell_radii(members: DataFrame) -> DataFrame:
    return members.groupBy("shell").agg(F.avg("tilt").alias("radius"), F.count("*").alias("n"))


def ring_positions(members: DataFrame) -> DataFrame:
    """With (x, y) of each member: x = tilt * sin(azimuth), y = tilt * cos(azimuth), azimuth in degrees."""
    a = F.radians("azimuth")
    return members.withColumn("x", F.col("tilt") * F.sin(a)).withColumn("y", F.col("tilt") * F.cos(a))


def nearest_member(members: DataFrame, x: float, y: float) -> DataFrame:
    """The member whose tilt lies nearest to a point, the first where several are as near."""
    d = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    return ring_positions(members).withColumn("d", d).orderBy("d", "member").limit(1).drop("d")
