"""Operators on images, movies and files against planted truth and brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.functions import kernels
from scanweave.operators import frames, multiangle, refine
from scanweave.plans import image_queries

SF = "/root/testdata/sf0.001"
MOVES = {m: (m * 5 % 7, -(m * 3 % 5)) for m in range(5)}
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_structure_and_local_contrast():
    rng = np.random.default_rng(1)
    a = 50 + rng.normal(size=(40, 44))
    assert kernels.structure(3 * a) == pytest.approx(kernels.structure(a))
    assert kernels.structure(np.full((50, 50), 7.0)) == pytest.approx(0, abs=1e-12) and kernels.structure(np.zeros((9, 9))) == 0 and kernels.structure(np.full((9, 9), np.nan)) == 0
    p = np.pad(a, 12, mode="symmetric")
    for y, x in ((0, 0), (20, 11), (39, 43)):
        w = p[y : y + 25, x : x + 25]
        assert kernels.local_contrast(a)[y, x] == pytest.approx((a[y, x] - w.mean()) / w.std(), rel=1e-6)
    assert np.allclose(kernels.local_contrast(5 * a + 3), kernels.local_contrast(a))


@tables
def test_scores_overrule_a_default_that_fails(spark):
    shape = (image_queries.SIDE, image_queries.SIDE)
    images = image_queries.members(spark, SF).checkpoint()
    tried = multiangle.candidate_offsets(images, shape, 0, 8.0).checkpoint()
    default = {r.member: (r.oy, r.ox) for r in tried.where(F.col("setting") == multiangle.DEFAULT_SETTING).collect()}
    assert default != MOVES and tried.count() == 5 * len(multiangle.PREFILTERS) * len(multiangle.SOLVERS)
    # scores against a plain loop over the images
    frames = {r.member: np.array(r.frame).reshape(shape) for r in images.collect()}
    scores = {r.setting: r.score for r in multiangle.alignment_scores(images, tried, shape).collect()}
    for setting, score in scores.items():
        at = {r.member: (r.oy, r.ox) for r in tried.where(F.col("setting") == setting).collect()}
        oy, ox = zip(*at.values(), strict=True)
        y0, x0, y1, x1 = max(0, -min(oy)), max(0, -min(ox)), shape[0] - max(0, *oy), shape[1] - max(0, *ox)
        total = sum(frames[m][y0 + a : y1 + a, x0 + b : x1 + b] for m, (a, b) in at.items())
        assert score == pytest.approx(kernels.structure(total) / kernels.structure(sum(frames.values())), abs=2e-9)
    # a repeated member and one without a frame change nothing
    more = images.union(images.where("member = 2")).union(spark.createDataFrame([(9, None)], "member int, frame array<double>"))
    won = multiangle.scored_offsets(more, shape, 0, 8.0, 0.05).collect()
    assert {r.member: (r.oy, r.ox) for r in won} == MOVES and len(won) == 5 and all(r.decisive and r.score == max(scores.values()) for r in won)
    kept = multiangle.scored_offsets(images, shape, 0, 8.0, 0.5).collect()
    assert {r.member: (r.oy, r.ox) for r in kept} == default and not any(r.decisive for r in kept)


def test_scores_of_members_without_structure(spark):
    flat = spark.createDataFrame([(m, [2.0] * 64) for m in range(3)], "member int, frame array<double>")
    got = multiangle.scored_offsets(flat, (8, 8), 0, 3.0).collect()
    assert [(r.setting, r.score, r.decisive) for r in got] == [(multiangle.DEFAULT_SETTING, None, False)] * 3
    apart = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 9, 0)], "member int, setting int, oy int, ox int")
    assert not multiangle.alignment_scores(flat, apart, (8, 8)).collect()
    with pytest.raises(ValueError):
        multiangle.scored_offsets(flat, (8, 8), 7)


def two_bumps(points, shape, sigma=2.0, volumes=(800.0, 500.0)):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return sum(v / (2 * np.pi * sigma**2) * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * sigma**2)) for (y, x), v in zip(points, volumes, strict=True))


def test_pairs_are_fitted_jointly(spark):
    """Six pixels apart and two wide: the joint fit finds it for any tile, separate fits fall short."""
    shape, rng, image, planted = (90, 120), np.random.default_rng(3), np.zeros((90, 120)), {}
    for k in range(12):
        y, x, turn = 14 + 30 * (k // 4) + rng.uniform(-1, 1), 14 + 30 * (k % 4) + rng.uniform(-1, 1), rng.uniform(0, np.pi)
        step = 3 * np.array([np.sin(turn), np.cos(turn)])
        planted[k] = np.array([[y, x] - step, [y, x] + step])
        image += two_bumps(planted[k], shape)
    image += rng.normal(0, 0.01, shape)
    pixels = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(shape[0]) for x in range(shape[1])], "image int, y int, x int, value double").repartition(5)
    start = np.rint(np.concatenate(list(planted.values())))
    atoms = spark.createDataFrame([(0, i, float(y), float(x)) for i, (y, x) in enumerate(start)], "image int, id long, y double, x double")
    pairs = spark.createDataFrame([(0, 2 * k, 2 * k + 1) for k in planted] + [(0, 3, 999)], "image int, a long, b long")
    got = {tile: {r.a // 2: r for r in refine.refined_pairs(pixels, atoms, pairs, shape, 2.5, tile=tile).collect()} for tile in (16, 64)}
    alone = refine.gaussians_in_box(image, start, 4)[:, 1:3].reshape(-1, 2, 2)
    for k, truth in planted.items():
        r, other = got[16][k], got[64][k]
        assert r == other and len(got[16]) == 12
        assert np.allclose([[r.ay, r.ax], [r.by, r.bx]], truth, atol=0.02) and r.separation == pytest.approx(6.0, abs=0.03)
        assert r.a_A == pytest.approx(800, rel=0.01) and r.b_A == pytest.approx(500, rel=0.01) and r.a_sigma_x == pytest.approx(2, rel=0.01) and r.fitted
        assert np.hypot(*(alone[k][1] - alone[k][0])) < 5.8
    # pixels that are missing or null don't count, and a pair without any keeps its atoms where they were
    gap = pixels.where("y NOT BETWEEN 12 AND 13").withColumn("value", F.when(F.col("x") % 9 != 0, F.col("value")))
    for r in refine.refined_pairs(gap, atoms, pairs, shape).collect():
        assert r.separation == pytest.approx(6.0, abs=0.1) and r.fitted
    bare = refine.refined_pairs(pixels.where("y > 200"), atoms, pairs, shape).collect()
    assert len(bare) == 12 and all(not r.fitted and r.a_A is None and (r.ay, r.ax) == tuple(start[r.a]) for r in bare)
    assert not refine.refined_pairs(pixels, atoms, pairs.where("a < 0"), shape).collect()
    with pytest.raises(ValueError):
        refine.refined_pairs(pixels, atoms, pairs, (12, 120)).collect()


def test_running_reference_streams(spark):
    """The state passes from batch to batch, sub-pixel moves are found to a tenth, and a frame of noise stays out of the reference."""
    rng, n, side = np.random.default_rng(5), 60, 80
    wide = np.fft.fft2(kernels.gaussian_filter(rng.normal(size=(120, 120)), 1.5))
    fy, fx = np.fft.fftfreq(120)[:, None], np.fft.fftfreq(120)[None, :]
    moves = np.column_stack([np.sin(np.arange(n) / 7) * 3, np.arange(n) * -0.07])
    rows = [(t, np.fft.ifft2(wide * np.exp(-2j * np.pi * (fy * dy + fx * dx))).real[20:100, 20:100].ravel().tolist()) for t, (dy, dx) in enumerate(moves)]
    rows[30] = (30, rng.normal(size=side * side).tolist())
    movie = spark.createDataFrame(rows + [(None, rows[0][1]), (99, None)], "t int, frame array<double>").repartition(7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = {}
        for size in ("4", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got[size] = frames.drift(movie, (side, side), "running", most=8.0).orderBy("t").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got["4"] == got["1000"] and [r.t for r in got["4"]] == list(range(n))
    for r in got["4"]:
        assert r.t == 30 or (abs(r.dy - moves[r.t, 0]) <= 0.1 and abs(r.dx - moves[r.t, 1]) <= 0.1), r
    assert not frames.drift(movie.where("t < 0"), (side, side), "running").collect()


def test_binned_median():
    from collections import Counter

    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 500):
        v = np.exp(rng.normal(size=n))
        got = frames.binned_median(Counter(round(np.log2(x) * frames.STEPS) for x in v))
        assert got == pytest.approx(np.sort(v)[(n - 1) // 2], rel=0.005)
