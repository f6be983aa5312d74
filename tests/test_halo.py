"""Blocks of frames with a halo: the same result for any tile, blur before detection, gaps in the scan."""

import numpy as np
import pytest

from scanweave.operators import frames, halo

SHAPE = (6, 5)


def scan(spark, gaps=()):
    rng = np.random.default_rng(4)
    a = rng.random((7, 9, *SHAPE))
    rows = [(y, x, a[y, x].ravel().tolist(), f"{y}-{x}") for y in range(7) for x in range(9) if (y, x) not in gaps]
    return a, spark.createDataFrame([*rows, (3, 3, None, "none")] if (3, 3) in gaps else rows, "y int, x int, frame array<double>, tag string").repartition(3)


def slow_blur(a, there, sigma):
    r = int(np.ceil(3 * sigma))
    out = np.zeros_like(a)
    for y, x in np.argwhere(there):
        total = 0.0
        for v, u in np.argwhere(there):
            if abs(v - y) <= r and abs(u - x) <= r:
                w = np.exp(-0.5 * ((v - y) ** 2 + (u - x) ** 2) / sigma**2)
                out[y, x] += w * a[v, u]
                total += w
        out[y, x] /= total
    return out


@pytest.mark.parametrize("tile", [1, 4, 16])
def test_blur_with_gaps(spark, tile):
    gaps = {(0, 0), (3, 3), (3, 4), (6, 8)}
    a, df = scan(spark, gaps)
    there = np.array([[(y, x) not in gaps for x in range(9)] for y in range(7)])
    want = slow_blur(a, there, 0.8)
    got = halo.nav_blur(df, SHAPE, 0.8, tile).collect()
    assert len(got) == there.sum() and all(r.tag == f"{r.y}-{r.x}" for r in got)
    for r in got:
        np.testing.assert_allclose(np.reshape(r.frame, SHAPE), want[r.y, r.x], atol=1e-12)
    assert halo.nav_blur(df.where("false"), SHAPE, 0.8, tile).collect() == []
    assert halo.nav_blur(df, SHAPE, 0.0).schema == df.schema


def test_detection_in_noise(spark):
    """A disk too faint for one frame is found where its neighbours' frames are taken in."""
    rng = np.random.default_rng(1)
    yy, xx = np.mgrid[:32, :32]
    disk = ((yy - 20) ** 2 + (xx - 11) ** 2 <= 9).astype(float)
    rows = [(y, x, (0.6 * disk + rng.normal(0, 1.0, (32, 32))).ravel().tolist()) for y in range(6) for x in range(6)]
    df = spark.createDataFrame(rows, "y int, x int, frame array<double>")
    near = lambda out: sum(abs(r.ky - 20) <= 2 and abs(r.kx - 11) <= 2 for r in out.collect())
    plain, blurred = (near(frames.find_vectors(df, (32, 32), 3.0, threshold=0.6, nav_sigma=s)) for s in (0.0, 1.5))
    assert blurred >= 30 and plain <= blurred / 2, (blurred, plain)
