"""Table functions from SQL against the operators that run the same kernels."""

import numpy as np

from scanweave.functions import tables
from scanweave.operators import frames


def test_lateral_joins(spark):
    rng = np.random.default_rng(3)
    yy, xx = np.mgrid[:24, :20]
    rows = [(y, x, (rng.random((24, 20)) + 5 * ((yy - 8 - y) ** 2 + (xx - 9 - x) ** 2 <= 9)).ravel().tolist()) for y in range(3) for x in range(2)]
    df = spark.createDataFrame([*rows, (9, 9, None)], "y int, x int, frame array<double>")
    whole = df.where("frame IS NOT NULL")
    tables.register(spark)
    df.createOrReplaceTempView("scan_frames")
    got = spark.sql("SELECT f.y, f.x, p.py, p.px, p.value FROM scan_frames f, LATERAL local_maxima(f.frame, 24, 20, 2, 0.9D) p")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frames.local_maxima(whole, (24, 20), 2, 0.9).collect()))
    found = spark.sql("SELECT f.y, f.x, p.* FROM scan_frames f, LATERAL find_vectors(f.frame, 24, 20, 3D, 'nxcorr', 0.5D) p").collect()
    want = frames.find_vectors(whole, (24, 20), 3.0, "nxcorr", 0.5).collect()
    assert len(found) == len(want) >= 6
    assert sorted((r.y, r.x, r.py, r.px, r.confidence) for r in found) == sorted((r.nav_y, r.nav_x, r.ky, r.kx, r.confidence) for r in want)
    assert {(r.y, r.x) for r in found if r["rank"] == 1 and abs(r.py - 8 - r.y) < 1 and abs(r.px - 9 - r.x) < 1} == {r[:2] for r in rows}
    # a line too short gives no row
    assert spark.sql("SELECT f.y, p.i FROM scan_frames f, LATERAL line_profile(f.frame, 24, 20, 1D, 1D, 1D, 1D, 1) p").collect() == []
