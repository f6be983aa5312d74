"""Planted truth for the multi-angle, phase and refinement operators and the synthetic sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.functions.components import Component, Model
from scanweave.operators import multiangle, phases, refine, spectra
from scanweave.sources import store, synthetic


def test_member_offsets(spark):
    m = synthetic.tilt_members(spark)
    truth = {r.member: (r.true_oy, r.true_ox) for r in m.collect()}
    assert {r.member: (r.oy, r.ox) for r in multiangle.solve_offsets(m, (32, 36), 0, 6.0).collect()} == truth
    for r in multiangle.patch_votes(m, (32, 36), 0, 24, 4, 4.0).collect():
        assert abs(r.oy - truth[r.member][0]) < 1 and abs(r.ox - truth[r.member][1]) < 1 and 0 <= r.agree_y <= 1
    with pytest.raises(ValueError):
        multiangle.solve_offsets(m, (32, 36), 99)


def test_atoms_are_refined(spark):
    image, points = synthetic.atom_lattice(4, 5, ellipticity=1.4, displacement=0.6)
    rough = np.rint(points)
    rows = spark.createDataFrame([(0, i, float(y), float(x)) for i, (y, x) in enumerate(rough)], "image int, id long, y double, x double")
    frame = spark.createDataFrame([(0, image.ravel().tolist())], "image int, frame array<double>")
    got = sorted(refine.refined_atoms(frame, rows, image.shape, 6).collect(), key=lambda r: r.id)
    for r, (y, x) in zip(got, points, strict=True):
        assert r.x == pytest.approx(x, abs=0.05) and r.y == pytest.approx(y, abs=0.05)
        assert r.sigma_x == pytest.approx(3.5, rel=0.05) and r.sigma_y == pytest.approx(2.5, rel=0.05) and r.A == pytest.approx(2 * np.pi * 2.5 * 3.5, rel=0.08)
    com = refine.refined_atoms(frame, rows, image.shape, 6, gaussian=False).collect()
    assert all(r.A is None for r in com) and len(com) == len(points)


def test_friedel_centre():
    rng = np.random.default_rng(0)
    half = rng.normal(0, 20, (12, 2))
    pattern = np.concatenate([half, -half, rng.normal(0, 20, (3, 2))]) + [5.0, -3.0]
    assert refine.friedel_centre(pattern) == pytest.approx([5.0, -3.0], abs=0.05)


def test_decode():
    heat = np.zeros((8, 8))
    heat[2, 3], heat[2, 4], heat[6, 6] = 0.9, 0.5, 0.7
    off = np.full((2, 8, 8), 0.25)
    assert refine.decoded(heat, off, 0.4, 5).tolist() == [[2.25, 3.25, 0.9], [6.25, 6.25, 0.7]]
    assert len(refine.decoded(heat, off, 0.95, 5)) == 0


def test_rings_find_their_phase():
    fcc, bcc = [3**0.5, 2.0, 8**0.5, 11**0.5], [2**0.5, 2.0, 6**0.5, 8**0.5]
    best = phases.match_rings([r / 4.05 for r in fcc], {"fcc": fcc, "bcc": bcc})
    assert best[0][0] == "fcc" and best[0][1] == pytest.approx(4.05) and best[0][3] == 4


def test_synthetic_spectra(spark):
    e = synthetic.eels_image(spark, 2, 3, 256)
    assert e.count() == 6 and all(len(r.spectrum) == 256 for r in e.collect())
    line = Model([Component.of("PowerLaw", A=2e10, r=3.0, fixed=("left_cutoff", "origin"))])
    rest = spectra.remove_background(e, line, 4, 40, (200.0, 600 / 255)).collect()
    assert all(abs(np.mean(r.spectrum[5:35])) < 60 for r in rest)
    s = synthetic.eds_image(spark, 2, 3, 512).collect()
    assert all(np.argmax(np.array(r.spectrum)[150:200]) >= 0 and set(r.concentration) == {"Fe", "Ni", "Cu"} for r in s)


def test_cif(spark):
    text = "data_x\n_cell_length_a 4.0862\n_cell_length_b 4.0862\n_cell_length_c 4.2\n_chemical_formula_sum 'Ba O3 Ti'\n"
    df = spark.createDataFrame([(text,), ("",)], "t string").select(*[c.alias(n) for n, c in store.parse_cif(F.col("t")).items()]).collect()
    assert df[0].a == 4.0862 and df[0].elements == ["Ba", "O", "Ti"] and df[1].a is None and df[1].elements == []


def test_dense_has_a_slot_for_every_vector(spark):
    from scanweave.operators import ragged

    rows = [(0, 0, float(i), 0.0, 1.0, i) for i in range(9)] + [(1, 1, 0.5, 0.0, 2.0, 20)]
    v = spark.createDataFrame(rows, "nav_y int, nav_x int, kx double, ky double, intensity double, ord long")
    grid = {"nav_y": 2, "nav_x": 2}
    got = ragged.to_dense(v, grid).collect()
    assert len(got) == 4 * 9
    filled = sorted((r.nav_y, r.nav_x, r.slot, r.kx) for r in got if r.kx is not None)
    assert filled == [(0, 0, i, float(i)) for i in range(9)] + [(1, 1, 0, 0.5)]
    assert ragged.to_dense(v, grid, 5).count() == 4 * 5
    assert ragged.to_dense(v.where("false"), grid).collect() == []


def test_dumbbell_pairs_take_the_whole_table(spark, tmp_path):
    from scanweave.plans import model_queries

    spark.range(1, 901).select(F.col("id").alias("p_partkey"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    xy = {k: (k * 7919 % 1009, k * 104729 % 997) for k in range(1, 901)}
    reach = 0.05 * np.hypot(153.0, 44.0)
    near = sorted((np.hypot(xy[b][0] - xy[a][0] + 153, xy[b][1] - xy[a][1] - 44), a, b) for a in xy for b in xy if a != b)
    firsts, seconds, want = set(), set(), set()
    for dist, a, b in near:
        if dist <= reach and a not in firsts and b not in seconds:
            firsts.add(a)
            seconds.add(b)
            want.add((a, b))
    got = {(r.a, r.b) for r in model_queries.dumbbell_pairs(spark, str(tmp_path)).collect()}
    assert got == want and max(map(max, got)) > 300
