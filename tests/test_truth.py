"""Planted truth, boundaries, empty inputs and laws of the scan operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave import api
from scanweave.axes import Axis, chunk_edge, is_movie
from scanweave.functions import components, kernels, roi, units
from scanweave.functions.components import Component, Model
from scanweave.operators import fields, frames, matching, neighbourhood, ragged, shape, spectra, strain, virtual
from scanweave.operators.grid import nav_grid
from scanweave.plans import registry
from scanweave.plans.kernel_queries import planted_frames
from scanweave.sources import store, synthetic
from scanweave.streaming import events

V = "nav_y int, nav_x int, kx double, ky double, intensity double, ord long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], V)


def test_roi_boundaries(spark):
    v = vectors(spark, [(0, 0, 0.3, 0.4, 1.0), (0, 1, 0.6, 0.8, 1.0), (1, 0, 0.0, 0.0, 1.0)])
    take = lambda r: sorted(x.ord for x in v.where(r.predicate(F.col("kx"), F.col("ky"))).collect())
    assert take(roi.Disk(0, 0, 1.0)) == [0, 1, 2]
    assert take(roi.Disk(0, 0, 1.0, 0.5)) == [1]
    assert take(roi.PixelRing(0, 0, 1.0, 0.5)) == [0, 1]
    assert take(roi.Rectangle(0.6, 0.8, 0.0, 0.0)) == [0, 2]
    assert take(roi.Box(0, 0, 0.4)) == [0, 2]
    with pytest.raises(ValueError):
        roi.PixelRing(100, 100, 1).pixels(8, 8)
    assert roi.channel_ranges([True, True, False, True]) == [(0, 2), (3, 4)]


def test_maps_are_dense_without_vectors(spark):
    v, sizes = vectors(spark, []) if False else spark.createDataFrame([], V), {"nav_y": 2, "nav_x": 3}
    for name in ("sum", "count"):
        assert [r.value for r in ragged.reduce_map(v, sizes, "intensity", name).collect()] == [0] * 6
    for name in ("mean", "max", "median", "std"):
        assert [r.value for r in ragged.reduce_map(v, sizes, "intensity", name).collect()] == [None] * 6
    assert virtual.virtual_image(v, roi.Disk(0, 0, 1), sizes).agg(F.sum("value")).first()[0] == 0
    assert ragged.reduce_map(v, sizes, "intensity", "mean", fill=-1.0).agg(F.sum("value")).first()[0] == -6
    with pytest.raises(ValueError):
        ragged.reduce_map(v, sizes, "intensity", "mode")


def test_nan_counts_as_missing(spark):
    v = vectors(spark, [(0, 0, 0.0, 0.0, float("nan")), (0, 0, 0.0, 0.0, 2.0)])
    assert ragged.reduce_map(v, {"nav_y": 1, "nav_x": 1}, "intensity", "sum").first().value == 2.0


def test_outside_the_grid_is_an_error(spark):
    with pytest.raises(Exception, match="outside the grid"):
        ragged.finalize(vectors(spark, [(5, 0, 0.0, 0.0, 1.0)]), {"nav_y": 2, "nav_x": 2}).collect()


def test_axes(spark):
    a = Axis("x", 12, 0.5, 10.0)
    assert a.cropped(-3, 4) == Axis("x", 4, 0.5, 10.0) and a.bounds(20, 30) == (11, 12)
    assert a.rebinned(4).offset == 10.75 and a.rebinned(4).size == 3
    with pytest.raises(ValueError, match="axis x"):
        a.rebinned(5)
    assert chunk_edge(2, 1 << 20) == 8 and chunk_edge(2, 1 << 30) == 1
    assert is_movie([Axis("t", 5, units="s")], 10) and not is_movie([Axis("y", 5), Axis("x", 5)], 10)
    assert spark.range(1).select(a.nearest(F.lit(10.75))).first()[0] == 2
    assert shape.movie_box((1, 2, 99, 99), 10, 8) == (1, 2, 10, 8) and shape.movie_box(("a",), 10, 8) == (0, 0, 10, 8)


def test_strain_recovers_planted(spark):
    v, ref = synthetic.strained_vectors(spark)
    got = api.strain_map(v, ref, {"nav_y": 4, "nav_x": 5}, 0.2)
    for r in got.df.collect():
        assert r.exx == pytest.approx(0.02 * r.nav_x / 4, abs=1e-9) and abs(r.eyy) < 1e-9 and abs(r.exy) < 1e-9 and r.coverage == 1.0
    assert got.provenance["action"] == "strain_map"
    robust = strain.robust_strain_map(v, ref, 0.2, {"nav_y": 4, "nav_x": 5})
    assert max(abs(r.exx - 0.02 * r.nav_x / 4) for r in robust.collect()) < 1e-6


def test_fit_recovers_planted_and_polish_keeps(spark):
    s = synthetic.spectrum_image(spark)
    model = Model([Component.of("Gaussian", A=30.0, centre=25.0, sigma=4.0, bounds={"sigma": (0.1, 20)}), Component.of("Offset", offset=1.0)])
    axis = (0.0, 50.0 / 255)
    truth = {(r.y, r.x): (r.true_area, r.true_centre) for r in s.collect()}
    for got in (spectra.fit(s, model, axis), spectra.seeded_fit(s, model, axis, 4, 5, 2), spectra.polish(s, spectra.fit(s, model, axis), model, axis)):
        for r in got.collect():
            area, centre = truth[r.y, r.x]
            assert r.parameters[0] == pytest.approx(area, rel=1e-4) and r.parameters[1] == pytest.approx(centre, rel=1e-5) and r.parameters[3] == pytest.approx(5, rel=1e-4) and r.converged
    assert Model.from_dict(model.to_dict()).to_dict() == model.to_dict()
    assert spectra.convergence(spectra.fit(s, model, axis)).first().rate == 1.0


def test_relabel_orders_components(spark):
    rows = [(0, i, [1.0, float(10 + i % 3), 1.0, 2.0, float(30 - i % 3), 1.0] if i % 2 else [2.0, float(30 - i % 3), 1.0, 1.0, float(10 + i % 3), 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "y int, x int, parameters array<double>")
    assert all(r.parameters[1] < r.parameters[4] for r in spectra.relabel(df, [(0, 3), (3, 6)]).collect())


def test_components_match_expressions(spark):
    x = np.linspace(0.5, 9, 30)
    p = {"Gaussian": [3, 4, 1.5], "Lorentzian": [2, 5, 0.7], "PowerLaw": [5, 1, -1, 2], "Exponential": [2, 3], "Arctan": [1, 2, 3], "HeavisideStep": [2, 4], "Logistic": [3, 2, 1, 4], "Offset": [1.5]}
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for kind, v in p.items():
        want = components.KINDS[kind][1](x[None, :], *(np.array([[float(a)]]) for a in v))[0]
        got = [r[0] for r in df.select(components.column(kind, F.col("x"), [F.lit(float(a)) for a in v])).collect()]
        assert np.allclose(got, want, atol=1e-9), kind
    assert np.allclose(components.KINDS["Erf"][1](np.array([[0.0, 1e9]]), *(np.array([[float(a)]]) for a in (2, 0, 1))), [[0, 1]])


def test_find_vectors_on_planted_disks(spark):
    rows, truth = planted_frames()
    df = spark.createDataFrame(rows, "y int, x int, frame array<double>")
    for method, threshold in (("nxcorr", 0.5), ("dog", 4.0)):
        got = api.find_vectors(df, (48, 48), 3.0, method, threshold, 6.0).df.collect()
        assert len(got) == len(truth), method
        for y, x, cy, cx in truth:
            assert any(r.nav_y == y and abs(r.ky - cy) < 0.3 and abs(r.kx - cx) < 0.3 for r in got)
    with pytest.raises(NotImplementedError):
        api.find_vectors(df, (48, 48), 3.0, "neural")


def test_drift_recovers_planted(spark):
    m = synthetic.drifting_movie(spark, 8).cache()
    truth = {r.t: (r.true_dy, r.true_dx) for r in m.collect()}
    for reference in ("first", "running"):
        for r in frames.drift(m, (96, 112), reference).collect():
            assert r.dy == pytest.approx(truth[r.t][0], abs=0.1) and r.dx == pytest.approx(truth[r.t][1], abs=0.1)
    g = frames.sharpness_gain(m, frames.drift(m, (96, 112)), (96, 112)).first()
    assert g.after > g.before


def test_kernels():
    a = np.arange(30.0).reshape(5, 6)
    assert np.array_equal(kernels.shifted(a, 1, -2, 0)[1:, :-2], a[:-1, 2:])
    assert np.allclose(kernels.line_profile(a, (2, 0), (2, 5)), a[2]) and kernels.line_profile(a, (2, 0), (2, 0.5)) is None
    label = kernels.connected(np.array([[0, 0], [0, 0.1], [0.1, 0], [5, 5]]), 0.2, 3)
    assert label.tolist() == [0, 0, 0, -1]
    noisy = np.ones((20, 20)) + np.random.default_rng(0).normal(0, 0.1, (20, 20))
    assert kernels.total_variation(noisy, 0.2).std() < noisy.std() / 2
    stop = kernels.beam_stop(np.where(np.arange(100).reshape(10, 10) < 20, 0.0, 10.0))
    assert stop is not None and stop[:3].all() and kernels.beam_stop(np.ones((10, 10))) is None


def test_greedy_rules(spark):
    peaks = spark.createDataFrame([(0, 0, 0.0, 0.0, 5.0, 0), (0, 0, 0.0, 2.0, 4.0, 1), (0, 0, 0.0, 5.0, 3.0, 2)], "y int, x int, py double, px double, intensity double, ord long")
    assert sorted(r.ord for r in matching.min_separation(peaks, 2.0, strict=True).collect()) == [0, 1, 2]
    assert sorted(r.ord for r in matching.min_separation(peaks, 2.0, strict=False).collect()) == [0, 2]
    c = spark.createDataFrame([(0, 1, 2, 0.1), (0, 1, 3, 0.2), (0, 4, 2, 0.3), (0, 4, 3, 0.4)], "g int, a int, b int, distance double")
    assert sorted((r.a, r.b) for r in matching.greedy_one_to_one(c, ["g"]).collect()) == [(1, 2), (4, 3)]
    assert matching.shells([0.0, 0.4, 0.9, 1.3], 0.5) == [0, 0, 1, 1]
    assert [len(r) for r in matching.rings(np.array([1.0, 1.03, 2.0, 2.05, 3.0]))] == [2, 2, 1]
    assert matching.far_from_kept(np.array([[0, 0], [0.1, 0], [1, 1]]), 0.5).tolist() == [0, 2]


def test_field_laws(spark):
    bump = [(y, x, float(np.exp(-((y - 8) ** 2 + (x - 8) ** 2) / 12))) for y in range(17) for x in range(17)]
    v = np.array([b[2] for b in bump]).reshape(17, 17)
    gy, gx = np.gradient(v)
    rows = [(y, x, float(gx[y, x]), float(gy[y, x])) for y in range(17) for x in range(17)]
    f = spark.createDataFrame(rows, "y int, x int, fx double, fy double")
    turned = fields.rotate_field(f, -37.0)
    best = fields.rotation_estimate(turned).first()
    assert min(abs(best.angle - a) for a in (37.0, 217.0)) <= 0.5 and not best.flip
    plane = fields.plane_fit(f.withColumn("fx", 2 * F.col("x") - 3 * F.col("y") + 1), "fx").first()
    assert (plane.a, plane.b, plane.c) == pytest.approx((2, -3, 1))
    assert fields.plane_fit(f.where("y = 99"), "fx").first() == (0.0, 0.0, 0.0)
    assert fields.plane_fit(f.where("y = 0 AND x < 2").withColumn("fx", F.lit(4.0)), "fx").first().c == 4.0


def test_blur_keeps_constants_and_sums_to_one(spark):
    g = nav_grid(spark, y=6, x=7).withColumn("value", F.lit(3.0))
    assert all(abs(r.value - 3) < 1e-12 for r in neighbourhood.blur(g, 0.7, 6, 7).collect())
    h = neighbourhood.with_halo(nav_grid(spark, y=8, x=8), 1, 4)
    assert h.where("tile_y = 0 AND tile_x = 0").count() == 25 and h.where("NOT halo").count() == 64


def test_units():
    assert units.wavelength(200.0) == pytest.approx(0.02508, abs=1e-5) and units.wavelength(300.0) == pytest.approx(0.01969, abs=1e-5)
    assert units.parse_unit(" nm^-1 ") == "1/nm"
    with pytest.raises(ValueError):
        units.per_angstrom("px")
    with pytest.raises(ValueError):
        units.electric_field(0, 1, 1)


def test_store_round_trip(spark, tmp_path):
    v, axes = vectors(spark, [(0, 0, 0.1, 0.2, 1.0)]), {"nav_y": Axis("nav_y", 1, 2.0, 1.0, "nm")}
    store.save(v, f"{tmp_path}/v", axes, {"action": "test"})
    df, got, about = store.load(spark, f"{tmp_path}/v")
    assert got == axes and about == {"action": "test"} and df.collect() == v.collect()
    with pytest.raises(ValueError, match="can't read"):
        store.open_file(spark, "x.dm9")
    (tmp_path / "m.raw").write_bytes(np.arange(24, dtype="<u2").tobytes())
    got = store.open_file(spark, f"{tmp_path}/m.raw", height=2, width=3).orderBy("i").collect()
    assert [r.frame for r in got] == np.arange(24.0).reshape(4, 6).tolist()
    made = []
    for _ in range(2):
        store.summary(spark, f"{tmp_path}/m.raw", f"{tmp_path}/side", lambda: (made.append(1), spark.range(3))[1])
    assert len(made) == 1
    store.export(spark.createDataFrame([(1, [1.0])], "a int, b array<double>"), f"{tmp_path}/c")
    assert ragged.upgraded(v.select("nav_x", "nav_y", "kx", "ky", F.lit(-1).alias("time"), "intensity"), 1).first().sigma is None
    with pytest.raises(ValueError):
        ragged.upgraded(v, 99)


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(datetime(2024, 1, 1) + timedelta(seconds=3 * i % 97), i % 5, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, pixel int, value double")
    for k in range(4):  # rows come in any order
        df.where(F.col("value") % 4 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = events.planes(stream, 10.0, 3600.0).writeStream.format("memory").queryName("planes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: tuple(map(str, r))
    assert sorted(spark.table("planes").collect(), key=key) == sorted(events.planes(df, 10.0).collect(), key=key)
    events.append(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200
    seen = []
    events.progressive(stream, lambda b, i: seen.append(b.count()), f"{tmp_path}/cp2").awaitTermination()
    assert sum(seen) == 200 and len(seen) == 4
    assert events.exposure(0.1, 5, 20, 7) == 0.5 and events.exposure(0.1, None, 20, 7) == 0.02


def test_registry(spark):
    f = synthetic.disks(spark)
    got = registry.run("navigator", f).collect()
    assert sorted(r.value for r in got) == [29.0 * k for k in range(1, 21)]
    with pytest.raises(TypeError, match="no parameter"):
        registry.run("navigator", f, colour="red")
    with pytest.raises(TypeError, match="needs"):
        registry.run("find_vectors", f)
    with pytest.raises(ValueError, match="lies between"):
        registry.run("find_vectors", f, shape=(16, 16), radius=-1)
    assert "find_vectors" in registry.applicable("frames")
    assert registry.preview(f, {"y": 0, "x": 1}, top="array_max(frame)").first().top == 2.0
    for bad in ("java_method('a')", "(select 1)", "reflect(1)"):
        with pytest.raises(ValueError):
            registry.evaluate(f, c=bad)


def test_api_chain(spark):
    f = synthetic.disks(spark)
    image = api.virtual_image(f, (16, 16), 8, 8, 2.0, mean=True)
    assert sorted(r.value for r in image.df.collect()) == [float(k) for k in range(1, 21)]
    dpc = api.dpc_map(f, (16, 16), rotation=0.0).df
    assert dpc.count() == 20 and dpc.agg(F.max("magnitude")).first()[0] < 1e-9
    v = vectors(spark, [(y, x, 0.1 * x, 0.05 * y, 9.0) for y in range(4) for x in range(4)] + [(y, x, 0.1 * x + 1, 0.05 * y, 1.0) for y in range(4) for x in range(4)])
    sizes = {"nav_y": 4, "nav_x": 4}
    for plane in ("none", "whole_scan", "corners"):
        c = api.center_zero_beam(v, sizes, 0.45, plane, 0.25).df
        assert max(abs(r.kx) + abs(r.ky) for r in c.where("intensity = 9").collect()) < 1e-9
    assert api.vector_virtual_image(v, sizes, 0, 0, 0.05).df.where("value > 0").count() == 2
    with pytest.raises(NotImplementedError):
        api.orientation_map(f)
