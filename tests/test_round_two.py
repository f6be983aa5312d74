"""Operators against brute force or planted truth: gradients, smoothing, searches, drift, clusters, stores."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.functions import components, kernels, units
from scanweave.functions.components import Component, Model
from scanweave.operators import frames, grid, matching, neighbourhood, orientation, ragged, refine, spectra, strain
from scanweave.sources import store, synthetic


def test_gradients_are_those_of_the_curves():
    x = np.linspace(0.5, 9, 40)
    p = {"Gaussian": [3, 4, 1.5], "GaussianHF": [4, 2, 3], "Lorentzian": [2, 5, 0.7], "PowerLaw": [5, 0.1, -1, 2], "Exponential": [2, 3], "Arctan": [1, 2, 3], "Erf": [2, 4, 1.5], "HeavisideStep": [2, 4.05], "Logistic": [3, 2, 1, 4], "Offset": [1.5]}
    models = [(Component(k, [components.Parameter(n, float(v)) for n, v in zip(components.KINDS[k][0], vs, strict=True)]), vs) for k, vs in p.items()]
    models += [(Component.of("Polynomial", order=3), [1, -2, 0.5, 0.1]), (Component.edge("e", [np.sin(x).tolist(), np.cos(x).tolist()], (0.5, x[1] - x[0])), [2, 0.31, 0.4])]
    for c, v in models:
        v = np.array([v, [1.1 * a for a in v]], float)
        got = c.gradient(x, v)
        for k in range(v.shape[1]):
            if (c.kind, k) in (("PowerLaw", 1), ("HeavisideStep", 1)):
                assert not got[:, k].any()
                continue
            h = np.zeros_like(v)
            h[:, k] = 1e-6
            assert np.allclose(got[:, k], (c.curve(x, v + h) - c.curve(x, v - h)) / 2e-6, atol=0.2 if c.kind == "Edge" and k == 1 else 1e-5), (c.kind, k)


def test_fit_agrees_with_least_squares():
    """A Gaussian with a free width over an offset: no other parameters nearby fit better."""
    rng = np.random.default_rng(0)
    x = np.linspace(0, 50, 128)
    model = Model([Component.of("Gaussian", A=30.0, centre=25.0, sigma=4.0), Component.of("Offset", offset=1.0)])
    data = np.stack([5 + 40 / (3 * np.sqrt(2 * np.pi)) * np.exp(-((x - c) ** 2) / 18) for c in (22, 25, 28)]) + rng.normal(0, 0.1, (3, 128))
    p, ok, chi, _ = spectra.levenberg_marquardt(model, x, data)
    assert ok.all()
    for _ in range(200):
        q = p * (1 + rng.normal(0, 1e-3, p.shape))
        assert (((data - model.curve(x, q)) ** 2).sum(axis=1) >= chi - 1e-9).all()


def test_edges_are_fitted_and_seeds_are_near(spark):
    x = np.linspace(200, 800, 256)
    step = np.where(x >= 400, (x / 400) ** -2.5, 0.0)
    model = Model([Component.of("PowerLaw", A=1e10, r=2.8, fixed=("left_cutoff", "origin")), Component.edge("C", [step.tolist()], (200.0, x[1] - x[0]), fit_onset=False)])
    truth = np.array([2e10, 0, 0, 3.0, 300.0, 0.0])
    data = model.curve(x, np.tile(truth, (2, 1)))
    rows = spark.createDataFrame([(0, i, d.tolist()) for i, d in enumerate(data)], "y int, x int, spectrum array<double>")
    for s in spectra.power_law_seeds(rows, 4, 60, (200.0, x[1] - x[0])).collect():
        assert s.r == pytest.approx(3.0, abs=0.05) and s.A == pytest.approx(2e10, rel=0.3)
    got = spectra.fit(rows, model, (200.0, x[1] - x[0])).collect()
    assert all(r.parameters[4] == pytest.approx(300.0, rel=1e-3) and r.parameters[3] == pytest.approx(3.0, rel=1e-4) for r in got)
    assert Model.from_dict(model.to_dict()).to_dict() == model.to_dict()
    two = Model([Component.of("Gaussian", A=1.0, centre=5.0, sigma=1.0), Component.of("Gaussian", A=1.0, centre=5.0, sigma=1.0)]).spread(0.0, 9.0)
    assert [c.parameters[1].value for c in two.components] == [3.0, 6.0]
    g = Component.of("Gaussian", A=1.0, centre=99.0, sigma=2.0).clamped_to(0.0, 50.0).scaled_to(np.linspace(0, 50, 501), np.array([1.0, 8.0]))
    assert g.parameters[1].value == 50.0 and g.curve(np.array([50.0]), np.array([[p.value for p in g.parameters]]))[0, 0] == pytest.approx(4.0)


def points_of(n, seed=0, outlier=True):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 60, (n, 2)).astype(float)
    if outlier:
        p[0] = 5000, -3000
    return p


def test_k_nearest_by_brute_force(spark):
    p = points_of(80)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(999, float("nan"), 0.0), (998, None, 1.0)], "id long, x double, y double")
    got = {}
    for r in matching.k_nearest_all(df, 4, 3.0).collect():
        got.setdefault(r.id, []).append((r.rank, r.n_id))
    assert set(got) == set(range(80))
    for i in range(80):
        order = sorted((round(float(np.hypot(*(p[i] - p[j]))), 9), j) for j in range(80) if j != i)[:4]
        assert [n for _, n in sorted(got[i])] == [j for _, j in order]
    assert matching.k_nearest_all(df.where("id = 3"), 4, 3.0).collect() == []
    assert matching.k_nearest_all(df.where("id < 3"), 4, 3.0).count() == 6


def test_pairs_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), 0, float(round(a, 1)), float(round(b, 1)), 1.0, i) for i, (a, b) in enumerate(rng.uniform(-1, 1, (120, 2)))]
    v = spark.createDataFrame(rows, "nav_y int, nav_x int, kx double, ky double, intensity double, ord long")
    want = {r[5]: any(r[0] == o[0] and r[5] != o[5] and np.hypot(r[2] + o[2], r[3] + o[3]) <= 0.15 for o in rows) for r in rows}
    assert {r.ord: r.paired for r in matching.friedel_pairs(v, 0.15).collect()} == want
    ref = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1, 1, (30, 2)))]
    got = {r.ord: (r.ref, r.distance) for r in matching.nearest_within(v, spark.createDataFrame(ref, "ref int, gx double, gy double"), 0.3).collect()}
    best = {r[5]: min((float(np.hypot(r[2] - s * g, r[3] - s * h)), i) for i, g, h in ref for s in (1, -1)) for r in rows}
    assert got.keys() == {k for k, (d, _) in best.items() if d < 0.3}
    assert all(got[k][0] == best[k][1] and got[k][1] == pytest.approx(best[k][0]) for k in got)


def test_interpolation_by_brute_force(spark):
    rng = np.random.default_rng(2)
    t = np.unique(rng.uniform(0, 10, 50))
    v = rng.normal(size=len(t))
    asked = [*rng.uniform(-2, 12, 80), *t[:3], t[5], t[5]]
    for ranges in (1, 7, 64):
        got = matching.interpolated(spark.createDataFrame([(float(a),) for a in asked], "t double"), spark.createDataFrame(list(zip(t.tolist(), v.tolist(), strict=True)), "t double, value double"), ranges).collect()
        assert sorted(r.t for r in got) == sorted(asked)
        assert all(r.value == pytest.approx(float(np.interp(r.t, t, v))) for r in got)


def test_friedel_centres_by_brute_force(spark):
    rng = np.random.default_rng(4)
    half = rng.normal(0, 20, (12, 2))
    pattern = np.concatenate([half, -half, rng.normal(0, 20, (3, 2))]) + [5.0, -3.0]
    rows = [(0, 0, float(a), float(b)) for a, b in pattern for _ in range(2)] + [(1, 0, 3.0, 4.0)]
    got = {r.nav_y: (r.cx, r.cy) for r in refine.friedel_centres(spark.createDataFrame(rows, "nav_y int, nav_x int, kx double, ky double")).collect()}
    assert got[0] == pytest.approx((5.0, -3.0), abs=0.05) and got[1] == (3.0, 4.0)
    # nearest opposites, all pairs at once
    c = np.array([0.3, -0.2])
    d = ((pattern[None] + pattern[:, None] - 2 * c) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1)
    want = sorted((i, int(near[i])) for i in range(len(pattern)) if near[near[i]] == i and i < near[i] and d[i, near[i]] <= 100)
    assert sorted(map(tuple, refine.nearest_opposites(pattern, c, 10.0, rows=4).tolist())) == want
    # one to one, the nearest first
    used, greedy = set(), set()
    for k in np.argsort(d.ravel(), kind="stable"):
        i, j = divmod(int(k), len(pattern))
        if d[i, j] <= 100 and not {i, j} & used:
            used |= {i, j}
            greedy.add((min(i, j), max(i, j)))
    assert {tuple(sorted(p)) for p in refine.opposite_pairs(pattern, c, 10.0).tolist()} == greedy


def test_dictionary_by_brute_force(spark):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(70, 6)), 1)
    a[40:50] = a[3]  # ties
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, pattern array<double>")
    u = a - a.mean(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    for tile in (7, 1000):
        got = {(r.id, r.rank): r.template for r in orientation.dictionary_index(df, df, 3, tile).collect()}
        assert got == {(i, k): j for i in range(70) for k, j in enumerate(np.argsort(-s[i], kind="stable")[:3].tolist(), 1)}
    few = orientation.dictionary_index(df, df.where("id < 2"), 3)
    assert few.count() == 140 and orientation.dictionary_index(df.where("false"), df, 3).collect() == []
    assert orientation.best_match(few).count() == 70


def test_orientations_are_smoothed_inside_grains(spark):
    group = orientation.cubic_group()
    assert len({tuple(np.round(g, 6)) for g in group}) == 24 and all(abs(sum(x * x for x in g) - 1) < 1e-9 for g in group)
    rng = np.random.default_rng(6)

    def mul(a, b):
        (w, x, y, z), (p, q, r, s) = a, b
        return np.array([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p])

    turn = lambda deg: np.array([np.cos(np.radians(deg) / 2), 0, 0, np.sin(np.radians(deg) / 2)])
    q = {(y, x): mul(group[int(rng.integers(24))], turn((5 if x < 3 else 25) + rng.normal(0, 0.5))) * rng.choice([1, -1]) for y in range(4) for x in range(6)}
    rows = [(y, x, 0, None if (y, x) == (0, 0) else 1.0 + 0.1 * x, *map(float, v)) for (y, x), v in q.items()]
    df = spark.createDataFrame(rows, "y int, x int, phase int, weight double, qw double, qx double, qy double, qz double")
    got = {(r.y, r.x): np.array([r.qw, r.qx, r.qy, r.qz]) for r in orientation.smoothed_orientations(df, {0: group}, 5.0, 1).collect()}
    weight = {(r[0], r[1]): r[3] for r in rows}
    for at, own in q.items():
        if weight[at] is None:
            assert np.allclose(got[at], own)
            continue
        total = own * weight[at]
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                n = (at[0] + dy, at[1] + dx)
                if n != at and n in q and weight[n] is not None:
                    best = max((mul(np.array(g), q[n]) for g in group), key=lambda v: abs(v @ own))
                    if np.degrees(2 * np.arccos(min(1, abs(best @ own)))) <= 5:
                        total = total + best * np.sign(best @ own) * weight[n]
        assert np.allclose(got[at], total / np.linalg.norm(total))


def test_strain_is_smoothed(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(3, 6, 5))
    a[:, 2, 2] = np.nan
    rows = [(y, x, *[None if np.isnan(v) else float(v) for v in a[:, y, x]]) for y in range(6) for x in range(5)]
    df = spark.createDataFrame(rows, "y int, x int, exx double, eyy double, exy double")
    for r in neighbourhood.smoothed_strain(df).collect():
        for k, v in enumerate((r.exx, r.eyy, r.exy)):
            near = a[k, max(0, r.y - 1) : r.y + 2, max(0, r.x - 1) : r.x + 2]
            assert v is None if np.isnan(a[k, r.y, r.x]) else v == pytest.approx(float(np.nanmedian(near)))
    whole = {(r.y, r.x): r.exx for r in neighbourhood.denoised_strain(df, tile=64).collect()}
    want = kernels.total_variation(a[0])
    assert len(whole) == 30 and whole[2, 2] is None and all(v is None or v == pytest.approx(want[k]) for k, v in whole.items())


def test_drift_modes_and_rejection(spark):
    m = synthetic.drifting_movie(spark, 8).cache()
    truth = {r.t: (r.true_dy, r.true_dx) for r in m.collect()}
    noise = np.random.default_rng(0).normal(size=96 * 112).tolist()
    bad = m.withColumn("frame", F.when(F.col("t") == 4, F.array(*map(F.lit, noise))).otherwise(F.col("frame")))
    for got, skip in ((frames.drift(m, (96, 112), "sequential"), ()), (frames.drift(m, (96, 112), "first", region=(10, 10, 70, 80)), ()), (frames.drift(bad, (96, 112), "running"), (4,)), (frames.drift(m, (96, 112), 0), ())):
        rows = got.collect()
        assert len(rows) == 8
        for r in rows:
            assert r.t in skip or (r.dy == pytest.approx(truth[r.t][0], abs=0.15) and r.dx == pytest.approx(truth[r.t][1], abs=0.15))
    with pytest.raises(ValueError, match="region"):
        frames.drift(m, (96, 112), region=(50, 0, 90, 20))
    with pytest.raises(ValueError, match="reference frame"):
        frames.drift(m, (96, 112), 77)


def test_clusters_by_brute_force(spark):
    rng = np.random.default_rng(8)
    p = np.round(np.concatenate([rng.normal(0, 0.05, (60, 2)), rng.normal(1, 0.05, (40, 2)), rng.uniform(-3, 3, (15, 2))]), 2)
    label = kernels.connected(p, 0.06, 5)
    got = {(r.kx, r.ky): (r.cluster_kx, r.cluster_ky) for r in frames.clusters(spark.createDataFrame([tuple(map(float, r)) for r in p], "kx double, ky double"), 0.06, 5).collect()}
    core = lambda i: (((p - p[i]) ** 2).sum(axis=1) <= 0.06**2).sum() >= 5
    names = {k: min(tuple(p[i]) for i in np.flatnonzero(label == k) if core(i)) for k in set(label) - {-1}}
    for i in range(len(p)):
        if core(i):
            assert got[tuple(p[i])] == names[label[i]]
        else:
            assert (got[tuple(p[i])] == (None, None)) == (label[i] == -1)


def test_peaks_hold_the_frame_at_the_peak():
    frame = np.zeros((24, 24))
    yy, xx = np.mgrid[:24, :24]
    frame[(yy - 12) ** 2 + (xx - 11) ** 2 <= 9] = 7.0
    frame[12, 11] = 20.0
    p = kernels.find_peaks(frame, "nxcorr", 3.0, 0.5, 6.0)
    assert len(p) == 1 and p[0, 2] == pytest.approx(float(kernels.sampled(frame, p[:1, :2])[0])) and 7.0 < p[0, 4] < 8.0 < p[0, 2]
    masked = np.zeros((24, 24), bool)
    masked[:5] = True
    noisy = frame + np.random.default_rng(0).normal(0, 0.1, frame.shape)
    noisy[:5] = 1e6
    assert np.median(np.abs(kernels.difference_of_gaussians(noisy, 3.0, masked)[10:])) > np.median(np.abs(kernels.difference_of_gaussians(noisy, 3.0)[10:])) * 0.5
    assert frames.numbered(3, 4, 2).tolist() == [(3 << 42) + (4 << 21), (3 << 42) + (4 << 21) + 1]
    with pytest.raises(ValueError):
        frames.numbered(1 << 21, 0, 1)


def test_units_that_say_nothing():
    assert units.parse_unit("") is None and units.parse_unit("  ") is None and units.parse_unit(None) is None and units.parse_unit("furlong") is None
    assert {units.parse_unit(t) for t in ("$\\AA^{-1}$", "1/A", "Å⁻¹", "A^{-1}", "per angstrom", "k_A^-1")} == {"1/Å"}
    assert {units.parse_unit(t) for t in ("nm$^{-1}$", "1 / nm", "nm-1", "per nm")} == {"1/nm"} and units.parse_unit("mrads") == "mrad"
    assert units.per_angstrom("") == 1.0


def test_files_that_say_their_shape(spark, tmp_path):
    a = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    header = bytearray(1024)
    struct.pack_into("<4i", header, 0, 4, 3, 2, 1)
    struct.pack_into("<i", header, 92, 8)
    (tmp_path / "a.mrc").write_bytes(bytes(header) + b"\0" * 8 + a.tobytes())
    for name in ("a.npy", "a.mrc"):
        got = store.open_file(spark, f"{tmp_path}/{name}").orderBy("i").collect()
        assert [r.frame for r in got] == a.reshape(2, 12).astype(float).tolist() and {(r.height, r.width) for r in got} == {(3, 4)}
    spark.range(3).write.orc(f"{tmp_path}/t.orc")
    assert store.open_file(spark, f"{tmp_path}/t.orc").count() == 3
    m = spark.createDataFrame([(0, 0, 1, 0.5)], "y int, x int, phase int, score double")
    store.save_orientations(m, f"{tmp_path}/o", [{"name": "fcc"}, {"name": "bcc"}])
    df, phases = store.load_orientations(spark, f"{tmp_path}/o")
    assert df.collect() == m.collect() and phases[1]["name"] == "bcc"
    store.save_drift(spark.createDataFrame([(0, 0.0, 1.5)], "t int, dy double, dx double"), f"{tmp_path}/d", "first", {"most": 8})
    assert store.load_drift(spark, f"{tmp_path}/d")[1]["parameters"] == {"most": 8}
    with pytest.raises(ValueError):
        store.load_drift(spark, f"{tmp_path}/o")


def test_positions_and_batches(spark):
    got = grid.spread_positions(spark, 9, 7, 3).orderBy("rank").collect()
    assert len(got) == 9 and (got[0].y, got[0].x) == (4, 3) and {r.y for r in got} == {0, 4, 8}
    assert grid.spread_positions(spark, 1, 50, 3).count() == 9
    pos = grid.nav_grid(spark, y=10, x=10)
    a, b = (sorted(map(tuple, grid.sampled_positions(p, 7).collect())) for p in (pos, pos.repartition(5)))
    assert a == b and len(a) == 7
    v = spark.createDataFrame([(0, 0, float(i), 0.0, float(i * i), i) for i in range(5)], "nav_y int, nav_x int, kx double, ky double, intensity double, ord long")
    assert ragged.reduce_map(v, {"nav_y": 1, "nav_x": 2}, "intensity", lambda s: s.max() - s.min()).where("nav_x = 0").first().value == 16.0


def slow_robust_affine(rows, rounds=10, cut=4.685):
    """(2, 3) map by iteratively reweighted least squares with Tukey's biweight."""
    g = np.column_stack([rows["gx"], rows["gy"], np.ones(len(rows))])
    k, w = rows[["kx", "ky"]].to_numpy(float), np.ones(len(rows))
    for _ in range(rounds):
        a = np.linalg.lstsq(g * np.sqrt(w)[:, None], k * np.sqrt(w)[:, None], rcond=None)[0]
        r = np.hypot(*(k - g @ a).T)
        scale = 1.4826 * np.median(r)
        if scale < 1e-12:
            break
        w = np.clip(1 - (r / (cut * scale)) ** 2, 0, None) ** 2
        if (w > 0).sum() < 3:
            break
    return a.T


def test_alignments(spark):
    """Patterns off centre need the centred alignment, patterns with missing spots the raw one; each position takes its own."""
    lattice = [(i, 0.5 * h, 0.5 * k) for i, (h, k) in enumerate((h, k) for h in (-1, 0, 1) for k in (-1, 0, 1) if h or k)]
    ref = spark.createDataFrame(lattice, "ref int, gx double, gy double")
    off = [(0, 0, x + 0.3, y - 0.2, i) for i, x, y in lattice]
    half = [(0, 1, 1.02 * x, y, i) for i, x, y in lattice if x >= 0 and (x, y) != (0.0, -0.5)]
    v = spark.createDataFrame([(*r[:4], 1.0, r[4]) for r in off + half], "nav_y int, nav_x int, kx double, ky double, intensity double, ord long")
    m = strain.aligned_matches(v, ref, 0.15)
    assert {(r.nav_x, r.raw) for r in m.collect()} == {(0, False), (1, True)}
    for out in (strain.strain_map(v, ref, 0.15, {"nav_y": 1, "nav_x": 3}, 8, alignment="best"), strain.robust_strain_map(v, ref, 0.15, {"nav_y": 1, "nav_x": 3}, alignment="best")):
        got = {r.nav_x: r for r in out.collect()}
        assert got[0].exx == pytest.approx(0, abs=1e-9) and got[1].exx == pytest.approx(1 / 1.02 - 1, abs=1e-9) and got[1].eyy == pytest.approx(0, abs=1e-9) and got[2].exx is None
    raw = {r.nav_x: r.n_matched for r in strain.strain_map(v, ref, 0.15, {"nav_y": 1, "nav_x": 3}, 8).collect()}
    assert raw[0] < 8 and raw[1] == 4
    assert strain.aligned_matches(v.where("false"), ref, 0.15).collect() == []


def test_robust_strain_by_brute_force(spark):
    v, ref = synthetic.strained_vectors(spark)
    far = (F.abs("kx") > 0.5) & (F.abs("ky") > 0.5) & (F.col("kx") * F.col("ky") > 0)
    spoiled = v.withColumn("kx", F.when((F.col("nav_x") == 2) & far, F.col("kx") + 0.15 * F.signum("kx")).otherwise(F.col("kx")))
    got = {(r.nav_y, r.nav_x): (r.exx, r.eyy, r.exy, r.omega) for r in strain.robust_strain_map(spoiled, ref, 0.3, {"nav_y": 4, "nav_x": 5}).collect()}
    rows = matching.one_per_reference(matching.nearest_within(spoiled, ref, 0.3)).toPandas()
    assert len(got) == 20
    for at, own in rows.groupby(["nav_y", "nav_x"]):
        grad = np.linalg.inv(slow_robust_affine(own)[:, :2]).T
        u, s, vt = np.linalg.svd(grad)
        stretch, turn = vt.T @ np.diag(s) @ vt, u @ vt
        assert got[at] == pytest.approx((stretch[0, 0] - 1, stretch[1, 1] - 1, stretch[0, 1], np.arctan2(turn[1, 0], turn[0, 0])), abs=1e-6)
