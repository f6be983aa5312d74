"""Queries whose truth is planted or follows from a rule: fits, drift, detectors, refinement, neighbours, streams; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import api
from ..functions.components import Component, Model
from ..operators import frames, multiangle, neighbourhood, orientation, ragged, refine, spectra, virtual
from ..sources import store, synthetic
from ..streaming import events
from . import domain as d
from .kernel_queries import planted_frames

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _folder(spark, name: str) -> str:
    return f"{store.working_dir(spark).rstrip('/')}/scanweave/{name}-{uuid.uuid4().hex}"


# fits -----------------------------------------------------------------------

_TRUTH = "SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(20 + 40 * (y * 5 + x) / 19::DOUBLE, 3) AS area, round(20 + 10 * (y * 5 + x) / 19::DOUBLE, 3) AS centre, 3.0::DOUBLE AS sigma, 5.0::DOUBLE AS level FROM range(4) a(y), range(5) b(x)"


def _model() -> Model:
    return Model([Component.of("Gaussian", A=30.0, centre=25.0, sigma=4.0, bounds={"sigma": (0.1, 20.0)}), Component.of("Offset", offset=1.0)])


_AXIS = (0.0, 50.0 / 255)


def _parameters(fits):
    names = ("area", "centre", "sigma", "level")
    return fits.select("y", "x", *[F.round(F.element_at("parameters", i), 3).alias(n) for i, n in enumerate(names, 1)])


@query(_TRUTH)
def planted_fit(spark, sf_dir):
    return _parameters(spectra.fit(synthetic.spectrum_image(spark), _model(), _AXIS))


@query(_TRUTH)
def planted_seeded_fit(spark, sf_dir):
    return _parameters(spectra.seeded_fit(synthetic.spectrum_image(spark), _model(), _AXIS, 4, 5, 2))


@query(_TRUTH)
def planted_polish(spark, sf_dir):
    s = synthetic.spectrum_image(spark)
    store.working_dir(spark)
    first = spectra.fit(s, _model(), _AXIS)
    # every third fit spoiled: its neighbours' parameters must mend it
    spoiled = (F.col("y") * 5 + F.col("x")) % 3 == 0
    wrong = F.transform("parameters", lambda v, i: F.when(i == 1, v + 15).otherwise(v))
    fits = first.withColumn("parameters", F.when(spoiled, wrong).otherwise(F.col("parameters"))).withColumn("chisq", F.when(spoiled, F.lit(1e6)).otherwise(F.col("chisq") + 1))
    return _parameters(spectra.polish(s, fits, _model(), _AXIS))


@query("""WITH e AS (SELECT CAST(vec_id // 25 AS INT) AS y, CAST(vec_id % 25 AS INT) AS x, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS f FROM embeddings),
p AS (SELECT y, x, f[1] AS a0, f[2] - 10 * (y % 2) AS b0, f[4] AS a1, f[5] - 10 * ((y + 1) % 2) AS b1 FROM e), o AS (SELECT *, b0 <= b1 AS kept FROM p)
SELECT y, x, round(CASE WHEN kept THEN a0 ELSE a1 END, 7) AS a0, round(least(b0, b1), 7) AS b0, round(CASE WHEN kept THEN a1 ELSE a0 END, 7) AS a1, round(greatest(b0, b1), 7) AS b1 FROM o""")
def relabelled_components(spark, sf_dir):
    f = lambda i: F.element_at("frame", i).cast("double")
    fits = d.frames(spark, sf_dir).select("y", "x", F.array(f(1), f(2) - 10 * (F.col("y") % 2), f(4), f(5) - 10 * ((F.col("y") + 1) % 2)).alias("parameters"))
    out = spectra.relabel(fits, [(0, 2), (2, 4)])
    return out.select("y", "x", *[F.round(F.element_at("parameters", i), 7).alias(n) for i, n in enumerate(("a0", "b0", "a1", "b1"), 1)])


_CH = f"{d.FRAMES}, c AS (SELECT y, x, CAST(i - 1 AS INT) AS i, CAST(frame[i] AS DOUBLE) AS v FROM f, range(1, 65) r(i)), w AS (SELECT y, x, sum(v + 2) FILTER (WHERE i >= 4 AND i < 22) * 0.5 AS one, sum(v + 2) FILTER (WHERE i >= 22 AND i < 40) * 0.5 AS two FROM c GROUP BY ALL)"


@query(f"WITH {_CH}, s AS (SELECT y, x, one, 2 * ln(one / two) / ln(22.0::DOUBLE / 4.0) AS r FROM w) SELECT y, x, round(one * (1 - r) / (pow(13.0::DOUBLE, 1 - r) - pow(4.0::DOUBLE, 1 - r)), 6) AS A, round(r, 7) AS r FROM s")
def power_law_seeds(spark, sf_dir):
    s = d.frames(spark, sf_dir).select("y", "x", F.transform("frame", lambda v: v.cast("double") + 2).alias("spectrum"))
    return rounded(rounded(spectra.power_law_seeds(s, 4, 40, (2.0, 0.5)), 6, "A"), 7, "r")


@query("SELECT CAST(i AS INT) AS id, CAST(16 * (1 + i % 5) AS DOUBLE) AS x, CAST(16 * (1 + i // 5) AS DOUBLE) AS y FROM range(20) r(i)")
def planted_atoms_by_mass(spark, sf_dir):
    return _atoms(spark, False)


@query("SELECT CAST(i AS INT) AS id, CAST(16 * (1 + i % 5) AS DOUBLE) AS x, CAST(16 * (1 + i // 5) AS DOUBLE) AS y FROM range(20) r(i)")
def planted_atoms_by_fit(spark, sf_dir):
    return _atoms(spark, True)


def _atoms(spark, gaussian: bool):
    image, points = synthetic.atom_lattice(4, 5)
    rows = spark.createDataFrame([(0, i, float(y) + 0.7 * (-1) ** i, float(x) - 0.6) for i, (y, x) in enumerate(points)], "image int, id long, y double, x double")
    frame = spark.createDataFrame([(0, image.ravel().tolist())], "image int, frame array<double>")
    return refine.refined_atoms(frame, rows, image.shape, 6, gaussian).select(F.col("id").cast("int").alias("id"), F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


# drift ----------------------------------------------------------------------


@query("SELECT CAST(t AS INT) AS t, mode, true AS close FROM range(8) r(t), (VALUES ('first'), ('sequential'), ('running'), ('region')) m(mode)")
def planted_drift(spark, sf_dir):
    m = synthetic.drifting_movie(spark, 8)
    got = None
    for mode in ("first", "sequential", "running", "region"):
        solved = frames.drift(m, (96, 112), "first" if mode == "region" else mode, region=(10, 10, 70, 80) if mode == "region" else None).select("t", "dy", "dx", F.lit(mode).alias("mode"))
        got = solved if got is None else got.union(solved)
    off = F.greatest(F.abs(F.col("dy") - F.col("true_dy")), F.abs(F.col("dx") - F.col("true_dx")))
    # the published gate is a tenth of a pixel; adding up steps is allowed half a tenth more
    return got.join(m.drop("frame"), "t").select("t", "mode", (off <= F.when(F.col("mode") == "sequential", 0.15).otherwise(0.1)).alias("close"))


_STEP = "CAST(vec_id % 3 - 1 AS INT) AS dy, CAST(vec_id % 5 - 2 AS INT) AS dx"


def _movie(spark, sf_dir):
    k = F.col("vec_id")
    rows = d.read(spark, sf_dir, "embeddings").select(k.cast("int").alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("frame"), (k % 3 - 1).cast("double").alias("dy"), (k % 5 - 2).cast("double").alias("dx"))
    return rows.select("t", "frame"), rows.select("t", "dy", "dx")


@query(f"""WITH f AS (SELECT CAST(vec_id AS INT) AS t, embedding AS frame, {_STEP} FROM embeddings), p AS (SELECT t, CAST(i AS INT) AS i, i // 8 + dy AS sy, i % 8 + dx AS sx, frame FROM f, range(64) r(i))
SELECT t, i, CASE WHEN sy BETWEEN 0 AND 7 AND sx BETWEEN 0 AND 7 THEN CAST(frame[sy * 8 + sx + 1] AS DOUBLE) END AS value FROM p""")
def frames_moved_back(spark, sf_dir):
    m, s = _movie(spark, sf_dir)
    out = frames.corrected(m, s, (8, 8)).select("t", F.posexplode("frame").alias("i", "value"))
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


@query(f"""WITH f AS (SELECT vec_id AS t, embedding AS frame, {_STEP} FROM embeddings), p AS (SELECT t, i, CAST(frame[i + 1] AS DOUBLE) AS a, CASE WHEN i // 8 + dy BETWEEN 0 AND 7 AND i % 8 + dx BETWEEN 0 AND 7 THEN CAST(frame[(i // 8 + dy) * 8 + i % 8 + dx + 1] AS DOUBLE) END AS b FROM f, range(64) r(i)),
m AS (SELECT i, avg(a) AS a, avg(b) AS b FROM p GROUP BY i) SELECT round(var_pop(a), 10) AS "before", round(var_pop(b), 10) AS "after" FROM m""")
def drift_preview(spark, sf_dir):
    m, s = _movie(spark, sf_dir)
    return rounded(frames.sharpness_gain(m, s, (8, 8)), 10, "before", "after")


@query(f"WITH f AS (SELECT CAST(vec_id AS INT) AS t, {_STEP} FROM embeddings) SELECT t, CAST(t % 8 - dy AS DOUBLE) AS y, CAST(t % 7 - dx AS DOUBLE) AS x FROM f")
def lab_to_sample(spark, sf_dir):
    m, s = _movie(spark, sf_dir)
    return frames.lab_to_sample(m.select("t", (F.col("t") % 8).cast("double").alias("y"), (F.col("t") % 7).cast("double").alias("x")), s)


def _offsets_sql(spark_free_members: int = 7) -> str:
    """The planted offsets of `synthetic.tilt_members`: drawn by the generator of its seed, so that they are values here."""
    import numpy as np

    rng = np.random.default_rng(5)
    rng.normal(size=(32 + 6, 36 + 6))
    rows = [(0, 0, 0)] + [(m, *(int(v) for v in rng.integers(-3, 4, 2))) for m in range(1, spark_free_members)]
    return "SELECT * FROM (VALUES " + ", ".join(f"({m}, {y}, {x})" for m, y, x in rows) + ") t(member, oy, ox)"


@query(_offsets_sql())
def planted_offsets(spark, sf_dir):
    return multiangle.solve_offsets(synthetic.tilt_members(spark), (32, 36), 0, 6.0).select("member", "oy", "ox")


@query(_offsets_sql())
def planted_votes(spark, sf_dir):
    return multiangle.patch_votes(synthetic.tilt_members(spark), (32, 36), 0, 24, 4, 4.0).select("member", F.rint("oy").cast("int").alias("oy"), F.rint("ox").cast("int").alias("ox"))


# detectors -------------------------------------------------------------------

_DISKS = "SELECT CAST(i AS INT) AS y, CAST(cy + i % 3 AS INT) AS py, CAST(cx - i % 2 AS INT) AS px FROM range(4) r(i), (VALUES (12, 12), (12, 34), (34, 22)) c(cy, cx)"


def _found(spark, method: str, threshold: float):
    df = spark.createDataFrame(planted_frames()[0], "y int, x int, frame array<double>")
    return frames.find_vectors(df, (48, 48), 3.0, method, threshold, 6.0)


def _disks(spark, method: str, threshold: float):
    return _found(spark, method, threshold).select(F.col("nav_y").alias("y"), F.rint("ky").cast("int").alias("py"), F.rint("kx").cast("int").alias("px"))


@query(_DISKS)
def planted_disks_nxcorr(spark, sf_dir):
    return _disks(spark, "nxcorr", 0.5)


@query(_DISKS)
def planted_disks_dog(spark, sf_dir):
    return _disks(spark, "dog", 4.0)


@query("SELECT CAST(12 AS BIGINT) AS n_found, CAST(12 AS BIGINT) AS n_true, CAST(12 AS BIGINT) AS n_hit")
def judged_against_truth(spark, sf_dir):
    truth = spark.createDataFrame([(y, x, float(cy), float(cx)) for y, x, cy, cx in planted_frames()[1]], "y int, x int, py double, px double")
    found = _found(spark, "nxcorr", 0.5).select(F.col("nav_y").alias("y"), F.col("nav_x").alias("x"), F.col("ky").alias("py"), F.col("kx").alias("px"))
    return frames.judged(found, truth, 0.5)


@query(f"""WITH {d.PIXELS}, n AS (SELECT a.y, a.x, a.ky, a.kx, any_value(a.value) AS v, max(b.value) AS top FROM p a JOIN p b ON a.y = b.y AND a.x = b.x AND abs(a.ky - b.ky) <= 2 AND abs(a.kx - b.kx) <= 2 GROUP BY a.y, a.x, a.ky, a.kx)
SELECT y, x, ky AS py, kx AS px, round(v, 7) AS value FROM n WHERE v >= top AND v >= 0.05""")
def frame_local_maxima(spark, sf_dir):
    return rounded(frames.local_maxima(d.frames(spark, sf_dir), (8, 8), 2, 0.05), 7, "value")


@query("""WITH f AS (SELECT embedding AS f FROM embeddings), m AS (SELECT i, avg(CASE WHEN i // 8 = 3 AND i % 8 < 4 THEN 0 ELSE 1 + abs(CAST(f[i + 1] AS DOUBLE)) END) AS m FROM f, range(64) r(i) GROUP BY i), s AS (SELECT i FROM m WHERE m < 0.15 * (SELECT avg(m) FROM m)),
g AS (SELECT DISTINCT i // 8 + a AS py, i % 8 + b AS px FROM s, range(-2, 3) p(a), range(-2, 3) q(b) WHERE abs(a) + abs(b) <= 2) SELECT CAST(py AS INT) AS py, CAST(px AS INT) AS px FROM g WHERE py BETWEEN 0 AND 7 AND px BETWEEN 0 AND 7""")
def beam_stop_pixels(spark, sf_dir):
    shaded = F.transform("frame", lambda v, i: F.when((F.floor(i / 8) == 3) & (i % 8 < 4), 0.0).otherwise(1 + F.abs(v.cast("double"))))
    return frames.beam_stop(d.frames(spark, sf_dir).withColumn("frame", shaded), (8, 8))


@query(f"""WITH {d.VECTORS}, o AS (SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM range(-1, 2) s(a), range(-1, 2) t(b) WHERE a * a + b * b <= 1),
e AS (SELECT nav_y, nav_x, intensity, CAST(round_even((ky + 1) / 0.2, 0) AS INT) + dy AS ky, CAST(round_even((kx + 1) / 0.2, 0) AS INT) + dx AS kx FROM v, o)
SELECT nav_y, nav_x, ky, kx, round(max(intensity), 2) AS value FROM e WHERE kx BETWEEN 0 AND 10 AND ky BETWEEN 0 AND 10 GROUP BY ALL""")
def rendered_vectors(spark, sf_dir):
    return rounded(virtual.rendered(d.vectors(spark, sf_dir), 11, 11, 1.0, 0.2), 2, "value")


@query(f"""WITH {d.VECTORS}, b AS (SELECT nav_y, nav_x, kx AS sx, ky AS sy FROM v WHERE abs(kx) <= 0.3 AND abs(ky) <= 0.3 QUALIFY row_number() OVER (PARTITION BY nav_y, nav_x ORDER BY intensity DESC, ord) = 1)
SELECT ord, intensity, round(kx - coalesce(sx, 0), 8) AS kx, round(ky - coalesce(sy, 0), 8) AS ky FROM v LEFT JOIN b USING (nav_y, nav_x)""")
def centred_vectors(spark, sf_dir):
    return rounded(api.center_zero_beam(d.vectors(spark, sf_dir), d.GRID, 0.3).df, 8, "kx", "ky").select("ord", "intensity", "kx", "ky")


# neighbours ------------------------------------------------------------------


@query(f"""WITH {d.MEANS}, r AS (SELECT y, x, CASE WHEN (y + x) % 11 = 0 THEN NULL ELSE fx END AS exx, fy AS eyy, fx * fy AS exy FROM m), n AS (SELECT a.y, a.x, median(b.exx) AS exx, median(b.eyy) AS eyy, median(b.exy) AS exy FROM r a, r b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT n.y, n.x, CASE WHEN r.exx IS NOT NULL THEN round(n.exx, 9) END AS exx, round(n.eyy, 9) AS eyy, round(n.exy, 9) AS exy FROM n JOIN r USING (y, x)""")
def smoothed_strain(spark, sf_dir):
    m = d.position_means(spark, sf_dir).select("y", "x", F.when((F.col("y") + F.col("x")) % 11 != 0, F.col("fx")).alias("exx"), F.col("fy").alias("eyy"), (F.col("fx") * F.col("fy")).alias("exy"))
    return rounded(neighbourhood.smoothed_strain(m), 9, "exx", "eyy", "exy")


_TURN = """WITH q AS (SELECT CAST(vec_id // 25 AS INT) AS y, CAST(vec_id % 25 AS INT) AS x, CAST((vec_id // 25) % 2 AS INT) AS phase, 1 + abs(CAST(embedding[1] AS DOUBLE)) AS w, radians(2 + 8 * CAST(embedding[2] AS DOUBLE)) / 2 AS h FROM embeddings),
u AS (SELECT y, x, phase, w, cos(h) AS qw, sin(h) AS qz FROM q)"""


@query(f"""{_TURN}, p AS (SELECT a.y, a.x, a.qw AS aw, a.qz AS az, b.w, b.qw AS bw, b.qz AS bz, a.qw * b.qw + a.qz * b.qz AS dot, a.y = b.y AND a.x = b.x AS own FROM u a JOIN u b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.phase = b.phase),
s AS (SELECT y, x, sum(w * bw * sign(dot)) AS sw, sum(w * bz * sign(dot)) AS sz FROM p WHERE own OR degrees(2 * acos(least(1, abs(dot)))) <= 1.0 GROUP BY ALL) SELECT y, x, round(sw / sqrt(sw * sw + sz * sz), 9) AS qw, round(sz / sqrt(sw * sw + sz * sz), 9) AS qz FROM s""")
def smoothed_orientations(spark, sf_dir):
    e = lambda i: F.element_at("frame", i).cast("double")
    h = F.radians(2 + 8 * e(2)) / 2
    fits = d.frames(spark, sf_dir).select("y", "x", (F.col("y") % 2).cast("int").alias("phase"), (1 + F.abs(e(1))).alias("weight"), F.cos(h).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(h).alias("qz"))
    return rounded(orientation.smoothed_orientations(fits, {}, 1.0, 1), 9, "qw", "qz").select("y", "x", "qw", "qz")


@query("""WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM v), u AS (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM c),
s AS (SELECT p.vec_id AS id, t.vec_id AS template, round(sum(p.v * t.v), 12) AS score FROM u p JOIN u t USING (i) GROUP BY ALL) SELECT id, template, round(score, 7) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, template) = 1""")
def correlation_map(spark, sf_dir):
    t = d.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("pattern"))
    return rounded(orientation.best_match(orientation.dictionary_index(t, t, 1)), 7, "score")


# streams ---------------------------------------------------------------------


def _stream(spark, sf_dir, name: str):
    """A table of the folder as a stream; the pattern matches the one table only, whether it is a file or a folder."""
    schema = d.read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@query("SELECT event_id, CAST(user_id AS BIGINT) AS pixel, value FROM events")
def streamed_append(spark, sf_dir):
    to = _folder(spark, "appended")
    rows = _stream(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("pixel"), "value")
    events.append(rows, f"{to}/data", f"{to}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{to}/data")


@query(f"WITH {d.VECTORS}, {d.GRID_SQL} SELECT nav_y, nav_x, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT nav_y, nav_x, count(*) AS n FROM v GROUP BY ALL) USING (nav_y, nav_x)")
def live_counts(spark, sf_dir):
    """Counts of every micro-batch, added up as they land."""
    to, keys = _folder(spark, "live"), [F.col("l_suppkey"), F.col("l_partkey")]
    v = _stream(spark, sf_dir, "lineitem").select((keys[0] % d.NY).cast("int").alias("nav_y"), (keys[1] % d.NX).cast("int").alias("nav_x"))
    events.progressive(v, lambda b, i: events.live_counts(b).write.mode("overwrite").parquet(f"{to}/counts/batch={i}"), f"{to}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{to}/counts").groupBy("nav_y", "nav_x").agg(F.sum("n").alias("n"))
    from ..operators.grid import grid_complete

    return grid_complete(got, d.GRID, ("n",))


@query("WITH p AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, CAST(user_id // 10 AS BIGINT) AS pixel, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT * FROM p WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 12 HOUR FROM events)")
def streamed_planes(spark, sf_dir):
    """Windows that the watermark has closed, appended once each."""
    to = _folder(spark, "planes")
    # a watermark needs instants
    kind = dict(d.read(spark, sf_dir, "events").dtypes)["ts"]
    rows = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("pixel"), "value")
    events.append(events.planes(rows, 6 * 3600.0, 12 * 3600.0, bin_factor=10), f"{to}/data", f"{to}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{to}/data"), 4, "total").withColumn("start", F.col("start").cast(kind))


@query(f"WITH {d.VECTORS} SELECT nav_y, nav_x, count(*) AS n, round(avg(kx), 8) AS kx FROM v GROUP BY ALL")
def streamed_store(spark, sf_dir):
    """Batches in any order, appended and put in the order of positions at the end."""
    to, c = _folder(spark, "ragged"), F.col
    v = _stream(spark, sf_dir, "lineitem").select((c("l_suppkey") % d.NY).cast("int").alias("nav_y"), (c("l_partkey") % d.NX).cast("int").alias("nav_x"), ((c("l_quantity") - 25.5) / 25.5).alias("kx"), (c("l_orderkey") * 8 + c("l_linenumber")).cast("long").alias("ord"))
    events.append(v, f"{to}/data", f"{to}/checkpoint").awaitTermination()
    done = ragged.finalize(spark.read.parquet(f"{to}/data"), d.GRID)
    return done.groupBy("nav_y", "nav_x").agg(F.count("*").alias("n"), F.round(F.avg("kx"), 8).alias("kx"))
