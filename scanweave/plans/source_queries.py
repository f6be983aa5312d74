"""Queries over sources, stores, selections, actions and units, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..axes import Axis, chunk_edge, is_movie
from ..functions import roi, units
from ..operators import atoms, dominance, fields, frames, grid, halo, matching, orientation, ragged, refine, shape, spectra, strain, virtual
from ..plans import registry
from ..sources import store, synthetic
from . import domain as d

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
    """A new folder for a result that is written and read again."""
    return f"{store.working_dir(spark).rstrip('/')}/scanweave/{name}-{uuid.uuid4().hex}"


# sources and stores --------------------------------------------------------


@query("SELECT p_partkey AS k, p_name AS name FROM part")
def open_table(spark, sf_dir):
    return store.open_file(spark, f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))


@query(f"WITH {d.VECTORS} SELECT nav_y, nav_x, kx, ky, intensity, ord FROM v")
def saved_vectors(spark, sf_dir):
    to = _folder(spark, "vectors")
    store.save(d.vectors(spark, sf_dir), to, {n: Axis(n, k) for n, k in d.GRID.items()}, {"action": "find_vectors"})
    return store.load(spark, to)[0].select("nav_y", "nav_x", "kx", "ky", "intensity", "ord")


@query("SELECT vec_id AS id, CAST(label AS INT) AS phase, round(CAST(embedding[1] AS DOUBLE), 6) AS score, CASE label % 2 WHEN 0 THEN 'fcc' ELSE 'bcc' END AS name FROM embeddings")
def saved_orientations(spark, sf_dir):
    to, names = _folder(spark, "orientations"), ["fcc", "bcc"]
    t = d.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("phase"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"))
    store.save_orientations(t, to, [{"name": n} for n in names])
    df, phases = store.load_orientations(spark, to)
    return df.withColumn("name", F.get(F.array(*[F.lit(p["name"]) for p in phases]), (F.col("phase") % 2).cast("int")))


@query("SELECT CAST(vec_id AS INT) AS t, CAST(vec_id % 5 AS DOUBLE) / 4 AS dy, CAST(vec_id % 3 AS DOUBLE) AS dx, 'first' AS reference FROM embeddings")
def saved_drift(spark, sf_dir):
    to, k = _folder(spark, "drift"), F.col("vec_id")
    t = d.read(spark, sf_dir, "embeddings").select(k.cast("int").alias("t"), ((k % 5).cast("double") / 4).alias("dy"), (k % 3).cast("double").alias("dx"))
    store.save_drift(t, to, "first", {"upsample": 8})
    df, about = store.load_drift(spark, to)
    return df.withColumn("reference", F.lit(about["reference"]))


@query("SELECT s_suppkey AS k, s_name AS name, CAST(s_suppkey % 3 AS INT) AS a, CAST(s_suppkey % 5 AS INT) AS b FROM supplier")
def exported_table(spark, sf_dir):
    to, k = _folder(spark, "export"), F.col("s_suppkey")
    store.export(d.read(spark, sf_dir, "supplier").select(k.alias("k"), F.col("s_name").alias("name"), F.array((k % 3).cast("int"), (k % 5).cast("int")).alias("pair")), to)
    back = spark.read.option("header", "true").schema("k long, name string, pair string").csv(to)
    return back.select("k", "name", *[F.get_json_object("pair", f"$[{i}]").cast("int").alias(n) for i, n in enumerate("ab")])


@query(f"WITH {d.PIXELS} SELECT y, x, round(sum(value), 5) AS value FROM p GROUP BY ALL")
def cached_navigator(spark, sf_dir):
    side = _folder(spark, "sidecar")
    made = lambda: virtual.navigator(d.frames(spark, sf_dir))
    store.summary(spark, f"{sf_dir}/embeddings.parquet", side, made)
    return rounded(store.summary(spark, f"{sf_dir}/embeddings.parquet", side, made), 5, "value")


@query("SELECT * FROM (VALUES ('x', 12, 0.5::DOUBLE, 10.0::DOUBLE, 'nm'), ('kx', 8, 0.1, -0.4, '1/nm')) t(axis, size, scale, \"offset\", units)")
def axis_metadata(spark, sf_dir):
    return store.metadata(spark.range(0), {"x": Axis("x", 12, 0.5, 10.0, "nm"), "kx": Axis("kx", 8, 0.1, -0.4, "1/nm")})


@query("SELECT 'nav_y' AS axis, CAST(10 AS INT) AS size, CAST(2 AS INT) AS version UNION ALL SELECT 'nav_x', 12, 2")
def stored_axes_json(spark, sf_dir):
    to = _folder(spark, "about")
    store.save(d.read(spark, sf_dir, "region"), to, {n: Axis(n, k) for n, k in d.GRID.items()})
    about = spark.read.parquet(f"{to}/about")
    size = lambda n: F.get_json_object("about", f"$.axes.{n}.size").cast("int")
    rows = about.select(F.get_json_object("about", "$.version").cast("int").alias("version"), F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), size(n).alias("size")) for n in d.GRID])).alias("a"))
    return rows.select("a.axis", "a.size", "version")


@query("SELECT 4.0862::DOUBLE AS a, 4.1::DOUBLE AS b, 90.0::DOUBLE AS alpha, CAST(NULL AS DOUBLE) AS gamma, 'P4mm' AS space_group, 'Ba,O,Ti' AS elements")
def cif_cell(spark, sf_dir):
    text = "data_x\n_cell_length_a 4.0862\n_cell_length_b   4.1(2)\n_cell_angle_alpha 90.0\n_symmetry_space_group_name_H-M 'P4mm'\n_chemical_formula_sum 'Ba O3 Ti'\n"
    got = store.parse_cif(F.lit(text))
    return spark.range(1).select(*[got[n].alias(n) for n in ("a", "b", "alpha", "gamma", "space_group")], F.concat_ws(",", got["elements"]).alias("elements"))


@query("SELECT * FROM (VALUES (1, 64, 1048576), (2, 8, 1048576), (2, 1, 1073741824), (3, 20, 8192), (0, 1, 8)) t(n_nav, edge, frame_bytes)")
def chunk_edges(spark, sf_dir):
    return spark.createDataFrame([(n, chunk_edge(n, b), b) for n, b in ((1, 1 << 20), (2, 1 << 20), (2, 1 << 30), (3, 1 << 13), (0, 8))], "n_nav int, edge int, frame_bytes int")


@query("SELECT * FROM (VALUES ('seconds', true), ('named', true), ('large', true), ('small', false), ('map', false)) t(k, movie)")
def movie_stacks(spark, sf_dir):
    nav = {"seconds": ([Axis("i", 5, units="s")], 10), "named": ([Axis("time", 5)], 10), "large": ([Axis("i", 5)], 1 << 20), "small": ([Axis("i", 5)], 10), "map": ([Axis("y", 5), Axis("t", 5)], 1 << 22)}
    return spark.createDataFrame([(k, is_movie(a, n)) for k, (a, n) in nav.items()], "k string, movie boolean")


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(29 * (y * 5 + x + 1) AS DOUBLE) AS value FROM range(4) a(y), range(5) b(x)")
def synthetic_disks(spark, sf_dir):
    return virtual.navigator(synthetic.disks(spark))


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(list_sum(list_transform(range(256), lambda i: 5 + (20 + 40 * (y * 5 + x) / 19) / (3 * sqrt(2 * pi())) * exp(-((i * 50.0::DOUBLE / 255 - 20 - 10 * (y * 5 + x) / 19) ** 2) / 18))), 6) AS value FROM range(4) a(y), range(5) b(x)")
def synthetic_spectra(spark, sf_dir):
    s = synthetic.spectrum_image(spark)
    return rounded(virtual.navigator(s.select("y", "x", "spectrum"), "spectrum"), 6, "value")


# selections ---------------------------------------------------------------


@query(f"WITH {d.FRAMES} SELECT CAST(y * 25 + x AS INT) AS t, CAST(i AS INT) AS i, CAST(frame[(2 + i // 4) * 8 + 3 + i % 4 + 1] AS DOUBLE) AS value FROM f, range(24) r(i)")
def movie_crop(spark, sf_dir):
    x0, y0, x1, y1 = shape.movie_box((3, 2, 7, 99), d.SIDE, d.SIDE)
    m = d.frames(spark, sf_dir).select((F.col("y") * d.COLUMNS + F.col("x")).cast("int").alias("t"), shape.crop_frame("frame", d.SIDE, x0, y0, x1, y1).alias("frame"))
    return m.select("t", F.posexplode("frame").alias("i", "value")).withColumn("value", F.col("value").cast("double"))


@query("WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, round(sum(v), 6) AS value, count(*) AS n FROM e WHERE (i >= 3 AND i < 9) OR (i >= 20 AND i < 31) GROUP BY ALL")
def channel_mask(spark, sf_dir):
    mask = [3 <= i < 9 or 20 <= i < 31 for i in range(64)]
    rows = d.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.where(roi.in_ranges(F.col("i"), roi.channel_ranges(mask))).groupBy("vec_id").agg(F.round(F.sum(F.col("v").cast("double")), 6).alias("value"), F.count("*").alias("n"))


@query("WITH m AS (SELECT s_suppkey % 7 - 3 AS oy, s_suppkey % 5 - 2 AS ox FROM supplier) SELECT greatest(0, max(-oy)) AS y0, greatest(0, max(-ox)) AS x0, min(32 - oy) AS y1, min(36 - ox) AS x1 FROM m")
def member_overlap(spark, sf_dir):
    k = F.col("s_suppkey")
    return shape.overlap_of(d.read(spark, sf_dir, "supplier").select((k % 7 - 3).alias("oy"), (k % 5 - 2).alias("ox")), 32, 36)


@query(f"WITH {d.FRAMES} SELECT y, x, round(sqrt(abs(CAST(frame[1] AS DOUBLE))) + greatest(CAST(frame[2] AS DOUBLE), 0), 6) AS value FROM f")
def guarded_expression(spark, sf_dir):
    out = registry.evaluate(d.frames(spark, sf_dir), value="sqrt(abs(element_at(frame, 1))) + greatest(element_at(frame, 2), 0)")
    return rounded(out.withColumn("value", F.col("value").cast("double")), 6, "value").select("y", "x", "value")


@query(f"WITH {d.VECTORS}, b(box, x0, x1, y0, y1) AS (VALUES (0, -0.5::DOUBLE, 0.5::DOUBLE, -0.5::DOUBLE, 0.5::DOUBLE), (1, 0.0, 0.9, 0.0, 0.9)) SELECT box, count(*) AS n, round(sum(intensity), 2) AS total FROM v JOIN b ON kx >= x0 AND kx < x1 AND ky >= y0 AND ky < y1 GROUP BY box")
def boxes_of_vectors(spark, sf_dir):
    boxes = [roi.Rectangle(-0.5, -0.5, 0.5, 0.5), roi.Rectangle(0.0, 0.0, 0.9, 0.9)]
    inside = F.filter(F.array(*[F.when(b.predicate(F.col("kx"), F.col("ky")), i) for i, b in enumerate(boxes)]), lambda i: i.isNotNull())
    rows = d.vectors(spark, sf_dir).select(F.explode(inside).alias("box"), "intensity")
    return rows.groupBy("box").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("total"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 40 AS g, (p_partkey * 7919 % 101)::DOUBLE AS y, (p_partkey * 104729 % 97)::DOUBLE AS x, p_retailprice AS s FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS i FROM p), m AS (SELECT g, max(i) AS n FROM o GROUP BY g)
SELECT id FROM (WITH RECURSIVE r(g, i, ids, ys, xs) AS (SELECT g, 0::BIGINT, []::BIGINT[], []::DOUBLE[], []::DOUBLE[] FROM m UNION ALL
SELECT r.g, o.i, CASE WHEN t.ok THEN list_append(ids, o.id) ELSE ids END, CASE WHEN t.ok THEN list_append(ys, o.y) ELSE ys END, CASE WHEN t.ok THEN list_append(xs, o.x) ELSE xs END
FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1, LATERAL (SELECT len(list_filter(range(1, len(ids) + 1), lambda k: (ys[k] - o.y) ** 2 + (xs[k] - o.x) ** 2 < 400)) = 0 AS ok) t)
SELECT unnest(ids) AS id FROM r JOIN m ON m.g = r.g AND m.n = r.i)""")
def separated_peaks(spark, sf_dir):
    k = F.col("p_partkey")
    peaks = d.read(spark, sf_dir, "part").select((k % 40).cast("int").alias("y"), F.lit(0).alias("x"), (k * 7919 % 101).cast("double").alias("py"), (k * 104729 % 97).cast("double").alias("px"), F.col("p_retailprice").alias("intensity"), k.alias("ord"))
    return matching.min_separation(peaks, 20.0).select(F.col("ord").alias("id"))


_PROPOSED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 40 END AS g, (p_partkey * 7919 % 101)::DOUBLE AS y, (p_partkey * 104729 % 97)::DOUBLE AS x, floor(p_retailprice / 50) AS s FROM part"


@query(f"""WITH p AS ({_PROPOSED}),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS i FROM p), m AS (SELECT g, max(i) AS n FROM o GROUP BY g),
h AS (SELECT g, unnest(ids) AS id FROM (WITH RECURSIVE r(g, i, ids, ys, xs) AS (SELECT g, 0::BIGINT, []::BIGINT[], []::DOUBLE[], []::DOUBLE[] FROM m UNION ALL
SELECT r.g, o.i, CASE WHEN t.ok THEN list_append(ids, o.id) ELSE ids END, CASE WHEN t.ok THEN list_append(ys, o.y) ELSE ys END, CASE WHEN t.ok THEN list_append(xs, o.x) ELSE xs END
FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1, LATERAL (SELECT len(list_filter(range(1, len(ids) + 1), lambda k: (ys[k] - o.y) ** 2 + (xs[k] - o.x) ** 2 <= 36)) = 0 AS ok) t)
SELECT r.g, ids FROM r JOIN m ON m.g = r.g AND m.n = r.i)),
a AS (SELECT o.*, k.id AS head, k.s AS top FROM o JOIN h ON h.g = o.g JOIN o k ON k.id = h.id AND k.g = o.g AND (k.y - o.y) ** 2 + (k.x - o.x) ** 2 <= 36 QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY k.i) = 1)
SELECT CAST(g AS INT) AS y, head AS ord, round(sum(s * y) / sum(s), 6) AS py, round(sum(s * x) / sum(s), 6) AS px, any_value(top)::DOUBLE AS intensity, count(*) AS n FROM a GROUP BY g, head""")
def merged_proposals(spark, sf_dir):
    k = F.col("p_partkey")
    peaks = d.read(spark, sf_dir, "part").select(
        F.when(k % 3 == 0, 0).otherwise(k % 40).cast("int").alias("y"), F.lit(0).alias("x"), (k * 7919 % 101).cast("double").alias("py"), (k * 104729 % 97).cast("double").alias("px"), F.floor(F.col("p_retailprice") / 50).cast("double").alias("intensity"), k.alias("ord"),
    )
    return rounded(dominance.merged(peaks, 6.0).select("y", "ord", "py", "px", "intensity", "n"), 6, "py", "px")


@query("""WITH c AS (SELECT CAST(l_orderkey % 500 AS INT) AS g, CAST(l_partkey % 9 AS INT) AS a, CAST(l_suppkey % 7 AS INT) AS b, min(l_extendedprice) AS distance FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY distance, a, b) AS i FROM c), m AS (SELECT g, max(i) AS n FROM o GROUP BY g)
SELECT g, a, b FROM (WITH RECURSIVE r(g, i, pairs) AS (SELECT g, 0::BIGINT, []::STRUCT(a INT, b INT)[] FROM m UNION ALL
SELECT r.g, o.i, CASE WHEN len(list_filter(pairs, lambda p: p.a = o.a OR p.b = o.b)) = 0 THEN list_append(pairs, {'a': o.a, 'b': o.b}) ELSE pairs END FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
SELECT r.g, unnest(pairs, recursive := true) FROM r JOIN m ON m.g = r.g AND m.n = r.i)""")
def one_to_one_pairs(spark, sf_dir):
    c = d.read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).cast("int").alias("g"), (F.col("l_partkey") % 9).cast("int").alias("a"), (F.col("l_suppkey") % 7).cast("int").alias("b")).agg(F.min("l_extendedprice").alias("distance"))
    return matching.greedy_one_to_one(c, ["g"]).select("g", "a", "b")


@query("WITH a AS (SELECT p_partkey AS id FROM part), p AS (SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON y.id = x.id + 1 WHERE x.id % 3 = 0) SELECT id FROM a WHERE id NOT IN (SELECT a FROM p UNION SELECT b FROM p)")
def unpaired_atoms(spark, sf_dir):
    a = d.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    pairs = a.where("id % 3 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(a.withColumnRenamed("id", "b"), "b")
    return atoms.unpaired(a, pairs)


@query(f"WITH {d.MEANS} SELECT round(avg(CASE WHEN fx > 0 THEN 1.0 ELSE 0.0 END), 9) AS rate, count(*) AS n FROM m")
def fit_convergence(spark, sf_dir):
    fits = d.position_means(spark, sf_dir).select("y", "x", (F.col("fx") > 0).alias("converged"))
    return rounded(spectra.convergence(fits), 9, "rate")


@query(f"WITH {d.MEANS}, g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(10) a(y), range(12) b(x)) SELECT g.y, g.x, round(fx, 8) AS shift, CAST(n AS DOUBLE) AS count FROM g LEFT JOIN (SELECT * FROM m WHERE fx > 0) m USING (y, x)")
def fit_maps(spark, sf_dir):
    fits = d.position_means(spark, sf_dir).where("fx > 0").select("y", "x", F.array("fx", F.col("n").cast("double")).alias("parameters"))
    return rounded(spectra.parameter_maps(fits, ["shift", "count"], {"y": d.NY, "x": d.NX}), 8, "shift")


@query(f"WITH {d.VECTORS} SELECT time AS phase, round(avg(intensity), 4) AS residual, CAST(row_number() OVER (ORDER BY round(avg(intensity), 4), time) AS INT) AS rank FROM v GROUP BY time")
def phase_ranking(spark, sf_dir):
    r = d.vectors(spark, sf_dir).groupBy(F.col("time").alias("phase")).agg(F.round(F.avg("intensity"), 4).alias("residual"))
    return orientation.phase_ranking(r)


@query("""WITH y AS (SELECT DISTINCT CAST(round_even(k * 9 / 3.0, 0) AS INT) AS y FROM range(4) r(k)), x AS (SELECT DISTINCT CAST(round_even(k * 11 / 3.0, 0) AS INT) AS x FROM range(4) r(k))
SELECT y, x, CAST(row_number() OVER (ORDER BY (y - 5) ** 2 + (x - 6) ** 2, y, x) AS INT) AS rank FROM y, x""")
def calibration_positions(spark, sf_dir):
    return grid.spread_positions(spark, d.NY, d.NX, 4)


@query(f"WITH {d.VECTORS} SELECT nav_y AS y, nav_x AS x FROM (SELECT DISTINCT nav_y, nav_x FROM v) ORDER BY md5('sample:' || nav_y || ':' || nav_x) LIMIT 17")
def sampled_positions(spark, sf_dir):
    return grid.sampled_positions(d.vectors(spark, sf_dir).select(F.col("nav_y").alias("y"), F.col("nav_x").alias("x")), 17)


@query("SELECT p_partkey AS id, round(10.0::DOUBLE + 0.25 * (p_partkey % 31), 6) AS coordinate, CAST(greatest(0, least(30, round_even((12.3 + (p_partkey % 50) * 0.2 - 10) / 0.25, 0))) AS INT) AS index FROM part")
def data_to_pixel(spark, sf_dir):
    a, k = Axis("x", 31, 0.25, 10.0), F.col("p_partkey")
    return d.read(spark, sf_dir, "part").select(k.alias("id"), F.round(a.coordinate(k % 31), 6).alias("coordinate"), a.nearest(12.3 + (k % 50) * 0.2).alias("index"))


@query("WITH e AS (SELECT CAST(user_id % 8 AS INT) AS y, CAST(event_type AS VARCHAR) AS kind, value FROM events) SELECT y, kind, count(*) AS n, round(sum(value), 3) AS total FROM e GROUP BY ROLLUP (y, kind)")
def rolled_up_counts(spark, sf_dir):
    e = d.read(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("y"), F.col("event_type").alias("kind"), "value")
    return e.rollup("y", "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"WITH {d.MEANS} SELECT CAST(y + 10 * a AS INT) AS y, CAST(x + 12 * b AS INT) AS x, n FROM m, range(2) p(a), range(3) q(b)")
def tiled_scan(spark, sf_dir):
    return shape.tiled(d.position_means(spark, sf_dir).select("y", "x", "n"), {"y": d.NY, "x": d.NX}, {"y": 2, "x": 3})


# actions -------------------------------------------------------------------


@query(f"WITH {d.PIXELS}, m AS (SELECT ky, kx, avg(value) AS m FROM p GROUP BY ALL) SELECT y, x, round(sum(value - m), 5) AS value FROM p JOIN m USING (ky, kx) GROUP BY ALL")
def action_chain(spark, sf_dir):
    f = d.frames(spark, sf_dir).withColumn("frame", F.transform("frame", lambda v: v.cast("double")))
    return rounded(registry.run("navigator", registry.run("static_background", f)), 5, "value")


@query("SELECT unnest(['center_of_mass', 'drift_correction', 'dynamic_background', 'fft', 'find_vectors', 'line_profile', 'navigator', 'static_background', 'virtual_imaging']) AS action")
def actions_for_frames(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in registry.applicable("frames")], "action string")


@query(f"WITH {d.FRAMES} SELECT y, x, round(list_sum(list_transform(frame, lambda v, i: CAST(frame[65 - i] AS DOUBLE) * 2 * i)), 4) AS code FROM f")
def mapped_frames(spark, sf_dir):
    f = d.frames(spark, sf_dir).withColumn("frame", F.transform("frame", lambda v: v.cast("double")))
    out = frames.map_frames(f, (8, 8), lambda a: a[::-1, ::-1], lambda a: 2 * a)
    return rounded(out.select("y", "x", F.aggregate(F.transform("frame", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v).alias("code")), 4, "code")


@query(f"""WITH {d.PIXELS}, k AS (SELECT i AS d, exp(-0.5 * (i / 0.7) ** 2) AS w FROM range(-3, 4) t(i)),
b AS (SELECT a.y, a.x, q.ky, q.kx, sum(u.w * v.w * q.value) / sum(u.w * v.w) AS value FROM f a, k u, k v, p q WHERE q.y = a.y + u.d AND q.x = a.x + v.d GROUP BY ALL)
SELECT y, x, round(sum(value * (8 * ky + kx + 1)), 4) AS code, round(max(value), 6) AS top FROM b GROUP BY y, x""")
def blurred_frames(spark, sf_dir):
    out = halo.nav_blur(d.frames(spark, sf_dir), (8, 8), 0.7)
    code = F.aggregate(F.transform("frame", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("y", "x", code.alias("code"), F.array_max("frame").alias("top")), 4, "code").withColumn("top", F.round("top", 6))


@query(f"""WITH {d.PIXELS}, n AS (SELECT a.y, a.x, q.ky, q.kx, q.value, q.y <> a.y OR q.x <> a.x AS beside FROM f a JOIN p q ON abs(q.y - a.y) <= 1 AND abs(q.x - a.x) <= 1),
m AS (SELECT y, x, ky, kx, max(value) FILTER (NOT beside) AS own, max(value) FILTER (beside) AS other FROM n GROUP BY ALL)
SELECT y, x, count(*) FILTER (own > other) AS n_above, round(sum(own - other), 4) AS gap FROM m GROUP BY y, x""")
def frames_above_neighbours(spark, sf_dir):
    """Pixels brighter than the same pixel of all 8 frames around, by a function that sees the neighbours."""

    def gap(block, there):
        a = np.where(there[:, :, None, None], block, -np.inf)
        p = np.pad(a, ((1, 1), (1, 1), (0, 0), (0, 0)), constant_values=-np.inf)
        h, w = a.shape[:2]
        around = np.max([p[i : i + h, j : j + w] for i in range(3) for j in range(3) if (i, j) != (1, 1)], axis=0)
        return block - np.where(np.isfinite(around), around, 0.0)

    out = frames.map_frames(d.frames(spark, sf_dir), (8, 8), gap, depth=1)
    return out.select("y", "x", F.size(F.filter("frame", lambda v: v > 0)).cast("long").alias("n_above"), F.round(F.aggregate("frame", F.lit(0.0), lambda a, v: a + v), 4).alias("gap"))


@query(f"WITH {d.FRAMES} SELECT y, x, CAST(list_max(frame) AS DOUBLE) AS top FROM f WHERE y = 3 AND x = 4")
def previewed_expression(spark, sf_dir):
    return registry.preview(d.frames(spark, sf_dir), {"y": 3, "x": 4}, top="array_max(frame)").select("y", "x", F.col("top").cast("double").alias("top"))


@query("""SELECT vec_id, label, round(a / n, 9) AS qw FROM (SELECT vec_id, CAST(label AS INT) AS label, CAST(embedding[1] AS DOUBLE) AS a, sqrt(list_sum(list_transform(embedding[1:4], lambda v: CAST(v AS DOUBLE) ** 2))) AS n FROM embeddings)""")
def template_quaternions(spark, sf_dir):
    t = d.read(spark, sf_dir, "embeddings")
    c = [F.element_at("embedding", i).cast("double") for i in range(1, 5)]
    n = F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))
    templates = t.select(F.col("vec_id").alias("template"), *[(x / n).alias(q) for x, q in zip(c, ("qw", "qx", "qy", "qz"), strict=True)], F.col("label").cast("int").alias("phase"))
    out = orientation.with_templates(t.select(F.col("vec_id").alias("template")), templates)
    return out.select(F.col("template").alias("vec_id"), F.col("phase").alias("label"), F.round("qw", 9).alias("qw"))


# units and display ----------------------------------------------------------


@query(f"WITH {d.VECTORS} SELECT ord, round(CASE WHEN ord % 2 = 0 THEN kx ELSE kx * 0.1 END, 9) AS q FROM v")
def unit_spellings(spark, sf_dir):
    v = d.vectors(spark, sf_dir)
    return v.select("ord", F.round(F.when(F.col("ord") % 2 == 0, units.convert(F.col("kx"), "", "$\\AA^{-1}$")).otherwise(units.convert(F.col("kx"), "nm$^{-1}$", "1/Å")), 9).alias("q"))


@query(f"WITH {d.VECTORS} SELECT ord, round(2 / {units.wavelength(200.0)!r} * sin(atan(sqrt(kx * kx + ky * ky) / 80) / 2), 9) AS g FROM v")
def flat_detector(spark, sf_dir):
    return d.vectors(spark, sf_dir).select("ord", F.round(units.flat_detector(F.hypot("kx", "ky"), 80.0, 200.0), 9).alias("g"))


_GAMMA = "(1 + 200 * 1e3 * 1.602176634e-19 / (9.1093837015e-31 * 299792458.0 ** 2))"


@query(f"WITH {d.MEANS} SELECT y, x, round(fx * {_GAMMA} * 9.1093837015e-31 * (299792458.0 ** 2 * (1 - 1 / {_GAMMA} ** 2)) * 0.1 * 1e-3 / (1.602176634e-19 * 50e-9) / 1e8, 8) AS field FROM m")
def electric_field(spark, sf_dir):
    return rounded(d.position_means(spark, sf_dir).select("y", "x", (F.col("fx") * units.electric_field(0.1, 50.0, 200.0)).alias("field")), 8, "field")


@query(f"WITH {d.VECTORS}, s AS (SELECT ord, 1 + confidence AS w, intensity AS n, l_b AS b FROM (SELECT *, 2.5::DOUBLE AS l_b FROM v)) SELECT ord, round(sqrt((w * w + 1 / 12) / n + 8 * pi() * (w * w + 1 / 12) ** 2 * b * b / (n * n)), 9) AS sigma FROM s")
def positional_sigma(spark, sf_dir):
    return d.vectors(spark, sf_dir).select("ord", F.round(units.positional_sigma(1 + F.col("confidence"), F.col("intensity"), F.lit(2.5)), 9).alias("sigma"))


@query(f"WITH {d.MEANS} SELECT y, x, round(fx * 100, 8) AS exx, round(fy * 100, 8) AS eyy, round(degrees(fx - fy), 8) AS omega FROM m")
def displayed_strain(spark, sf_dir):
    m = d.position_means(spark, sf_dir).select("y", "x", F.col("fx").alias("exx"), F.col("fy").alias("eyy"), (F.col("fx") - F.col("fy")).alias("omega"))
    return rounded(units.strain_display(m, ("exx", "eyy")), 8, "exx", "eyy", "omega")


@query(f"WITH {d.MEANS}, s AS (SELECT sqrt(fx * fx + fy * fy) AS m FROM m) SELECT round(least(max(m), avg(m) + 0.5 * stddev_pop(m)), 9) AS ceiling FROM s")
def wheel_ceiling(spark, sf_dir):
    return rounded(fields.magnitude_ceiling(d.position_means(spark, sf_dir), 0.5), 9, "ceiling")


@query(f"WITH {d.MEANS} SELECT round(-quantile_cont(abs(fx), 0.98), 9) AS low, round(quantile_cont(abs(fx), 0.98), 9) AS high FROM m")
def symmetric_levels(spark, sf_dir):
    return rounded(virtual.robust_levels(d.position_means(spark, sf_dir), "fx", True), 9, "low", "high")


_ROT = "cos(radians(15)) AS c, sin(radians(15)) AS s"


@query(f"""WITH {d.MEANS}, t AS (SELECT y, x, fx AS xx, fy AS yy, fx * fy AS xy, {_ROT} FROM m), r AS (SELECT y, x, c * c * xx - 2 * c * s * xy + s * s * yy AS exx, s * s * xx + 2 * c * s * xy + c * c * yy AS eyy, c * s * (xx - yy) + (c * c - s * s) * xy AS exy FROM t)
SELECT y, x, round(exx, 8) AS exx, round(eyy, 8) AS eyy, round(exy, 8) AS exy, round((exx + eyy) / 2 + sqrt(((exx - eyy) / 2) ** 2 + exy * exy), 8) AS e1, round((exx + eyy) / 2 - sqrt(((exx - eyy) / 2) ** 2 + exy * exy), 8) AS e2 FROM r""")
def rotated_strain(spark, sf_dir):
    m = d.position_means(spark, sf_dir).select("y", "x", F.col("fx").alias("exx"), F.col("fy").alias("eyy"), (F.col("fx") * F.col("fy")).alias("exy"), F.lit(0.0).alias("omega"))
    return rounded(strain.principal(strain.rotate_tensor(m, 15.0)), 8, "exx", "eyy", "exy", "e1", "e2").select("y", "x", "exx", "eyy", "exy", "e1", "e2")


@query(f"""WITH {d.VECTORS}, p AS (SELECT nav_y, nav_x, confidence AS w, kx AS sx, ky AS sy, kx * 1.02 + 0.01 * ky AS qx, ky * 0.99 + intensity / 1e6 AS qy FROM v),
m AS (SELECT nav_y, nav_x, sum(w * sx * sx) AS xx, sum(w * sx * sy) AS xy, sum(w * sy * sy) AS yy, sum(w * qx * sx) AS ux, sum(w * qx * sy) AS uy, sum(w * qy * sx) AS vx, sum(w * qy * sy) AS vy, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT *, (xx + yy) / 2 AS half, sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS r, xx * yy - xy * xy AS det FROM m)
SELECT nav_y, nav_x, round((ux * yy - uy * xy) / det, 7) AS a00, round((uy * xx - ux * xy) / det, 7) AS a01, round((vx * yy - vy * xy) / det, 7) AS a10, round((vy * xx - vx * xy) / det, 7) AS a11, half - r > 0.05 * (half + r) AS well, n FROM e""")
def strain_of_pairs(spark, sf_dir):
    c = F.col
    p = d.vectors(spark, sf_dir).select("nav_y", "nav_x", c("confidence").alias("w"), c("kx").alias("sx"), c("ky").alias("sy"), (c("kx") * 1.02 + 0.01 * c("ky")).alias("qx"), (c("ky") * 0.99 + c("intensity") / 1e6).alias("qy"))
    return rounded(strain.strain_of_pairs(p, ("nav_y", "nav_x")), 7, "a00", "a01", "a10", "a11")


@query(f"WITH {d.VECTORS} SELECT nav_y, nav_x, round(kx * 0.1, 9) AS qx, round(ky * 0.1, 9) AS qy, intensity FROM v")
def peaks_for_matching(spark, sf_dir):
    return rounded(ragged.peaks_for_matching(d.vectors(spark, sf_dir), 0.1), 9, "qx", "qy")


@query("""WITH g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, (x + 0.5) / 12 - 0.5 AS gx, 0.4 - (y + 0.5) / 10 AS gy, radians(20) AS t FROM range(10) a(y), range(12) b(x)),
v AS (SELECT y, x, gx, gy * cos(t) - 0.7 * sin(t) AS vy, gy * sin(t) + 0.7 * cos(t) AS vz FROM g)
SELECT y, x, round(gx / sqrt(gx * gx + vy * vy + vz * vz), 9) AS rx, round(vy / sqrt(gx * gx + vy * vy + vz * vz), 9) AS ry, round(vz / sqrt(gx * gx + vy * vy + vz * vz), 9) AS rz FROM v""")
def detector_rays(spark, sf_dir):
    return rounded(orientation.detector_rays(grid.nav_grid(spark, y=d.NY, x=d.NX), (0.5, 0.4, 0.7), d.NY, d.NX, 20.0), 9, "rx", "ry", "rz")


@query("SELECT 'y' AS axis, 32::INT AS size, 12.5::DOUBLE AS \"offset\" UNION ALL SELECT 'x', 36, -2.0")
def composed_origin(spark, sf_dir):
    a = shape.overlay({"y": Axis("y", 32, 0.5, 11.0), "x": Axis("x", 36, 2.0, -4.0)}, {"y": 3, "x": 1})
    return store.metadata(spark.range(0), a).select("axis", "size", "offset")


@query("""WITH s AS (SELECT 0 AS m, y, x, list_sum(frame) AS v FROM (SELECT CAST(vec_id // 25 AS INT) AS y, CAST(vec_id % 25 AS INT) AS x, embedding AS frame FROM embeddings)), t AS (SELECT m, y, x - 1 AS x, v FROM s WHERE x >= 1 UNION ALL SELECT 1, y, x, v FROM s WHERE x < 24)
SELECT m AS member, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 4) AS value FROM t""")
def member_planes(spark, sf_dir):
    nav, size = virtual.navigator(d.frames(spark, sf_dir)), (d.frames(spark, sf_dir).agg(F.max("y")).first()[0] + 1, d.COLUMNS)
    region = shape.common_region([(0, 0), (0, -1)], [size, size])
    both = [shape.aligned(nav, o, region).withColumn("member", F.lit(i)) for i, o in enumerate(((0, 0), (0, -1)))]
    return rounded(both[0].unionByName(both[1]), 4, "value").select("member", "y", "x", "value")


@query("""SELECT h, k, l, round(1 / sqrt((h / 4.0) ** 2 + (k / 4.0) ** 2 + (l / 4.2) ** 2), 8) AS d FROM range(-2, 3) a(h), range(-2, 3) b(k), range(-2, 3) c(l) WHERE h <> 0 OR k <> 0 OR l <> 0""")
def spot_reflections(spark, sf_dir):
    return rounded(orientation.d_spacings(spark, 4.0, 4.0, 4.2, 2, both_signs=True), 8, "d").select(*[F.col(c).cast("long").alias(c) for c in "hkl"], "d")


@query(f"""WITH {d.FRAMES}, h AS (SELECT y, x, list_transform(frame, lambda v: CAST(v AS DOUBLE)) AS f FROM f), c AS (SELECT y, x, CAST(i // 8 AS INT) AS py, CAST(i % 8 AS INT) AS px, f[i + 1] AS v FROM h, range(64) r(i)),
n AS (SELECT a.y, a.x, a.py, a.px, any_value(a.v) AS v, max(b.v) AS top FROM c a JOIN c b ON a.y = b.y AND a.x = b.x AND abs(a.py - b.py) <= 1 AND abs(a.px - b.px) <= 1 GROUP BY a.y, a.x, a.py, a.px)
SELECT y, x, py + 0.25 AS py, px - 0.125 AS px, round(v, 6) AS confidence FROM n WHERE v >= top AND v >= 0.1 QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY v DESC, py, px) <= 4""")
def decoded_peaks(spark, sf_dir):
    off = lambda v: F.array_repeat(F.lit(v), 64)
    heat = d.frames(spark, sf_dir).select("y", "x", "frame", off(0.25).alias("off_y"), off(-0.125).alias("off_x"))
    return rounded(refine.decoded_peaks(heat, (8, 8), 0.1, 4), 6, "confidence")


@query(f"WITH {d.VECTORS} SELECT ord, round(0.5 * confidence + 0.25 * (ord % 5) / 4 + 0.25 * CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END, 9) AS score FROM v WHERE 0.5 * confidence + 0.25 * (ord % 5) / 4 + 0.25 * CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END >= 0.8")
def merged_peaks(spark, sf_dir):
    v = d.vectors(spark, sf_dir).select("ord", "confidence", ((F.col("ord") % 5) / 4).alias("persistence"), (F.col("ord") % 2 == 0).alias("friedel"))
    return rounded(frames.merged_peaks(v, 0.1, keep=0.8), 9, "score").select("ord", "score")
