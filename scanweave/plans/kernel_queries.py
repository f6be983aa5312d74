"""Queries over frame kernels, streams and sources, with SQL where it can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import frames
from ..streaming import events
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


def _frames(spark, sf_dir):
    return d.frames(spark, sf_dir).withColumn("frame", F.transform("frame", lambda v: v.cast("double")))


def _movie(spark, sf_dir):
    return d.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("frame"))


@query()
def find_vectors_nxcorr(spark, sf_dir):
    return frames.find_vectors(_frames(spark, sf_dir), (8, 8), 1.5, "nxcorr", 0.4)


@query()
def find_vectors_dog(spark, sf_dir):
    return frames.find_vectors(_frames(spark, sf_dir), (8, 8), 1.5, "dog", 2.0)


@query()
def rigid_drift(spark, sf_dir):
    return frames.drift(_movie(spark, sf_dir), (8, 8), most=3.0)


@query()
def drift_corrected(spark, sf_dir):
    m = _movie(spark, sf_dir)
    return frames.corrected(m, frames.drift(m, (8, 8), most=3.0), (8, 8))


@query(f"WITH {d.PIXELS}, m AS (SELECT ky, kx, avg(value) AS m FROM p GROUP BY ALL) SELECT y, x, round(sum((value - m) * (ky * 8 + kx + 1)), 5) AS code FROM p JOIN m USING (ky, kx) GROUP BY ALL")
def static_background(spark, sf_dir):
    out = frames.static_background(_frames(spark, sf_dir))
    code = F.aggregate(F.transform("frame", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("y", "x", code.alias("code")), 5, "code")


def _blurred(sigma: float, source: str = "p", value: str = "value") -> str:
    """CTEs that end in b (y, x, ky, kx, v): the frames of a table blurred, edges reflected once."""
    r = int(np.ceil(3 * sigma))
    mirror = lambda c: f"CASE WHEN {c} + d < 0 THEN -{c} - d - 1 WHEN {c} + d > 7 THEN 15 - {c} - d ELSE {c} + d END"
    return f"""w0 AS (SELECT d, exp(-0.5 * (d / {sigma}::DOUBLE) ** 2) AS w FROM range({-r}, {r + 1}) r(d)), w AS (SELECT d, w / sum(w) OVER () AS w FROM w0),
b0 AS (SELECT a.y, a.x, a.ky, a.kx, sum(s.{value} * w.w) AS v FROM {source} a, w, {source} s WHERE s.y = a.y AND s.x = a.x AND s.kx = a.kx AND s.ky = {mirror('a.ky')} GROUP BY ALL),
b AS (SELECT a.y, a.x, a.ky, a.kx, sum(s.v * w.w) AS v FROM b0 a, w, b0 s WHERE s.y = a.y AND s.x = a.x AND s.ky = a.ky AND s.kx = {mirror('a.kx')} GROUP BY ALL)"""


@query(f"WITH {d.PIXELS}, {_blurred(1.0)} SELECT y, x, round(sum((p.value - b.v) * (ky * 8 + kx + 1)), 5) AS code FROM p JOIN b USING (y, x, ky, kx) GROUP BY ALL")
def dynamic_background(spark, sf_dir):
    out = frames.dynamic_background(_frames(spark, sf_dir), (8, 8), 1.0)
    return rounded(out.select("y", "x", _code()), 5, "code")


def _code():
    """A frame as one number in which every pixel has its own weight."""
    return F.aggregate(F.transform("frame", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v).alias("code")


@query(f"""WITH {d.PIXELS}, u AS (SELECT CAST(v AS INT) AS v, CAST(w AS INT) AS w FROM range(8) a(v), range(8) b(w)),
t AS (SELECT p.y, p.x, v, w, sum(value * cos(2 * pi() * (v * ky + w * kx) / 8)) AS re, sum(value * sin(2 * pi() * (v * ky + w * kx) / 8)) AS im FROM p, u GROUP BY ALL)
SELECT y, x, CAST(((v + 4) % 8) * 8 + (w + 4) % 8 AS INT) AS i, round(ln(1 + sqrt(re * re + im * im)), 6) AS value FROM t""")
def power_spectra(spark, sf_dir):
    from ..functions.kernels import power_spectrum

    out = frames.map_frames(_frames(spark, sf_dir), (8, 8), power_spectrum)
    return rounded(out.select("y", "x", F.posexplode("frame").alias("i", "value")), 6, "value")


@query(f"WITH {d.PIXELS} SELECT y, x, kx AS i, round((sum(value) FILTER (WHERE ky = 2) + sum(value) FILTER (WHERE ky = 3) + sum(value) FILTER (WHERE ky = 4)) / 3, 7) AS value FROM p GROUP BY ALL")
def line_profiles(spark, sf_dir):
    out = frames.line_profiles(_frames(spark, sf_dir), (8, 8), (3.0, 0.0), (3.0, 7.0), 3)
    return rounded(out.select("y", "x", F.posexplode("frame").alias("i", "value")), 7, "value")


def _by_sql(spark, sf_dir, select: str):
    """A query text over the view frames (y, x, frame), with the table functions."""
    tables.register(spark)
    return spark.sql(select, frames=_frames(spark, sf_dir))


@query(f"""WITH {d.PIXELS}, n AS (SELECT a.y, a.x, a.ky, a.kx, any_value(a.value) AS value, max(b.value) AS top FROM p a JOIN p b ON a.y = b.y AND a.x = b.x AND abs(a.ky - b.ky) <= 2 AND abs(a.kx - b.kx) <= 2 GROUP BY ALL)
SELECT y, x, ky AS py, kx AS px, round(value, 6) AS value FROM n WHERE value >= top AND value >= 0.1""")
def maxima_by_table_function(spark, sf_dir):
    return _by_sql(spark, sf_dir, "SELECT f.y, f.x, p.py, p.px, round(p.value, 6) AS value FROM {frames} f, LATERAL local_maxima(f.frame, 8, 8, 2, 0.1D) p")


@query(f"WITH {d.PIXELS} SELECT y, x, kx AS i, round((sum(value) FILTER (WHERE ky = 2) + sum(value) FILTER (WHERE ky = 3) + sum(value) FILTER (WHERE ky = 4)) / 3, 7) AS value FROM p GROUP BY ALL")
def profiles_by_table_function(spark, sf_dir):
    return _by_sql(spark, sf_dir, "SELECT f.y, f.x, p.i, round(p.value, 7) AS value FROM {frames} f, LATERAL line_profile(f.frame, 8, 8, 3D, 0D, 3D, 7D, 3) p")


@query(f"""WITH {d.PIXELS}, q AS (SELECT y, x, ky, kx, ln(1 + greatest(value, 0)) AS value FROM p), {_blurred(2.0, "q")}, e AS (SELECT y, x, ky, kx, q.value - b.v AS v FROM q JOIN b USING (y, x, ky, kx)),
c AS (SELECT *, median(v) OVER (PARTITION BY y, x) AS mid FROM e), g AS (SELECT *, 1.4826 * median(abs(v - mid)) OVER (PARTITION BY y, x) AS mad FROM c)
SELECT y, x, round(sum((v - mid) / mad * (ky * 8 + kx + 1)), 4) AS code FROM g GROUP BY ALL""")
def preprocessed_frames(spark, sf_dir):
    return rounded(frames.preprocessed(_frames(spark, sf_dir), (8, 8), 2.0).select("y", "x", _code()), 4, "code")


# streams -----------------------------------------------------------------

def _events(spark, sf_dir):
    return d.read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("pixel"), "value", "event_type", "props")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, CAST(user_id // 10 AS BIGINT) AS pixel, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def exposure_planes(spark, sf_dir):
    return rounded(events.planes(_events(spark, sf_dir), 6 * 3600.0, bin_factor=10), 4, "total")


@query("""SELECT start, CAST(user_id // 50 AS BIGINT) AS pixel, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY ALL""")
def sliding_planes(spark, sf_dir):
    return rounded(events.planes(_events(spark, sf_dir), 12 * 3600.0, bin_factor=50, slide_seconds=6 * 3600.0), 4, "total")


@query("SELECT CAST(event_id // 16 AS BIGINT) AS plane, user_id AS pixel, count(*) AS n FROM events GROUP BY ALL")
def frame_planes(spark, sf_dir):
    return events.frame_planes(_events(spark, sf_dir).withColumnRenamed("event_id", "frame_id"), 16)


@query("SELECT event_id AS frame_id, user_id AS pixel, value FROM events WHERE event_id = 17")
def raw_event_frame(spark, sf_dir):
    return events.raw_frame(_events(spark, sf_dir).withColumnRenamed("event_id", "frame_id"), 17).select("frame_id", "pixel", "value")


@query("SELECT user_id AS pixel, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def latest_by_pixel(spark, sf_dir):
    return events.latest(_events(spark, sf_dir).select("pixel", "value", "event_id"), ("pixel",), "event_id")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id AS pixel, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return events.sessions(_events(spark, sf_dir), 4 * 3600.0, "pixel")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def event_properties(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT i AS tick, CAST((3 + floor(i * 2.5::DOUBLE)) % 17 AS INT) AS index FROM range(200) r(i)")
def playback_clock(spark, sf_dir):
    return events.playback(spark, 200, 0.05, 0.08, 17, 4.0, 3)


@query("SELECT f AS frame, CAST(r AS INT) AS repeat FROM range(0, 40, 3) a(f), range(15) b(r) WHERE r < CASE f WHEN 9 THEN 15 ELSE 1 END")
def movie_frame_list(spark, sf_dir):
    return events.frame_list(spark, 0, 40, 3, {9: 1.5}, 10.0)


@query(f"""WITH RECURSIVE {d.VECTORS}, p AS (SELECT kx, ky, count(*) AS n, row_number() OVER (ORDER BY kx, ky) AS id FROM v GROUP BY kx, ky),
l AS (SELECT a.id AS a, b.id AS b, b.n FROM p a JOIN p b ON (a.kx - b.kx) ** 2 + (a.ky - b.ky) ** 2 <= 0.05 * 0.05), c AS (SELECT a AS id FROM l GROUP BY a HAVING sum(n) >= 5),
e AS (SELECT l.a, l.b FROM l WHERE l.a IN (SELECT id FROM c) AND l.b IN (SELECT id FROM c)),
r(id, root) AS (SELECT id, id FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE e.b > r.root), t AS (SELECT id, min(root) AS root FROM r GROUP BY id),
o AS (SELECT l.b AS id, min(t.root) AS root FROM l JOIN t ON t.id = l.a GROUP BY l.b)
SELECT p.kx, p.ky, p.n, q.kx AS cluster_kx, q.ky AS cluster_ky FROM p LEFT JOIN o ON o.id = p.id LEFT JOIN p q ON q.id = o.root""")
def vector_clusters(spark, sf_dir):
    from ..sources.store import working_dir

    working_dir(spark)
    return frames.clusters(d.vectors(spark, sf_dir).select("kx", "ky"), 0.05, 5)


def planted_frames(n: int = 4, size: int = 48, seed: int = 0) -> tuple[list[tuple], list[tuple]]:
    """Frames with disks at known places, and the places: (y, x, frame), (y, x, cy, cx)."""
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:size, :size]
    rows, truth = [], []
    for i in range(n):
        a = rng.normal(0, 0.05, (size, size))
        for cy, cx in ((12, 12), (12, 34), (34, 22)):
            cy, cx = cy + i % 3, cx - i % 2
            a += (yy - cy) ** 2 + (xx - cx) ** 2 <= 9
            truth.append((i, 0, cy, cx))
        rows.append((i, 0, a.ravel().tolist()))
    return rows, truth
