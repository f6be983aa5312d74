"""Queries over fields, neighbours, matches and strain, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..functions.roi import Box, corner_blocks
from ..operators import fields, matching, neighbourhood, strain
from ..operators.grid import FOUR
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


def _d(c: str, along: str, across: str) -> str:
    w = f"(PARTITION BY {across} ORDER BY {along})"
    return f"(CASE WHEN lag({c}) OVER {w} IS NOT NULL AND lead({c}) OVER {w} IS NOT NULL THEN (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 WHEN lead({c}) OVER {w} IS NOT NULL THEN lead({c}) OVER {w} - {c} ELSE {c} - lag({c}) OVER {w} END)"


_DC = f"dc AS (SELECT y, x, {_d('fx', 'x', 'y')} + {_d('fy', 'y', 'x')} AS div, {_d('fy', 'x', 'y')} - {_d('fx', 'y', 'x')} AS curl FROM m)"


@query(f"WITH {d.MEANS}, {_DC} SELECT y, x, round(div, 8) AS div, round(curl, 8) AS curl FROM dc")
def divergence_curl(spark, sf_dir):
    return rounded(neighbourhood.div_curl(d.position_means(spark, sf_dir)), 8, "div", "curl")


_PLANE = "regr AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(v) AS sv, sum(x * v) AS sxv, sum(y * v) AS syv FROM q)"
_DET = "(sxx * (syy * n - sy * sy) - sxy * (sxy * n - sy * sx) + sx * (sxy * sy - syy * sx))"
_SOLVED = f"""SELECT round((sxv * (syy * n - sy * sy) - sxy * (syv * n - sy * sv) + sx * (syv * sy - syy * sv)) / {_DET}, 7) AS a,
round((sxx * (syv * n - sy * sv) - sxv * (sxy * n - sy * sx) + sx * (sxy * sv - syv * sx)) / {_DET}, 7) AS b,
round((sxx * (syy * sv - syv * sy) - sxy * (sxy * sv - syv * sx) + sxv * (sxy * sy - syy * sx)) / {_DET}, 7) AS c FROM regr"""


@query(f"WITH {d.MEANS}, q AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, fx AS v FROM m), {_PLANE} {_SOLVED}")
def plane_fit(spark, sf_dir):
    return rounded(fields.plane_fit(d.position_means(spark, sf_dir), "fx"), 7, "a", "b", "c")


@query(f"WITH {d.MEANS}, q AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, fy AS v FROM m WHERE (y < 3 OR y >= 7) AND (x < 4 OR x >= 8)), {_PLANE} {_SOLVED}")
def corner_plane(spark, sf_dir):
    where = corner_blocks(d.NY, d.NX, 0.3)(F.col("y"), F.col("x"))
    return rounded(fields.plane_fit(d.position_means(spark, sf_dir), "fy", where), 7, "a", "b", "c")


@query(f"WITH {d.MEANS}, q AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, fx AS v FROM m), {_PLANE}, s AS ({_SOLVED.replace('round(', '(').replace(', 7)', ')')}) SELECT round(m.fx - (s.a * m.x + s.b * m.y + s.c), 7) AS fx, m.y, m.x FROM m, s")
def field_minus_plane(spark, sf_dir):
    return rounded(fields.minus_plane(d.position_means(spark, sf_dir), columns=("fx",)), 7, "fx").select("y", "x", "fx")


@query(f"""WITH {d.MEANS}, q AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, fx AS v FROM m), {_PLANE}, s AS ({_SOLVED.replace('round(', '(').replace(', 7)', ')')}),
q2 AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, fy AS v FROM m), regr2 AS ({_PLANE[9:-1].replace('FROM q', 'FROM q2')}), s2 AS ({_SOLVED.replace('round(', '(').replace(', 7)', ')').replace('FROM regr', 'FROM regr2')})
SELECT 'fx' AS component, round(avg(fx), 7) AS mean, round(max(a * x + b * y + c) - min(a * x + b * y + c), 7) AS ramp, abs(avg(fx)) <= 0.25 AS centred FROM m, s
UNION ALL SELECT 'fy', round(avg(fy), 7), round(max(a * x + b * y + c) - min(a * x + b * y + c), 7), abs(avg(fy)) <= 0.25 FROM m, s2""")
def centring_report(spark, sf_dir):
    return rounded(fields.centring_report(d.position_means(spark, sf_dir)), 7, "mean", "ramp")


@query(f"WITH {d.MEANS} SELECT y, x, round(fy * cos(radians(210)) - fx * sin(radians(210)), 8) AS fx, round(fy * sin(radians(210)) + fx * cos(radians(210)), 8) AS fy FROM m")
def rotate_field(spark, sf_dir):
    return rounded(fields.rotate_field(d.position_means(spark, sf_dir), 30.0, True, True), 8, "fx", "fy").select("y", "x", "fx", "fy")


@query(f"""WITH {d.MEANS}, {_DC}, fm AS (SELECT y, x, fy AS fx, fx AS fy FROM m), fdc AS ({_DC[7:-1].replace('FROM m', 'FROM fm')}),
k AS (SELECT false AS flip, avg(div * div) AS dd, avg(div * curl) AS dc, avg(curl * curl) AS cc FROM dc UNION ALL SELECT true, avg(div * div), avg(div * curl), avg(curl * curl) FROM fdc),
w AS (SELECT flip, i * 0.5 AS angle, sqrt(greatest(0, sin(radians(i * 0.5)) ** 2 * dd + 2 * sin(radians(i * 0.5)) * cos(radians(i * 0.5)) * dc + cos(radians(i * 0.5)) ** 2 * cc)) AS score FROM k, range(720) r(i))
SELECT CAST(angle AS DOUBLE) AS angle, flip, round(score, 9) AS score, (SELECT round(score, 9) FROM w WHERE NOT flip AND angle = 0) AS baseline FROM w ORDER BY round(score, 12), w.flip, w.angle LIMIT 1""")
def rotation_estimate(spark, sf_dir):
    return rounded(fields.rotation_estimate(d.position_means(spark, sf_dir)), 9, "score", "baseline")


@query(f"WITH {d.MEANS}, p AS (SELECT y, x, sqrt(fx * fx + fy * fy) AS magnitude, atan2(fx, fy) - pi() / 6 AS t FROM m) SELECT y, x, round(magnitude, 8) AS magnitude, round(CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END, 7) AS phase FROM p")
def magnitude_phase(spark, sf_dir):
    out = fields.magnitude_phase(d.position_means(spark, sf_dir))
    return out.select("y", "x", F.round("magnitude", 8).alias("magnitude"), F.round("phase", 7).alias("phase"))


_PLANES = f"""q AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, fx AS v FROM m), {_PLANE}, s AS ({_SOLVED.replace('round(', '(').replace(', 7)', ')')}),
q2 AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, fy AS v FROM m), regr2 AS ({_PLANE[9:-1].replace('FROM q', 'FROM q2')}), s2 AS ({_SOLVED.replace('round(', '(').replace(', 7)', ')').replace('FROM regr', 'FROM regr2')})"""


@query(f"""WITH {d.MEANS}, {_PLANES}, c AS (SELECT m.y, m.x, m.fx - (s.a * m.x + s.b * m.y + s.c) AS fx, m.fy - (s2.a * m.x + s2.b * m.y + s2.c) AS fy FROM m, s, s2),
r AS (SELECT y, x, (fx * cos(radians(30)) - fy * sin(radians(30))) * {units.electric_field(0.1, 50.0, 200.0)!r} AS fx, (fx * sin(radians(30)) + fy * cos(radians(30))) * {units.electric_field(0.1, 50.0, 200.0)!r} AS fy FROM c),
{_DC.replace('dc AS', 'e AS').replace('FROM m', 'FROM r')}, p AS (SELECT y, x, fx, fy, sqrt(fx * fx + fy * fy) AS magnitude, atan2(fx, fy) - pi() / 6 AS t FROM r)
SELECT y, x, round(fx, 6) AS fx, round(fy, 6) AS fy, round(magnitude, 6) AS magnitude, round(CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END, 5) AS phase, round(div, 6) AS div, round(curl, 6) AS curl FROM p JOIN e USING (y, x)""")
def dpc_map(spark, sf_dir):
    out = fields.dpc_map(d.position_means(spark, sf_dir), 30.0, mrad_per_px=0.1, thickness_nm=50.0, energy_kev=200.0)
    return rounded(rounded(out, 6, "fx", "fy", "magnitude", "div", "curl"), 5, "phase").select("y", "x", "fx", "fy", "magnitude", "phase", "div", "curl")


_NEAR = "near AS (SELECT a.y, a.x, b.y AS ny, b.x AS nx FROM m a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), m b WHERE b.y = a.y + dy AND b.x = a.x + dx)"


@query(f"WITH {d.MEANS}, {_NEAR}, c AS (SELECT near.y, near.x, median(b.n) AS mid, count(*) AS k FROM near JOIN m b ON b.y = ny AND b.x = nx GROUP BY ALL) SELECT y, x, m.n > 1.05 * mid AS poor FROM m JOIN c USING (y, x)")
def poor_fits(spark, sf_dir):
    fits = d.position_means(spark, sf_dir).select("y", "x", F.col("n").cast("double").alias("chisq"), F.lit(True).alias("converged"))
    return neighbourhood.poor_fits(fits, 1.05).select("y", "x", "poor")


@query(f"""WITH {d.FRAMES}, c AS (SELECT y, x, unnest(frame)::DOUBLE AS v, generate_subscripts(frame, 1) AS i FROM f),
s AS (SELECT y, x, i, v - avg(v) OVER (PARTITION BY y, x) AS v FROM c), u AS (SELECT y, x, i, v / sqrt(sum(v * v) OVER (PARTITION BY y, x)) AS v FROM s),
p AS (SELECT a.y, a.x, sum(a.v * b.v) AS dot FROM u a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), u b WHERE b.y = a.y + dy AND b.x = a.x + dx AND a.i = b.i GROUP BY a.y, a.x, b.y, b.x)
SELECT y, x, round(avg(dot), 7) AS value FROM p GROUP BY ALL""")
def average_dot_product(spark, sf_dir):
    return rounded(neighbourhood.average_dot_product(d.frames(spark, sf_dir)), 7, "value")


@query("""WITH b AS (SELECT CAST(vec_id // 25 AS INT) AS y, CAST(vec_id % 25 AS INT) AS x, list_distinct(list_transform(embedding[1:6], lambda v: CAST(floor(v * 10) AS BIGINT))) AS m FROM embeddings),
p AS (SELECT a.y, a.x, len(list_intersect(a.m, c.m)) / len(a.m) AS s FROM b a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), b c WHERE c.y = a.y + dy AND c.x = a.x + dx)
SELECT y, x, round(avg(s), 9) AS value FROM p GROUP BY ALL""")
def orientation_similarity(spark, sf_dir):
    best = d.frames(spark, sf_dir).select("y", "x", F.array_distinct(F.transform(F.slice("frame", 1, 6), lambda v: F.floor(v.cast("double") * 10))).alias("matches"))
    return rounded(neighbourhood.orientation_similarity(best), 9, "value")


@query(f"""WITH {d.VECTORS}, p AS (SELECT nav_y AS y, nav_x AS x, kx AS px, ky AS py, ord FROM v), u AS (SELECT DISTINCT y, x, px, py FROM p),
n AS (SELECT a.y, a.x, a.px, a.py, count(DISTINCT o.k) AS hits FROM u a, (VALUES (0, 0, 1), (1, 0, -1), (2, 1, 0), (3, -1, 0)) o(k, dy, dx), u b
      WHERE b.y = a.y + dy AND b.x = a.x + dx AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 <= 0.05 * 0.05 GROUP BY ALL),
fr AS (SELECT DISTINCT y, x FROM p), fn AS (SELECT a.y, a.x, count(*) AS k FROM fr a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), fr b WHERE b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL)
SELECT p.y, p.x, p.ord FROM p LEFT JOIN n USING (y, x, px, py) LEFT JOIN fn USING (y, x) WHERE coalesce(fn.k, 0) < 3 OR coalesce(hits, 0) >= 3""")
def persistent_peaks(spark, sf_dir):
    v = d.vectors(spark, sf_dir).select(F.col("nav_y").alias("y"), F.col("nav_x").alias("x"), F.col("ky").alias("py"), F.col("kx").alias("px"), "ord")
    return neighbourhood.persistent(v, 0.05, 3).select("y", "x", "ord")


@query(f"""WITH {d.MEANS}, w AS (SELECT d, exp(-0.5 * (d / 0.8) ** 2) AS w FROM range(-3, 4) r(d)), k AS (SELECT d, w / sum(w) OVER () AS w FROM w),
gx AS (SELECT a.y, a.x, sum(b.fx * k.w) AS v FROM m a, k, m b WHERE b.y = a.y AND b.x = CASE WHEN a.x + d < 0 THEN -a.x - d - 1 WHEN a.x + d > 11 THEN 23 - a.x - d ELSE a.x + d END GROUP BY ALL)
SELECT a.y, a.x, round(sum(b.v * k.w), 8) AS value FROM gx a, k, gx b WHERE b.x = a.x AND b.y = CASE WHEN a.y + d < 0 THEN -a.y - d - 1 WHEN a.y + d > 9 THEN 19 - a.y - d ELSE a.y + d END GROUP BY a.y, a.x""")
def scan_blur(spark, sf_dir):
    m = d.position_means(spark, sf_dir).select("y", "x", F.col("fx").alias("value"))
    return rounded(neighbourhood.blur(m, 0.8, d.NY, d.NX), 8, "value")


@query(f"WITH {d.MEANS}, n AS (SELECT a.y, a.x, median(b.fx) AS value FROM m a, m b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT y, x, round(value, 9) AS value FROM n")
def median_filter(spark, sf_dir):
    m = d.position_means(spark, sf_dir).select("y", "x", F.col("fx").alias("value"))
    return rounded(neighbourhood.median_filter(m), 9, "value")


@query("""WITH g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(10) a(y), range(12) b(x))
SELECT y, x, (SELECT c FROM (VALUES (0), (4), (8), (9)) n(c) ORDER BY abs(y - c), c LIMIT 1) AS seed_y, (SELECT c FROM (VALUES (0), (4), (8), (11)) n(c) ORDER BY abs(x - c), c LIMIT 1) AS seed_x FROM g""")
def coarse_seeds(spark, sf_dir):
    from ..operators.grid import nav_grid

    g = nav_grid(spark, y=d.NY, x=d.NX)
    near = neighbourhood.nearest_coarse
    return g.select("y", "x", near(F.col("y"), neighbourhood.coarse_nodes(d.NY, 4)).alias("seed_y"), near(F.col("x"), neighbourhood.coarse_nodes(d.NX, 4)).alias("seed_x"))


# matching ----------------------------------------------------------------

_REFS = [(i, x, y) for i, (x, y) in enumerate([(0.5, 0.0), (0.0, 0.6), (0.5, 0.6), (0.5, -0.6), (0.9, 0.2), (0.02, 0.0)])]
_REF_SQL = "refs(ref, gx, gy) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, x, y in _REFS) + ")"


def _refs(spark):
    return spark.createDataFrame(_REFS, "ref int, gx double, gy double")


_KEPT = "kept AS (SELECT * FROM refs WHERE sqrt(gx * gx + gy * gy) > 0.25 * (SELECT median(sqrt(gx * gx + gy * gy)) FROM refs WHERE gx <> 0 OR gy <> 0))"
_ROT = "cos(radians(15)) AS c, sin(radians(15)) AS s"
_MATCH = f"""{_KEPT}, s AS (SELECT ref, gx, gy, 0 AS neg FROM kept UNION ALL SELECT ref, -gx, -gy, 1 FROM kept),
c AS (SELECT rid, nav_y, nav_x, ord, kx, ky, ref, gx, gy, neg, sqrt((kx - gx) * (kx - gx) + (ky - gy) * (ky - gy)) AS distance FROM (SELECT *, row_number() OVER () AS rid FROM v), s),
n AS (SELECT * FROM c WHERE distance < 0.2 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY round(distance, 12), ref, neg) = 1)"""


def _matched(spark, sf_dir):
    refs = matching.zero_beam_filtered(_refs(spark))
    return matching.nearest_within(d.vectors(spark, sf_dir), refs, 0.2)


@query(f"WITH {d.VECTORS}, {_REF_SQL}, {_KEPT} SELECT ref, gx, gy FROM kept")
def zero_beam_filter(spark, sf_dir):
    return matching.zero_beam_filtered(_refs(spark))


@query(f"WITH {d.VECTORS}, {_REF_SQL}, {_MATCH} SELECT nav_y, nav_x, count(*) AS n, round(sum(distance), 6) AS total FROM n GROUP BY ALL")
def nearest_match(spark, sf_dir):
    return _matched(spark, sf_dir).groupBy("nav_y", "nav_x").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 6).alias("total"))


@query(f"WITH {d.VECTORS}, {_REF_SQL}, {_MATCH} SELECT nav_y, nav_x, count(DISTINCT ref) / 5 AS coverage FROM n GROUP BY ALL")
def match_coverage(spark, sf_dir):
    return matching.coverage(_matched(spark, sf_dir), 5)


@query("""WITH p AS (SELECT s_suppkey AS k, abs(s_acctbal) / 1000 AS magnitude FROM supplier), f AS (SELECT k, magnitude, (SELECT c FROM (VALUES (1.0::DOUBLE), (2.0), (4.0), (8.0)) n(c) ORDER BY abs(c - magnitude), c LIMIT 1) AS family FROM p)
SELECT k, family FROM f WHERE abs(family - magnitude) <= 0.15 * family""")
def nearest_family(spark, sf_dir):
    p = d.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.abs("s_acctbal") / 1000).alias("magnitude"))
    return matching.nearest_family(p, [1.0, 2.0, 4.0, 8.0], 0.15).select("k", "family")


@query(f"""WITH {d.VECTORS}, w AS (SELECT *, row_number() OVER () AS rid FROM v), q AS (SELECT DISTINCT a.rid FROM w a JOIN w b ON a.nav_y = b.nav_y AND a.nav_x = b.nav_x AND a.ord <> b.ord AND sqrt((a.kx + b.kx) * (a.kx + b.kx) + (a.ky + b.ky) * (a.ky + b.ky)) <= 0.1137) SELECT w.nav_y, w.nav_x, w.ord, q.rid IS NOT NULL AS paired FROM w LEFT JOIN q USING (rid)""")
def friedel_pairs(spark, sf_dir):
    return matching.friedel_pairs(d.vectors(spark, sf_dir), 0.1137).select("nav_y", "nav_x", "ord", "paired")


_POINTS = "p AS (SELECT p_partkey AS id, (p_partkey * 7919 % 1009)::DOUBLE AS x, (p_partkey * 104729 % 997)::DOUBLE AS y FROM part)"


def _points(spark, sf_dir):
    k = F.col("p_partkey")
    return d.read(spark, sf_dir, "part").select(k.alias("id"), (k * 7919 % 1009).cast("double").alias("x"), (k * 104729 % 997).cast("double").alias("y"))


@query(f"WITH {_POINTS} SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id)::INT AS rank, b.id AS n_id FROM p a, p b WHERE a.id <> b.id QUALIFY rank <= 4")
def k_nearest(spark, sf_dir):
    return matching.k_nearest_all(_points(spark, sf_dir), 4, 16.0).select("id", "rank", "n_id")


@query(f"WITH {d.VECTORS}, s AS (SELECT nav_y, nav_x, avg(kx) AS sx, avg(ky) AS sy FROM v GROUP BY ALL) SELECT ord, round(kx - sx, 8) AS kx, round(ky - sy, 8) AS ky FROM v JOIN s USING (nav_y, nav_x)")
def shift_vectors(spark, sf_dir):
    v = d.vectors(spark, sf_dir)
    s = v.groupBy("nav_y", "nav_x").agg(F.avg("kx").alias("sx"), F.avg("ky").alias("sy"))
    return rounded(matching.shift_vectors(v, s), 8, "kx", "ky").select("ord", "kx", "ky")


@query(f"""WITH {d.VECTORS}, i AS (SELECT * FROM v WHERE abs(kx) <= 0.3 AND abs(ky) <= 0.3), t AS (SELECT nav_y, nav_x, kx AS ox, ky AS oy, intensity AS b FROM i QUALIFY row_number() OVER (PARTITION BY nav_y, nav_x ORDER BY intensity DESC, ord) = 1),
r AS (SELECT nav_y, nav_x, any_value(b) AS a, max(intensity) FILTER (WHERE sqrt((kx - ox) ** 2 + (ky - oy) ** 2) > 0.5) AS o FROM v JOIN t USING (nav_y, nav_x) GROUP BY ALL) SELECT round(median(a / o), 8) AS value FROM r WHERE o IS NOT NULL""")
def beam_contrast(spark, sf_dir):
    return rounded(matching.beam_contrast(d.vectors(spark, sf_dir), Box(0, 0, 0.3), 0.5), 8, "value")


@query(f"WITH {d.VECTORS} SELECT nav_y, nav_x, ord FROM v WHERE (nav_y, nav_x) IN (SELECT (nav_y, nav_x) FROM v GROUP BY nav_y, nav_x HAVING count(*) >= 500)")
def positions_with_enough(spark, sf_dir):
    return matching.positions_with(d.vectors(spark, sf_dir), 500).select("nav_y", "nav_x", "ord")


@query(f"WITH {d.VECTORS}, h AS (SELECT CAST(floor(sqrt(kx * kx + ky * ky) / 0.07) AS INT) AS bin FROM v) SELECT bin, count(*) AS n FROM h WHERE bin < 15 GROUP BY ALL")
def ring_histogram(spark, sf_dir):
    return matching.ring_histogram(d.vectors(spark, sf_dir), 0.07, 1.05)


@query(f"""WITH {d.VECTORS}, h AS (SELECT CAST(floor(sqrt(kx * kx + ky * ky) / 0.07) AS INT) AS bin, count(*) AS n FROM v GROUP BY ALL), f AS (SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM range(15) r(b) LEFT JOIN h ON h.bin = b),
w AS (SELECT bin, n, coalesce(lag(n) OVER (ORDER BY bin), 0) AS l, coalesce(lead(n) OVER (ORDER BY bin), 0) AS r, max(n) OVER () AS top FROM f) SELECT bin, n FROM w WHERE n > l AND n >= r AND n >= 0.2 * top ORDER BY n DESC, bin LIMIT 3""")
def ring_peaks(spark, sf_dir):
    return matching.ring_peaks(matching.ring_histogram(d.vectors(spark, sf_dir), 0.07, 1.05), 0.2, 3, 15)


@query("""WITH t AS (SELECT CAST(i AS DOUBLE) / 4 AS t FROM range(-2, 40) r(i)), p AS (SELECT CAST(r_regionkey * 2 AS DOUBLE) AS t, CAST(r_regionkey * r_regionkey AS DOUBLE) AS value FROM region)
SELECT t, round(CASE WHEN t <= 0 THEN 0 WHEN t >= 8 THEN 16 ELSE (SELECT a.value + (b.value - a.value) * (q.t - a.t) / 2 FROM p a JOIN p b ON b.t = a.t + 2 WHERE q.t >= a.t AND q.t < b.t) END, 8) AS value FROM t q""")
def interpolated_trace(spark, sf_dir):
    trace = d.read(spark, sf_dir, "region").select((F.col("r_regionkey") * 2).cast("double").alias("t"), (F.col("r_regionkey") * F.col("r_regionkey")).cast("double").alias("value"))
    times = spark.range(-2, 40).select((F.col("id").cast("double") / 4).alias("t"))
    return rounded(matching.interpolated(times, trace), 8, "value")


@query(f"""WITH {d.VECTORS}, {_REF_SQL}, {_MATCH}, o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY nav_y, nav_x, ref ORDER BY distance, ord) = 1),
g AS (SELECT nav_y, nav_x, count(*) AS n_matched, count(DISTINCT ref) / 5 AS coverage FROM o GROUP BY ALL), gr AS (SELECT CAST(y AS INT) AS nav_y, CAST(x AS INT) AS nav_x FROM range(10) a(y), range(12) b(x))
SELECT nav_y, nav_x, coalesce(n_matched, 0) AS n_matched, coalesce(coverage, 0) AS coverage FROM gr LEFT JOIN g USING (nav_y, nav_x)""")
def strain_matches(spark, sf_dir):
    refs = matching.zero_beam_filtered(_refs(spark))
    return strain.strain_map(d.vectors(spark, sf_dir), refs, 0.2, d.GRID, 5).select("nav_y", "nav_x", "n_matched", "coverage")


def _solved3(u: str) -> list[str]:
    """Cramer's rule for the affine map's row whose right side is xu, yu, u."""
    det = "(xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x))"
    xu, yu, uu = f"x{u}", f"y{u}", u
    return [f"({xu} * (yy * n - y * y) - xy * ({yu} * n - y * {uu}) + x * ({yu} * y - yy * {uu})) / {det}", f"(xx * ({yu} * n - y * {uu}) - {xu} * (xy * n - y * x) + x * (xy * {uu} - {yu} * x)) / {det}"]


_T = ", ".join(f"{e} AS {n}" for e, n in zip(_solved3("u") + _solved3("v"), ("t00", "t01", "t10", "t11"), strict=True))


@query(f"""WITH {d.VECTORS}, {_REF_SQL}, {_MATCH}, o AS (SELECT *, CASE neg WHEN 1 THEN -gx ELSE gx END AS g0, CASE neg WHEN 1 THEN -gy ELSE gy END AS g1 FROM (SELECT nav_y, nav_x, ord, kx, ky, ref, neg, distance, CASE neg WHEN 1 THEN -gx ELSE gx END AS gx, CASE neg WHEN 1 THEN -gy ELSE gy END AS gy FROM n) QUALIFY row_number() OVER (PARTITION BY nav_y, nav_x, ref ORDER BY distance, ord, neg) = 1),
f AS (SELECT nav_y, nav_x, sum(g0 * g0) AS xx, sum(g0 * g1) AS xy, sum(g0) AS x, sum(g1 * g1) AS yy, sum(g1) AS y, count(*)::DOUBLE AS n, sum(g0 * kx) AS xu, sum(g1 * kx) AS yu, sum(kx) AS u, sum(g0 * ky) AS xv, sum(g1 * ky) AS yv, sum(ky) AS v FROM o GROUP BY ALL),
t AS (SELECT nav_y, nav_x, n, {_T} FROM f), g AS (SELECT nav_y, nav_x, n, t11 / det AS f00, -t10 / det AS f01, -t01 / det AS f10, t00 / det AS f11 FROM (SELECT *, t00 * t11 - t01 * t10 AS det FROM t) WHERE n >= 3),
m AS (SELECT *, f00 * f00 + f10 * f10 AS m00, f00 * f01 + f10 * f11 AS m01, f01 * f01 + f11 * f11 AS m11 FROM g), q AS (SELECT *, sqrt(greatest(0, m00 * m11 - m01 * m01)) AS root FROM m), w AS (SELECT *, sqrt(greatest(0, m00 + m11 + 2 * root)) AS trace FROM q),
z AS (SELECT nav_y, nav_x, (m00 + root) / trace - 1 AS xx, (m11 + root) / trace - 1 AS yy, m01 / trace AS xy, {_ROT} FROM w),
e AS (SELECT nav_y, nav_x, c * c * xx - 2 * c * s * xy + s * s * yy AS exx, s * s * xx + 2 * c * s * xy + c * c * yy AS eyy, c * s * (xx - yy) + (c * c - s * s) * xy AS exy FROM z), gr AS (SELECT CAST(y AS INT) AS nav_y, CAST(x AS INT) AS nav_x FROM range(10) a(y), range(12) b(x))
SELECT nav_y, nav_x, round(exx, 6) AS exx, round(eyy, 6) AS eyy, round(exy, 6) AS exy, round((exx + eyy) / 2 + sqrt(((exx - eyy) / 2) ** 2 + exy * exy), 6) AS e1 FROM gr LEFT JOIN e USING (nav_y, nav_x)""")
def strain_map(spark, sf_dir):
    out = strain.principal(strain.rotate_tensor(strain.strain_map(d.vectors(spark, sf_dir), matching.zero_beam_filtered(_refs(spark)), 0.2, d.GRID, 5), 15.0))
    return rounded(out, 6, "exx", "eyy", "exy", "e1").select("nav_y", "nav_x", "exx", "eyy", "exy", "e1")


def _robust_sql(rounds: int) -> str:
    """Tables t1, w1, ..., t<rounds>: the solved map under the weights of each round, and the weights that follow."""
    sums = "sum(w * g0 * g0) AS xx, sum(w * g0 * g1) AS xy, sum(w * g0) AS x, sum(w * g1 * g1) AS yy, sum(w * g1) AS y, sum(w) AS n, sum(w * g0 * kx) AS xu, sum(w * g1 * kx) AS yu, sum(w * kx) AS u, sum(w * g0 * ky) AS xv, sum(w * g1 * ky) AS yv, sum(w * ky) AS v, count(*) AS rows"
    out = ["w0 AS (SELECT nav_y, nav_x, ord, kx, ky, g0, g1, 1.0::DOUBLE AS w FROM o)"]
    for i in range(rounds):
        out.append(f"f{i} AS (SELECT nav_y, nav_x, {sums} FROM w{i} GROUP BY ALL), t{i} AS (SELECT nav_y, nav_x, rows, {_T}, (u - t00 * x - t01 * y) / n AS tx, (v - t10 * x - t11 * y) / n AS ty FROM f{i})")
        far = "sqrt((kx - t00 * g0 - t01 * g1 - tx) ** 2 + (ky - t10 * g0 - t11 * g1 - ty) ** 2)"
        out.append(f"r{i} AS (SELECT a.*, {far} AS r FROM w{i} a JOIN t{i} USING (nav_y, nav_x)), s{i} AS (SELECT *, 1.4826 * median(r) OVER p AS scale FROM r{i} WINDOW p AS (PARTITION BY nav_y, nav_x))")
        out.append(f"n{i} AS (SELECT *, greatest(0, 1 - (r / (4.685 * greatest(scale, 1e-12))) ** 2) ** 2 AS v FROM s{i})")
        out.append(f"w{i + 1} AS (SELECT nav_y, nav_x, ord, kx, ky, g0, g1, CASE WHEN scale >= 1e-12 AND count(*) FILTER (v > 0) OVER p >= 3 THEN v ELSE w END AS w FROM n{i} WINDOW p AS (PARTITION BY nav_y, nav_x))")
    return ",\n".join(out)


_ONE = """o AS (SELECT *, gx AS g0, gy AS g1 FROM (SELECT nav_y, nav_x, ord, kx, ky, ref, neg, distance, gx, gy FROM n) QUALIFY row_number() OVER (PARTITION BY nav_y, nav_x, ref ORDER BY distance, ord, neg) = 1)"""


@query(f"""WITH {d.VECTORS}, {_REF_SQL}, {_MATCH}, {_ONE}, {_robust_sql(10)},
g AS (SELECT nav_y, nav_x, t11 / det AS f00, -t10 / det AS f01, -t01 / det AS f10, t00 / det AS f11 FROM (SELECT *, t00 * t11 - t01 * t10 AS det FROM t9) WHERE rows >= 3),
m AS (SELECT *, f00 * f00 + f10 * f10 AS m00, f00 * f01 + f10 * f11 AS m01, f01 * f01 + f11 * f11 AS m11 FROM g), q AS (SELECT *, sqrt(greatest(0, m00 * m11 - m01 * m01)) AS root FROM m), z AS (SELECT *, sqrt(greatest(0, m00 + m11 + 2 * root)) AS trace FROM q),
gr AS (SELECT CAST(y AS INT) AS nav_y, CAST(x AS INT) AS nav_x FROM range(10) a(y), range(12) b(x)),
e AS (SELECT nav_y, nav_x, round((m00 + root) / trace - 1, 5) AS exx, round((m11 + root) / trace - 1, 5) AS eyy, round(m01 / trace, 5) AS exy FROM z)
SELECT nav_y, nav_x, CASE WHEN exx = 0 THEN 0 ELSE exx END AS exx, CASE WHEN eyy = 0 THEN 0 ELSE eyy END AS eyy, CASE WHEN exy = 0 THEN 0 ELSE exy END AS exy FROM gr LEFT JOIN e USING (nav_y, nav_x)""")
def robust_strain_map(spark, sf_dir):
    out = strain.robust_strain_map(d.vectors(spark, sf_dir), matching.zero_beam_filtered(_refs(spark)), 0.2, d.GRID)
    # no negative zeros
    return rounded(out, 5, "exx", "eyy", "exy").select("nav_y", "nav_x", *[F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) for c in ("exx", "eyy", "exy")])


@query(f"""WITH {d.VECTORS}, {_REF_SQL}, {_KEPT}, a AS (SELECT v.*, kx - avg(kx) OVER p AS cx, ky - avg(ky) OVER p AS cy FROM v WINDOW p AS (PARTITION BY nav_y, nav_x)),
c AS (SELECT ref, gx - avg(gx) OVER () AS gx, gy - avg(gy) OVER () AS gy FROM kept), s0 AS (SELECT gx, gy FROM kept UNION ALL SELECT -gx, -gy FROM kept), s1 AS (SELECT gx, gy FROM c UNION ALL SELECT -gx, -gy FROM c),
h AS (SELECT nav_y, nav_x, EXISTS (SELECT 1 FROM s0 WHERE sqrt((kx - gx) ** 2 + (ky - gy) ** 2) < 0.2) AS raw, EXISTS (SELECT 1 FROM s1 WHERE sqrt((cx - gx) ** 2 + (cy - gy) ** 2) < 0.2) AS centred FROM a)
SELECT nav_y, nav_x, count(*) FILTER (raw) > count(*) FILTER (centred) AS raw, greatest(count(*) FILTER (raw), count(*) FILTER (centred)) AS n FROM h GROUP BY ALL HAVING n > 0""")
def chosen_alignments(spark, sf_dir):
    refs = matching.zero_beam_filtered(_refs(spark))
    return strain.aligned_matches(d.vectors(spark, sf_dir), refs, 0.2).groupBy("nav_y", "nav_x", "raw").agg(F.count("*").alias("n"))


@query(f"WITH {d.VECTORS}, s AS (SELECT nav_y, nav_x, ord, CASE WHEN ord % 3 = 0 THEN NULL ELSE 0.01 + (ord % 10) / 100 END AS sigma, confidence FROM v), w AS (SELECT ord, confidence / (sigma * sigma + 0.0025) AS w FROM s) SELECT ord, round(coalesce(w, (SELECT median(w) FROM w)), 5) AS weight FROM w")
def vector_weights(spark, sf_dir):
    v = d.vectors(spark, sf_dir).withColumn("sigma", F.when(F.col("ord") % 3 != 0, 0.01 + (F.col("ord") % 10) / 100))
    return rounded(strain.vector_weights(v, 0.05), 5, "weight").select("ord", "weight")


@query("SELECT p_partkey AS k, trim(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '_') AS slug FROM part")
def name_slugs(spark, sf_dir):
    return d.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), units.slug(F.col("p_name")).alias("slug"))


@query(f"WITH {d.VECTORS} SELECT ord, round(kx * 0.1, 8) AS qx, round(2 / {units.wavelength(200.0)!r} * sin(atan(abs(ky) / 100) / 2), 8) AS g FROM v")
def reciprocal_units(spark, sf_dir):
    v = d.vectors(spark, sf_dir)
    return v.select("ord", F.round(units.convert(F.col("kx"), "1/nm", "1/Å"), 8).alias("qx"), F.round(units.flat_detector(F.abs("ky"), 100.0, 200.0), 8).alias("g"))
