"""Queries over multi-angle, phase and refinement operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..axes import Axis, nearest_node
from ..functions import units
from ..operators import matching, multiangle, orientation, phases, refine
from ..operators.grid import nav_grid
from ..sources import synthetic
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


@query()
def member_offsets(spark, sf_dir):
    return multiangle.solve_offsets(synthetic.tilt_members(spark), (32, 36), 0, 6.0)


@query()
def member_votes(spark, sf_dir):
    return multiangle.patch_votes(synthetic.tilt_members(spark), (32, 36), 0, 24, 4, 4.0)


_M = "m AS (SELECT CAST(s_suppkey AS INT) AS member, CAST(s_suppkey % 4 AS DOUBLE) / 2 AS tilt, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS azimuth FROM supplier)"


def _members(spark, sf_dir):
    k = F.col("s_suppkey")
    return d.read(spark, sf_dir, "supplier").select(k.cast("int").alias("member"), ((k % 4).cast("double") / 2).alias("tilt"), (k * 37 % 360).cast("double").alias("azimuth"))


@query(f"WITH {_M} SELECT member, CAST(CASE WHEN tilt <= 0.6 THEN 0 ELSE 1 END AS INT) AS shell FROM m")
def tilt_shells(spark, sf_dir):
    return multiangle.with_shells(_members(spark, sf_dir), 0.6).select("member", "shell")


@query(f"WITH {_M}, s AS (SELECT tilt, CAST(CASE WHEN tilt <= 0.6 THEN 0 ELSE 1 END AS INT) AS shell FROM m) SELECT shell, round(avg(tilt), 9) AS radius, count(*) AS n FROM s GROUP BY shell")
def shell_radii(spark, sf_dir):
    return rounded(multiangle.shell_radii(multiangle.with_shells(_members(spark, sf_dir), 0.6)), 9, "radius")


@query(f"WITH {_M}, p AS (SELECT *, tilt * sin(radians(azimuth)) AS x, tilt * cos(radians(azimuth)) AS y FROM m) SELECT member FROM p ORDER BY (x - 0.3) ** 2 + (y - 0.8) ** 2, member LIMIT 1")
def nearest_member(spark, sf_dir):
    return multiangle.nearest_member(_members(spark, sf_dir), 0.3, 0.8).select("member")


@query("""WITH r(ref, gx, gy) AS (VALUES (0, 1.0::DOUBLE, 0.02::DOUBLE), (1, 0.0, 1.43), (2, 3.0, 3.0)), m AS (SELECT *, sqrt(gx * gx + gy * gy) AS n FROM r), f AS (SELECT *, (SELECT c FROM (VALUES (1.0::DOUBLE), (1.4142), (2.0)) t(c) ORDER BY abs(c - n), c LIMIT 1) AS fam FROM m)
SELECT ref, round(gx * fam / n, 9) AS gx, round(gy * fam / n, 9) AS gy FROM f WHERE abs(fam - n) <= 0.05 * fam""")
def snapped_reference(spark, sf_dir):
    r = spark.createDataFrame([(0, 1.0, 0.02), (1, 0.0, 1.43), (2, 3.0, 3.0)], "ref int, gx double, gy double")
    return rounded(phases.snapped(r, [1.0, 1.4142, 2.0], 0.05), 9, "gx", "gy")


@query(f"""WITH {d.VECTORS}, c AS (SELECT CAST(floor(kx / 0.4 + 0.5) AS BIGINT) AS cx, CAST(floor(ky / 0.4 + 0.5) AS BIGINT) AS cy, count(DISTINCT (nav_y, nav_x)) AS n, avg(kx) AS gx, avg(ky) AS gy FROM v GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY n DESC, cx, cy) - 1 AS INT) AS ref, round(gx, 9) AS gx, round(gy, 9) AS gy, n FROM c WHERE n >= 0.9 * (SELECT count(DISTINCT (nav_y, nav_x)) FROM v)""")
def consensus_reference(spark, sf_dir):
    return rounded(phases.consensus(d.vectors(spark, sf_dir), 0.4, 0.9), 9, "gx", "gy")


@query(f"""WITH {d.VECTORS}, p AS (SELECT kx, ky, count(*) AS times FROM v GROUP BY ALL), e AS (SELECT a.kx, a.ky, sum(b.times) AS s FROM p a JOIN p b ON (a.kx - b.kx) ** 2 + (a.ky - b.ky) ** 2 <= 0.0625 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY s DESC, kx, ky) AS i FROM e),
h AS (SELECT unnest(ids) AS i FROM (WITH RECURSIVE r(i, ids, ys, xs) AS (SELECT 0::BIGINT, []::BIGINT[], []::DOUBLE[], []::DOUBLE[] UNION ALL
SELECT o.i, CASE WHEN t.ok THEN list_append(ids, o.i) ELSE ids END, CASE WHEN t.ok THEN list_append(ys, o.ky) ELSE ys END, CASE WHEN t.ok THEN list_append(xs, o.kx) ELSE xs END
FROM r JOIN o ON o.i = r.i + 1, LATERAL (SELECT len(list_filter(range(1, len(ids) + 1), lambda k: (ys[k] - o.ky) ** 2 + (xs[k] - o.kx) ** 2 <= 0.0625)) = 0 AS ok) t)
SELECT ids FROM r ORDER BY i DESC LIMIT 1)),
a AS (SELECT o.kx, o.ky, min(k.i) AS head FROM o JOIN h ON true JOIN o k ON k.i = h.i AND (k.ky - o.ky) ** 2 + (k.kx - o.kx) ** 2 <= 0.0625 GROUP BY ALL),
c AS (SELECT head, count(DISTINCT (nav_y, nav_x)) AS n, median(v.kx) AS gx, median(v.ky) AS gy FROM v JOIN a USING (kx, ky) GROUP BY head)
SELECT CAST(row_number() OVER (ORDER BY head) - 1 AS INT) AS ref, round(gx, 9) AS gx, round(gy, 9) AS gy, n FROM c WHERE n >= greatest(2, ceil(0.9 * (SELECT count(DISTINCT (nav_y, nav_x)) FROM v)))""")
def ball_consensus_reference(spark, sf_dir):
    return rounded(phases.ball_consensus(d.vectors(spark, sf_dir), 0.25, 0.9), 9, "gx", "gy")


@query("SELECT * FROM (VALUES ('cubic', 3), ('other', 2)) t(phase, matched)")
def phase_of_rings(spark, sf_dir):
    got = phases.match_rings([1.0, 1.155, 1.633], {"cubic": [1.7321, 2.0, 2.8284], "other": [1.0, 2.5, 4.1]})
    return spark.createDataFrame([(n, m) for n, _, _, m in got], "phase string, matched int")


@query("""WITH g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, (x + 0.5) / 20 - 0.5 AS gx, 0.4 - (y + 0.5) / 16 AS gy FROM range(16) a(y), range(20) b(x)), r AS (SELECT y, x, gx / sqrt(gx * gx + gy * gy + 0.49) AS rx, gy / sqrt(gx * gx + gy * gy + 0.49) AS ry, 0.7 / sqrt(gx * gx + gy * gy + 0.49) AS rz FROM g)
SELECT y, x, CASE WHEN abs(rx) <= 0.2 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN abs((rx + ry) / sqrt(2)) <= 0.1 THEN 2.0 ELSE 0 END AS value FROM r""")
def band_pattern(spark, sf_dir):
    rays = orientation.detector_rays(nav_grid(spark, y=16, x=20), (0.5, 0.4, 0.7), 16, 20, 0.0)
    return phases.band_image(rays, [(1, 0, 0, 0.2, 1.0), (1, 1, 0, 0.1, 2.0)])


@query("SELECT CAST(n AS BIGINT) AS n, w FROM (VALUES (3, 1.0::DOUBLE)) t(n, w)")
def band_zone_axes(spark, sf_dir):
    b = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "id int, nx double, ny double, nz double")
    return orientation.zone_axes(b, 3, 5).select("n", "w")


@query("SELECT CAST(a * 100 + b * 10 + c AS BIGINT) AS id, a * 10.0::DOUBLE AS phi1, b * 10.0::DOUBLE AS big_phi, c * 10.0::DOUBLE AS phi2 FROM range(10) x(a), range(10) y(b), range(10) z(c)")
def orientation_grid(spark, sf_dir):
    return phases.euler_grid(spark, 10.0)


@query("SELECT 'Gaussian|A,centre|true,true' AS signature, 'g1,g2' AS members, CAST(2 AS BIGINT) AS n")
def exchangeable_components(spark, sf_dir):
    c = spark.createDataFrame([("g1", "Gaussian", ["A", "centre"], [True, True]), ("g2", "Gaussian", ["A", "centre"], [True, True]), ("g3", "Gaussian", ["A", "centre"], [True, False]), ("o", "Offset", ["offset"], [True])], "name string, kind string, parameters array<string>, free array<boolean>")
    return phases.exchangeable(c).select("signature", F.concat_ws(",", "members").alias("members"), "n")


@query("SELECT 'Fe,O,Ti' AS elements")
def composition_elements(spark, sf_dir):
    p = spark.createDataFrame([(0, ["Fe", "O", "C"], ["C"]), (1, ["O", "Ti"], [])], "phase int, elements array<string>, trace array<string>")
    return phases.composition_elements(p).select(F.concat_ws(",", "elements").alias("elements"))


@query(f"WITH {d.VECTORS} SELECT DISTINCT CAST(greatest(0, least(4, round_even((0.5 + nav_x * 0.25 - 0.4) / 0.6, 0))) AS INT) AS node FROM v")
def grid_translation(spark, sf_dir):
    return d.vectors(spark, sf_dir).select(nearest_node(Axis("x", 12, 0.25, 0.5), Axis("x", 5, 0.6, 0.4), F.col("nav_x")).alias("node")).distinct()


@query("SELECT n_nationkey AS k, regexp_replace(n_name, '[^0-9a-zA-Z_]+', '_', 'g') AS name FROM nation")
def identifiers(spark, sf_dir):
    return d.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), units.identifier(F.col("n_name")).alias("name"))


@query()
def friedel_centres(spark, sf_dir):
    return refine.friedel_centres(d.vectors(spark, sf_dir))


@query(f"WITH {d.VECTORS} SELECT ord, (kx - 0.2) ** 2 + ky ** 2 <= 0.09 OR (kx + 0.5) ** 2 + (ky - 0.5) ** 2 <= 0.01 AS inside FROM v")
def inside_circles(spark, sf_dir):
    v = d.vectors(spark, sf_dir).select("ord", F.col("kx").alias("px"), F.col("ky").alias("py"))
    return v.select("ord", matching.in_any_circle(v, [(0.2, 0.0, 0.3), (-0.5, 0.5, 0.1)]).alias("inside"))
