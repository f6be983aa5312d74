"""Queries over spectra, atoms and orientations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.components import Component, Model, column
from ..operators import atoms, orientation, spectra
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


def _spectra(spark, sf_dir):
    return d.frames(spark, sf_dir).select("y", "x", F.transform("frame", lambda v: v.cast("double")).alias("spectrum"))


_CH = f"{d.FRAMES}, c AS (SELECT y, x, CAST(i - 1 AS INT) AS i, CAST(frame[i] AS DOUBLE) AS v, 2.0::DOUBLE + 0.5 * (i - 1) AS e FROM f, range(1, 65) r(i))"


@query(f"WITH {_CH} SELECT y, x, round(regr_slope(v, e), 8) AS slope, round(regr_intercept(v, e), 8) AS intercept FROM c WHERE i >= 10 AND i < 30 GROUP BY ALL")
def background_line(spark, sf_dir):
    return rounded(spectra.line_fit(_spectra(spark, sf_dir), 10, 30, (2.0, 0.5)), 8, "slope", "intercept")


@query(f"WITH {_CH}, l AS (SELECT y, x, regr_slope(v, e) AS s, regr_intercept(v, e) AS t FROM c WHERE i >= 10 AND i < 30 GROUP BY ALL) SELECT y, x, round(sum((v - (s * e + t)) * (i + 1)), 5) AS code FROM c JOIN l USING (y, x) GROUP BY ALL")
def background_removed(spark, sf_dir):
    out = spectra.remove_line(_spectra(spark, sf_dir), 10, 30, (2.0, 0.5))
    code = F.aggregate(F.transform("spectrum", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("y", "x", code.alias("code")), 5, "code")


@query(f"WITH {_CH} SELECT y, x, round((sum(v) - (any_value(v) FILTER (WHERE i = 0) + any_value(v) FILTER (WHERE i = 63)) / 2) * 0.5, 7) AS area FROM c GROUP BY ALL")
def curve_area(spark, sf_dir):
    return rounded(spectra.curve_area(_spectra(spark, sf_dir), 0.5), 7, "area")


_LINES = """l AS (SELECT CAST(l_suppkey % 10 AS INT) AS y, CAST(l_partkey % 12 AS INT) AS x,
    CASE l_orderkey % 4 WHEN 0 THEN 'Fe_Ka' WHEN 1 THEN 'Fe_Kb' WHEN 2 THEN 'Ni_Ka' ELSE 'background' END AS component, l_extendedprice - 5000 AS intensity FROM lineitem)"""


def _lines(spark, sf_dir):
    k = F.col("l_orderkey") % 4
    name = F.when(k == 0, "Fe_Ka").when(k == 1, "Fe_Kb").when(k == 2, "Ni_Ka").otherwise("background")
    return d.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("y"), (F.col("l_partkey") % 12).cast("int").alias("x"), name.alias("component"), (F.col("l_extendedprice") - 5000).alias("intensity"))


_MAPS = f"{_LINES}, e AS (SELECT y, x, regexp_extract(component, '^([A-Z][a-z]?)_', 1) AS element, sum(greatest(intensity, 0)) AS intensity FROM l WHERE component <> 'background' GROUP BY ALL)"


@query(f"WITH {_MAPS} SELECT y, x, element, round(intensity, 3) AS intensity FROM e")
def element_maps(spark, sf_dir):
    return rounded(spectra.element_maps(_lines(spark, sf_dir)), 3, "intensity")


def _quantified(method: str, factor: str):
    sql = f"WITH {_MAPS}, w AS (SELECT y, x, element, intensity {factor} AS w FROM e) SELECT y, x, element, CASE WHEN sum(w) OVER (PARTITION BY y, x) > 0 THEN round(w / sum(w) OVER (PARTITION BY y, x), 9) END AS fraction, {'false' if method == 'relative' else chr(39) + 'Ni' + chr(39) + ' = element'} AS defaulted FROM w"

    def run(spark, sf_dir):
        out = spectra.quantify(spectra.element_maps(_lines(spark, sf_dir)), method, None if method == "relative" else {"Fe": 1.7})
        return rounded(out, 9, "fraction").select("y", "x", "element", "fraction", "defaulted")

    run.__name__ = f"quantify_{method}"
    query(sql)(run)


_quantified("relative", "")
_quantified("cliff_lorimer", "* CASE element WHEN 'Fe' THEN 1.7 ELSE 1 END")
_quantified("eels", "/ CASE element WHEN 'Fe' THEN 1.7 ELSE 1 END")


@query("""SELECT CAST(i AS INT) AS i, round(30 / (2 * sqrt(2 * pi())) * exp(-((i * 0.2 - 4) ** 2) / 8) + 3 / pi() * 1 / ((i * 0.2 - 6) ** 2 + 1) + CASE WHEN i * 0.2 > 1 THEN 50 * pow(i * 0.2 + 0.5, -3) ELSE 0 END + 2 * exp(-(i * 0.2) / 3) + 0.5 * atan(2 * (i * 0.2 - 5)) + 1.5, 8) AS value FROM range(50) r(i)""")
def model_curve(spark, sf_dir):
    x = F.col("i") * 0.2
    lit = lambda *v: [F.lit(float(a)) for a in v]
    total = column("Gaussian", x, lit(30, 4, 2)) + column("Lorentzian", x, lit(3, 6, 1)) + column("PowerLaw", x, lit(50, 1, -0.5, 3)) + column("Exponential", x, lit(2, 3)) + column("Arctan", x, lit(0.5, 2, 5)) + column("Offset", x, lit(1.5))
    return spark.range(50).select(F.col("id").cast("int").alias("i")).select("i", F.round(total, 8).alias("value"))


@query("SELECT edge, element, onset, element IN ('C', 'N') AS suggested FROM (VALUES ('C_K', 'C', 284.0::DOUBLE), ('N_K', 'N', 401.0), ('O_K', 'O', 532.0), ('Fe_L3', 'Fe', 708.0), ('Si_L3', 'Si', 99.0)) t(edge, element, onset) WHERE onset BETWEEN 200 AND 600")
def edges_in_range(spark, sf_dir):
    t = spark.createDataFrame([("C_K", "C", 284.0), ("N_K", "N", 401.0), ("O_K", "O", 532.0), ("Fe_L3", "Fe", 708.0), ("Si_L3", "Si", 99.0)], "edge string, element string, onset double")
    return spectra.edges_in_range(t, 200.0, 600.0, ["C", "N"])


@query()
def gaussian_fit(spark, sf_dir):
    model = Model([Component.of("Gaussian", A=1.0, centre=16.0, sigma=6.0, bounds={"sigma": (0.5, 60.0)}), Component.of("Offset", offset=0.0)])
    return spectra.fit(_spectra(spark, sf_dir), model, (2.0, 0.5))


@query()
def power_law_background(spark, sf_dir):
    model = Model([Component.of("PowerLaw", A=1.0, r=1.0, fixed=("left_cutoff", "origin"))])
    return spectra.remove_background(_spectra(spark, sf_dir), model, 4, 40, (2.0, 0.5))


# atoms -------------------------------------------------------------------

_ATOMS = "a AS (SELECT p_partkey AS id, (p_partkey * 7919 % 1009)::DOUBLE AS x, (p_partkey * 104729 % 997)::DOUBLE AS y, 1 + (p_partkey % 7)::DOUBLE AS sigma_x, (p_partkey % 5)::DOUBLE AS sigma_y, p_retailprice AS intensity FROM part)"


def _atoms(spark, sf_dir):
    k = F.col("p_partkey")
    f = lambda c: c.cast("double")
    return d.read(spark, sf_dir, "part").select(k.alias("id"), f(k * 7919 % 1009).alias("x"), f(k * 104729 % 997).alias("y"), (1 + f(k % 7)).alias("sigma_x"), f(k % 5).alias("sigma_y"), F.col("p_retailprice").alias("intensity"))


_NN = "nn AS (SELECT a.id, b.id AS n_id, b.x AS nx, b.y AS ny, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS rank FROM a, a b WHERE a.id <> b.id)"


@query(f"WITH {_ATOMS} SELECT id, CASE WHEN least(sigma_x, sigma_y) > 0 THEN round(greatest(sigma_x, sigma_y) / least(sigma_x, sigma_y), 9) END AS ellipticity, CASE WHEN sigma_x >= sigma_y THEN 0 ELSE round(pi() / 2, 9) END AS angle FROM a")
def atom_shapes(spark, sf_dir):
    return rounded(atoms.shape_properties(_atoms(spark, sf_dir)), 9, "ellipticity", "angle").select("id", "ellipticity", "angle")


@query(f"WITH {_ATOMS}, {_NN} SELECT id, round(avg(distance), 8) AS distance FROM nn WHERE rank <= 3 GROUP BY id")
def neighbour_distance(spark, sf_dir):
    return rounded(atoms.neighbour_distance(_atoms(spark, sf_dir), 3, 16.0), 8, "distance")


@query(f"WITH {_ATOMS}, {_NN} SELECT a.id, round(any_value(a.x) - avg(nx), 8) AS dx, round(any_value(a.y) - avg(ny), 8) AS dy FROM a JOIN nn USING (id) WHERE rank <= 4 GROUP BY a.id")
def atom_displacement(spark, sf_dir):
    return rounded(atoms.displacement(_atoms(spark, sf_dir), 4, 16.0), 8, "dx", "dy")


@query(f"WITH {_ATOMS}, {_NN}, s AS (SELECT nx - a.x AS dx, ny - a.y AS dy, distance FROM a JOIN nn USING (id) WHERE rank = 1), t AS (SELECT dx, dy, CASE WHEN dx < 0 OR (dx = 0 AND dy < 0) THEN -1 ELSE 1 END AS f FROM s WHERE distance <= 60) SELECT round(median(dx * f), 8) AS vx, round(median(dy * f), 8) AS vy FROM t")
def dumbbell_vector(spark, sf_dir):
    return rounded(atoms.dumbbell_vector(_atoms(spark, sf_dir), 16.0, 60.0), 8, "vx", "vy")


@query(f"WITH {_ATOMS}, p AS (SELECT b.id AS a, b.id + 1 AS b FROM a b WHERE b.id % 2 = 1), q AS (SELECT p.a, p.b, n.x - m.x AS dx, n.y - m.y AS dy, m.x AS ax, m.y AS ay, n.x AS bx, n.y AS cy, m.intensity AS ai, n.intensity AS bi FROM p JOIN a m ON m.id = p.a JOIN a n ON n.id = p.b), w AS (SELECT *, atan2(dy, dx) + pi() / 2 AS t FROM q) SELECT a, b, round(sqrt(dx * dx + dy * dy), 8) AS separation, round(CASE WHEN t < 0 THEN t + pi() WHEN t >= pi() THEN t - pi() ELSE t END - pi() / 2, 8) AS angle, (ax + bx) / 2 AS centre_x, (ay + cy) / 2 AS centre_y, CASE WHEN ai > 0 THEN round(bi / ai, 8) END AS ratio FROM w")
def dumbbell_properties(spark, sf_dir):
    a = _atoms(spark, sf_dir)
    pairs = a.where("id % 2 = 1").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return rounded(atoms.dumbbell_properties(a, pairs), 8, "separation", "angle", "ratio")


@query(f"""WITH {_ATOMS}, c AS (SELECT a.id AS a, b.id AS b, sqrt((b.x - (a.x - 153)) ** 2 + (b.y - (a.y + 44)) ** 2) AS d FROM a JOIN a b ON a.id <> b.id AND abs(b.x - (a.x - 153)) <= 8 AND abs(b.y - (a.y + 44)) <= 8),
o AS (SELECT a, b, d, row_number() OVER (ORDER BY d, a, b) AS i FROM c WHERE d <= 0.05 * sqrt(153.0::DOUBLE ** 2 + 44.0::DOUBLE ** 2))
SELECT p.a, p.b, round(p.d, 8) AS distance FROM (WITH RECURSIVE r(i, one, two, held) AS (SELECT 0::BIGINT, MAP {{0::BIGINT: true}}, MAP {{0::BIGINT: true}}, 0::BIGINT UNION ALL
SELECT o.i, CASE WHEN one[o.a] IS NULL AND two[o.b] IS NULL THEN map_concat(one, MAP {{o.a: true}}) ELSE one END, CASE WHEN one[o.a] IS NULL AND two[o.b] IS NULL THEN map_concat(two, MAP {{o.b: true}}) ELSE two END,
CASE WHEN one[o.a] IS NULL AND two[o.b] IS NULL THEN o.i ELSE 0 END FROM r JOIN o ON o.i = r.i + 1) SELECT o.a, o.b, o.d FROM r JOIN o ON o.i = r.held) p""")
def dumbbell_pairs(spark, sf_dir):
    return rounded(atoms.dumbbell_pairs(_atoms(spark, sf_dir), -153.0, 44.0, 0.05), 8, "distance")


@query(f"WITH {_ATOMS} SELECT CAST(round_even(y / 10, 0) AS INT) AS y, CAST(round_even(x / 10, 0) AS INT) AS x, arg_max(intensity, id) AS value FROM a WHERE round_even(y / 10, 0) < 60 AND round_even(x / 10, 0) < 80 GROUP BY ALL")
def atom_map(spark, sf_dir):
    a = _atoms(spark, sf_dir).withColumn("x", F.col("x") / 10).withColumn("y", F.col("y") / 10)
    return atoms.to_map(a, "intensity", 60, 80)


# orientation -------------------------------------------------------------

_Q = """q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, a / n AS w, b / n AS x, c / n AS y, e / n AS z FROM (SELECT *, sqrt(a * a + b * b + c * c + e * e) AS n FROM q)),
v AS (SELECT vec_id, abs(2 * (x * z + w * y)) AS vx, abs(2 * (y * z - w * x)) AS vy, abs(1 - 2 * (x * x + y * y)) AS vz FROM u),
s AS (SELECT vec_id, list_sort([vx, vy, vz]) AS s FROM v)"""


def _quaternions(spark, sf_dir):
    t = d.read(spark, sf_dir, "embeddings")
    c = [F.element_at("embedding", i).cast("double") for i in range(1, 5)]
    n = F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))
    return t.select("vec_id", *[(x / n).alias(name) for x, name in zip(c, ("qw", "qx", "qy", "qz"), strict=True)])


@query(f"WITH {_Q} SELECT vec_id, round(s[2] / (1 + s[3]), 8) AS px, round(s[1] / (1 + s[3]), 8) AS py, round((s[3] - s[2]) / greatest(s[3] - s[2], s[2] - s[1], s[1]), 6) AS r FROM s")
def inverse_pole_figure(spark, sf_dir):
    out = orientation.ipf(_quaternions(spark, sf_dir), ("qw", "qx", "qy", "qz"))
    return out.select("vec_id", F.round("px", 8).alias("px"), F.round("py", 8).alias("py"), F.round("r", 6).alias("r"))


@query(f"WITH {_Q} SELECT CAST(floor(s[1] / (1 + s[3]) / 0.5 * 8) AS INT) AS iy, CAST(floor(s[2] / (1 + s[3]) / 0.5 * 8) AS INT) AS ix, count(*) AS n FROM s GROUP BY ALL")
def pole_density(spark, sf_dir):
    return orientation.pole_density(orientation.ipf(_quaternions(spark, sf_dir), ("qw", "qx", "qy", "qz")), 8)


@query("""WITH v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM v), u AS (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM c),
s AS (SELECT p.vec_id AS id, t.vec_id AS template, sum(p.v * t.v) AS score FROM u p JOIN u t USING (i) GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, template) AS INT) AS rank FROM s) SELECT id, rank, template, round(score, 7) AS score FROM r WHERE rank <= 3""")
def dictionary_index(spark, sf_dir):
    t = d.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("pattern"))
    return rounded(orientation.dictionary_index(t, t, 3), 7, "score")


@query(f"WITH {d.VECTORS}, s AS (SELECT nav_y AS y, nav_x AS x, time AS phase, round(avg(intensity), 2) AS score FROM v GROUP BY ALL) SELECT y, x, phase, score FROM s QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY score DESC, phase) = 1")
def merge_phases(spark, sf_dir):
    s = d.vectors(spark, sf_dir).groupBy(F.col("nav_y").alias("y"), F.col("nav_x").alias("x"), F.col("time").alias("phase")).agg(F.round(F.avg("intensity"), 2).alias("score"))
    return orientation.merge_phases(s)


@query("""WITH r AS (SELECT h, k, l FROM range(-2, 3) a(h), range(-2, 3) b(k), range(-2, 3) c(l) WHERE h > 0 OR (h = 0 AND (k > 0 OR (k = 0 AND l > 0)))) SELECT h, k, l, round(1 / sqrt((h / 4.0) ** 2 + (k / 4.0) ** 2 + (l / 4.2) ** 2), 8) AS d FROM r""")
def d_spacings(spark, sf_dir):
    return rounded(orientation.d_spacings(spark, 4.0, 4.0, 4.2, 2), 8, "d").select(*[F.col(c).cast("long").alias(c) for c in "hkl"], "d")


@query(f"WITH {d.VECTORS} SELECT DISTINCT CASE WHEN kx < 0 OR (kx = 0 AND ky < 0) THEN -kx ELSE kx END + 0.0 AS kx, CASE WHEN kx < 0 OR (kx = 0 AND ky < 0) THEN -ky ELSE ky END + 0.0 AS ky FROM v")
def friedel_half(spark, sf_dir):
    return orientation.friedel_half(d.vectors(spark, sf_dir))


@query(f"""WITH {_Q}, m AS (SELECT vec_id, abs(a) AS p1, abs(b) AS pp, abs(c) AS p2 FROM q) SELECT vec_id, round(cos(p1) * cos(p2) - sin(p1) * sin(p2) * cos(pp), 9) AS m00, round(sin(p1) * sin(pp), 9) AS m20, round(p1, 7) AS phi1, round(pp, 7) AS big_phi, round(p2, 7) AS phi2 FROM m WHERE pp > 1e-3""")
def euler_round_trip(spark, sf_dir):
    t = d.read(spark, sf_dir, "embeddings").select("vec_id", *[F.abs(F.element_at("embedding", i).cast("double")).alias(n) for i, n in ((1, "p1"), (2, "pp"), (3, "p2"))]).where("pp > 1e-3")
    m = orientation.euler_matrix(F.col("p1"), F.col("pp"), F.col("p2"))
    a, b, c = orientation.matrix_euler(m)
    return t.select("vec_id", F.round(m[0][0], 9).alias("m00"), F.round(m[2][0], 9).alias("m20"), F.round(a, 7).alias("phi1"), F.round(b, 7).alias("big_phi"), F.round(c, 7).alias("phi2"))
