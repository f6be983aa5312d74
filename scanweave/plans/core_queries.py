"""Queries over the core operators, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions.roi import Disk, PixelRing, Rectangle
from ..operators import ragged, shape, virtual
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


def _map_sql(value: str, where: str = "true", empty: str = "coalesce({}, 0)") -> str:
    return f"WITH {d.VECTORS}, {d.GRID_SQL}, a AS (SELECT nav_y, nav_x, {value} AS value FROM v WHERE {where} GROUP BY ALL) SELECT nav_y, nav_x, {empty.format('value')} AS value FROM g LEFT JOIN a USING (nav_y, nav_x)"


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


DISK = Disk(0.1, -0.1, 0.6, 0.2)
_IN_DISK = "(kx - 0.1) * (kx - 0.1) + (ky - -0.1) * (ky - -0.1) <= 0.6 * 0.6 AND (kx - 0.1) * (kx - 0.1) + (ky - -0.1) * (ky - -0.1) > 0.2 * 0.2"


@query(_map_sql("round(sum(intensity), 3)", _IN_DISK))
def virtual_image_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(virtual.virtual_image(d.vectors(spark, sf_dir), DISK, d.GRID), 3, "value")


@query(_map_sql("count(*)", "kx * kx + ky * ky <= 0.25"))
def virtual_image_disk_count(spark, sf_dir):
    return virtual.virtual_image(d.vectors(spark, sf_dir), Disk(0.0, 0.0, 0.5), d.GRID, weighted=False)


@query(_map_sql("round(sum(intensity), 3)", "kx >= -0.5 AND kx < 0.5 AND ky >= 0.0 AND ky < 0.4"))
def virtual_image_rectangle(spark, sf_dir):
    return rounded(virtual.virtual_image(d.vectors(spark, sf_dir), Rectangle(0.5, 0.4, -0.5, 0.0), d.GRID), 3, "value")


@query(f"WITH {d.VECTORS}, g AS (SELECT CAST(t AS INT) AS time, CAST(y AS INT) AS nav_y, CAST(x AS INT) AS nav_x FROM range(7) c(t), range(10) a(y), range(12) b(x)), a AS (SELECT time, nav_y, nav_x, round(sum(intensity), 3) AS value FROM v WHERE {_IN_DISK} GROUP BY ALL) SELECT time, nav_y, nav_x, coalesce(value, 0) AS value FROM g LEFT JOIN a USING (time, nav_y, nav_x)")
def virtual_series(spark, sf_dir):
    return rounded(virtual.virtual_series(d.vectors(spark, sf_dir), DISK, {"time": 7} | d.GRID), 3, "value")


def _reduce(name: str, digits: int):
    def run(spark, sf_dir):
        return rounded(ragged.reduce_map(d.vectors(spark, sf_dir), d.GRID, "intensity", name), digits, "value")

    run.__name__ = f"reduce_{name}"
    return run


for _name, _sql in {"sum": "sum(intensity)", "mean": "avg(intensity)", "max": "max(intensity)", "min": "min(intensity)", "median": "median(intensity)", "std": "stddev_pop(intensity)"}.items():
    query(_map_sql(f"round({_sql}, 3)", empty="coalesce({}, 0)" if _name == "sum" else "{}"))(_reduce(_name, 3))


@query(_map_sql("count(*)"))
def reduce_count(spark, sf_dir):
    return ragged.reduce_map(d.vectors(spark, sf_dir), d.GRID, "intensity", "count")


@query(_map_sql("round(max(intensity) - min(intensity), 3)", empty="{}"))
def reduce_callable(spark, sf_dir):
    return rounded(ragged.reduce_map(d.vectors(spark, sf_dir), d.GRID, "intensity", lambda v: v.max() - v.min()), 3, "value")


@query(_map_sql("count(*)", "time = 3").replace("AS value FROM g", "AS n FROM g"))
def count_map_at_time(spark, sf_dir):
    return ragged.count_map(d.vectors(spark, sf_dir), d.GRID, 3)


@query(f"WITH {d.VECTORS} SELECT kx, ky, intensity, ord FROM v WHERE nav_y = 3 AND nav_x = 7")
def select_point(spark, sf_dir):
    return ragged.select_at(d.vectors(spark, sf_dir), nav_y=3, nav_x=7).select("kx", "ky", "intensity", "ord")


@query(f"WITH {d.VECTORS} SELECT nav_y, nav_x, kx, ky FROM v WHERE time = 2")
def select_time_prefix(spark, sf_dir):
    return ragged.select_at(d.vectors(spark, sf_dir), time=2).select("nav_y", "nav_x", "kx", "ky")


@query(f"WITH {d.VECTORS}, {d.GRID_SQL}, c AS (SELECT nav_y, nav_x, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT nav_y, nav_x, count(*) AS n FROM v GROUP BY ALL) USING (nav_y, nav_x)) SELECT nav_y, nav_x, n, CAST(coalesce(sum(n) OVER (ORDER BY nav_y, nav_x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def position_offsets(spark, sf_dir):
    return ragged.offsets(d.vectors(spark, sf_dir), d.GRID)


@query(f"WITH {d.VECTORS} SELECT ord, CAST(nav_y * 12 + nav_x AS BIGINT) AS pos FROM v")
def finalize_batches(spark, sf_dir):
    v = d.vectors(spark, sf_dir)
    return ragged.finalize(v.where("time >= 3").unionByName(v.where("time < 3")), d.GRID).select("ord", "pos")


@query(f"WITH {d.VECTORS} SELECT DISTINCT kx, ky FROM v")
def unique_vectors(spark, sf_dir):
    return ragged.unique_vectors(d.vectors(spark, sf_dir))


@query(f"WITH {d.VECTORS}, g AS (SELECT CAST(y AS INT) AS nav_y, CAST(x AS INT) AS nav_x, CAST(s AS INT) AS slot FROM range(10) a(y), range(12) b(x), range((SELECT max(n) FROM (SELECT count(*) AS n FROM v GROUP BY nav_y, nav_x))) c(s)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY nav_y, nav_x ORDER BY ord, kx, ky, intensity) - 1 AS INT) AS slot FROM v) SELECT nav_y, nav_x, slot, kx, ky, intensity FROM g LEFT JOIN (SELECT nav_y, nav_x, slot, kx, ky, intensity FROM r) USING (nav_y, nav_x, slot)")
def to_dense(spark, sf_dir):
    return ragged.to_dense(d.vectors(spark, sf_dir), d.GRID)


@query(f"WITH {d.VECTORS} SELECT nav_y, nav_x, kx, ky, intensity, ord FROM v QUALIFY row_number() OVER (PARTITION BY nav_y, nav_x ORDER BY intensity DESC, ord) = 1")
def brightest_vector(spark, sf_dir):
    return ragged.brightest(d.vectors(spark, sf_dir), ["nav_y", "nav_x"]).select("nav_y", "nav_x", "kx", "ky", "intensity", "ord")


@query(f"WITH {d.VECTORS} SELECT nav_y, nav_x, count(*) AS n FROM v GROUP BY ALL ORDER BY n DESC, nav_y, nav_x LIMIT 1")
def default_reference(spark, sf_dir):
    return ragged.default_reference(d.vectors(spark, sf_dir))


# frames ------------------------------------------------------------------

MASK = PixelRing(3.5, 3.5, 3.0, 1.0)
_MASKED = "(kx - 3.5) * (kx - 3.5) + (ky - 3.5) * (ky - 3.5) <= 9 AND (kx - 3.5) * (kx - 3.5) + (ky - 3.5) * (ky - 3.5) >= 1"


@query(f"WITH {d.PIXELS} SELECT y, x, round(sum(value), 5) AS value FROM p WHERE {_MASKED} GROUP BY ALL")
def frame_image_sum(spark, sf_dir):
    return rounded(virtual.frame_image(d.frames(spark, sf_dir), MASK, 8, 8), 5, "value")


@query(f"WITH {d.PIXELS} SELECT y, x, round(avg(value), 6) AS value FROM p WHERE {_MASKED} GROUP BY ALL")
def frame_image_mean(spark, sf_dir):
    return rounded(virtual.frame_image(d.frames(spark, sf_dir), MASK, 8, 8, mean=True), 6, "value")


@query(f"WITH {d.PIXELS} SELECT y, x, round(sum(value), 5) AS value FROM p GROUP BY ALL")
def navigator(spark, sf_dir):
    return rounded(virtual.navigator(d.frames(spark, sf_dir)), 5, "value")


@query(f"WITH {d.PIXELS} SELECT y, round(sum(value), 4) AS value FROM p GROUP BY ALL")
def navigator_of_rows(spark, sf_dir):
    return rounded(virtual.top_navigator(d.frames(spark, sf_dir), "y"), 4, "value")


@query(f"WITH {d.PIXELS} SELECT CAST(ky * 8 + kx AS INT) AS pixel, round_even(avg(CAST(floor(value * 100) AS BIGINT)), 0) AS value FROM p WHERE y BETWEEN 2 AND 5 AND x BETWEEN 3 AND 9 GROUP BY ALL")
def region_mean_integer(spark, sf_dir):
    frames = d.frames(spark, sf_dir).withColumn("frame", F.transform("frame", lambda v: F.floor(v.cast("double") * 100)))
    return virtual.region_mean(frames, F.col("y").between(2, 5) & F.col("x").between(3, 9), True)


@query(f"WITH {d.PIXELS}, s AS (SELECT y, x, sum(abs(value)) AS m, sum(abs(value) * kx) AS mx, sum(abs(value) * ky) AS my FROM p GROUP BY ALL) SELECT y, x, CASE WHEN m > 0 THEN round(3.5 - mx / m, 6) END AS sx, CASE WHEN m > 0 THEN round(3.5 - my / m, 6) END AS sy FROM s")
def centre_of_mass(spark, sf_dir):
    frames = d.frames(spark, sf_dir).withColumn("frame", F.transform("frame", F.abs))
    return rounded(virtual.centre_of_mass(frames, 8, 8, 3.5, 3.5), 6, "sx", "sy")


@query(f"WITH {d.PIXELS}, s AS (SELECT y, x, avg(abs(value)) FILTER (WHERE {_MASKED}) AS a, avg(abs(value)) AS b FROM p GROUP BY ALL) SELECT y, x, CASE WHEN b <> 0 THEN round(a / b, 6) END AS value FROM s")
def region_brightness(spark, sf_dir):
    frames = d.frames(spark, sf_dir).withColumn("frame", F.transform("frame", F.abs))
    return rounded(virtual.brightness(frames, MASK, 8, 8), 6, "value")


@query(f"WITH {d.PIXELS}, s AS (SELECT sum(value) AS value FROM p GROUP BY y, x) SELECT round(quantile_cont(value, 0.02), 5) AS low, round(quantile_cont(value, 0.98), 5) AS high FROM s")
def robust_levels(spark, sf_dir):
    return rounded(virtual.robust_levels(virtual.navigator(d.frames(spark, sf_dir)), "value"), 5, "low", "high")


@query(f"""WITH {d.VECTORS}, o AS (SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM range(-1, 2) s(a), range(-1, 2) t(b) WHERE a * a + b * b <= 1),
e AS (SELECT nav_y, nav_x, intensity, CAST(round_even((ky + 1) / 0.2, 0) AS INT) + dy AS ky, CAST(round_even((kx + 1) / 0.2, 0) AS INT) + dx AS kx FROM v, o),
m AS (SELECT nav_y, nav_x, ky, kx, max(intensity) AS i FROM e WHERE kx BETWEEN 0 AND 10 AND ky BETWEEN 0 AND 10 GROUP BY ALL)
SELECT CAST(ky AS INT) AS ky, CAST(kx AS INT) AS kx, round(sum(i), 2) AS value FROM m GROUP BY ALL""")
def region_profile(spark, sf_dir):
    return rounded(virtual.region_profile(d.vectors(spark, sf_dir), 11, 11, 1.0, 0.2), 2, "value")


# shapes ------------------------------------------------------------------

def _height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the scan that the table fills, the last one perhaps in part."""
    return d.frames(spark, sf_dir).agg(F.max("y")).first()[0] + 1


def _axes(height: int = 20) -> dict[str, Axis]:
    return {"y": Axis("y", height), "x": Axis("x", 25), "ky": Axis("ky", 8), "kx": Axis("kx", 8)}


@query(f"WITH {d.PIXELS} SELECT CAST(y - 2 AS INT) AS y, x, CAST(ky - 1 AS INT) AS ky, kx, value FROM p WHERE y BETWEEN 2 AND 6 AND ky BETWEEN 1 AND 4")
def crop_axes(spark, sf_dir):
    out, _ = shape.crop(d.pixels(spark, sf_dir), _axes(), {"y": (2, 7), "ky": (1, 5)})
    return out.select("y", "x", "ky", "kx", "value")


@query(f"WITH {d.FRAMES} SELECT y, x, CAST(k AS INT) AS place, frame[(2 + (k - 1) // 3) * 8 + 1 + (k - 1) % 3 + 1] AS value FROM f, range(1, 13) r(k)")
def crop_frames(spark, sf_dir):
    cut = d.frames(spark, sf_dir).select("y", "x", shape.crop_frame("frame", 8, 1, 2, 4, 6).alias("frame"))
    return cut.select("y", "x", F.posexplode("frame").alias("place", "value")).withColumn("place", F.col("place") + 1)


@query(f"WITH {d.PIXELS} SELECT CAST(y // 2 AS INT) AS y, CAST(x // 5 AS INT) AS x, CAST(ky // 4 AS INT) AS ky, CAST(kx // 2 AS INT) AS kx, round(sum(value), 4) AS value FROM p GROUP BY ALL")
def rebin_axes(spark, sf_dir):
    height = _height(spark, sf_dir)
    out, _ = shape.rebin(d.pixels(spark, sf_dir), _axes(height + height % 2), {"y": 2, "x": 5, "ky": 4, "kx": 2})
    return rounded(out, 4, "value")


@query(f"WITH {d.PIXELS} SELECT y, x, CAST(ky // 3 AS INT) AS ky, CAST(kx // 3 AS INT) AS kx, round(avg(value), 6) AS value FROM p WHERE ky < 6 AND kx < 6 GROUP BY ALL")
def downsample_frames(spark, sf_dir):
    return rounded(shape.downsample(d.pixels(spark, sf_dir), "ky", "kx", 8, 8, 3, keys=("y", "x")), 6, "value")


@query("SELECT vec_id, CAST(vec_id // 20 AS INT) AS y, CAST(vec_id % 20 AS INT) AS x FROM embeddings")
def fold_stack(spark, sf_dir):
    t = d.read(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("i"))
    return shape.fold(t, 20).select("vec_id", "y", "x")


@query(f"WITH {d.PIXELS} SELECT CAST(t AS INT) AS t, y, x, ky, kx, CASE WHEN t = 0 THEN value ELSE value * 2 END AS value FROM p, range(2) r(t) WHERE x < 20")
def stack_members(spark, sf_dir):
    p, height = d.pixels(spark, sf_dir), _height(spark, sf_dir)
    out = shape.stack([p, p.withColumn("value", F.col("value") * 2)], [{"y": height, "x": 20, "ky": 8, "kx": 8}, {"y": height, "x": 25, "ky": 8, "kx": 8}])
    return out.select("t", "y", "x", "ky", "kx", "value")


@query(f"WITH {d.FRAMES}, s AS (SELECT y, x, list_sum(frame) AS v FROM f), a AS (SELECT y, x, v FROM s WHERE x BETWEEN 2 AND 24), b AS (SELECT y - 2 AS y, x + 2 AS x, v FROM s WHERE y >= 2 AND x + 2 BETWEEN 2 AND 24) SELECT CAST(y AS INT) AS y, CAST(x - 2 AS INT) AS x, round(a.v + b.v, 4) AS value FROM a JOIN b USING (y, x)")
def sum_aligned_members(spark, sf_dir):
    nav, size = virtual.navigator(d.frames(spark, sf_dir)), (_height(spark, sf_dir), d.COLUMNS)
    region = shape.common_region([(0, 0), (2, -2)], [size, size])
    both = [shape.aligned(nav, o, region) for o in ((0, 0), (2, -2))]
    return rounded(shape.sum_members(both, ["y", "x"]), 4, "value")


@query(f"WITH {d.FRAMES} SELECT y, x, round(list_sum(list_transform(frame, lambda v, i: CAST(v AS DOUBLE) * i)), 3) AS code FROM f")
def long_round_trip(spark, sf_dir):
    back = shape.to_frames(d.pixels(spark, sf_dir), ["y", "x"])
    code = F.aggregate(F.transform("frame", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(back.select("y", "x", code.alias("code")), 3, "code")
