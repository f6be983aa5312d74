"""The scan domain projected onto general tables, in Spark and in SQL.

lineitem gives vectors on a 10 x 12 scan; embeddings give 8 x 8 frames, or
64-channel spectra, on a scan of 25 columns; events give a stream of detector
events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NY, NX, COLUMNS, SIDE = 10, 12, 25, 8
GRID = {"nav_y": NY, "nav_x": NX}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_suppkey") % NY).cast("int").alias("nav_y"), (F.col("l_partkey") % NX).cast("int").alias("nav_x"),
        ((F.col("l_quantity") - 25.5) / 25.5).alias("kx"), ((F.col("l_discount") - 0.05) / 0.05).alias("ky"), F.col("l_extendedprice").alias("intensity"),
        (1 - F.col("l_tax")).alias("confidence"), (F.year("l_shipdate") - 1995).cast("int").alias("time"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ord"),
    )


VECTORS = """v AS (SELECT CAST(l_suppkey % 10 AS INT) AS nav_y, CAST(l_partkey % 12 AS INT) AS nav_x,
    (l_quantity - 25.5) / 25.5 AS kx, (l_discount - 0.05) / 0.05 AS ky, l_extendedprice AS intensity,
    1 - l_tax AS confidence, CAST(year(l_shipdate) - 1995 AS INT) AS time, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ord FROM lineitem)"""
GRID_SQL = "g AS (SELECT CAST(y AS INT) AS nav_y, CAST(x AS INT) AS nav_x FROM range(10) a(y), range(12) b(x))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "embeddings")
    return t.select(F.floor(F.col("vec_id") / COLUMNS).cast("int").alias("y"), (F.col("vec_id") % COLUMNS).cast("int").alias("x"), F.col("embedding").alias("frame"))


FRAMES = "f AS (SELECT CAST(vec_id // 25 AS INT) AS y, CAST(vec_id % 25 AS INT) AS x, embedding AS frame FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.shape import to_long

    return to_long(frames(spark, sf_dir), SIDE).withColumn("value", F.col("value").cast("double"))


PIXELS = FRAMES + ", p AS (SELECT y, x, CAST((i - 1) // 8 AS INT) AS ky, CAST((i - 1) % 8 AS INT) AS kx, CAST(frame[i] AS DOUBLE) AS value FROM f, range(1, 65) r(i))"


def position_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2-vector field on the scan: mean kx and ky at each position."""
    return vectors(spark, sf_dir).groupBy(F.col("nav_y").alias("y"), F.col("nav_x").alias("x")).agg(F.avg("kx").alias("fx"), F.avg("ky").alias("fy"), F.count("*").alias("n"))


MEANS = VECTORS + ", m AS (SELECT nav_y AS y, nav_x AS x, avg(kx) AS fx, avg(ky) AS fy, count(*) AS n FROM v GROUP BY ALL)"
