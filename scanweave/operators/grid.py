"""Dense navigation grids: every map has a row for every scan position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))


def nav_grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """One row for each position, of integer columns named like the axes, slowest first."""
    total = 1
    for n in sizes.values():
        total *= n
    df, below = spark.range(total), total
    cols = []
    for name, n in sizes.items():
        below //= n
        cols.append(F.expr(f"(id div {below}) % {n}").cast("int").alias(name))
    return df.select(*cols)


def grid_complete(df: DataFrame, sizes: dict[str, int], zero: tuple[str, ...] = ()) -> DataFrame:
    """df with every position of the grid: 0 in the columns zero (sums and counts), null in the others where a position is missing."""
    out = nav_grid(df.sparkSession, **sizes).join(df, list(sizes), "left")
    return out.fillna(0, subset=list(zero)) if zero else out


def neighbours(df: DataFrame, values: list[str], offsets=FOUR, y: str = "y", x: str = "x") -> DataFrame:
    """(y, x, n_<value>...): a row for each existing neighbour of each position.

    Offsets are exploded, so the join that follows is an equi-join on position.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])
    spread = df.withColumn("__o", F.explode(steps))
    return spread.select((F.col(y) + F.col("__o.dy")).alias(y), (F.col(x) + F.col("__o.dx")).alias(x), *[F.col(v).alias(f"n_{v}") for v in values])


def spread_positions(spark: SparkSession, ny: int, nx: int, per_axis: int) -> DataFrame:
    """(y, x, rank): positions spread evenly over a scan, the one nearest the middle first; a line gets as many as a map."""
    if ny == 1 or nx == 1:
        per_axis *= per_axis
    step = lambda n: F.rint(F.col("k") * ((n - 1) / max(1, min(per_axis, n) - 1))).cast("int")
    axis = lambda n, name: spark.range(min(per_axis, n)).withColumnRenamed("id", "k").select(step(n).alias(name)).distinct()
    d = (F.col("y") - ny // 2) ** 2 + (F.col("x") - nx // 2) ** 2
    # per_axis squared rows at most
    return axis(ny, "y").crossJoin(axis(nx, "x")).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(d, "y", "x")))


def sampled_positions(positions: DataFrame, n: int, seed: str = "sample") -> DataFrame:
    """n positions (y, x) drawn by a hash of the seed and the position: the same ones in every run."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.col("y").cast("string"), F.lit(":"), F.col("x").cast("string")))
    return positions.select("y", "x").distinct().withColumn("__k", key).orderBy("__k").limit(n).drop("__k")
