"""Vectors: the ragged store, one row for each vector found at a scan position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import grid_complete

#: The columns of a vectors table; confidence and sigma may be null, time is -1 where there is no time axis.
COLUMNS = ("nav_x", "nav_y", "kx", "ky", "time", "intensity", "confidence", "sigma")
FORMAT_VERSION = 2


def _reducer(name: str, column: Column) -> Column:
    made = {
        "sum": lambda: F.sum(column.cast("double")),
        "mean": lambda: F.avg(column),
        "max": lambda: F.max(column),
        "min": lambda: F.min(column),
        "median": lambda: F.percentile(column, F.lit(0.5)),
        "std": lambda: F.stddev_pop(column),
        "count": lambda: F.count(F.lit(1)),
    }
    if name not in made:
        raise ValueError(f"no reducer is called {name}: {', '.join(made)}")
    return made[name]()


def reduce_map(vectors: DataFrame, sizes: dict[str, int], column: str, reducer: str | Callable[[pd.Series], float], fill: float | None = None) -> DataFrame:
    """(positions..., value): a column reduced at each position; empty positions have 0 for sum and count and fill for the others.

    NaN counts as missing. A callable gets a position's values, in ascending
    order, as a Series; many positions come in a batch.
    """
    keys = list(sizes)
    if callable(reducer):
        schema = ", ".join(f"{k} int" for k in keys) + ", value double"
        cut = vectors.select(*[F.col(k).cast("int").alias(k) for k in keys], F.col(column).cast("double").alias("__v"))

        def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield rows[keys].assign(value=[float(reducer(pd.Series(v, dtype=float))) for v in rows["__v"]])

        got = cut.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias("__v")).mapInPandas(reduced, schema)
    else:
        v = F.lit(1) if reducer == "count" else F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
        got = vectors.groupBy(*keys).agg(_reducer(reducer, v).alias("value"))
    out = grid_complete(got, sizes, ("value",) if reducer in ("sum", "count") else ())
    return out.fillna(fill, subset=["value"]) if fill is not None else out


def count_map(vectors: DataFrame, sizes: dict[str, int], at_time: int | None = None) -> DataFrame:
    """Vectors at each position, of one time if given."""
    rows = vectors if at_time is None else vectors.where(F.col("time") == at_time)
    return grid_complete(rows.groupBy(*sizes).agg(F.count("*").alias("n")), sizes, ("n",))


def select_at(vectors: DataFrame, **index: int) -> DataFrame:
    """The rows at a full index, or under a prefix of one."""
    for k, v in index.items():
        vectors = vectors.where(F.col(k) == v)
    return vectors


def flat_position(sizes: dict[str, int]) -> Column:
    """A position's number in C order; an index below 0 (no time axis) counts as 0."""
    out = F.lit(0).cast("long")
    for k, n in sizes.items():
        out = out * n + F.greatest(F.col(k), F.lit(0))
    return out


def finalize(batches: DataFrame, sizes: dict[str, int], order: str = "ord") -> DataFrame:
    """Batches that came in any order, with pos, and sorted by it inside each partition; the order of arrival breaks ties. Rows outside the grid are an error."""
    outside = F.lit(False)
    for k, n in sizes.items():
        outside = outside | (F.col(k) >= n)
    pos = F.when(outside, F.raise_error(F.lit("a row lies outside the grid"))).otherwise(flat_position(sizes))
    return batches.withColumn("pos", pos.cast("long")).repartitionByRange("pos").sortWithinPartitions("pos", order)


def offsets(vectors: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(positions..., n, start): where each position's rows start in C order. One row for each position of the grid is summed up, not the vectors."""
    counts = count_map(vectors, sizes).withColumn("pos", flat_position(sizes))
    lead = next(iter(sizes))
    rows = counts.groupBy(lead).agg(F.sum("n").alias("row_n"))
    before = F.coalesce(F.sum("row_n").over(Window.partitionBy(F.lit(0)).orderBy(lead).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select(F.col(lead).alias("__lead"), before.alias("row_start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(lead).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = counts.join(rows, F.col(lead) == F.col("__lead"))
    return joined.select(*sizes, "n", (F.col("row_start") + inside).cast("long").alias("start"))


def unique_vectors(vectors: DataFrame, columns: tuple[str, ...] = ("kx", "ky")) -> DataFrame:
    """Distinct vectors (threshold 0)."""
    return vectors.select(*columns).distinct()


def to_dense(vectors: DataFrame, sizes: dict[str, int], most: int | None = None, order: str = "ord") -> DataFrame:
    """(positions..., slot, kx, ky, intensity): each position's vectors, null beyond its own count; as many slots as the fullest position has, or only the first `most`. Vectors of one ord follow by their values."""
    keys = list(sizes)
    if most is None:
        most = vectors.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "kx", "ky", "intensity")) - 1
    rows = vectors.withColumn("slot", nth).where(F.col("slot") < most).select(*keys, "slot", "kx", "ky", "intensity")
    return grid_complete(rows, sizes | {"slot": max(most, 1)}).where(F.col("slot") < most)


def brightest(vectors: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The brightest vector of each position; the first to arrive where several are."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("intensity"), order))
    return vectors.withColumn("__n", first).where("__n = 1").drop("__n")


def default_reference(vectors: DataFrame, keys: tuple[str, str] = ("nav_y", "nav_x")) -> DataFrame:
    """The position with most vectors, the first in C order where several have."""
    return vectors.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(1)


def upgraded(stored: DataFrame, version: int) -> DataFrame:
    """A stored table of an older format: missing late columns (a prefix is present) are added as null; a newer format is an error."""
    if version > FORMAT_VERSION:
        raise ValueError(f"format {version} is newer than {FORMAT_VERSION}")
    have = [c for c in COLUMNS if c in stored.columns]
    if have != list(COLUMNS[: len(have)]):
        raise ValueError("the stored columns aren't a prefix of the format's")
    return stored.select(*have, *[F.lit(None).cast("double").alias(c) for c in COLUMNS[len(have) :]])


def peaks_for_matching(vectors: DataFrame, scale: float = 1.0) -> DataFrame:
    """(nav_y, nav_x, qx, qy, intensity), scaled to 1/Å."""
    return vectors.select("nav_y", "nav_x", (F.col("kx") * scale).alias("qx"), (F.col("ky") * scale).alias("qy"), "intensity")
