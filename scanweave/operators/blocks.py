"""Exhaustive comparison of two tables by a grid of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(held: DataFrame, passing: DataFrame, key: str, value: str, block: int, run: Callable[[pd.DataFrame, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """run(held rows of a block, passing rows batch by batch) for every pair of a block of held and a block of passing.

    Both tables have key (a long) and value. Each side is dealt into blocks by a
    hash of the key: held into blocks of about `block` rows, which a task keeps,
    passing into as many as fill the shuffle partitions, which stream by in order
    of the key. Each pair is one cell of a grid and one task; neither table passes
    through the driver or is broadcast.
    """
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high = max(1, -(-held.count() // block))
    wide = max(1, -(-parts // high))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.select(key, value, F.lit(0).alias("__side"), F.pmod(F.xxhash64(key), F.lit(high)).alias("__i"), every(wide).alias("__j"))
    right = passing.select(key, value, F.lit(1).alias("__side"), every(high).alias("__i"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(wide)).alias("__j"))
    cells = left.union(right).withColumn("__cell", (F.col("__i") * wide + F.col("__j")).cast("int"))
    cells = cells.repartitionById(high * wide, F.col("__cell")).sortWithinPartitions("__side", key).select("__side", key, value)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[pd.DataFrame] = []

        def rest() -> Iterator[pd.DataFrame]:
            for b in batches:
                own.append(b[b["__side"] == 0])
                if len(b) > len(own[-1]):
                    yield b[b["__side"] == 1]
                    break
            for b in batches:
                yield b

        others = rest()
        first = next(others, None)
        block_rows = pd.concat(own) if own else None
        own.clear()
        if first is not None and block_rows is not None and len(block_rows):

            def streamed() -> Iterator[pd.DataFrame]:
                yield first
                yield from others

            yield from run(block_rows, streamed())

    return cells.mapInPandas(task, schema)
