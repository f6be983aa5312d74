"""Mixing sources to target weights, with DataFrame operations only.

Each document gets a hash-random key. The keys of a source are dealt into
ranges; sums by range and prefix sums over them give every range its start, and
a second prefix sum inside the range gives every document its own. The
document then knows where it lies on its source's line of words, and the
source's budget cuts that line exactly; a budget over the source's size repeats
whole epochs first. No source is ever sorted by one task: only its range sums
are, and their number is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, n_words


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(src, source_size) -> the same with target.

    Sources by code point, null last, have the given weights in turn. They share
    the sum of all sizes; a target stops at max_epochs times its source's size,
    and the others take the rest by weight. With the sources in order of cap /
    weight, those before the first one that fits under the common level are
    full. The table has a row for each source, so the ordering windows are small.
    """
    all_rows = Window.partitionBy(F.lit(0))
    by_name = all_rows.orderBy(F.col("src").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_fill = all_rows.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", (F.sum("source_size").over(all_rows).cast("double") - F.col("full")) / (F.sum("weight").over(all_rows) - F.col("gone")))
    fits = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    df = df.withColumn("level", F.first(fits, ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))
    return df.select("src", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    ranges: int | None = None,
    size: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many of each document's words the mix takes.

    size is the number of words (null text: 0). taken counts repeats: the whole
    epochs that fit into the rounded target, plus what is left of it in the order
    of the hash keys; the document at the cut gives only the words up to it, so a
    source's taken words sum to its rounded target. Equal keys (repeated ids) are
    ordered by size; rows equal in both can be exchanged. A null source is a
    source, a row with a null id has a key from its text, and an empty table
    gives an empty result. Other columns of docs are ignored, whatever their names.

    ranges: the number of key ranges, by default one for each 256 documents, from
    16 to 65,536. carry: columns of docs that the result has too, in a struct
    called row, so that rows need no joining back by an id that may repeat.
    """
    words = n_words(F.col(text_col)) if size is None else size
    carried = [F.struct(*carry).alias("row")] if carry else []
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), words.alias("size"), F.md5(F.concat(F.lit(seed + ":"), name)).alias("key"), *carried)
    if ranges is None:
        ranges = max(16, min(65_536, docs.count() // 256))
    if not carry:  # words are counted once
        rows = materialise(rows, "mix-sizes")
    # ranges of equal width of the key's first 32 bits
    part = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges), 32).cast("int")
    rows = rows.withColumn("part", part)

    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("src").agg(F.sum("part_size").alias("source_size")), weights, max_epochs)
    line = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(line), F.lit(0)))
    t = targets.withColumnRenamed("src", "t_src")
    parts = parts.join(t, parts["src"].eqNullSafe(t["t_src"])).select(F.col("src").alias("p_src"), F.col("part").alias("p_part"), "part_start", "source_size", "target")

    joined = rows.join(parts, rows["src"].eqNullSafe(parts["p_src"]) & (rows["part"] == parts["p_part"]))
    inside = Window.partitionBy("src", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("part_start") + F.sum("size").over(inside) - F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return joined.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carry else []))
