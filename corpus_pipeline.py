"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm import decontam, minhash, mixing, quality, sharding
from scanweave.llm.shared import materialise, n_words, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates.

    Every row is a document. Where ids repeat or are null, rows are numbered in
    the order of their ids (null last, then by text), and the numbers stand for them.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
        return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    # a row's place in the input comes last, so that no id and no text is too large for a range
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("__place")]
    placed = docs.withColumn("__place", F.monotonically_increasing_id())
    numbered = materialise(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    kept = minhash.near_duplicates(numbered, id_col="__row").where("kept").select(F.col("doc_id").alias("kept_row"))
    return numbered.join(kept, numbered["__row"] == kept["kept_row"], "left_semi").select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for every whole epoch, and one more where the cut leaves it at least half of its words.

    Documents without words give the mix nothing and are kept once.
    """
    sized = docs.withColumn("__size", n_words(F.col("text")))
    taken = mixing.mix(sized, size=F.col("__size"), carry=docs.columns)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    rows = taken.select("row", times.alias("times")).where(F.col("times") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return sharding.shard(docs, shards=40).select("doc_id", "size", "shard", "slot")


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: SQL can't express the quality stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
