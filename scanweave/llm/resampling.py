"""Importance resampling towards a target: n-gram weights, Gumbel scores, and a cutoff found by a sketch and a bracket.

One pass counts every document's and every target text's word n-grams by hash
bucket; the log ratio of the two shares is a bucket's gain, kept in one dense
array. A second pass scores each document by the sum of its n-grams' gains, read
from the array a whole text at a time. Each score gets Gumbel noise from a hash
of the id, so taking the highest is a draw without replacement by weight.

The highest k are found without sorting all: a mergeable quantile sketch gives a
bracket of scores around the cutoff, one exact count of the rows above and inside
says whether the cutoff lies in it (if not, it is widened), and only the rows
inside are sorted. The drawn rows are then ranked by ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, pieces, text_bytes

BUCKETS, LONGEST = 10_000, 3
#: Everything but ASCII letters, digits and what isn't ASCII parts words; capitals are made small.
_WORDS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)).lower() + bytes(range(128, 256))


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text: its words, and the bucket of every n-gram that ends in it."""
    before: list[bytes] = []
    for words in pieces(text.translate(_WORDS)):
        both = before + words
        new, spaced = len(before), [b" " + w for w in both]
        # the checksum of an n-gram goes on from that of the one a word shorter
        sums, out = list(map(crc32, both)), []
        for n in range(1, LONGEST + 1):
            out.append(sums[max(0, new - n + 1) :])
            sums = list(map(crc32, spaced[n:], sums))
        total = sum(map(len, out))
        yield len(words), np.fromiter((x for part in out for x in part), np.int64, total) % BUCKETS
        before = both[max(0, len(both) - LONGEST + 1) :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text in text_bytes(b.column(0)):
            for _, buckets in features(text):
                count += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """n-grams of all whole texts by bucket: each task passes on a row a bucket, and BUCKETS rows reach the driver."""
    rows = docs.select(text_col).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times each bucket's smoothed log ratio of target to corpus, rounded down."""
    here, there = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    # math.log, as databases have it: vectorised logarithms may differ in the last place
    return np.array([math.floor(1000 * math.log((t + 1.0) * here / ((s + 1.0) * there))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for i, text in enumerate(text_bytes(b.column(1))):
                for words, buckets in features(text):
                    out[:, i] += words, len(buckets), gain[buckets].sum()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a standard Gumbel number made from the id, rounded down; a null id counts as an empty text."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column place, from 1: the row's place in the order, from ranges sorted one by one and the sizes of those before."""
    own = F.monotonically_increasing_id()
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", own), name)
    # an id's upper bits are its partition, the lower 33 the row's place there
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    # a row a range, however many rows there are
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + within + 1).drop("__part", "__before", "__at")


def bracket(rows: DataFrame, value: str, k: int, n: int, accuracy: int = 10_000) -> tuple[int, int | None, int | None]:
    """(rows above, least, greatest) of a range of values in which the k-th greatest of n values lies; None: no bound on that side.

    The sketch's error is at most 1 / accuracy of the rows, and the first range
    reaches twice that to either side. Exact counts decide; a range that misses is
    made sixteen times as wide, and in the end has no bounds.
    """
    reach = 2.0 / accuracy
    while True:
        low, high = 1 - k / n - reach, 1 - k / n + reach
        marks = rows.agg(F.percentile_approx(value, [max(low, 0.0), min(high, 1.0)], accuracy)).first()[0]
        least, most = marks[0] if low > 0 else None, marks[1] if high < 1 else None
        up = F.lit(False) if most is None else F.col(value) > most
        within = F.lit(True) if least is None else F.col(value) >= least
        above, inside = rows.agg(F.count_if(up), F.count_if(~up & within)).first()
        if above < k <= above + inside:
            return above, least, most
        reach *= 16


def draw(scored: DataFrame, k: int, n: int, score: str = "score", ties: tuple[str, ...] = (), accuracy: int = 10_000) -> tuple[DataFrame, Column]:
    """The k rows of the highest scores among n, with a column place from 1, and a condition that tells them from the rest; of equal scores the smaller values of ties (null last) come first.

    The ties must tell all rows apart. scored is read several times, so it should be a written table.
    """
    if not k:
        return scored.where("false").withColumn("place", F.lit(0).cast("long")), F.lit(False)
    order = [F.desc(score), *(F.asc_nulls_last(c) for c in ties)]
    above, least, most = bracket(scored, score, k, n, accuracy)
    inside = F.lit(True)
    for bound in (None if least is None else F.col(score) >= least, None if most is None else F.col(score) <= most):
        inside = inside if bound is None else inside & bound
    last = numbered(scored.where(inside), order, "bracket").where(F.col("place") == k - above).select(score, *ties).first()
    # the whole key of the last row drawn, null after all values
    key = lambda of: F.struct(-of(score), *(x for c in ties for x in (of(c).isNull(), of(c))))
    cut = key(lambda c: F.lit(last[c]).cast(scored.schema[c].dataType))
    return numbered(scored.where(key(F.col) <= cut), order, "drawn"), key(F.col) <= cut


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row per row of docs; rank is null for what isn't drawn.

    Of the documents of least_words words or more, percent in 100 (rounded down)
    are drawn, those of the highest scores, ties to the smaller id (null last). A
    null text is an empty one, without features: its weight is 0. Rows that repeat
    an id are drawn one by one, the one with fewer features first. An empty table
    gives an empty result, an empty target weighs all buckets by the corpus alone.
    Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = materialise(rows, "scored")
    enough = F.col("n_words") >= least_words
    long = scored.where(enough)
    n = long.count()
    drawn, is_drawn = draw(long, percent * n // 100, n, ties=("doc_id", "n_features", "row"))
    out = ("doc_id", "n_features", "weight", "score")
    return drawn.select(*out, F.col("place").alias("rank")).union(scored.where(~(enough & is_drawn)).select(*out, F.lit(None).cast("long")))
