"""Exact top-k search by inner product, term at a time.

A term is a dimension, its postings the vectors with a weight there. Queries and
vectors are dealt into blocks, and each pair of a query block and a vector block
is a cell of a grid, one task's work. The task keeps its queries, takes the
vectors as they stream past, turns a few thousand at a time into postings, and
for one term after the other scatters query weight times posting weight into a
dense array of scores. Every score is complete before any is dropped: the best k
of each query are picked by partition selection and merged into the task's
running list, which leaves the task once. A final ranking merges the cells'
lists. Weights are integers, so scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that a task holds, and the block of scores that it fills at a time: queries x vectors.
QUERY_BLOCK, QUERIES, VECTORS = 65_536, 64, 2048


def exact_type(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The narrower integer type that no score, whole or partial, can leave."""
    top = lambda a: int(np.abs(a).max(initial=0))
    return np.int32 if top(queries) * top(vectors) * max(1, vectors.shape[1]) < 2**31 else np.int64


def accumulate(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(queries, vectors) of integer scores, by term. A term that most vectors have is added as a whole row."""
    kind = exact_type(queries, vectors)
    scores, part = np.zeros((len(queries), len(vectors)), kind), np.empty((len(queries), len(vectors)), kind)
    by_query, by_term = queries.astype(kind), np.ascontiguousarray(vectors.T.astype(kind))
    for term, weights in enumerate(by_term):
        own = by_query[:, term]
        who, posting = np.flatnonzero(own), np.flatnonzero(weights)
        if not len(who) or not len(posting):
            continue
        if 2 * len(posting) >= len(weights) and 2 * len(who) >= len(own):
            np.multiply(own[:, None], weights[None, :], out=part)
            scores += part
        else:
            scores[np.ix_(who, posting)] += np.multiply.outer(own[who], weights[posting])
    return scores


class Best:
    """Running lists of the k best (score, id) of some queries, ties to the smaller id. Vectors come in order of their ids."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.score, self.id = np.full((len(own), k), self.NONE), np.zeros((len(own), k), np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from first on with vectors of ascending ids. The rows of a query's own id, however many, are taken out before any selection."""
        rows = slice(first, first + len(scores))
        low, high = np.searchsorted(ids, self.own[rows], "left"), np.searchsorted(ids, self.own[rows], "right")
        # a later id with the score of the last one held loses the tie
        better = scores > self.score[rows, -1:]
        for r in np.flatnonzero(low < high):
            better[r, low[r] : high[r]] = False
        for r in np.flatnonzero(better.any(axis=1)):
            at = np.flatnonzero(better[r])
            s = scores[r, at].astype(np.int64)
            if len(at) > self.k:
                least = -np.partition(-s, self.k - 1)[self.k - 1]
                above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
                take = np.sort(np.concatenate([above, equal[: self.k - len(above)]]))
                at, s = at[take], s[take]
            both, names = np.concatenate([self.score[first + r], s]), np.concatenate([self.id[first + r], ids[at]])
            order = _descending(both)[: self.k]
            self.score[first + r], self.id[first + r] = both[order], names[order]

    def lists(self) -> Iterator[pa.RecordBatch]:
        """(query_id, vec_id, score) of all that was found."""
        for first in range(0, len(self.own), 4096):
            score, name = self.score[first : first + 4096], self.id[first : first + 4096]
            r, c = np.nonzero(score != self.NONE)
            yield pa.RecordBatch.from_arrays([pa.array(self.own[first + r]), pa.array(name[r, c]), pa.array(score[r, c])], ["query_id", "vec_id", "score"])


def _descending(scores: np.ndarray) -> np.ndarray:
    """Places in order of falling scores, equal ones as they stand; the least number can't be negated, so the order is turned instead."""
    return len(scores) - 1 - np.argsort(scores[::-1], kind="stable")[::-1]


def _search(k: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One cell: its queries (side 0) first, then its vectors by id."""
        own, queries, waiting, size, best = [], [], [], 0, None

        def searched() -> None:
            ids, rows = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            for at in range(0, len(ids), VECTORS):
                for q in range(0, len(best.own), QUERIES):
                    best.add(q, accumulate(queries[q : q + QUERIES], rows[at : at + VECTORS]), ids[at : at + VECTORS])

        for b in filter(len, batches):
            side, ids = b.column("side").to_numpy(), b.column("vec_id").to_numpy()
            rows = b.column("v").flatten().to_numpy().reshape(len(ids), -1)
            n = int((side == 0).sum())
            if n:
                own.append(ids[:n])
                queries.append(rows[:n])
            if n == len(ids) or not len(own):
                continue
            if best is None:
                best, queries = Best(np.concatenate(own), k), np.concatenate(queries)
            waiting.append((ids[n:], rows[n:]))
            size += len(ids) - n
            if size >= VECTORS:
                searched()
                waiting, size = [], 0
        if size:
            searched()
        if best is not None:
            yield from best.lists()

    return run


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors (or ids) that are null, or hold null or non-finite components, take no part."""
    x = F.col(vector_col)
    limit = F.lit(float("inf"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < limit))
    return df.where(x.isNotNull() & F.col(id_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores over all other rows of (vec_id, v), from rank 1, ties to the smaller id.

    Vectors of different lengths are searched apart: a query meets those of its
    own length, and vectors of length 0 score 0. A repeated vec_id is a candidate
    in each row, but never of its own query, and a repeated query id is one query
    (its least vector). Fewer candidates than k give fewer ranks; an empty table
    gives an empty result. Scores must fit into 64 bits. Other columns are ignored.

    query_block: queries that a task holds (65,536 of 64 components are 32 MB).
    Vectors are dealt into as many blocks as fill the shuffle partitions, and go
    to each query block's row of the grid; what the cells pass on is k rows a
    query and vector block. Neither side passes through the driver.
    """
    spark = vectors.sparkSession
    block, parts = query_block or QUERY_BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select("vec_id", "v", F.size("v").alias("dims"))
    queries = rows.where(is_query).groupBy("dims", "vec_id").agg(F.min("v").alias("v"))
    # a row for each length that vectors have
    grid, cells = {}, 0
    for r in queries.groupBy("dims").count().orderBy("dims").collect():
        high = -(-r["count"] // block)
        grid[r["dims"]] = (cells, high, max(1, -(-parts // high)))
        cells += high * grid[r["dims"]][2]
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def of(place: int) -> Column:
        out = F.lit(None).cast("int")
        for dims, shape in grid.items():
            out = F.when(F.col("dims") == dims, shape[place]).otherwise(out)
        return out

    shaped = lambda df, side: df.where(F.col("dims").isin(list(grid))).select("vec_id", "v", F.lit(side).alias("side"), of(0).alias("start"), of(1).alias("high"), of(2).alias("wide"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = shaped(queries, 0).withColumn("i", F.pmod(F.xxhash64("vec_id"), F.col("high"))).withColumn("j", every("wide"))
    right = shaped(rows, 1).withColumn("j", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("wide"))).withColumn("i", every("high"))
    cell = (F.col("start") + F.col("i") * F.col("wide") + F.col("j")).cast("int")
    both = left.select("vec_id", "v", "side", cell.alias("cell")).union(right.select("vec_id", "v", "side", cell.alias("cell")))
    lists = both.repartitionById(cells, F.col("cell")).sortWithinPartitions("side", "vec_id").select("side", "vec_id", "v").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
