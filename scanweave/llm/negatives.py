"""Hard-negative mining by a vertical scan (BOND): dimension by dimension, with bounds.

Anchors and vectors are dealt into blocks, and each pair of an anchor block and
a vector block is one task's work. A task turns its vectors, a few thousand at a
time, into columns. For one anchor the columns are read in the order of the
anchor's weights, heaviest first. After each few columns every candidate has a
partial score, and what the unread columns can still add lies between the sums
of their least and greatest contributions; candidates whose range can't reach a
result leave the bitmap. The few that stay to the last column have exact scores.

Two scans: the first finds each anchor's positives (best of its own label), the
second the best of other labels in the window below each positive's score.
Components are integers, so scores and bounds are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Anchors that a task holds, vectors that it turns into columns at a time, and columns read between two looks at the bounds.
ANCHOR_BLOCK, VECTORS, STEP = 8192, 8192, 8
NONE = np.iinfo(np.int64).min


@dataclass
class Columns:
    """Some vectors by column: components (dims, n), the ids in ascending order, labels."""

    cols: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    least: np.ndarray = field(init=False)
    greatest: np.ndarray = field(init=False)

    def __post_init__(self):
        self.least, self.greatest = self.cols.min(axis=1, initial=0), self.cols.max(axis=1, initial=0)

    def others(self, own: int, label: int, same: bool) -> np.ndarray:
        """The bitmap of the rows of the label (or of any other one), without those of the id own."""
        alive = (self.labels == label) == same
        alive[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = False
        return alive


def scan(anchor: np.ndarray, block: Columns, alive: np.ndarray, can_stay, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the candidates in the bitmap alive that stay to the end.

    can_stay(low, high) says which of the candidates, whose scores lie from low to high, may still be in the result.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    a, cols = anchor[order], block.cols
    ends = np.sort(np.stack([a * block.least[order], a * block.greatest[order]]), axis=0)
    # what the columns from each place on can add at least and at most
    rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), ends.dtype)], axis=1)
    at = np.flatnonzero(alive)
    part = np.zeros(len(at), a.dtype)
    for first in range(0, len(a), step):
        if not len(at):
            break
        some = order[first : first + step]
        read = cols[some] if len(at) == cols.shape[1] else cols[some[:, None], at]
        part += a[first : first + step] @ read
        left = min(first + step, len(a))
        stay = can_stay(part + rest[0, left], part + rest[1, left])
        if not stay.all():
            at, part = at[stay], part[stay]
    return at, part


def kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest value, NONE if there are fewer."""
    return values[np.argpartition(values, len(values) - k)[len(values) - k]] if len(values) >= k else NONE


@dataclass
class Best:
    """A running list of the k best (score, id), ties to the smaller id."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def least(self) -> int:
        """What a score must reach to be among the k best."""
        return self.score[-1] if len(self.score) >= self.k else NONE

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score.astype(np.int64)]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score))[: self.k]
        self.score, self.id = score[order], ids[order]


class Positives:
    """The best of an anchor's own label."""

    same = True

    def __init__(self, k: int, windows: None = None):
        self.best = Best(k)

    def can_stay(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= max(self.best.least(), kth(low, self.best.k))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        self.best.add(score, ids)

    def lists(self) -> list[Best]:
        return [self.best]


class Negatives:
    """The best of the other labels in each of an anchor's windows (least and greatest score)."""

    same = False

    def __init__(self, k: int, windows: np.ndarray):
        self.windows, self.best = windows, [Best(k) for _ in windows]

    def can_stay(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), bool)
        for (least, most), best in zip(self.windows, self.best, strict=True):
            inside = (low >= least) & (high <= most)
            out |= (high >= max(least, best.least(), kth(low[inside], best.k))) & (low <= most)
        return out

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        for (least, most), best in zip(self.windows, self.best, strict=True):
            inside = (score >= least) & (score <= most)
            best.add(score[inside], ids[inside])

    def lists(self) -> list[Best]:
        return self.best


def kind_of(anchors: np.ndarray, vectors: np.ndarray) -> type:
    """float64 where every partial sum and bound is a whole number that it holds exactly (its products are fast), else int64."""
    top = lambda a: int(np.abs(a).max(initial=0))
    return np.float64 if 4 * top(anchors) * top(vectors) * max(1, vectors.shape[1]) < 2**53 else np.int64


def _cell(search: type, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One cell: its anchors (side 0) first, then its vectors by id."""
        heads, ids, labels, rows, waiting, size = [], [], [], None, [], 0

        def searched() -> None:
            names, kinds, v = (np.concatenate([w[i] for w in waiting]) for i in range(3))
            kind = kind_of(rows, v)
            block = Columns(np.ascontiguousarray(v.T.astype(kind)), names, kinds)
            for i, found in enumerate(heads):
                at, score = scan(rows[i].astype(kind), block, block.others(ids[i], labels[i], search.same), found.can_stay)
                found.add(score, names[at])

        for b in filter(len, batches):
            side, names, kinds = (b.column(c).to_numpy() for c in ("side", "vec_id", "label"))
            v = b.column("v").flatten().to_numpy().reshape(len(names), -1).astype(np.int64)
            n = int((side == 0).sum())
            if n:
                heads += [search(k, np.array([(w["least"], w["most"]) for w in x or ()], np.int64).reshape(-1, 2)) for x in b.column("windows").slice(0, n).to_pylist()]
                ids, labels = [*ids, *names[:n]], [*labels, *kinds[:n]]
                rows = v[:n] if rows is None else np.concatenate([rows, v[:n]])
            if n < len(names) and heads:
                waiting.append((names[n:], kinds[n:], v[n:]))
                size += len(names) - n
                if size >= VECTORS:
                    searched()
                    waiting, size = [], 0
        if size:
            searched()
        found = [(ids[i], place, best) for i, head in enumerate(heads) for place, best in enumerate(head.lists()) if len(best.id)]
        for first in range(0, len(found), 4096):
            some = found[first : first + 4096]
            times = [len(best.id) for _, _, best in some]
            out = [np.repeat(np.array([f[i] for f in some], np.int64), times) for i in (0, 1)] + [np.concatenate([getattr(best, x) for _, _, best in some]) for x in ("id", "score")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor_id", "place", "vec_id", "score"])

    return run


def labelled_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component; rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no part."""
    x, limit = F.col(vector_col), F.lit(float("inf"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < limit))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return df.where(x.isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & ok).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v"))


WINDOWS = "array<struct<least:bigint,most:bigint>>"
FOUND = "anchor_id long, place long, vec_id long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Grid:
    """Blocks of anchors by blocks of vectors, and the narrowest type of the components."""

    high: int
    wide: int
    component: str

    def dealt(self, anchors: DataFrame, rows: DataFrame) -> DataFrame:
        """(side, vec_id, label, windows, v), each cell's rows in a partition of their own: anchors first, then vectors by id."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = anchors.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(self.high))).withColumn("j", every(self.wide))
        right = rows.withColumn("j", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(self.wide))).withColumn("i", every(self.high)).withColumn("windows", F.lit(None).cast(WINDOWS))
        cell = (F.col("i") * self.wide + F.col("j")).cast("int").alias("cell")
        kept = lambda df, side: df.select(F.lit(side).alias("side"), "vec_id", "label", "windows", F.col("v").cast(f"array<{self.component}>").alias("v"), cell)
        return kept(left, 0).union(kept(right, 1)).repartitionById(self.high * self.wide, F.col("cell")).sortWithinPartitions("side", "vec_id").drop("cell")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the cells found for each anchor and window, with their rank."""
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors of (vec_id, label, v), v of integers.

    An anchor's positives are its best other rows of its own label; for each, the
    best rows of other labels whose score s has least_percent * p <= 100 * s <=
    most_percent * p, p being the positive's score. Ties go to the smaller id.
    A repeated vec_id is a candidate in each row, but never for an anchor of the
    same id, and a repeated anchor is one (the least label, then vector). Vectors
    of different lengths are searched apart. Anchors without positives and
    positives without negatives give no row; an empty table gives an empty
    result. 100 times a score must fit into 64 bits. Other columns are ignored.

    anchor_block: anchors that a task holds. Labels play no part in how rows are
    dealt, so a frequent one makes no task larger. What a cell passes on is k rows
    an anchor and window.
    """
    spark: SparkSession = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "v")
    top = F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    # a row for each length that vectors have
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.sum(is_anchor.cast("long")).alias("anchors"), top.alias("top")).where("anchors > 0").orderBy("dims").collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = spark.createDataFrame([], MINED)
    for k, r in enumerate(lengths):
        high = -(-r["anchors"] // anchor_block)
        grid = Grid(high, max(1, -(-parts // high)), "smallint" if (r["top"] or 0) < 2**15 else "int" if r["top"] < 2**31 else "bigint")
        mined = _mined(rows.where(F.size("v") == r["dims"]), is_anchor, grid, positives, negatives, least_percent, most_percent)
        out = out.union(mined) if k else mined
    return out


def _mined(rows: DataFrame, is_anchor: Column, grid: Grid, positives: int, negatives: int, least_percent: int, most_percent: int) -> DataFrame:
    """mine() for vectors of one length."""
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    found = grid.dealt(anchors.withColumn("windows", F.lit(None).cast(WINDOWS)), rows).mapInArrow(_cell(Positives, positives), FOUND)
    own = _best(found, positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives"))
    own = materialise(own, "positives")  # read twice below
    # the least whole s with 100 * s >= percent * p, the greatest with 100 * s <= percent * p: div cuts towards 0, so the remainder goes first
    floor = lambda x: f"(({x}) - pmod({x}, 100)) div 100"
    windows = F.expr(f"transform(positives, p -> struct(-({floor(f'-{least_percent} * p.score')}) AS least, {floor(f'{most_percent} * p.score')} AS most))")
    second = anchors.join(own, anchors["vec_id"] == own["anchor_id"]).withColumn("windows", windows)
    hard = _best(grid.dealt(second, rows).mapInArrow(_cell(Negatives, negatives), FOUND), negatives)
    p = F.get("positives", F.col("place").cast("int"))
    return hard.join(own, "anchor_id").select("anchor_id", p["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), p["score"].alias("positive_score"), F.col("score").alias("negative_score"))
