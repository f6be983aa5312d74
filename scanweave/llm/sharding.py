"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

The documents are points whose dimensions are metadata (source, language,
length, id) and whose weight is their size in bytes. A node of the tree that is
to hold k leaves is cut along its widest dimension at the weighted quantile
floor(k/2)/k, the weighted median for even k, until every node holds one leaf of
about the target bytes. All nodes of a level are cut together by distributed
histograms: the executors find the bin that holds the quantile and sum up what
lies on either side of it, and that bin alone is divided again, between the
least and the greatest key in it, until the cut is close enough. The sums also
hold the spans of both sides, so the next level needs no pass to find them.

Three rows for each node that is cut reach the driver in a pass (below, inside
and above the bin), and the tree goes back in the plan; trees of over MOST_LEAVES
leaves are grown down to nodes of that many, which are written apart and grown on
their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Bits of an order key: the dimension's value above, a hash of the row below, so that equal values can be cut too.
VALUE_BITS, HASH_BITS, BIN_BITS = 30, 32, 10
DIMS, MOST_LEAVES = 4, 256


@dataclass
class Node:
    """shards [first, first + leaves); left takes the keys of dimension dim below cut."""

    first: int
    leaves: int
    dim: int = -1
    cut: int = 0


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _points(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    text, doc = F.col(text_col), F.col(id_col).cast("long")
    size = text_size(text)
    code = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 32 - VALUE_BITS)
    length = F.least(F.log2(size.cast("double")) * F.lit(1 << 24), F.lit(float((1 << VALUE_BITS) - 1))).cast("long")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), code(source_col).alias("v0"), code(lang_col).alias("v1"), length.alias("v2"), F.coalesce(doc, F.lit(0)).alias("raw_id"),
        F.xxhash64(doc, crc, F.lit("shard")).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("low"),
    )


def _node_of(nodes: list[Node]) -> Column:
    """The index into nodes of a row's deepest node so far: a walk from the root with the tree in literal arrays."""
    at = {(n.first, n.leaves): i for i, n in enumerate(nodes)}
    left, dim, cut = [], [], []
    for i, n in enumerate(nodes):
        child = at.get((n.first, n.leaves // 2)) if n.dim >= 0 else None
        left.append(i if child is None else child)  # a node's right child follows its left one
        dim.append(max(0, n.dim))
        cut.append((1 << 62) if child is None else n.cut)
    depth = max(1, (nodes[0].leaves - 1).bit_length())
    of = lambda values, i, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), i)
    keys = F.array(*[F.col(f"k{d}") for d in range(DIMS)])
    step = lambda node, _: of(left, node, "int") + (F.get(keys, of(dim, node, "int")) >= of(cut, node, "long")).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


@dataclass
class Part:
    """What is known of a set of points: their bytes and rows, and the least and greatest value of each dimension."""

    bytes: int = 0
    rows: int = 0
    low: list[int] = field(default_factory=lambda: [1 << 62] * DIMS)
    high: list[int] = field(default_factory=lambda: [-1] * DIMS)

    def __add__(self, other: Part) -> Part:
        return Part(self.bytes + other.bytes, self.rows + other.rows, [*map(min, self.low, other.low)], [*map(max, self.high, other.high)])

    @classmethod
    def of(cls, row) -> Part:
        return cls(row["bytes"], row["n"], [row[f"lo{d}"] for d in range(DIMS)], [row[f"hi{d}"] for d in range(DIMS)])


@dataclass
class Search:
    """A node's cut, known to lie between the keys lo and hi (exclusive): what lies below and above them, and the bytes that are to lie below the cut."""

    dim: int
    lo: int
    hi: int
    goal: float
    close: float
    below: Part = field(default_factory=Part)
    above: Part = field(default_factory=Part)

    @property
    def step(self) -> int:
        return max(0, (self.hi - self.lo - 1).bit_length() - BIN_BITS)


def _sums(kind: Callable = F.sum) -> list[Column]:
    """Aggregates of points (sums of size and 1) or of sums of points."""
    bytes_, rows = (F.sum("size"), F.count("*")) if kind is F.sum else (F.sum("bytes"), F.sum("n"))
    value = lambda name, d: F.shiftright(F.col(f"k{d}"), HASH_BITS) if kind is F.sum else F.col(f"{name}{d}")
    return [bytes_.alias("bytes"), rows.alias("n"), *[f(value(n, d)).alias(f"{n}{d}") for d in range(DIMS) for n, f in (("lo", F.min), ("hi", F.max))]]


def _round(placed: DataFrame, searches: dict[int, Search], n_nodes: int) -> dict[tuple[int, int], object]:
    """(node, side) -> sums of the rows below (-1), inside (0) and above (1) the bin that holds each node's cut; the bin's row has its least and greatest key too."""
    by_node = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("node"))
    of = lambda f: [f(searches[i]) if i in searches else 0 for i in range(n_nodes)]
    key = F.get(F.array(*[F.col(f"k{d}") for d in range(DIMS)]), by_node(of(lambda c: c.dim), "int"))
    lo, hi, step = by_node(of(lambda c: c.lo), "long"), by_node(of(lambda c: c.hi), "long"), by_node(of(lambda c: c.step), "int")
    rows = placed.where(F.col("node").isin(list(searches))).select("node", "size", *[f"k{d}" for d in range(DIMS)], key.alias("key"), lo.alias("lo"), hi.alias("hi"), step.alias("step"))
    rows = rows.where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))).withColumn("bin", F.expr("shiftright(key - lo, step)"))
    bins = rows.groupBy("node", "bin").agg(*_sums(), F.min("key").alias("least"), F.max("key").alias("most"))
    # a node has at most 2 ** BIN_BITS bins
    upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = by_node(of(lambda c: c.goal - c.below.bytes), "double")
    bins = bins.withColumn("upto", upto).withColumn("hit", F.when(F.col("upto") >= reach, F.col("bin")))
    all_bins = Window.partitionBy("node")
    # where rounding leaves the goal beyond the last bin, that one holds it
    chosen = F.coalesce(F.min("hit").over(all_bins), F.max("bin").over(all_bins))
    sides = bins.withColumn("side", F.signum((F.col("bin") - chosen).cast("double")).cast("int"))
    sums = sides.groupBy("node", "side").agg(*_sums(F.max), F.min("least").alias("least"), F.max("most").alias("most"))
    return {(r["node"], r["side"]): r for r in sums.collect()}


def kd_tree(points: DataFrame, whole: Part, shards: int, closeness: float, most_leaves: int = 1, root: list[int] | None = None) -> list[Node]:
    """The tree's nodes, root first, cut until they hold at most most_leaves. points has size and the order keys k0, k1, ...; whole sums them up; root has the dimensions' widths to compare with, by default those of whole."""
    nodes, parts = [Node(0, shards)], [whole]
    level = [0] if shards > most_leaves else []
    width = lambda p: [max(0, b - a) for a, b in zip(p.low, p.high, strict=True)]
    root = root or [max(1, w) for w in width(whole)]
    while level:
        placed, searches = points.withColumn("node", _node_of(nodes)), {}
        for i in level:
            n, p = nodes[i], parts[i]
            n.dim = max(range(DIMS), key=lambda d: (width(p)[d] / root[d], -d))
            if not p.rows:  # any cut does
                n.cut = 0
            else:
                searches[i] = Search(n.dim, p.low[n.dim] << HASH_BITS, (p.high[n.dim] + 1) << HASH_BITS, p.bytes * (n.leaves // 2) / n.leaves, closeness * p.bytes / n.leaves)
        halves = {i: (Part(), Part()) for i in level}
        while searches:
            found = _round(placed, searches, len(nodes))
            for i, c in list(searches.items()):
                c.below, c.above = (p + Part.of(found[i, side]) if (i, side) in found else p for p, side in ((c.below, -1), (c.above, 1)))
                inside, r = Part.of(found[i, 0]), found[i, 0]
                if inside.bytes > c.close and inside.rows > 1 and r["least"] < r["most"]:
                    c.lo, c.hi = r["least"], r["most"] + 1
                    continue
                down = c.below.bytes + inside.bytes - c.goal < c.goal - c.below.bytes
                nodes[i].cut = r["most"] + 1 if down else r["least"]
                halves[i] = (c.below + inside, c.above) if down else (c.below, inside + c.above)
                del searches[i]
        children = []
        for i in level:
            n, half = nodes[i], nodes[i].leaves // 2
            for (first, leaves), part in zip(((n.first, half), (n.first + half, n.leaves - half)), halves[i], strict=True):
                nodes.append(Node(first, leaves))
                parts.append(part)
                if leaves > most_leaves:
                    children.append(len(nodes) - 1)
        level = children
    return nodes


def _leaves(points: DataFrame, whole: Part, shards: int, closeness: float, first: int = 0, root: list[int] | None = None) -> DataFrame:
    """points with shard, from first on."""
    if shards <= MOST_LEAVES:
        nodes = kd_tree(points, whole, shards, closeness, root=root)
        return points.withColumn("shard", F.element_at(F.array(*[F.lit(first + n.first) for n in nodes]), _node_of(nodes) + 1))
    nodes = kd_tree(points, whole, shards, closeness, MOST_LEAVES, root)
    root = root or [max(1, b - a) for a, b in zip(whole.low, whole.high, strict=True)]
    apart = materialise(points.withColumn("node", _node_of(nodes)), "shard-nodes", "node")
    sums = {r["node"]: Part.of(r) for r in apart.groupBy("node").agg(*_sums()).collect()}
    own = [(i, n) for i, n in enumerate(nodes) if n.dim < 0]
    return reduce(DataFrame.union, [_leaves(apart.where(F.col("node") == i).drop("node"), sums.get(i, Part()), n.leaves, closeness, first + n.first, root) for i, n in own])


def shard(
    docs: DataFrame,
    shards: int | None = 40,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    closeness: float = 0.005,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row's shard, and its place in it, gapless from 0.

    size is the text's UTF-8 bytes (null: none) plus 16. shards is the number of
    leaves; where it is None, leaves are to hold target_bytes. A cut is searched
    until the bin that holds it has at most closeness of a leaf's bytes or one
    row. The shards' bytes are near equal, and nothing stands above that: rows
    equal in a dimension are divided by a hash of the row, so neither a source nor
    a group of equal texts is bound to one shard; copies of one row (equal id and
    text) stay together. An empty table gives an empty result; fewer rows
    than shards leave shards empty. Other columns of docs are ignored. The
    result depends on the rows alone, not on their order or partitions.
    """
    raw = materialise(_points(docs, id_col, text_col, source_col, lang_col), "shard-points")
    top = (1 << VALUE_BITS) - 1
    facts = raw.agg(F.min("raw_id").alias("lo"), F.max("raw_id").alias("hi"), F.sum("size").alias("bytes"), F.count("*").alias("n"), *[f(f"v{d}").alias(f"{n}{d}") for d in range(3) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    n = facts["n"]
    if shards is None:
        shards = max(1, -(-(facts["bytes"] or 0) // max(1, target_bytes or 1)))
    lo, hi = facts["lo"] or 0, facts["hi"] or 0
    v3 = ((F.col("raw_id").cast("double") - F.lit(float(lo))) * F.lit(top / max(1.0, float(hi) - float(lo)))).cast("long")
    raw = raw.withColumn("v3", F.least(F.greatest(v3, F.lit(0)), F.lit(top)))
    points = raw.select("doc_id", "size", "text_crc32", "low", *[F.expr(f"shiftleft(v{d}, {HASH_BITS}) + low").alias(f"k{d}") for d in range(DIMS)])
    # the ids are scaled to the whole width
    whole = Part(facts["bytes"], n, [*(facts[f"lo{d}"] for d in range(3)), 0], [*(facts[f"hi{d}"] for d in range(3)), top if hi > lo else 0]) if n else Part()
    placed = _leaves(points, whole, shards, closeness).select("doc_id", "size", "text_crc32", "low", "shard")
    return with_slots(placed, max(1, n // (256 * max(1, shards))))


def with_slots(placed: DataFrame, parts: int) -> DataFrame:
    """slot: numbers within a shard from counts by (shard, part of the hash), so that no task sorts a shard."""
    placed = placed.withColumn("part", F.pmod(F.col("low"), F.lit(parts)).cast("int"))
    line = Window.partitionBy("c_shard").orderBy("c_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(F.col("shard").alias("c_shard"), F.col("part").alias("c_part")).agg(F.count("*").alias("n"))
    counts = counts.select("c_shard", "c_part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("first"))
    joined = placed.join(counts, (F.col("shard") == F.col("c_shard")) & (F.col("part") == F.col("c_part")))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + nth - 1).cast("long").alias("slot"))
