"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

A document's set is its distinct runs of five words (ASCII letters lower-cased).
Two permutations give all coordinates of its signature: the first, sigma,
scatters the shingles over the 64-bit circle; the second, pi, ranks the points,
and coordinate k ranks them after the circle has been turned by k steps. Bands
of four coordinates make bucket keys: a pair at similarity 0.75 shares none of
the 32 buckets with a probability of 5 in a million.

Copies (equal sets) are one class with one representative. Inside a bucket pairs
are not enumerated: every member is held against three hubs, and links are
confirmed on the full sets. What the hubs leave apart is compared too: in small
buckets pairs of different components, in large ones the members outside the
bucket's main component against all, in blocks that pass only confirmed links.
So a bucket costs about its size, and no link that joins two components is lost.

Facts about a bucket (its size, its hubs) are written before its members are
joined with them: both sides of every such join are plain tables, which adaptive
execution cuts where one key's rows are too many for a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import WordHashes, lists, materialise, mixed, text_bytes, windows

SHINGLE, SIMILAR = 5, 75
BANDS, ROWS = 32, 4
#: The turn of the circle from one coordinate to the next, an odd number.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles taken at once, so that a block stays in the processor's cache.
BLOCK = 1 << 15
SMALL_BUCKET, TILE = 64, 512


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter document is one shingle, one without words has none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    return np.unique(windows(h, min(SHINGLE, len(h))) ^ np.uint64(min(SHINGLE, len(h))))


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """(documents, coordinates) of circulant MinHash; the sets are not empty."""
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    sigma = mixed(np.concatenate(sets))
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        turned = sigma - np.uint64(int(STEP) * k % 2**64)
        x = (turned >> np.uint64(32)).astype(np.uint32) ^ turned.astype(np.uint32)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) of 64-bit bucket keys; the band's number is part of the key."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * STEP, parts.shape[:2])
    for r in range(ROWS):
        key = mixed(key + parts[:, :, r])
    return key.astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids, sets = batch.column(0).to_pylist(), []
        sets = [shingle_set(t.lower().split(), hashes) for t in text_bytes(batch.column(1))]
        keys = np.zeros((len(sets), BANDS), np.int64)
        full = [i for i, s in enumerate(sets) if len(s)]
        at = 0
        while at < len(full):
            end, size = at, 0
            while end < len(full) and (end == at or size + len(sets[full[end]]) <= BLOCK):
                size += len(sets[full[end]])
                end += 1
            keys[full[at:end]] = band_keys(signatures([sets[i] for i in full[at:end]]))
            at = end
        n = np.array([len(s) for s in sets], np.int64)
        # two sums of different mixes of a set's members stand for the whole set
        f1 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
        f2 = np.array([mixed(s ^ STEP).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
        flat = keys[full].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(f1), pa.array(f2), lists(flat, np.where(n > 0, BANDS, 0), pa.int64())], ["doc_id", "n_shingles", "f1", "f2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.lower().split(), hashes).view(np.int64) for t in text_bytes(batch.column(1))]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(flat, [len(s) for s in sets], pa.int64())], ["id", "members"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose sets are similar enough."""
    a = sets.select(F.col("id").alias("ia"), F.col("members").alias("sa"))
    b = sets.select(F.col("id").alias("ib"), F.col("members").alias("sb"))
    both = pairs.join(b, pairs["b"] == b["ib"]).join(a, F.col("a") == F.col("ia"))
    # a pair whose sizes alone rule it out needs no intersection
    fit = F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * SIMILAR
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(fit).select("a", "b", shared.alias("n"), (F.size("sa") + F.size("sb")).alias("m")).where(F.col("n") * 100 >= (F.col("m") - F.col("n")) * SIMILAR).select("a", "b")


def _tile_links(rows: pa.Table) -> pa.Table:
    """Links between a tile's two sides, by a product of 0/1 matrices: side 0 is the rows outside the main component."""
    side, ids, roots = (rows.column(c).to_numpy() for c in ("side", "id", "root"))
    members = rows.column("members").combine_chunks()
    flat, offsets = members.flatten().to_numpy(), members.offsets.to_numpy() - members.offsets[0].as_py()
    sizes = np.diff(offsets)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = [], []
    if len(left) and len(right):
        names, code = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        common = np.zeros((len(left), len(right)), np.float32)
        lplace, rplace = np.full(len(ids), -1), np.full(len(ids), -1)
        lplace[left], rplace[right] = np.arange(len(left)), np.arange(len(right))
        for first in range(0, len(names), 4096):  # a slice of the shingles at a time bounds the matrices
            take = (code >= first) & (code < first + 4096)
            c, o = code[take] - first, owner[take]
            ml, mr = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            ml[lplace[o[lplace[o] >= 0]], c[lplace[o] >= 0]] = 1
            mr[rplace[o[rplace[o] >= 0]], c[rplace[o] >= 0]] = 1
            common += ml @ mr.T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        linked = (100 * common >= SIMILAR * union) & (roots[left][:, None] != roots[right][None, :])
        i, j = np.nonzero(linked)
        # a link to each other component is enough
        seen = np.unique(np.stack([i, roots[right][j]], axis=1), axis=0, return_index=True)[1]
        a, b = ids[left][i[seen]], ids[right][j[seen]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _unequal(bucketed: DataFrame, roots: DataFrame) -> DataFrame:
    """Bucket members with their component, where a bucket has more than one."""
    r = roots.select(F.col("id").alias("rid"), F.col("root").alias("r"))
    named = materialise(bucketed.join(r, bucketed["id"] == r["rid"], "left").select("key", "id", "size", F.coalesce("r", "id").alias("root")), "named")
    mixed_keys = materialise(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") < F.col("hi")).select(F.col("key").alias("mk")), "mixed")
    return named.join(mixed_keys, named["key"] == mixed_keys["mk"]).drop("mk")


def _part(x: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(x), n).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs.

    component_id is the smallest id reachable over links of similarity >= 0.75,
    kept whether it is the document's own. Documents without words link with
    nothing and are kept. Ids are integers; rows of one id with different texts
    count as one document that links with both, and a null id is its own
    component. An empty table gives an empty result. Other columns are ignored.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialise(cols.mapInArrow(_sketch, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"), "sketches")

    # classes of equal sets; rep is the smallest id
    full = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "classes")
    members = classes.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("h0"), F.max("id").alias("h1"), F.min_by("id", F.xxhash64("id")).alias("h2")).where(F.col("size") > 1)
    buckets = materialise(buckets.withColumnRenamed("key", "bkey"), "bucket-sizes")
    bucketed = materialise(members.join(buckets, members["key"] == buckets["bkey"]).drop("bkey"), "buckets")

    needed = bucketed.select("id").distinct().withColumnRenamed("id", "nid")
    sets = materialise(cols.join(needed, cols["doc_id"] == needed["nid"], "left_semi").mapInArrow(_sets, "id long, members array<long>"), "sets")

    hubs = bucketed.select(F.col("id").alias("b"), F.explode(F.array("h0", "h1", "h2")).alias("a")).where(F.col("a") != F.col("b"))
    links = materialise(_confirmed(hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets), "links")
    same_id = full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("a")).join(full, ["f1", "f2", "n_shingles"]).where(F.col("a") != F.col("doc_id")).select("a", F.col("doc_id").alias("b"))
    roots = components(links)

    apart = materialise(_unequal(bucketed, roots), "apart")
    small, large = apart.where(F.col("size") <= SMALL_BUCKET), apart.where(F.col("size") > SMALL_BUCKET)
    other = small.select(F.col("key").alias("okey"), F.col("id").alias("b"), F.col("root").alias("broot"))
    pairs = small.join(other, (small["key"] == other["okey"]) & (F.col("id") < F.col("b")) & (F.col("root") != F.col("broot"))).select(F.col("id").alias("a"), "b").distinct()
    tried = hubs.select(F.least("a", "b").alias("ta"), F.greatest("a", "b").alias("tb"))
    pairs = pairs.join(tried, (pairs["a"] == tried["ta"]) & (pairs["b"] == tried["tb"]), "left_anti")
    more = _confirmed(pairs, sets)
    more = materialise(more.union(_large_links(large, sets)), "links")
    linked = links.union(more).union(same_id) if _repeated(cols) else links.union(more)
    roots = components(linked)

    reps = classes.select("f1", "f2", F.col("n_shingles").alias("n"), "rep")
    r = roots.select(F.col("id").alias("rid"), "root")
    reps = reps.join(r, reps["rep"] == r["rid"], "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "n", F.coalesce("root", "rep").alias("root"))
    found = full.select("doc_id", "n_shingles", "f1", "f2").join(reps, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") == F.col("n")))
    # documents without words, which all have one key, meet nothing
    rest = sketch.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    out = found.select("doc_id", "n_shingles", "root").union(rest.select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _repeated(cols: DataFrame) -> bool:
    """Whether an id stands in more than one row; then copies' classes can meet in it."""
    return not cols.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty()


def _large_links(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in large buckets between members outside the main component (rest) and all members, tile by tile."""
    by_root = large.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).withColumnRenamed("key", "mkey")
    main = materialise(main, "main")
    tiles = main.withColumn("nl", F.ceil((F.col("all") - F.col("most")) / TILE).cast("int")).withColumn("nr", F.ceil(F.col("all") / TILE).cast("int"))
    rows = large.join(tiles, large["key"] == tiles["mkey"])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.where(F.col("root") != F.col("main")).select("key", _part(F.col("id"), F.col("nl")).alias("i"), every(F.col("nr")).alias("j"), F.lit(0).alias("side"), "id", "root")
    right = rows.select("key", every(F.col("nl")).alias("i"), _part(F.col("id"), F.col("nr")).alias("j"), F.lit(1).alias("side"), "id", "root")
    s = sets.withColumnRenamed("id", "sid")
    both = left.union(right)
    return both.join(s, both["id"] == s["sid"]).groupBy("key", "i", "j").applyInArrow(_tile_links, "a long, b long")
