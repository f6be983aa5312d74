"""Queries over images, movies and files made from the given tables with planted moves, pairs and events; their SQL states what was planted."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import frames, multiangle, refine
from ..sources import ranges, store
from ..streaming import preview
from . import domain as d

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Sides of the members' images, the room around them in the scene, and the light that doesn't move with it.
SIDE, ROOM, LIGHT, TEXTURE = 96, 8, 1500.0, 6.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scene(spark, sf_dir, side: int):
    """(y, x, v): a texture of mean 0 and deviation 1, line items counted by pixels that their keys' hashes give, and smoothed; of bounded size, whatever the table's."""
    hit = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(side * side))
    counts = d.read(spark, sf_dir, "lineitem").groupBy(hit.alias("p")).agg(F.sum("l_quantity").cast("double").alias("n"))
    grid = spark.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"), F.col("id").alias("p"))
    there = grid.join(counts, "p", "left").select("y", "x", F.coalesce("n", F.lit(0.0)).alias("n"))
    # counts less their mean: else the pixels at the border, which sum fewer, would stand out the more the more line items there are
    level = there.crossJoin(F.broadcast(there.agg(F.avg("n").alias("m")))).select("y", "x", (F.col("n") - F.col("m")).alias("n"))
    bell = {-2: 0.1353, -1: 0.6065, 0: 1.0, 1: 0.6065, 2: 0.1353}
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(v * w).alias("w")) for a, v in bell.items() for b, w in bell.items()])
    near = level.select("y", "x", "n", F.explode(steps).alias("s"))
    smooth = near.groupBy((F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x")).agg(F.sum(F.col("n") * F.col("s.w")).alias("v"))
    full = smooth.where(F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1))
    one = full.agg(F.avg("v").alias("m"), F.stddev("v").alias("s"))
    return full.crossJoin(F.broadcast(one)).select("y", "x", ((F.col("v") - F.col("m")) / F.col("s")).alias("v"))


_MOVES = "CAST(r_regionkey * 5 % 7 AS INT) AS oy, CAST(-(r_regionkey * 3 % 5) AS INT) AS ox"


def members(spark, sf_dir):
    """(member, frame): a member for each region, its part of the scene moved by whole pixels under a light that stays."""
    k = F.col("r_regionkey")
    m = d.read(spark, sf_dir, "region").select(k.cast("int").alias("member"), (k * 5 % 7).cast("int").alias("oy"), (-(k * 3 % 5)).cast("int").alias("ox"))
    at = scene(spark, sf_dir, SIDE + 2 * ROOM).crossJoin(F.broadcast(m)).select("member", (F.col("y") - ROOM + F.col("oy")).alias("y"), (F.col("x") - ROOM + F.col("ox")).alias("x"), "v")
    light = LIGHT * F.exp(-((F.col("y") - SIDE // 2) ** 2 + (F.col("x") - SIDE // 2) ** 2) / (2 * 120.0**2))
    seen = at.where(F.col("y").between(0, SIDE - 1) & F.col("x").between(0, SIDE - 1)).select("member", "y", "x", (20 + light + TEXTURE * F.col("v")).alias("v"))
    return seen.groupBy("member").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p")).select("member", F.col("p.v").alias("frame"))


@query(f"SELECT CAST(r_regionkey AS INT) AS member, {_MOVES}, true AS decisive FROM region")
def scored_member_offsets(spark, sf_dir):
    return multiangle.scored_offsets(members(spark, sf_dir), (SIDE, SIDE), 0, 8.0, 0.05).select("member", "oy", "ox", "decisive")


# dumbbells: one for each supplier, 20 to a row of an image, 6 pixels apart in one of eight directions
_DUMBBELLS = "k AS (SELECT s_suppkey AS k, 24 + 48 * (s_suppkey // 20) + (s_suppkey % 5 - 2) / 5.0::DOUBLE AS my, 24 + 48 * (s_suppkey % 20) + (s_suppkey % 7 - 3) / 7.0::DOUBLE AS mx, s_suppkey % 8 * pi() / 8 AS turn FROM supplier)"


def dumbbells(spark, sf_dir):
    """(k, my, mx, ay, ax, by, bx): planted pairs."""
    k = F.col("s_suppkey")
    c = d.read(spark, sf_dir, "supplier").select(k.alias("k"), (24 + 48 * F.floor(k / 20) + (k % 5 - 2) / 5).alias("my"), (24 + 48 * (k % 20) + (k % 7 - 3) / 7).alias("mx"), (k % 8 * F.pi() / 8).alias("turn"))
    sy, sx = 3 * F.sin("turn"), 3 * F.cos("turn")
    return c.select("k", "my", "mx", (F.col("my") - sy).alias("ay"), (F.col("mx") - sx).alias("ax"), (F.col("my") + sy).alias("by"), (F.col("mx") + sx).alias("bx"))


@query(f"WITH {_DUMBBELLS} SELECT CAST(2 * k AS BIGINT) AS a, CAST(2 * k + 1 AS BIGINT) AS b, 6.0::DOUBLE AS separation, round(my - 3 * sin(turn), 3) AS ay, round(mx - 3 * cos(turn), 3) AS ax, round(my + 3 * sin(turn), 3) AS \"by\", round(mx + 3 * cos(turn), 3) AS bx, round(400.0 + 10 * (k % 9), 3) AS a_volume, true AS fitted FROM k")
def refined_dumbbells(spark, sf_dir):
    p = dumbbells(spark, sf_dir)
    side = F.sequence(F.lit(-16), F.lit(16))
    boxes = p.withColumn("dy", F.explode(side)).withColumn("dx", F.explode(side)).withColumn("y", (F.rint("my") + F.col("dy")).cast("int")).withColumn("x", (F.rint("mx") + F.col("dx")).cast("int"))
    bell = lambda n, v: v / (8 * F.pi()) * F.exp(-((F.col("y") - F.col(f"{n}y")) ** 2 + (F.col("x") - F.col(f"{n}x")) ** 2) / 8)
    pixels = boxes.select(F.lit(0).alias("image"), "y", "x", (bell("a", 400.0 + 10 * (F.col("k") % 9)) + bell("b", F.lit(300.0))).alias("value"))
    at = lambda n, i: p.select(F.lit(0).alias("image"), (2 * F.col("k") + i).alias("id"), F.rint(f"{n}y").alias("y"), F.rint(f"{n}x").alias("x"))
    pairs = p.select(F.lit(0).alias("image"), (2 * F.col("k")).alias("a"), (2 * F.col("k") + 1).alias("b"))
    rows = d.read(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] // 20 + 1
    out = refine.refined_pairs(pixels, at("a", 0).union(at("b", 1)), pairs, (48 * rows, 48 * 20))
    return out.select("a", "b", F.col("a_A").alias("a_volume"), *[F.round(n, 3).alias(n) for n in ("separation", "ay", "ax", "by", "bx")], "fitted").withColumn("a_volume", F.round("a_volume", 3))


_DRIFT = "CAST(n_nationkey * 3 % 7 AS INT) AS dy, CAST(-(n_nationkey * 2 % 5) AS INT) AS dx"


@query(f"SELECT CAST(n_nationkey AS INT) AS t, {_DRIFT}, true AS close FROM nation")
def running_drift(spark, sf_dir):
    side = SIDE
    k = F.col("n_nationkey")
    m = d.read(spark, sf_dir, "nation").select(k.cast("int").alias("t"), (k * 3 % 7).cast("int").alias("dy"), (-(k * 2 % 5)).cast("int").alias("dx"))
    at = scene(spark, sf_dir, side + 2 * ROOM).crossJoin(F.broadcast(m)).select("t", (F.col("y") - ROOM + F.col("dy")).alias("y"), (F.col("x") - ROOM + F.col("dx")).alias("x"), "v")
    movie = at.where(F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p")).select("t", F.col("p.v").alias("frame"))
    got = frames.drift(movie, (side, side), "running", most=8.0).select("t", F.col("dy").alias("gy"), F.col("dx").alias("gx"))
    off = F.greatest(F.abs(F.col("gy") - F.col("dy")), F.abs(F.col("gx") - F.col("dx")))
    return got.join(m, "t").select("t", "dy", "dx", (off <= 0.1).alias("close"))


# files ---------------------------------------------------------------------

def _stacks(spark, sf_dir) -> str:
    """A folder of raw stacks of the embeddings' frames, a file written by each task."""
    to = f"{store.working_dir(spark).rstrip('/')}/scanweave/stacks-{uuid.uuid4().hex}"

    def write(batches):
        files, root = ranges._filesystem(to)
        files.create_dir(root)
        name, n = f"{root}/{uuid.uuid4().hex}.raw", 0
        with files.open_output_stream(name) as f:
            for rows in batches:
                f.write(np.stack(rows["embedding"].to_numpy()).astype("<f4").tobytes() if len(rows) else b"")
                n += len(rows)
        yield pd.DataFrame({"name": [name], "n": [n]})

    # a task that ran twice leaves two files: only those that a finished task named stay
    named = d.read(spark, sf_dir, "embeddings").select("embedding").repartition(4).mapInPandas(write, "name string, n long").toPandas()
    files, root = ranges._filesystem(to)
    for f in files.get_file_info(ranges.fs.FileSelector(root)):
        if f.path not in set(named["name"]):
            files.delete_file(f.path)
    return to


_CODES = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * i))"


@query(f"SELECT round({_CODES}, 5) AS code, count(*) AS n FROM embeddings GROUP BY ALL")
def frames_by_byte_ranges(spark, sf_dir):
    rows = ranges.frame_ranges(spark, _stacks(spark, sf_dir), height=8, width=8, dtype="<f4", task_bytes=16 << 10)
    code = F.aggregate(F.transform("frame", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy(F.round(code, 5).alias("code")).agg(F.count("*").alias("n"))


# streams -------------------------------------------------------------------

@query("SELECT user_id AS pixel, arg_max(value, event_id) AS value, max(event_id) AS event_id, count(*) AS n, count(*) >= 5 AS ready FROM events GROUP BY ALL")
def live_preview(spark, sf_dir):
    """Four micro-batches of events that come out of order, in two runs of the query: the second goes on from the first one's checkpoint."""
    to = f"{store.working_dir(spark).rstrip('/')}/scanweave/preview-{uuid.uuid4().hex}"
    rows = d.read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("pixel"), "value")
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    for run in (0, 1):
        rows.where(F.floor(part / 2) == run).repartition(2, part).write.mode("append").parquet(f"{to}/events")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{to}/events")
        query = preview.keep_updates(preview.live_latest(stream, ("pixel",), "event_id", "value", 5), f"{to}/updates", f"{to}/checkpoint")
        query.awaitTermination()
    return preview.preview(spark, f"{to}/updates", ("pixel",)).select("pixel", "value", "event_id", "n", "ready")
