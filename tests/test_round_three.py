"""Findings of round three: joins that stay off the driver, copies, whole sums, bounded memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.operators import atoms, matching


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of all tables that are written on the way."""
    seen, frame = [], type(spark.range(0))
    real = frame.checkpoint

    def checkpoint(self, *a, **b):
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return real(self, *a, **b)

    monkeypatch.setattr(frame, "checkpoint", checkpoint)
    return seen


def crowded(spark, tmp_path):
    """Points on few places, many of them copies, and a few far off."""
    rng = np.random.default_rng(5)
    p = [*rng.integers(0, 6, (150, 2)), *rng.integers(0, 400, (50, 2))]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(p)]
    spark.createDataFrame(rows, "id long, x double, y double").write.parquet(f"{tmp_path}/points")
    return rows, spark.read.parquet(f"{tmp_path}/points")


def test_k_nearest_of_copies_without_a_broadcast(spark, tmp_path, plans):
    rows, df = crowded(spark, tmp_path)
    out = matching.k_nearest_all(df, 4, 16.0)
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append((r.rank, r.n_id, r.distance))
    for i, x, y in rows:
        want = sorted((float(np.hypot(x - a, y - b)), j) for j, a, b in rows if j != i)[:4]
        assert [(n, d) for _, n, d in sorted(got[i])] == [(j, d) for d, j in want]
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]


def test_k_nearest_narrows_crowded_cells(spark):
    df = spark.range(4096).select("id", (F.col("id") % 64).cast("double").alias("x"), F.floor(F.col("id") / 64).cast("double").alias("y"))
    assert matching.fitting_width(df, 16.0, 20) == 4.0 and matching.fitting_width(df, 2.0, 20) == 2.0
    # copies can't be parted
    assert matching.fitting_width(df.select(F.lit(1e6).alias("x"), F.lit(0.0).alias("y")), 16.0, 20) < 1e-8
    assert matching.fitting_width(df.where("false"), 16.0, 20) == 16.0


@pytest.mark.parametrize("vx, vy, tolerance", [(-3.0, 2.0, 0.4), (0.4, 0.3, 4.0), (40.0, 0.0, 1.0)])
def test_dumbbell_pairs_of_copies_without_a_broadcast(spark, tmp_path, plans, vx, vy, tolerance):
    rows, df = crowded(spark, tmp_path)
    reach, at = tolerance * (vx * vx + vy * vy) ** 0.5, {i: (x, y) for i, x, y in rows}
    near = sorted((float(np.hypot(at[b][0] - (at[a][0] + vx), at[b][1] - (at[a][1] + vy))), a, b) for a in at for b in at if a != b)
    firsts, seconds, want = set(), set(), set()
    for dist, a, b in near:
        if dist <= reach and a not in firsts and b not in seconds:
            firsts.add(a)
            seconds.add(b)
            want.add((a, b, round(dist, 9)))
    out = atoms.dumbbell_pairs(df, vx, vy, tolerance)
    assert {(r.a, r.b, round(r.distance, 9)) for r in out.collect()} == want
    assert not [p for p in plans if "Broadcast" in p]


def test_members_are_summed_where_all_are(spark, tmp_path):
    from scanweave.plans import core_queries

    # 4 rows of 25 positions, the last one filled in part
    rows = [(i, [float(i)] * 64) for i in range(85)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = {divmod(i, 25): 64.0 * i for i, _ in rows}
    want = {(y, x - 2): v + at[y + 2, x - 2] for (y, x), v in at.items() if x >= 2 and (y + 2, x - 2) in at}
    got = {(r.y, r.x): r.value for r in core_queries.sum_aligned_members(spark, str(tmp_path)).collect()}
    assert got == want and (1, 5) in got and (1, 15) not in got


def test_the_scene_keeps_its_texture_with_many_line_items(spark, tmp_path):
    from scanweave.plans import image_queries

    spark.range(1_500_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (1.0 + F.col("id") % 50).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    inside = image_queries.scene(spark, str(tmp_path), 40).where("y BETWEEN 4 AND 35 AND x BETWEEN 4 AND 35")
    assert 0.8 < inside.agg(F.stddev("v")).first()[0] < 1.2


def search_peak(spark, monkeypatch, orientation):
    """Peak MB of one full cell of the exhaustive search."""
    import tracemalloc

    import pandas as pd

    held = {}
    monkeypatch.setattr(orientation, "compared", lambda *a: held.update(run=a[5], tile=a[4]) or spark.createDataFrame([], "id long, template long, score double"))
    rng = np.random.default_rng(1)
    orientation.dictionary_index(*[spark.createDataFrame([(0, [0.0, 1.0])], "id long, pattern array<double>")] * 2, 3)
    frame = lambda n: pd.DataFrame({"id": np.arange(n), "pattern": list(rng.normal(size=(n, 16)))})
    templates, batch = frame(16_384), frame(2048)
    tracemalloc.start()
    rows = sum(len(x) for x in held["run"](templates, iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 3 * 2048
    return peak


def test_a_cell_of_the_exhaustive_search_is_bounded(spark, monkeypatch):
    from scanweave.operators import orientation

    assert search_peak(spark, monkeypatch, orientation) < 150


def test_previews_without_expiry_call_no_python(spark, tmp_path):
    from scanweave.streaming import preview

    rows = spark.range(4).select(F.col("id").alias("k"), F.col("id").alias("o"), F.when(F.col("id") == 1, float("nan")).otherwise(F.col("id").cast("double")).alias("v"), F.current_timestamp().alias("ts"))
    rows.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    live = preview.live_latest(stream, ("k",), "o", "v")
    assert "PandasWithState" not in live._jdf.queryExecution().analyzed().toString()
    preview.keep_updates(live, f"{tmp_path}/updates", f"{tmp_path}/checkpoint").awaitTermination()
    # what is no number is null, as it was
    assert {(r.k, r.v) for r in preview.preview(spark, f"{tmp_path}/updates", ("k",)).collect()} == {(0, 0.0), (1, None), (2, 2.0), (3, 3.0)}


def test_dumbbell_tiles_repeat_few_pixels(spark):
    import inspect

    from scanweave.operators import halo, refine

    tile = inspect.signature(refine.refined_pairs).parameters["tile"].default
    side = 4 * tile
    pixels = spark.range(0, side * side, 7).select(F.floor(F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"))
    assert halo.tiled(pixels, 10, tile).count() < 1.2 * pixels.count()
