"""The live preview against a plain loop: restarts, order, readiness, expiry."""

from datetime import datetime, timedelta

import pytest

from scanweave.streaming import preview

SCHEMA = "k string, o long, v double, ts timestamp"
START = datetime(2024, 1, 1)


def run(spark, to, batches, **options):
    """Each batch is a file and a run of its own: every run goes on from the checkpoint of the one before."""
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{to}/rows")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{to}/rows")
        preview.keep_updates(preview.live_latest(stream, ("k",), "o", "v", **options), f"{to}/updates", f"{to}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{to}/updates")


def test_order_ties_nulls_and_restarts(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [("a", 5, 1.0, at(0)), ("b", 1, None, at(0)), (None, 1, 4.0, at(0)), ("c", None, 9.0, at(0))],
        [("a", 3, 2.0, at(1)), ("b", 1, 2.0, at(1)), ("b", 1, 1.5, at(1)), ("a", 5, 0.5, at(1))],
        [("a", 2**53 + 1, None, at(2)), (None, 0, 1.0, at(2)), ("c", None, 1.0, at(2)), ("b", 1, None, at(2))],
    ]
    updates = run(spark, f"file://{tmp_path}", batches, ready_after=3)
    got = {r.k: (r.o, r.v, r.n, r.ready) for r in preview.preview(spark, f"file://{tmp_path}/updates", ("k",)).collect()}
    assert got == {"a": (2**53 + 1, None, 4, True), "b": (1, 2.0, 4, True), None: (1, 4.0, 2, False)}
    # once ready, a key stays ready; an old row changes nothing but the count
    history = [(r.o, r.v, r.n, r.ready) for r in updates.where("k = 'a'").orderBy("number").collect()]
    assert history == [(5, 1.0, 1, False), (5, 1.0, 3, True), (2**53 + 1, None, 4, True)]


def test_keys_expire_and_begin_anew(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [("a", 1, 1.0, at(0)), ("b", 1, 1.0, at(0))],
        [("b", 2, 2.0, at(50))],
        [("b", 3, 3.0, at(100))],
        [("b", 4, 4.0, at(101))],
        [("a", 0, 7.0, at(110))],
    ]
    updates = run(spark, f"file://{tmp_path}", batches, ready_after=2, expire_seconds=60.0, late_seconds=5.0)
    a = [(r.o, r.v, r.n, r.ready, r.expired) for r in updates.where("k = 'a'").orderBy("number", "n").collect()]
    assert a == [(1, 1.0, 1, False, False), (1, 1.0, 1, False, True), (0, 7.0, 1, False, False)]
    assert {r.k: (r.o, r.n) for r in preview.preview(spark, f"file://{tmp_path}/updates", ("k",)).collect()} == {"a": (0, 1), "b": (4, 4)}


def test_a_table_is_refused(spark):
    with pytest.raises(ValueError):
        preview.live_latest(spark.createDataFrame([], SCHEMA), ("k",), "o", "v")
