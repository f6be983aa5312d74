"""Stacks read by byte ranges against the whole-file readers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.sources import ranges, store


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.i, r.height, r.width, tuple(r.frame)) for r in df.collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to, rng = tmp_path_factory.mktemp("stacks"), np.random.default_rng(0)
    for kind in ("npy", "mrc", "raw", "none"):
        (to / kind).mkdir()
    a = rng.integers(0, 9999, (3, 7, 4, 5)).astype("<u2")
    np.save(to / "npy" / "c.npy", a)
    np.save(to / "npy" / "fortran.npy", np.asfortranarray(a))
    np.save(to / "npy" / "line.npy", np.arange(6.0))
    np.save(to / "npy" / "image.npy", a[0, 0].astype(">f4"))
    head = np.zeros(256, "<i4")
    head[:4], head[23] = (5, 4, 21, 6), 64
    (to / "mrc" / "a.mrc").write_bytes(head.tobytes() + b"\1" * 64 + a.tobytes())
    for name in ("a.raw", "b.raw"):
        (to / "raw" / name).write_bytes(b"\2" * 11 + a.tobytes() + b"\3" * 7)
    (to / "raw" / "_SUCCESS").write_bytes(b"")
    return to


@pytest.mark.parametrize("task_bytes", (1, 130, 1 << 20))
def test_ranges_equal_whole_files(spark, folder, task_bytes):
    for kind in ("npy", "mrc"):
        assert rows(ranges.frame_ranges(spark, str(folder / kind), kind=kind, task_bytes=task_bytes)) == rows(store.stack_frames(spark, str(folder / kind), kind))
    got = ranges.frame_ranges(spark, f"file://{folder}/raw", height=4, width=5, header=11, task_bytes=task_bytes)
    want = store.raw_frames(spark, str(folder / "raw" / "*.raw"), 4, 5, header=11).select("path", "i", F.lit(4).alias("height"), F.lit(5).alias("width"), "frame")
    assert rows(got) == rows(want) and got.count() == 42
    if task_bytes == 1:
        assert got.rdd.getNumPartitions() == 42


def test_bounds_of_i_are_pushed_down(spark, folder):
    df = ranges.frame_ranges(spark, f"file:{folder}/raw/a.raw", height=4, width=5, header=11, task_bytes=40)
    every = rows(df)
    for cond in ("i = 4", "i > 17", "i >= 3 AND i < 5", "i <= 2", "i IN (1, 19)", "i > 30", "i = 2 AND height = 4", "i IS NULL", "i <> 3", "i = 3 OR i = 20"):
        part = df.where(cond)
        kept = [r for r in every if eval(cond.replace(" = ", " == ").replace("AND", "and").replace("OR", "or").replace("IN", "in").replace("<>", "!=").replace("IS NULL", "is None"), {"i": r[1], "height": r[2]})]
        assert rows(part) == kept, cond
    assert df.where("i = 4").rdd.getNumPartitions() == 1 and df.where("i >= 3 AND i < 5").rdd.getNumPartitions() == 2


def test_a_long_stack_is_many_tasks(spark, tmp_path):
    """Three gigabytes (a sparse file): beyond what one binary value can hold; its last frames are read alone."""
    side, n = 1024, 1500
    path = tmp_path / "long.raw"
    with open(path, "wb") as f:
        f.truncate(side * side * 2 * n)
        f.seek(side * side * 2 * (n - 1))
        f.write(np.full(side * side, 7, "<u2").tobytes())
    df = ranges.frame_ranges(spark, str(path), height=side, width=side)
    assert df.rdd.getNumPartitions() == -(-n // 32)
    got = df.where(f"i >= {n - 2}").select("i", F.aggregate("frame", F.lit(0.0), lambda a, v: a + v).alias("s")).collect()
    assert sorted((r.i, r.s) for r in got) == [(n - 2, 0.0), (n - 1, 7.0 * side * side)]


def test_odd_files(spark, folder, tmp_path):
    assert ranges.frame_ranges(spark, str(folder / "none"), kind="npy").count() == 0
    assert ranges.frame_ranges(spark, str(folder / "raw" / "a.raw"), height=400, width=500).count() == 0
    whole = (folder / "mrc" / "a.mrc").read_bytes()
    (tmp_path / "cut.mrc").write_bytes(whole[:-3])
    for path, options in ((tmp_path / "absent", {"kind": "npy"}), (tmp_path / "cut.mrc", {"kind": "mrc"}), (tmp_path, {}), (tmp_path, {"kind": "tiff"})):
        with pytest.raises(Exception):
            ranges.frame_ranges(spark, str(path), **options).collect()
