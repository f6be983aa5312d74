"""Event streams as movies, live counts and latest frames, the same functions for batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def exposure(frame_seconds: float, frames: int | None = None, ms: float | None = None, fps: float | None = None) -> float:
    """Seconds of one plane: frames per plane first, then milliseconds, then planes per second; else one frame."""
    if frames:
        return frames * frame_seconds
    if ms:
        return ms / 1e3
    if fps:
        return 1 / fps
    return frame_seconds


def microseconds(seconds: float) -> str:
    """A span rounded to the clock's resolution. Planes of whole detector frames that aren't whole microseconds are exact by `frame_planes`."""
    return f"{max(1, round(seconds * 1e6))} microseconds"


def planes(events: DataFrame, seconds: float, late_seconds: float | None = None, bin_factor: int = 1, slide_seconds: float | None = None, time: str = "ts", pixel: str = "pixel") -> DataFrame:
    """(start, pixel, n, total): events counted by exposure window and binned pixel.

    On a stream, rows may be late by late_seconds (at least the exposure) before
    their window is closed; the store the domain came from takes rows in any
    order, so choose it generously. slide_seconds makes windows overlap.
    """
    if events.isStreaming:
        events = events.withWatermark(time, microseconds(max(seconds, late_seconds or 0)))
    width = microseconds(seconds)
    span = F.window(time, width, microseconds(slide_seconds) if slide_seconds else width)
    cell = F.floor(F.col(pixel) / bin_factor).cast("long").alias("pixel")
    return events.groupBy(span.alias("w"), cell).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "pixel", "n", "total")


def frame_planes(events: DataFrame, frames_per_plane: int, frame: str = "frame_id") -> DataFrame:
    """(plane, pixel, n): events counted by whole detector frames."""
    return events.groupBy(F.floor(F.col(frame) / frames_per_plane).cast("long").alias("plane"), "pixel").agg(F.count("*").alias("n"))


def raw_frame(events: DataFrame, frame_id: int, frame: str = "frame_id") -> DataFrame:
    return events.where(F.col(frame) == frame_id)


def live_counts(vectors: DataFrame) -> DataFrame:
    """Vectors at each position so far; on a stream use output mode complete or update."""
    return vectors.groupBy("nav_y", "nav_x").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, keys: tuple[str, ...] = ("y", "x"), order: str = "batch") -> DataFrame:
    """The newest row of each position."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def sessions(events: DataFrame, gap_seconds: float, key: str, time: str = "ts", late_seconds: float = 0.0) -> DataFrame:
    """(key, start, end, n): runs of a key's events without a pause as long as the gap."""
    if events.isStreaming:
        events = events.withWatermark(time, microseconds(max(gap_seconds, late_seconds)))
    w = F.session_window(time, microseconds(gap_seconds))
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append(stream: DataFrame, path: str, checkpoint: str, partition: tuple[str, ...] = ()) -> StreamingQuery:
    """Batches that come in any order, appended to a table; sort them by `ragged.finalize` when the stream has ended."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.partitionBy(*partition) if partition else writer).trigger(availableNow=True).start()


def progressive(stream: DataFrame, on_batch, checkpoint: str) -> StreamingQuery:
    """on_batch(df, number) for each micro-batch as it lands; stop() cancels."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch).trigger(availableNow=True).start()


def playback(spark: SparkSession, ticks: int, tick_seconds: float, scale: float, size: int, speed: float = 1.0, start: int = 0, loop: bool = True) -> DataFrame:
    """(tick, index): floor(start + elapsed * speed / scale), round the movie or stopping at its end. A scale outside 0.001 to 1000 frames a second counts as a tenth of a second."""
    if not 1e-3 <= 1 / scale <= 1e3:
        scale = 0.1
    i = F.floor(F.lit(float(start)) + F.col("id") * (tick_seconds * speed / scale))
    index = F.pmod(i, F.lit(size)) if loop else F.least(i, F.lit(size - 1))
    return spark.range(ticks).select(F.col("id").alias("tick"), index.cast("int").alias("index"))


def frame_list(spark: SparkSession, start: int, stop: int, stride: int = 1, freezes: dict[int, float] | None = None, fps: float = 10.0) -> DataFrame:
    """(n, frame): a strided range; a frozen frame is repeated round(hold * fps) times."""
    frames = spark.range(start, stop, stride).select(F.col("id").alias("frame"))
    times: Column = F.lit(1)
    for f, hold in (freezes or {}).items():
        times = F.when(F.col("frame") == f, max(1, round(hold * fps))).otherwise(times)
    return frames.select("frame", F.explode(F.sequence(F.lit(0), times - 1)).alias("repeat"))
