"""A live preview: keyed state across micro-batches, with positions that become ready, stay so, and expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .events import microseconds


def plain(v):
    """A Python value of a numpy one."""
    return v.item() if hasattr(v, "item") else v


def _latest(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, ready_after: int) -> DataFrame:
    """The updates of keys that never expire. A value or an order that is not a number counts as null."""

    def known(c: str):
        return F.when(~F.isnan(c), F.col(c)) if dict(rows.dtypes)[c] in ("float", "double") else F.col(c)

    cut = rows.select(*keys, known(order).alias("__o"), known(value).alias("__v")).where("__o IS NOT NULL")
    got = cut.groupBy(*keys).agg(F.max(F.struct("__o", "__v")).alias("__top"), F.count("*").alias("n"))
    return got.select(*keys, F.col("__top.__o").alias(order), F.col("__top.__v").alias(value), "n", (F.col("n") >= ready_after).alias("ready"), F.lit(False).alias("expired"))


def live_latest(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, ready_after: int = 1, expire_seconds: float | None = None, late_seconds: float = 0.0, time: str = "ts") -> DataFrame:
    """A stream of updates (keys..., order, value, n, ready, expired): a key's newest row so far, in output mode update.

    Rows may come in any order: one with a lower order than its key's counts in n
    and changes nothing else; of equal orders the greater value stays, null being the least. A key is
    ready from its ready_after-th row on (rows without an order aren't counted). With
    expire_seconds a key without a row for so long, by the rows' time and late_seconds
    of patience, gives one update with expired and is forgotten: it begins anew with its next row; rows that are later than that
    patience are dropped by Spark. State is a row a key. Without expiry it is that of Spark's
    own aggregates, so no key costs a call of Python.
    """
    if not rows.isStreaming:
        raise ValueError("a preview follows a stream; use events.latest for a table")
    types = dict(rows.dtypes)
    if expire_seconds is None:
        return _latest(rows, keys, order, value, ready_after)
    state_schema = f"o {types[order]}, v {types[value]}, n long, seen timestamp"
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{order}` {types[order]}, `{value}` {types[value]}, n long, ready boolean, expired boolean"
    names = [*keys, order, value, "n", "ready", "expired"]
    span = pd.Timedelta(seconds=expire_seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        o, v, n, seen = state.get if state.exists else (None, None, 0, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, o, v, n, n >= ready_after, True)], columns=names)
            return
        for b in batches:
            b = b[b[order].notna()]
            if not len(b):
                continue
            n += len(b)
            # a row of several types would turn whole numbers into fractions, which the state takes for null
            top = b[order].max()
            best = b.loc[b[order] == top, value].dropna()
            lo, lv = plain(top), plain(best.max()) if len(best) else None
            if o is None or lo > o or (lo == o and lv is not None and (v is None or lv > v)):
                o, v = lo, lv
            if b[time].notna().any():
                seen = b[time].max() if seen is None or pd.isna(seen) else max(pd.Timestamp(seen), b[time].max())
        if not n:
            return
        state.update((o, v, n, None if seen is None else pd.Timestamp(seen).to_pydatetime()))
        if seen is not None:
            # a time in the past can't be set: a key whose time has come expires with the next batch
            due = int((pd.Timestamp(seen) + span).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, o, v, n, n >= ready_after, False)], columns=names)

    cut = rows.select(*keys, order, value, time).withWatermark(time, microseconds(late_seconds))
    return cut.groupBy(*keys).applyInPandasWithState(step, schema, state_schema, "update", GroupStateTimeout.EventTimeTimeout)


def keep_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Updates written batch by batch under their numbers, so that a batch that runs again after a failure replaces its own."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/number={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def preview(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The state as of the last batch: each key's last update, without the keys that expired."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "number")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("number", "n")).alias("__r"))
    return last.select(*keys, "__r.*").where("NOT expired").drop("expired")
