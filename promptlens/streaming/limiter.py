"""Exact rolling request limits in a stream (ST-04), as the batch audit has them.

A request is decided when the watermark has passed it, for then no earlier one
can still come: the requests of the last ``width`` before it, peers included,
are all known. Until then it waits in its key's state; decided requests stay
there as bare times while a later window can hold them. One event-time timer per
key wakes it for its earliest waiting request, and once more to forget the last
times. What comes after the watermark has passed it is late: it is neither
decided nor counted, and goes to a side table, so that no row is lost.

The watermark's column is dropped before the keyed operator, which else would
drop late rows itself; the operator still sees the watermark.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from promptlens.operators.limits import MINUTE_US

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that arbitrary keyed state asks for, while in use."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class RollingLimit(StatefulProcessor):
    """State of a key: waiting (us, id), and times of decided requests."""

    def __init__(self, keys: list[str], width: int, limit: int):
        self.keys, self.width, self.limit = keys, width, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long")
        self.recent = handle.getListState("recent", "us long")

    def _wake(self, us: int, fired: int | None = None) -> None:
        """Have the key woken when the watermark has passed ``us``; the timer
        that has just fired is still listed."""
        at, known = us // 1000 + 1, [t for t in self.handle.listTimers() if t != fired]
        if not known or at < min(known):
            for timer in known:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def _told(self, key, **columns) -> pd.DataFrame:
        n = len(columns["id"])
        return pd.DataFrame({**{k: [v] * n for k, v in zip(self.keys, key)}, **columns})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for pdf in rows:
            us, ids = pdf["us"].to_numpy("i8"), pdf["id"].to_numpy("i8")
            late = us < mark
            if late.any():
                none = [None] * int(late.sum())
                yield self._told(key, id=ids[late], us=us[late], prior_requests=pd.Series(none, dtype="Int64"),
                                 throttled=pd.Series(none, dtype="boolean"), wait_us=pd.Series(none, dtype="Int64"), late=True)
            if not late.all():
                self.waiting.appendList(list(zip(us[~late].tolist(), ids[~late].tolist())))
                first = min(int(us[~late].min()), first if first is not None else int(us[~late].min()))
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [x for x in held if x[0] < mark], [x for x in held if x[0] >= mark]
        times = np.array([x[0] for x in self.recent.get()] if self.recent.exists() else [], dtype="i8")
        if ready:
            us, ids = np.array([x[0] for x in ready], "i8"), np.array([x[1] for x in ready], "i8")
            times = np.sort(np.r_[times, us])
            low = np.searchsorted(times, us - self.width, side="right")
            prior = np.searchsorted(times, us, side="right") - low - 1
            throttled = prior >= self.limit
            yield self._told(key, id=ids, us=us, prior_requests=pd.Series(prior, dtype="Int64"), throttled=pd.Series(throttled, dtype="boolean"),
                             wait_us=pd.Series(np.where(throttled, self.width - (us - times[low]), 0), dtype="Int64"), late=False)
            self.waiting.put(rest) if rest else self.waiting.clear()
        times = times[times > mark - self.width]
        self.recent.put([(t,) for t in times.tolist()]) if len(times) else self.recent.clear()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if rest:
            self._wake(min(x[0] for x in rest), fired)
        elif len(times):
            self._wake(int(times.max()) + self.width, fired)


def limited(stream: DataFrame, keys: list[str], limit: int, ts: str = "ts", id_col: str = "event_id", width: int = MINUTE_US,
            delay: str = "1 hour") -> DataFrame:
    """``stream`` (keys, id, ts) -> keys, id, us, prior_requests, throttled,
    wait_us, late: a row per request once it is decided or found late."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.withWatermark(ts, delay).select(*keys, F.unix_micros(ts).alias("us"), F.col(id_col).cast("long").alias("id"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "id long", "us long", "prior_requests long", "throttled boolean", "wait_us long", "late boolean"])
    return rows.groupBy(*keys).transformWithStateInPandas(RollingLimit(keys, width, limit), schema, "Append", "EventTime")


def stream_limits(spark: SparkSession, src: str, schema, out: str, keys: list[str], limit: int, ts: str = "ts", id_col: str = "event_id",
                  width: int = MINUTE_US, delay: str = "1 hour", max_files: int = 8) -> tuple[DataFrame, DataFrame]:
    """Run over a file stream until what is there has been read; returns
    (decided, late). A rerun goes on from the checkpoint. Requests that the
    watermark has not passed yet wait in the state for the next run."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .option("recursiveFileLookup", "true").parquet(src))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on replay: idempotent
        batch.write.mode("overwrite").partitionBy("late").parquet(os.path.join(out, f"batch={batch_id}"))

    told = limited(stream, keys, limit, ts, id_col, width, delay)
    with keyed_state(spark):
        query = (told.writeStream.outputMode("append").foreachBatch(sink).trigger(availableNow=True)
                 .option("checkpointLocation", out + "-checkpoint").start())
        query.awaitTermination()
    rows = spark.read.schema(told.schema).parquet(out)
    return rows.where("not late").drop("late"), rows.where("late").select(*keys, "id", "us")
