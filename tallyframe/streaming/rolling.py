"""Profiles by time: tumbling windows for batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.profile import profile
from ..plans.resolve import Plan


def bucket(ts: Column, interval: str, label: str = "start") -> tuple[Column, Callable[[Column], Column]]:
    """A tumbling window, and its name. label "start": left-closed, named by its start; "end": right-closed, named by its end."""
    if label == "start":
        return F.window(ts, interval), lambda w: w["start"]
    tick = F.expr("INTERVAL 1 MICROSECOND")
    return F.window(ts, interval, interval, "1 microsecond"), lambda w: w["end"] - tick


def rolling_profile(df: DataFrame, ts: str, interval: str, plan: Plan | None = None, by: list[str] = (), watermark: str | None = None, columns: list[str] | None = None, label: str = "start") -> DataFrame:
    """Profiles by bucket and segment; on a stream, watermark bounds the state and late rows are dropped beyond it."""
    dtype = df.schema[ts].dataType.typeName()
    if dtype == "timestamp_ntz":  # watermarks need an instant
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming and watermark:
        df = df.withWatermark(ts, watermark)
    columns = columns or [c for c in df.columns if c not in (ts, *by)]
    return profile(df, plan, {k: F.col(k) for k in by}, columns, bucket(F.col(ts), interval, label))


def start_rolling(df: DataFrame, write, checkpoint: str, every: str | None = None, mode: str = "update"):
    """Start a stream of profiles; write(batch, id) is called at each trigger, and a lost trigger is run again."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


#: Fixed value: the shortest interval between writes, in minutes.
MIN_MINUTES = 5


class RollingLogger:
    """Profiles of a stream by event time: open buckets are state, and each trigger gives what changed to the writers.

    callback(profile, bucket-batch id) is called for each trigger; a trigger that fails is tried `attempts` times and then
    raises, so that the stream's checkpoint starts it again. Rows older than the watermark open no bucket again; with
    late="merge" there is no watermark, late rows give another profile of their bucket, and readers merge.
    """

    def __init__(self, stream: DataFrame, ts: str, interval: str, checkpoint: str, callback, every_minutes: int | None = None, watermark: str = "1 hour", late: str = "drop", attempts: int = 3, **options):
        if every_minutes is not None and every_minutes < MIN_MINUTES:
            raise ValueError(f"at least {MIN_MINUTES} minutes between writes")
        self.callback, self.attempts, self.last = callback, attempts, None
        if late == "drop":
            profiles = rolling_profile(stream, ts, interval, watermark=watermark, **options)
            self.query = start_rolling(profiles, self._take, checkpoint, f"{every_minutes} minutes" if every_minutes else None)
        else:  # each batch is profiled by itself
            self.query = start_rolling(stream, lambda batch, i: self._take(rolling_profile(batch, ts, interval, **options), i), checkpoint, f"{every_minutes} minutes" if every_minutes else None, "append")

    def _take(self, batch: DataFrame, i: int) -> None:
        if batch.isEmpty():  # an empty bucket is not written
            return
        for attempt in range(self.attempts):
            try:
                self.callback(batch, i)
                return
            except Exception:
                if attempt + 1 == self.attempts:
                    raise

    def status(self) -> dict:
        """What the stream is doing, and its open state as the last progress tells it."""
        progress = self.query.lastProgress
        return {"active": self.query.isActive, "status": self.query.status, "progress": progress}

    def close(self) -> None:
        self.query.stop()
