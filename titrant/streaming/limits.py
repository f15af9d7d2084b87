"""Keyed request state: trailing-window limits and session lifetimes.

The batch forms are exact on any key size; the streaming forms keep bounded
state per key under a watermark.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DoubleType, StructField, StructType

from titrant.functions.ordering import trailing_count

DAY = 24 * 60 * 60

_OUT = "job_id long, event_id long, t double, accepted boolean"


def _fold(max_requests: int, window: float):
    """Sequential acceptance over rows sorted by key and time.  What is held
    is the accepted times of one key inside the window, `max_requests` at most.
    Keys are compared as they are, a missing one like any other."""
    def run(batches):
        key, taken = object(), deque()
        for b in batches:
            verdicts = []
            for job, t in zip(b.column("job_id").to_pylist(), b.column("t").to_pylist()):
                if job != key:
                    key = job
                    taken.clear()
                while taken and taken[0] < t - window:
                    taken.popleft()
                verdicts.append(len(taken) < max_requests)
                if verdicts[-1]:
                    taken.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(verdicts, pa.bool_())], [*b.schema.names, "accepted"])
    return run


def limit_requests(events: DataFrame, max_requests: int = 30, window: int = DAY) -> DataFrame:
    """Accept a request while fewer than `max_requests` of its key were accepted
    in the trailing window (inclusive edge); rejected ones do not count.

    `events`: job_id, event_id, t (seconds).  Requests without a key share one;
    requests without a time are rejected.  A verdict depends on all earlier
    ones of its key, so a key is read in order by one task, as a stream.  Of one key and
    time only the first `max_requests` can be accepted: the others are sure rejections
    and never reach that task, which is bounded by the key's distinct times.
    """
    e = events.select("job_id", "event_id", F.col("t").cast("double").alias("t"))
    at_once = Window.partitionBy("job_id", "t").orderBy("event_id")
    numbered = e.withColumn("_n", F.row_number().over(at_once))
    open_ = (F.col("_n") <= max_requests) & F.col("t").isNotNull()
    ordered = numbered.filter(open_).drop("_n").repartition("job_id").sortWithinPartitions("job_id", "t", "event_id")
    types = {f.name: f.dataType.simpleString() for f in e.schema.fields}
    verdicts = ordered.mapInArrow(_fold(max_requests, window), f"job_id {types['job_id']}, event_id {types['event_id']}, t double, accepted boolean")
    return verdicts.unionByName(numbered.filter(~open_).drop("_n").withColumn("accepted", F.lit(False)))


def recent_requests(events: DataFrame, window: int = DAY) -> DataFrame:
    """Requests of the same key in the trailing window, this one included."""
    return trailing_count(events, "job_id", F.col("t"), "event_id", window, "recent")


class RequestLimiter(StatefulProcessor):
    """Streaming acceptance: the state of a key is its accepted times still
    inside the window, never more than the limit."""

    def __init__(self, max_requests: int = 30, window: int = DAY):
        self.max_requests, self.window = max_requests, window

    def init(self, handle) -> None:
        self.times = handle.getListState("accepted", StructType([StructField("t", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["t", "event_id"], kind="stable")
        taken = deque(r[0] for r in self.times.get()) if self.times.exists() else deque()
        verdicts = []
        for t in pdf["t"]:
            while taken and taken[0] < t - self.window:
                taken.popleft()
            verdicts.append(len(taken) < self.max_requests)
            if verdicts[-1]:
                taken.append(t)
        self.times.put([(float(t),) for t in taken])
        yield pd.DataFrame({"job_id": pdf["job_id"], "event_id": pdf["event_id"], "t": pdf["t"], "accepted": verdicts})

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, max_requests: int = 30, window: int = DAY, watermark: str = "24 hours") -> DataFrame:
    """Streaming form of limit_requests over events (job_id, event_id, ts)."""
    timed = events.withWatermark("ts", watermark).withColumn("t", F.unix_micros("ts") / F.lit(1e6))
    return timed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=RequestLimiter(max_requests, window), outputStructType=_OUT, outputMode="Append", timeMode="None")


# ---- lifetimes -----------------------------------------------------------

CREATE_MINUTES, TOUCH_MINUTES = 60, 240


def _keep_minutes(kind: Column, create: int, touch: int) -> Column:
    return F.when(kind == "create", create).otherwise(touch)


def lifetimes(events: DataFrame, create: int = CREATE_MINUTES, touch: int = TOUCH_MINUTES) -> DataFrame:
    """Lifetime spans per job from (job_id, t seconds, kind create|touch).

    Every event keeps the job for its own number of minutes; overlapping spans
    join.  Events of one minute always share a span, so they are first reduced
    to one row per job and minute, which bounds a job by its time line and not
    by its traffic.
    """
    end = F.col("t") + _keep_minutes(F.col("kind"), create, touch) * 60
    minutes = events.withColumn("_m", F.floor(F.col("t") / 60)).groupBy("job_id", "_m").agg(
        F.min("t").alias("t"), F.max(end).alias("end"), F.count_if(F.col("kind") == "create").alias("creates"),
        F.count_if(F.col("kind") != "create").alias("touches"))
    w = Window.partitionBy("job_id").orderBy("t")
    opened = minutes.withColumn("_until", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = opened.withColumn("_span", F.sum(F.when(
        F.col("_until").isNull() | (F.col("t") >= F.col("_until")), 1).otherwise(0)).over(w))
    return spans.groupBy("job_id", "_span").agg(
        F.min("t").alias("created"), F.max("end").alias("expires"),
        F.sum("creates").alias("creates"), F.sum("touches").alias("touches")).drop("_span")


def lifetime_stream(events: DataFrame, create: int = CREATE_MINUTES, touch: int = TOUCH_MINUTES, watermark: str = "4 hours") -> DataFrame:
    """Streaming form of lifetimes over events (job_id, ts, kind): session windows
    with a gap that depends on the event."""
    gap = F.when(F.col("kind") == "create", f"{create} minutes").otherwise(f"{touch} minutes")
    return (events.withWatermark("ts", watermark).groupBy("job_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count_if(F.col("kind") == "create").alias("creates"), F.count_if(F.col("kind") != "create").alias("touches"))
            .select("job_id", F.col("w.start").alias("created"), F.col("w.end").alias("expires"), "creates", "touches"))
