"""Watermarks that a stream keeps itself: generators of its own, marked events, several inputs, idle inputs.

Spark's withWatermark knows the latest time minus a delay and drops late rows before any operator. Operators
that judge rows themselves (LateData) take a Watermarks object instead. Times are milliseconds. A watermark w
closes the windows whose end is not after w.
"""

from __future__ import annotations

import time as clock_time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(time: str, delay: int = 0) -> Column:
    """The usual generator: `delay` behind the latest time."""
    return F.max(time) - delay


def to_the_millisecond(time: str, delay: int = 0) -> Column:
    """A generator of its own that states the last millisecond that is complete: one later than latest()."""
    return F.max(time) - delay + 1


def last_seen(time: str, arrival: str) -> Column:
    """For input in order: the time of the row that came last, not the greatest."""
    return F.max_by(time, arrival) + 1


def marked(time: str, marker: Column, delay: int = 0) -> Column:
    """Event by event: only rows for which marker holds move the watermark."""
    return F.max(F.when(marker, F.col(time))) - delay + 1


class Watermarks:
    """The least watermark of a stream's inputs, moved by each micro-batch; it never goes back.

    of: an aggregate such as latest("t"). source: the column that names a row's input, sources the inputs
    there are (few: the state has a row of each); without them the stream is one input. An input that has
    given nothing yet holds the watermark back. idle: milliseconds of the clock after which an input
    without rows no longer counts, until it gives rows again; if all are idle the watermark stays.
    Rows of other inputs, or with a null source, move nothing. Null: no watermark yet.
    """

    SCHEMA = "source string, watermark bigint, seen bigint"

    def __init__(self, of: Column, source: str | None = None, sources: tuple[str, ...] = ("",), idle: int | None = None, clock: Callable[[], int] = lambda: int(clock_time.time() * 1000)):
        self.of, self.source, self.sources, self.idle, self.clock = of, source, sources, idle, clock

    def advance(self, rows: DataFrame, state: dict | None) -> dict:
        """state: {input: (watermark, last seen)}, and {None: (combined, 0)}; the state after these rows."""
        now = self.clock()
        state = dict(state) if state else {s: (None, now) for s in self.sources} | {None: (None, 0)}
        name = F.col(self.source) if self.source else F.lit("")
        given = rows.filter(name.isin(*self.sources)).groupBy(name.alias("source")).agg(self.of.alias("watermark"))
        for r in given.collect():  # a row of each input
            before = state[r.source][0]
            state[r.source] = (max((x for x in (before, r.watermark) if x is not None), default=None), now)
        counted = [w for s, (w, seen) in state.items() if s is not None and (self.idle is None or now - seen < self.idle)]
        least = min(counted) if counted and None not in counted else None
        state[None] = (max((x for x in (state[None][0], least) if x is not None), default=None), 0)
        return state

    def save(self, spark: SparkSession, state: dict, path: str) -> None:
        spark.createDataFrame([(s, w, seen) for s, (w, seen) in state.items()], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> dict:
        return {r.source: (r.watermark, r.seen) for r in spark.read.parquet(path).collect()}  # a row of each input
