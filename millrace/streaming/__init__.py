"""Streams: watermarks, windows, joins, top-N and late data on Structured Streaming."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.session import Checkpointing
from millrace.streaming.watermarks import Watermarks, last_seen, latest, marked, to_the_millisecond  # noqa: F401


def with_event_time(df: DataFrame, millis: str = "ts", into: str = "et", delay: str | None = "0 seconds") -> DataFrame:
    """Event time from epoch milliseconds, with a watermark that is `delay` behind the latest (None: no watermark)."""
    out = df.withColumn(into, F.timestamp_millis(F.col(millis)))
    return out if delay is None else out.withWatermark(into, delay)


@contextlib.contextmanager
def no_idle_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside get no batches without rows."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append", clock: bool = False) -> DataFrame:
    """What a stream over bounded input gives, as a table: runs it over all that is there and returns the rows.

    Each batch is written to its own folder under `path` (a batch that runs again replaces its folder), so
    nothing is gathered on the driver. Mode "complete" keeps the last batch, which has all rows.
    clock: the stream has processing-time state or timers, for which Spark would run empty batches for ever;
    they are switched off for it, so it ends with its input.
    """
    seen = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{batch}")
        seen[:] = [batch] if mode == "complete" else [*seen, batch]

    with no_idle_batches(spark) if clock else contextlib.nullcontext():
        Checkpointing(checkpoint, None).start(stream, mode, each_batch=write).awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{path}/{k}" for k in seen))


def window_counts(df: DataFrame, time: str, size: str, keys: list[str], slide: str | None = None) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def dedup_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return df.dropDuplicatesWithinWatermark(keys)


def top_n_batches(n: int, order: list[Column | str], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch over closed window counts: the first n of each window go to write."""
    return lambda df, k: write(R.top_n(df, ["window_start", "window_end"], order, n), k)


def lookup_batches(dimension: Callable[[], DataFrame], key: str, dimension_key: str, write: Callable[[DataFrame, int], None], how: str = "inner") -> Callable[[DataFrame, int], None]:
    """foreachBatch: each micro-batch joins the dimension as it then is (see sources.Lookup)."""
    return lambda df, k: write(R.lookup_join(df, dimension(), key, dimension_key, how), k)


def control_batches(control: Callable[[], DataFrame], default: str, write: Callable[[DataFrame, int], None], column: str = "mode") -> Callable[[DataFrame, int], None]:
    """foreachBatch: every row with the latest value of a one-row control table, `default` while it is empty."""

    def run(df: DataFrame, k: int) -> None:
        latest = control().select(F.col(column).cast("string").alias(column)).limit(1)
        one = latest.agg(F.coalesce(F.first(column), F.lit(default)).alias(column))
        write(df.crossJoin(F.broadcast(one)), k)  # one row

    return run


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder if it is there, wherever Spark can reach it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class LateData:
    """Tumbling counts with allowed lateness and a late side output, over micro-batches.

    Keeps its own watermark (`watermarks`, or the latest event time - delay; milliseconds) and the counts of
    open windows in two tables under `state`, one folder per batch, so a replayed batch gives the same rows
    again. Only the folders of the last two batches stay:

    * a row is late if its window's end + lateness is not after the watermark before the batch;
    * others are added to their windows;
    * a window is emitted once the watermark reaches its end, and again when a later row changes it;
    * windows whose end + lateness has passed are dropped from the state.

    Rows without a time have no window and go nowhere.
    late(df, batch) gets late rows, emit(df, batch) rows (window_start, window_end, keys, n) in milliseconds.
    Spark's own watermark drops late rows before any operator sees them, so the stream must have none.
    """

    def __init__(self, state: str, time: str, keys: list[str], size: int, delay: int, lateness: int, emit: Callable, late: Callable, watermarks: Watermarks | None = None):
        self.state, self.time, self.keys, self.size, self.lateness, self.emit, self.late = state, time, keys, size, lateness, emit, late
        self.watermarks = watermarks or Watermarks(latest(time, delay))

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark, at, last = df.sparkSession, f"{self.state}/{batch}", f"{self.state}/{batch - 1}"
        held = Watermarks.load(spark, f"{last}/watermark") if batch else None
        open_ = spark.read.parquet(f"{last}/open") if batch else None
        start = F.col(self.time) - F.pmod(F.col(self.time), F.lit(self.size))
        rows = df.filter(F.col(self.time).isNotNull()).withColumns({"window_start": start, "window_end": start + self.size}).persist()
        try:
            passed = F.lit(held[None][0] if held else None).cast("bigint")
            is_late = F.coalesce(F.col("window_end") + self.lateness <= passed, F.lit(False))
            self.late(rows.filter(is_late).drop("window_start", "window_end"), batch)
            moved = self.watermarks.advance(rows, held)
            every = rows.filter(~is_late).groupBy("window_start", "window_end", *self.keys).agg(F.count(F.lit(1)).alias("n")).withColumn("changed", F.lit(True))
            if open_ is not None:
                every = every.unionByName(open_.withColumn("changed", F.lit(False)))
            every = every.groupBy("window_start", "window_end", *self.keys).agg(F.sum("n").alias("n"), F.bool_or("changed").alias("changed"), F.bool_or(~F.col("changed") & (F.col("window_end") <= passed)).alias("given")).persist()
            try:
                upto = F.lit(moved[None][0]).cast("bigint")
                due = (F.col("window_end") <= upto) & (F.col("changed") | ~F.coalesce("given", F.lit(False)))
                self.emit(every.filter(due).select("window_start", "window_end", *self.keys, "n"), batch)
                stays = F.coalesce(F.col("window_end") + self.lateness > upto, F.lit(True))
                every.filter(stays).select("window_start", "window_end", *self.keys, "n").write.mode("overwrite").parquet(f"{at}/open")
                self.watermarks.save(spark, moved, f"{at}/watermark")
            finally:
                every.unpersist()
        finally:
            rows.unpersist()
        if batch > 1:  # the batch before this one may still be asked for, if this one is replayed
            forget(spark, f"{self.state}/{batch - 2}")


class ListState:
    """Lists of an operator without keys: each of its `subtasks` adds the elements that it is given.

    The lists are a table under `path`, one folder per batch (a replayed batch replaces its folder), so no
    task or driver holds a whole list. A restart, which may have another number of subtasks, deals the elements out
    again: lists(n) gives each to one of n subtasks, lists(n, union=True) gives all to each of them.
    """

    def __init__(self, path: str, subtasks: int):
        self.path, self.subtasks = path, subtasks

    def __call__(self, df: DataFrame, batch: int) -> None:
        dealt = df.repartition(self.subtasks).withColumns({"subtask": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
        dealt.write.mode("overwrite").parquet(f"{self.path}/{batch}")

    @staticmethod
    def lists(spark: SparkSession, path: str, subtasks: int, union: bool = False) -> DataFrame:
        """The elements with the subtask that has them now."""
        stored = spark.read.parquet(f"{path}/*")
        to = F.explode(F.sequence(F.lit(0), F.lit(subtasks - 1))) if union else F.pmod(F.col("place") + F.col("subtask"), F.lit(subtasks)).cast("int")
        return stored.withColumn("subtask", to).drop("place")
