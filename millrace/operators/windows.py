"""Window builders: tumbling, sliding, session, cumulating and count windows, and OVER frames.

Time windows give window_start and window_end columns with the type of the time column, aligned to the
epoch plus an offset. All are plain DataFrame expressions; those that Spark plans for streams work on
streams too. Count windows and OVER frames are for bounded input (streams: see streaming.processors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import with_checkpoints


def _bounds(df: DataFrame, window: Column, time: str) -> DataFrame:
    kind = dict(df.dtypes)[time]
    df = df.withColumn("_window", window)
    return df.withColumns({"window_start": F.col("_window.start").cast(kind), "window_end": F.col("_window.end").cast(kind)}).drop("_window")


def tumble(df: DataFrame, time: str, size: str, offset: str | None = None) -> DataFrame:
    """Each row with the window [start, end) that it falls in. Null times have no window and go."""
    return _bounds(df, F.window(time, size, size, offset) if offset else F.window(time, size), time)


def hop(df: DataFrame, time: str, size: str, slide: str, offset: str | None = None) -> DataFrame:
    """Each row once for every window of `size` that starts every `slide` and holds it."""
    return _bounds(df, F.window(time, size, slide, offset) if offset else F.window(time, size, slide), time)


def grouped(df: DataFrame, window: Column, time: str, keys: list, aggs: list[Column]) -> DataFrame:
    """keys, window_start, window_end and aggs of groupBy(window, keys); streams keep their watermark."""
    kind = dict(df.dtypes)[time]
    g = df.groupBy(window.alias("_window"), *keys).agg(*aggs)
    rest = [c for c in g.columns if c != "_window"]
    return g.select(F.col("_window.start").cast(kind).alias("window_start"), F.col("_window.end").cast(kind).alias("window_end"), *rest)


def session(df: DataFrame, time: str, gap: str, keys: list, aggs: list[Column]) -> DataFrame:
    """Sessions of rows not more than `gap` apart (exactly the gap still merges), with keys and aggs.

    A session without keys gets a constant one, which streams need.
    """
    if keys:
        return grouped(df, F.session_window(time, gap), time, keys, aggs)
    return grouped(df, F.session_window(time, gap), time, [F.lit(0).alias("_all")], aggs).drop("_all")


def cumulate(df: DataFrame, time: str, step: str, size: str, steps: int) -> DataFrame:
    """Each row once for every window [start, start + k*step), k up to `steps`, that holds it, where start
    is the start of its window of `size` = steps*step. step in SQL interval words, such as "6 hours"."""
    kind = dict(df.dtypes)[time]
    df = df.withColumn("_window", F.window(time, size))
    unit = F.expr(f"INTERVAL {step}")
    ends = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.col("_window.start") + unit * k)
    df = df.withColumn("_end", F.explode(F.filter(ends, lambda e: e > F.col(time).cast(kind))))
    return df.withColumns({"window_start": F.col("_window.start").cast(kind), "window_end": F.col("_end").cast(kind)}).drop("_window", "_end")


def _kept(df: DataFrame) -> DataFrame:
    """df in files of the shared folder."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def _numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df with _n, the number of a row in its key's order, from 1.

    Without keys the numbers have two levels: the rows are dealt out by ranges of the order, a range's
    rows are numbered inside it, and the counts of the ranges before it are added. No task has all rows.
    """
    if keys:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # dealt once: the counts and the rows have to be of the same ranges
    dealt = _kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    inside = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(starts), "_range").withColumn("_n", F.col("_n") + F.col("_start")).drop("_range", "_start")


def count_tumble(df: DataFrame, keys: list[str], order: list, size: int, aggs: list[Column]) -> DataFrame:
    """aggs of each full run of `size` rows of a key; a rest that does not fill a window is not given.

    window_no counts a key's windows from 0.
    """
    rows = _numbered(df, keys, order).withColumn("window_no", F.floor((F.col("_n") - 1) / size))
    return rows.groupBy(*keys, "window_no").agg(F.count(F.lit(1)).alias("_rows"), *aggs).filter(F.col("_rows") == size).drop("_rows")


def count_slide(df: DataFrame, keys: list[str], order: list, size: int, slide: int, aggs: dict[str, Column], full: bool = False) -> DataFrame:
    """Every `slide` rows of a key, aggs over its last `size` rows.

    full=False gives the first windows before `size` rows have come, over those that have; full=True
    starts with the first full window and goes on by `slide` from there. aggs: name to aggregate.
    """
    spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    last = spec.rowsBetween(-(size - 1), 0)
    rows = df.withColumns({n: a.over(last) for n, a in aggs.items()} | {"_n": F.row_number().over(spec)})
    fires = (F.col("_n") >= size) & ((F.col("_n") - size) % slide == 0) if full else F.col("_n") % slide == 0
    return rows.filter(fires).select(*keys, F.col("_n").alias("upto"), *aggs)


def over_rows(keys: list[str], order: list, preceding: int | None = None):
    """ROWS frame from `preceding` rows before (None: all) to the current row."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding if preceding is None else -preceding, 0)


def over_range(keys: list[str], order, preceding: int | None = None):
    """RANGE frame with peers, from `preceding` (in units of a numeric order column; None: all) to the current row."""
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding if preceding is None else -preceding, 0)


def over_interval(aggregate: str, keys: list[str], time: str, interval: str) -> Column:
    """RANGE frame over time, bounds inclusive: over_interval("sum(value)", ["user"], "ts", "'2' HOUR")."""
    return F.expr(f"{aggregate} OVER (PARTITION BY {', '.join(keys)} ORDER BY {time} RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)")
