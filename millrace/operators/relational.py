"""Joins, top-N, dedup, keyed aggregates and routing that SQL has no single word for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: A side that Spark may copy to every executor: only if its estimated size is known and below this.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if the optimizer's size estimate allows it, else df: a plain shuffle join."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_time: str, right_time: str, before: str, after: str, inclusive: bool = True, how: str = "inner") -> DataFrame:
    """Equi-join on keys where right_time lies from left_time - before to left_time + after.

    before and after are SQL intervals, such as "2 seconds". Column names of the sides have to differ. On
    streams both sides need a watermark; it also bounds the state.
    """
    low = F.col(left_time) - F.expr(f"INTERVAL {before}")
    high = F.col(left_time) + F.expr(f"INTERVAL {after}")
    at = F.col(right_time)
    inside = (at >= low) & (at <= high) if inclusive else (at > low) & (at < high)
    on = inside
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    return left.join(right, on, how)


def window_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_time: str, right_time: str, size: str) -> DataFrame:
    """Inner join of rows with equal keys in the same tumbling window; pairs over a window's edge don't match."""
    a = left.withColumn("_lw", F.window(left_time, size))
    b = right.withColumn("_rw", F.window(right_time, size))
    on = F.col("_lw.start") == F.col("_rw.start")
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    kind = dict(left.dtypes)[left_time]
    return a.join(b, on).withColumn("window_start", F.col("_lw.start").cast(kind)).drop("_lw", "_rw")


def lookup_join(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, how: str = "inner") -> DataFrame:
    """Join with a dimension as it is now; broadcast if its size allows it."""
    return df.join(small(dimension), F.col(key) == F.col(dimension_key), how)


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rk") -> DataFrame:
    """The first n rows of each key with their rank from 1. Give `order` a last, unique column: then ties are decided."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key."""
    return top_n(df, keys, [F.col(c).desc() for c in order], 1, "_rk").drop("_rk")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_n(df, keys, [F.col(c).asc() for c in order], 1, "_rk").drop("_rk")


def max_by_record(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The whole record with the greatest `by` of each key (one aggregate, no sort): last visit per user."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*by))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def min_by_record(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def max_field(df: DataFrame, keys: list[str], field: str, arrival: list[str]) -> DataFrame:
    """Rolling-max semantics: the greatest `field`, the other columns as in the key's first record."""
    rest = [c for c in df.columns if c not in keys and c != field]
    first = F.min_by(F.struct(*rest), F.struct(*arrival))
    return df.groupBy(*keys).agg(first.alias("_first"), F.max(field).alias(field)).select(*keys, field, *(F.col(f"_first.{c}").alias(c) for c in rest))


def min_field(df: DataFrame, keys: list[str], field: str, arrival: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c != field]
    first = F.min_by(F.struct(*rest), F.struct(*arrival))
    return df.groupBy(*keys).agg(first.alias("_first"), F.min(field).alias(field)).select(*keys, field, *(F.col(f"_first.{c}").alias(c) for c in rest))


def running(df: DataFrame, keys: list[str], order: list, aggs: dict[str, Column]) -> DataFrame:
    """One output row per input row: aggs over the rows of its key so far."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: a.over(frame) for n, a in aggs.items()})


def alarm_on_jump(df: DataFrame, keys: list[str], order: list, field: str, limit: float) -> DataFrame:
    """Rows whose field differs from the one before, of the same key, by more than limit; with that one."""
    before = F.lag(field).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("before", before).filter(F.abs(F.col(field) - F.col("before")) > limit)


def running_top(df: DataFrame, keys: list[str], order: list, field: str, n: int) -> DataFrame:
    """For each row the n greatest values of its key so far, greatest first; nulls are no values.

    A fold over the sorted rows of a key that holds n values, in Arrow batches: a window frame from the
    first row would collect all rows before each row.
    """

    def fold(batches):
        now, top = object(), []
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, field)]
            for *key, value in zip(*columns, strict=True):
                if key != now:
                    now, top = key, []
                if value is not None:
                    top = sorted((*top, value), reverse=True)[:n]
                out.append(top)
            kind = batch.schema.field(field).type
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(kind))], [*batch.schema.names, "top"])

    schema = StructType([*df.schema, StructField("top", ArrayType(df.schema[field].dataType))])
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(fold, schema)


def route(df: DataFrame, routes: dict[str, Column], rest: str = "main", tag: str = "route") -> DataFrame:
    """Tag of the first route whose condition holds; null conditions do not hold; others go to `rest`."""
    out = F
    for name, condition in routes.items():
        out = out.when(condition, name)
    return df.withColumn(tag, out.otherwise(rest) if routes else F.lit(rest))


def connect(left: DataFrame, right: DataFrame, tag: str = "side") -> DataFrame:
    """Two streams of different types as one: columns of either, null in the other, and the side's tag."""
    return left.withColumn(tag, F.lit("left")).unionByName(right.withColumn(tag, F.lit("right")), allowMissingColumns=True)


def bill_check(app: DataFrame, third: DataFrame, key: str, left_time: str, right_time: str, wait: str) -> DataFrame:
    """Bounded form of the two-stream match: each side's row with whether the other came within `wait`."""
    a, b = app.select(F.col(key).alias("order_id"), F.col(left_time).alias("app_time")), third.select(F.col(key).alias("_k"), F.col(right_time).alias("third_time"))
    gap = F.expr(f"INTERVAL {wait}")
    on = (F.col("order_id") == F.col("_k")) & (F.col("third_time") <= F.col("app_time") + gap) & (F.col("app_time") <= F.col("third_time") + gap)
    both = a.join(b, on, "full")
    state = F.when(F.col("_k").isNull(), "third missing").when(F.col("order_id").isNull(), "app missing").otherwise("matched")
    return both.select(F.coalesce("order_id", "_k").alias("order_id"), "app_time", "third_time", state.alias("result"))


def partition_by_id(df: DataFrame, n: int, partition: Column) -> DataFrame:
    """Rows dealt to the partitions that `partition` names: a custom partitioner."""
    return df.repartitionById(n, partition.cast("int"))


PARTITIONERS = ("rebalance", "rescale", "key group", "shuffle", "broadcast", "global", "forward")


def dealt(df: DataFrame, how: str, n: int, keys: list[str] = ()) -> DataFrame:
    """Rows dealt to n tasks: in turn (rebalance), by joining neighbouring tasks (rescale; n is less than now),
    by hash of the keys (key group), at random (shuffle), all rows to each (broadcast: n times the rows),
    all to one (global: what it is given has to fit one task), or as they are (forward).
    """
    if how == "rebalance":
        return df.repartition(n)
    if how == "rescale":
        return df.coalesce(n)
    if how == "key group":
        return df.repartition(n, *keys)
    if how == "shuffle":
        return df.withColumn("_to", (F.rand(7) * n).cast("int")).repartitionById(n, "_to").drop("_to")
    if how == "broadcast":
        return df.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartitionById(n, "_to").drop("_to")
    if how == "global":
        return df.coalesce(1)
    if how == "forward":
        return df
    raise ValueError(how)


def tokens(df: DataFrame, text: str, separator: str = " ") -> DataFrame:
    """One row (word) per word; empty words at the end of a line go, as they do when a line is split in Java.
    The separator is a regular expression."""
    if len(separator) == 1 and (separator.isalnum() or separator in " ,;:-_/\t"):
        line = F.rtrim(F.col(text), F.lit(separator))
        return df.select(F.explode(F.when(line != "", F.split(line, separator))).alias("word"))
    words = F.split(text, separator)
    used = F.reverse(F.transform(words, lambda w, i: F.when(w != "", i + 1)))
    upto = F.coalesce(F.array_max(used), F.lit(0))
    return df.select(F.explode(F.slice(words, F.lit(1), upto)).alias("word"))


def word_count(df: DataFrame, text: str = "value", separator: str = " ") -> DataFrame:
    return tokens(df, text, separator).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
