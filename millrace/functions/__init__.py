"""User-defined scalar, aggregate, table and table-aggregate functions, and rich functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def my_upper(s: pd.Series) -> pd.Series:
    """Upper case by batch; null stays null. F.upper does the same inside the JVM."""
    return s.str.upper()


def my_avg(v: pd.Series) -> float:
    """Mean of a group as sum over count; null if the group has no value.

    It shows what a user-defined aggregate looks like: Spark gives it each group whole, without partial
    sums. F.avg is the same, with them.
    """
    v = v.dropna()
    return float(v.sum()) / len(v) if len(v) else None


class SplitWords:
    """split_words(line, separator): (word, len) per word. The separator is a regular expression; empty words at the end go."""

    def eval(self, line: str, separator: str):
        if line is None:
            return
        words = re.split(separator, line)
        while words and words[-1] == "":
            words.pop()
        for w in words:
            yield w, len(w)


class Top2:
    """Table aggregate over the rows (key, value) of one key, given by PARTITION BY key: (key, rank, value) of the two
    greatest values; equal values rank apart, nulls are no values, and a key with one value has one row.

    accumulate is eval, emit is terminate; two values are all that it holds.
    """

    def __init__(self):
        self.key = self.first = self.second = None

    def eval(self, row):
        self.key, v = row[0], row[1]
        if v is None:
            return
        if self.first is None or v > self.first:
            self.first, self.second = v, self.first
        elif self.second is None or v > self.second:
            self.second = v

    def terminate(self):
        for rank, v in ((1, self.first), (2, self.second)):
            if v is not None:
                yield self.key, rank, v


def register(spark: SparkSession) -> None:
    """my_upper, my_avg, split_words and top2_values for SQL."""
    spark.udf.register("my_upper", F.pandas_udf(my_upper, "string"))
    spark.udf.register("my_avg", F.pandas_udf(my_avg, "double"))
    spark.udtf.register("split_words", F.udtf(SplitWords, returnType="word string, len int"))
    spark.udtf.register("top2_values", F.udtf(Top2, returnType="key bigint, rank int, value bigint"))


def typed_length(column: str) -> Column:
    """A scalar function with a declared result type."""

    def length(s: pd.Series) -> pd.Series:
        return s.str.len().astype("Int32")

    return F.pandas_udf(length, "int")(F.col(column))


def top2(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rank, value): the built-in form of the table aggregate; rank 2 only where a key has two rows."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc())
    return df.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select(key, "rank", value)


def mapped(df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A function of any form (def, lambda, object with __call__) over a frame."""
    return df.transform(f)


class Rich:
    """A function with open and close, each called once per task; call takes and gives a pandas batch."""

    def open(self) -> None: ...

    def close(self) -> None: ...

    def call(self, batch: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


class Doubler(Rich):
    def open(self) -> None:
        self.factor = 2

    def call(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": batch["event_id"], "doubled": batch["value"] * self.factor})


def with_resource(df: DataFrame, f: Rich, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f.open()
        try:
            for b in batches:
                yield f.call(b)
        finally:
            f.close()

    return df.mapInPandas(run, schema)


def window_start(ms: Column, size: int, offset: int = 0) -> Column:
    """Start of the window of `size` milliseconds that holds a time in milliseconds."""
    return ms - F.pmod(ms - offset, F.lit(size))
