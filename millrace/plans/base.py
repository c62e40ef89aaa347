"""The register of queries, and what their plans share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder
from millrace.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame; oracle is DuckDB SQL for the same rows."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return register


def sql_query(name: str, spark_sql: str, oracle: str, tables: tuple[str, ...]) -> None:
    """A query that is SQL text over views of the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    query(oracle, name)(run)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sensor readings: id, vc (whole part of value), ts in milliseconds, event_id."""
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("id"), F.floor("value").cast("int").alias("vc"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_id")


def scratch(spark: SparkSession) -> str:
    """A new folder path that all executors see."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
