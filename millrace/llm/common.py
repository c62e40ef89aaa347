"""What the training-data operators share: checkpoints, worker imports, block arithmetic."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import with_checkpoints


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder that the driver uses.

    A cluster that does not mount that folder ships the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def checkpoint(df: DataFrame) -> DataFrame:
    """df cut from its lineage by files in the cluster's shared folder, spark.checkpoint.dir.

    Only where that is unset and all executors are on this machine, as in tests, a folder is made here.
    """
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def body(text: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that are broadcast are at most so many: each has more than this part of the rows.
HOT_KEYS = 10_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and in `weight` the number of left's rows of the key, or fewer.

    Keys with more than a HOT_KEYS-th of the weight are fewer than HOT_KEYS, so they can be broadcast; the rows
    of left with such a key are not shuffled. No rows, or null keys, give no rows.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.filter(F.col(weight) * HOT_KEYS > total))
    usual = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(F.col(weight) * HOT_KEYS <= total), keys, how)
    return left.join(hot, keys, how).select(*usual.columns).union(usual)
