"""Sinks: print, files, Kafka, JDBC (append, overwrite upsert, adding upsert), changelogs, custom writers.

Functions named *_batch return a writer for foreachBatch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources import jvm_jdbc


def print_rows(df: DataFrame, identifier: str = "", limit: int | None = None, to_stderr: bool = False) -> None:
    """`ID> row` for up to `limit` rows of a bounded frame; None: all, a partition at a time."""
    out = sys.stderr if to_stderr else sys.stdout
    head = f"{identifier}> " if identifier else ""
    for row in df.toLocalIterator() if limit is None else df.limit(limit).collect():
        print(head + str(tuple(row)), file=out)


def print_batch(identifier: str = "", to_stderr: bool = False, limit: int | None = None) -> Callable[[DataFrame, int], None]:
    return lambda df, _: print_rows(df, identifier, limit, to_stderr)


def row_files(df: DataFrame, path: str, checkpoint: str, bucket_time: str, fmt: str = "json", bucket: str = "yyyy-MM-dd HH-mm", interval: str | None = "2 seconds"):
    """Streaming file sink with a folder for each `bucket` of time; files appear whole when a batch is done."""
    out = df.withColumn("bucket", F.date_format(bucket_time, bucket))
    w = out.writeStream.format(fmt).partitionBy("bucket").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if interval is None else w.trigger(processingTime=interval)).start()


def kafka_rows(df: DataFrame, key: str | None = None, fmt: str = "json") -> DataFrame:
    """(key, value) as the Kafka sink takes them: value is the row as json, csv or, with one column, text."""
    if fmt == "text":
        (value,) = (c for c in df.columns if c != key)
        value = F.col(value).cast("string")
    else:
        value = {"json": F.to_json, "csv": F.to_csv}[fmt](F.struct(*df.columns))
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), value.alias("value"))


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None, fmt: str = "json", mode: str = "append", writer: str = "kafka"):
    """Streaming Kafka sink, at least once. With a key and mode "update" it is an upsert log: the last value of a
    key counts, so replays change nothing once read by key. writer names another format in tests."""
    w = kafka_rows(df, key, fmt).writeStream.outputMode(mode).format(writer).option("checkpointLocation", checkpoint)
    return w.option("kafka.bootstrap.servers", servers).option("topic", topic).start()


def jdbc_append(df: DataFrame, url: str, name: str, batch: int = 1000, **options) -> None:
    """Appends to a database table, which is made if it is missing. Executors write; the driver does where only it has the database."""
    if jvm_jdbc.only_in_driver(df.sparkSession, url):
        jvm_jdbc.append(df, url, name, {"batchsize": str(batch)} | options)
        return
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=str(batch), **options).mode("append").save()


def jdbc_append_batch(url: str, name: str, **options) -> Callable[[DataFrame, int], None]:
    return lambda df, _: jdbc_append(df, url, name, **options)


def query_id(df: DataFrame) -> str:
    """Id of the streaming query that calls a foreachBatch function; it stays the same as long as its checkpoint does. Empty elsewhere."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


class Topic:
    """A log of records in a folder, written in transactions: each micro-batch is one.

    A batch's records are written first, below the query's id and the batch's number, and then its commit;
    a batch that runs again after a failure replaces its records. read() gives committed records only, so
    each record counts once from a replayable source to the readers of the topic.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, df: DataFrame, batch: int) -> None:
        own = f"run={query_id(df) or 'none'}/batch={batch}"
        df.write.mode("overwrite").parquet(f"{self.path}/records/{own}")
        self.commit(df.sparkSession, own)

    def commit(self, spark, own: str) -> None:
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{own}")

    def read(self, spark, committed: bool = True) -> DataFrame:
        records = spark.read.option("basePath", f"{self.path}/records").parquet(f"{self.path}/records")
        if committed:
            commits = spark.read.option("basePath", f"{self.path}/commits").parquet(f"{self.path}/commits").select("run", "batch")
            records = records.join(commits, ["run", "batch"], "left_semi")
        return records.drop("run", "batch")


class Upsert:
    """Upsert of micro-batches into a database table by key, through a staging table.

    add: names of columns that are added to the stored value (others overwrite it). The query's id and the
    batch's number are stored with each batch, in the same transaction, so a batch that is replayed after a
    failure is not added twice. A query that starts anew, with another checkpoint, has another id: its
    batches are added from number 0 on. Outside a stream the id is `run`. dialect: "merge" (Derby, Postgres 15) or "mysql".
    The stored table has the frame's columns; the staging and batch tables are made if they are missing.
    """

    def __init__(self, url: str, name: str, keys: list[str], add: tuple[str, ...] = (), dialect: str = "merge", run: str = "", **options):
        self.url, self.name, self.keys, self.add, self.dialect, self.run, self.options = url, name, keys, add, dialect, run, options

    def statement(self, columns: list[str], staging: str) -> str:
        rest = [c for c in columns if c not in self.keys]
        q = (lambda c: f"`{c}`") if self.dialect == "mysql" else (lambda c: f'"{c}"')
        names = ", ".join(map(q, columns))
        if self.dialect == "mysql":
            sets = ", ".join(f"{q(c)} = {q(c)} + VALUES({q(c)})" if c in self.add else f"{q(c)} = VALUES({q(c)})" for c in rest)
            return f"INSERT INTO {self.name} ({names}) SELECT {names} FROM {staging} ON DUPLICATE KEY UPDATE {sets}"
        on = " AND ".join(f"t.{q(c)} = s.{q(c)}" for c in self.keys)
        sets = ", ".join(f"{q(c)} = t.{q(c)} + s.{q(c)}" if c in self.add else f"{q(c)} = s.{q(c)}" for c in rest)
        own = ", ".join(f"s.{q(c)}" for c in columns)
        return f"MERGE INTO {self.name} t USING {staging} s ON {on} WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({own})"

    def __call__(self, df: DataFrame, batch: int) -> None:
        staging, done = f"{self.name}_staging", f"{self.name}_batches"
        run = (query_id(df) or self.run).replace("'", "''")
        connection = jvm_jdbc.connect(df.sparkSession, self.url, self.options)
        try:
            if not jvm_jdbc.has_table(connection, done):
                jvm_jdbc.run(connection, f"CREATE TABLE {done} (run VARCHAR(100), batch BIGINT)")
            if self.add and jvm_jdbc.one(connection, f"SELECT count(*) FROM {done} WHERE run = '{run}' AND batch = {batch}"):
                return
            if jvm_jdbc.has_table(connection, staging):
                jvm_jdbc.run(connection, f"DELETE FROM {staging}")
            else:  # with the column types of the stored table
                like = f"LIKE {self.name}" if self.dialect == "mysql" else f"AS SELECT * FROM {self.name} WITH NO DATA"
                jvm_jdbc.run(connection, f"CREATE TABLE {staging} {like}")
            jdbc_append(df, self.url, staging, **self.options)
            connection.setAutoCommit(False)
            try:
                jvm_jdbc.run(connection, self.statement(df.columns, staging))
                jvm_jdbc.run(connection, f"INSERT INTO {done} VALUES ('{run}', {batch})")
                connection.commit()
            except Exception:
                connection.rollback()
                raise
            connection.setAutoCommit(True)
        finally:
            connection.close()


def changelog(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Row changes between two states of a table: op +I, -U and +U, -D with the row's columns."""
    rest = [c for c in now.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("_a"), F.lit(True).alias("_in_a"))
    b = now.select(*keys, F.struct(*rest).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full").filter(F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")))
    old = F.struct(F.when(F.col("_in_b").isNull(), "-D").otherwise("-U").alias("op"), F.col("_a").alias("row"))
    new = F.struct(F.when(F.col("_in_a").isNull(), "+I").otherwise("+U").alias("op"), F.col("_b").alias("row"))
    made = F.filter(F.array(F.when(F.col("_in_a"), old), F.when(F.col("_in_b"), new)), lambda x: x.isNotNull())
    out = both.select(*keys, F.explode(made).alias("_c"))
    return out.select("_c.op", *keys, *(F.col(f"_c.row.{c}").alias(c) for c in rest))


class RowWriter:
    """foreach() writer: a custom sink with open, invoke per row and close, once per task and batch."""

    def __init__(self, invoke: Callable, setup: Callable | None = None, teardown: Callable | None = None):
        self.invoke, self.setup, self.teardown = invoke, setup, teardown

    def open(self, partition_id: int, epoch_id: int) -> bool:
        if self.setup:
            self.setup()
        return True

    def process(self, row) -> None:
        self.invoke(row)

    def close(self, error) -> None:
        if self.teardown:
            self.teardown()


def many(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One micro-batch to several sinks, computed once."""

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for w in writers:
                w(df, batch)
        finally:
            df.unpersist()

    return write


def side_outputs(tag: str, outputs: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """Rows of each tag to its own sink."""
    return many(*((lambda df, k, name=name, w=w: w(df.filter(F.col(tag) == name).drop(tag), k)) for name, w in outputs.items()))
