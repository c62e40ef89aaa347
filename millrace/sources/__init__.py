"""Sources: files with metadata, lines, collections, generators, sockets, Kafka, JDBC; one registry of tables.

Batch and streaming forms take the same options. A schema is always declared, never inferred.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from millrace.session import shared_folder
from millrace.sources import jvm_jdbc

EVENT = "user STRING, url STRING, ts BIGINT"
SENSOR = "id STRING, vc INT, ts BIGINT"
WORD_COUNT = "word STRING, count BIGINT"
URL_VIEW_COUNT = "window_start BIGINT, window_end BIGINT, url STRING, count BIGINT"
ORDER_EVENT = "id STRING, ts BIGINT"
ORDER_DETAIL = "id STRING, order_id STRING, ts BIGINT"
CLICK = "id STRING, province_id STRING, ts BIGINT"
APP_EVENT = "id STRING, order_id STRING, event_type STRING, ts BIGINT"
THIRD_PARTY_EVENT = "id STRING, order_id STRING, event_type STRING, third_party STRING, ts BIGINT"
#: File facts that a file source can add, by the name of their column.
FILE_FACTS = {"file.size": "file_size", "file.modification-time": "file_modification_time", "file.path": "file_path", "file.name": "file_name"}
#: Values that the random event generator picks from (fixed values).
USERS = ("Zhangsan", "Lisi", "Wangwu", "Tom", "Jerry")
URLS = ("/home", "/list", "/detail", "/pay", "/cart")


def from_collection(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def from_elements(spark: SparkSession, *values, kind: str = "string", name: str = "value") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def values(spark: SparkSession, sql_rows: str, columns: str) -> DataFrame:
    """Inline VALUES: values(spark, "('a', 1), ('b', 2)", "k, v")."""
    return spark.sql(f"SELECT * FROM VALUES {sql_rows} AS t({columns})")


def text_file(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    return (spark.readStream if streaming else spark.read).options(**options).text(path)


def socket_text(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def parse_csv_lines(df: DataFrame, schema: str, line: str = "value", trim: bool = True) -> DataFrame:
    """Columns of comma-separated lines; a line that does not parse fails the job. Other columns stay."""
    wanted = StructType.fromDDL(schema)
    parts = F.split(line, ",")
    word = lambda i: F.trim(F.element_at(parts, i + 1)) if trim else F.element_at(parts, i + 1)
    return df.select(*(word(i).cast(f.dataType).alias(f.name) for i, f in enumerate(wanted)), *(c for c in df.columns if c != line))


def csv_files(spark: SparkSession, path: str, schema: str, facts: dict[str, str] | None = None, streaming: bool = False, **options) -> DataFrame:
    """Rows of csv files; facts maps new column names to keys of FILE_FACTS."""
    reader = (spark.readStream if streaming else spark.read).schema(schema).options(**{"mode": "FAILFAST"} | options)
    df = reader.csv(path)
    names = [f.name for f in StructType.fromDDL(schema)]
    return df.select(*names, *(F.col(f"_metadata.{FILE_FACTS[k]}").alias(n) for n, k in (facts or {}).items()))


def json_files(spark: SparkSession, path: str, schema: str, streaming: bool = False, **options) -> DataFrame:
    return (spark.readStream if streaming else spark.read).schema(schema).options(**options).json(path)


def parquet_files(spark: SparkSession, path: str, schema: StructType | str | None = None, streaming: bool = False, **options) -> DataFrame:
    if streaming:
        return spark.readStream.schema(schema or spark.read.parquet(path).schema).options(**options).parquet(path)
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- generators


class RandomEvents:
    """Column expressions of random events over a row number: uuid, user, url, time in milliseconds."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def columns(self, index: Column) -> list[Column]:
        pick = lambda of, k: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(index, F.lit(self.seed + k)), F.lit(len(of))) + 1).cast("int"))
        return [pick(USERS, 1).alias("user"), pick(URLS, 2).alias("url")]


def random_events(spark: SparkSession, count: int | None = None, rate: int = 1, seed: int = 0) -> DataFrame:
    """Bounded if count is given (ts counts rows at `rate` a second from 0), else a stream (ts is the clock)."""
    maker = RandomEvents(seed)
    if count is not None:
        df = spark.range(count)
        return df.select(*maker.columns(F.col("id")), (F.col("id") * 1000 / rate).cast("bigint").alias("ts"))
    df = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return df.select(*maker.columns(F.col("value")), F.unix_millis("timestamp").alias("ts"))


def generated(spark: SparkSession, count: int, of: Column, rate: int | None = None) -> DataFrame:
    """`of` is an expression over `id`, the row number from 0: a generator function. With rate, a stream."""
    if rate is None:
        return spark.range(count).select(of)
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("id")).filter(F.col("id") < count).select(of)


class DatagenSource(DataSource):
    """format("millrace-datagen"): options number-of-rows, rows-per-second, partitions, seed, and for each field
    of the schema fields.F.kind (random or sequence) with .length, .min, .max or .start, .end."""

    @classmethod
    def name(cls) -> str:
        return "millrace-datagen"

    def schema(self) -> str:
        return "id BIGINT"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DatagenReader(schema, self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return DatagenStream(schema, self.options)


def datagen_row(schema: StructType, options: dict, index: int) -> tuple:
    out = []
    for f in schema:
        get = lambda k, d=None, f=f: options.get(f"fields.{f.name}.{k}".lower(), options.get(f"fields.{f.name}.{k}", d))
        kind = f.dataType.simpleString()
        if get("kind", "random") == "sequence":
            v = int(get("start", 0)) + index
            out.append(str(v) if kind == "string" else v)
            continue
        rng = random.Random(f"{options.get('seed', '0')}/{f.name}/{index}")
        if kind == "string":
            out.append("".join(rng.choice("0123456789abcdef") for _ in range(int(get("length", 100)))))
        elif kind in ("double", "float"):
            out.append(rng.uniform(float(get("min", 0)), float(get("max", 1))))
        elif kind == "boolean":
            out.append(rng.random() < 0.5)
        else:
            out.append(rng.randint(int(get("min", -(1 << 31))), int(get("max", (1 << 31) - 1))))
    return tuple(out)


def datagen_count(schema: StructType, options: dict) -> int | None:
    """Rows in all: the given number, or as far as the shortest sequence goes."""
    ends = [int(options[f"fields.{f.name}.end"]) - int(options.get(f"fields.{f.name}.start", 0)) + 1 for f in schema if f"fields.{f.name}.end" in options]
    given = [int(options["number-of-rows"])] if "number-of-rows" in options else []
    return min(given + ends) if given + ends else None


class DatagenReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.of, self.options = schema, dict(options)

    def partitions(self):
        n = datagen_count(self.of, self.options)
        if n is None:
            raise ValueError("a bounded read needs number-of-rows or a sequence with an end")
        k = max(1, int(self.options.get("partitions", 1)))
        return [InputPartition((n * i // k, n * (i + 1) // k)) for i in range(k)]

    def read(self, partition):
        for i in range(*partition.value):
            yield datagen_row(self.of, self.options, i)


class DatagenStream(SimpleDataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.of, self.options, self.last = schema, dict(options), None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"index": 0}

    def read(self, start: dict):
        rate, n = int(self.options.get("rows-per-second", 10)), datagen_count(self.of, self.options)
        now = time.time()
        if self.last is not None and now - self.last < 1:
            return iter([]), start
        self.last = now
        end = start["index"] + rate if n is None else min(n, start["index"] + rate)
        return self.readBetweenOffsets(start, {"index": end}), {"index": end}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter([datagen_row(self.of, self.options, i) for i in range(start["index"], end["index"])])


def datagen(spark: SparkSession, schema: str, streaming: bool = False, **options) -> DataFrame:
    """datagen(spark, "id STRING, vc INT", **{"number-of-rows": 9, "fields.vc.min": 1, "fields.vc.max": 9})."""
    return own_source(spark, DatagenSource, schema, streaming, **options)


class CountingSource(DataSource):
    """An example of a source class: rows (id, ts) from 0 to the option rows, in the option's number of partitions.
    As a stream it gives up to ten rows a batch. open and close of a reader are the ends of its generator."""

    @classmethod
    def name(cls) -> str:
        return "millrace-counting"

    def schema(self) -> str:
        return "id BIGINT, ts BIGINT"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CountingReader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return CountingStream(self.options)


class CountingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.tasks = int(options["rows"]), max(1, int(options.get("partitions", 1)))

    def partitions(self):
        return [InputPartition((self.rows * i // self.tasks, self.rows * (i + 1) // self.tasks)) for i in range(self.tasks)]

    def read(self, partition):
        return ((i, i * 1000) for i in range(*partition.value))


class CountingStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.rows = int(options["rows"])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": 0}

    def read(self, start: dict):
        end = {"id": min(self.rows, start["id"] + 10)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter([(i, i * 1000) for i in range(start["id"], end["id"])])


def own_source(spark: SparkSession, source: type[DataSource], schema: str, streaming: bool = False, **options) -> DataFrame:
    """Rows of a source class, which is registered by its name."""
    spark.dataSource.register(source)
    reader = (spark.readStream if streaming else spark.read).format(source.name()).schema(schema)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


# ---- Kafka, JDBC


def kafka_options(servers: str, topics: str, start: str | dict = "latest", group: str | None = None, read_committed: bool = False) -> dict[str, str]:
    """Options of format("kafka"). start: "earliest", "latest" or {topic: {partition: offset}}. What was read is kept
    in the query's checkpoint, not in the consumer group, which only names the consumer."""
    import json

    out = {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": start if isinstance(start, str) else json.dumps(start)}
    if group:
        out["kafka.group.id"] = group
    if read_committed:
        out["kafka.isolation.level"] = "read_committed"
    return out


def kafka(spark: SparkSession, options: dict[str, str], streaming: bool = True, source: DataFrame | None = None) -> DataFrame:
    """Rows of the Kafka source. source stands in for it where no broker is there: same columns."""
    if source is not None:
        return source
    return (spark.readStream if streaming else spark.read).format("kafka").options(**options).load()


def kafka_values(df: DataFrame, schema: str, fmt: str = "csv", facts: tuple[str, ...] = ()) -> DataFrame:
    """Values parsed as csv or json lines, with facts out of topic, partition, offset, timestamp."""
    parse = {"csv": F.from_csv, "json": F.from_json}[fmt]
    value = parse(F.col("value").cast("string"), schema, {"mode": "FAILFAST"})
    return df.select(value.alias("v"), *facts).select("v.*", *facts)


def jdbc(spark: SparkSession, url: str, name: str, split: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A database table. split (numeric column, low, high, tasks) reads it in that many tasks. An embedded database that
    executors can't reach is read by the driver, by one cursor, into files of the shared folder: its rows at the time of the call."""
    if jvm_jdbc.only_in_driver(spark, url):
        return jvm_jdbc.copy(spark, url, name, options, f"{shared_folder(spark)}/jdbc-{uuid.uuid4().hex}")
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if split:
        column, low, high, n = split
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return reader.load()


class Lookup:
    """A dimension that is read again when it is older than `ttl` seconds, for joins in each micro-batch."""

    def __init__(self, read, ttl: float = 20.0, clock=time.monotonic):
        self.read, self.ttl, self.clock, self.at, self.rows = read, ttl, clock, None, None

    def __call__(self) -> DataFrame:
        now = self.clock()
        if self.at is None or now - self.at >= self.ttl:
            if self.rows is not None:
                self.rows.unpersist()
            self.rows, self.at = self.read().persist(), now
        return self.rows
