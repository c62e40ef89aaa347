"""Sources, sinks and streams as queries: each runs over bounded input and gives its final rows.

A stream is fed the events of a table in files by time, one file a micro-batch, and a last row far ahead,
which closes all windows; that row's results are taken out again.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import socket
import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import sources as S
from millrace import streaming as T
from millrace.ddl import Registry
from millrace.operators import relational as R
from millrace.plans.base import events, query, scratch, sensors
from millrace.plans.relational import TOPN
from millrace.plans.windows import hopped, sessions, tumbled
from millrace.session import Checkpointing, shared_folder
from millrace.sources import sinks as K
from millrace.sources import table
from millrace.streaming import processors as P

FAR = "2100-01-01 00:00:00"
PARTS = 3


def fed(spark, d, last: bool = True) -> DataFrame:
    """events as a stream of PARTS micro-batches in order of time, ts as TIMESTAMP; then the row far ahead.

    The parts are cut at quantiles of ts. The first and the last are open, and null times are in the first, so
    every row is in exactly one, whatever its event_id."""
    path = scratch(spark)
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    cuts = e.agg(F.percentile_approx(at, [k / PARTS for k in range(1, PARTS)])).first()[0] or []  # none: no times
    part = sum((F.coalesce(at >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for k in range(PARTS):
        e.filter(part == k).coalesce(1).write.parquet(f"{path}/{k}")
    if last:
        end = {"event_id": "-1L", "ts": f"TIMESTAMP '{FAR}'", "user_id": "-1L", "event_type": "'end'", "value": "0D", "props": "''"}
        spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in end.items())).select(e.columns).coalesce(1).write.parquet(f"{path}/{PARTS}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def collected(spark, stream: DataFrame, mode: str = "append", clock: bool = False) -> DataFrame:
    path = scratch(spark)
    return T.bounded(spark, stream, f"{path}/out", f"{path}/cp", mode, clock)


def ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def written(spark, stream: DataFrame, writer, mode: str = "append") -> None:
    Checkpointing(scratch(spark), None).start(stream, mode, each_batch=writer).awaitTermination()


def to_files(path: str):
    return lambda df, k: df.write.mode("overwrite").parquet(f"{path}/batch={k}")


def printed(spark, run) -> DataFrame:
    """What run() prints, a row a line. The lines go through a file of the driver's, and from there in parts to the shared folder."""
    path, n = scratch(spark), 0
    with tempfile.TemporaryFile("w+") as out:
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(out):
            run()
        out.seek(0)
        while part := list(itertools.islice(out, 100_000)):
            spark.createDataFrame([(line.rstrip("\n"),) for line in part], "line string").write.parquet(f"{path}/{n}")
            n += 1
    return spark.read.schema("line string").parquet(*(f"{path}/{k}" for k in range(n))) if n else spark.createDataFrame([], "line string")


# ---- sources


@query("SELECT * FROM (VALUES ('Tom', '/home', CAST(1000 AS BIGINT)), ('Jerry', '/cart', 2000)) t(\"user\", url, ts)")
def s1_from_collection(spark, d):
    return S.from_collection(spark, [("Tom", "/home", 1000), ("Jerry", "/cart", 2000)], S.EVENT)


@query("SELECT * FROM (VALUES ('a'), ('b'), ('c')) t(value)")
def s2_from_elements(spark, d):
    return S.from_elements(spark, "a", "b", "c")


@query("SELECT * FROM (VALUES ('A1', 'B1', 100), ('A1', 'B2', 400)) t(a, b, amount)")
def s3_values(spark, d):
    return S.values(spark, "('A1', 'B1', 100), ('A1', 'B2', 400)", "a, b, amount")


NATION_LINES = "SELECT n_name AS value FROM nation"


@query(NATION_LINES)
def s4_text_file(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").select("n_name").write.text(f"{path}/t")
    return S.text_file(spark, f"{path}/t")


@contextlib.contextmanager
def served(lines: list[str]):
    """A socket server that gives the lines to its first client and stays open; its port."""
    server, stop = socket.create_server(("127.0.0.1", 0)), threading.Event()

    def serve():
        client, _ = server.accept()
        client.sendall("".join(f"{x}\n" for x in lines).encode())
        stop.wait(120)
        client.close()

    threading.Thread(target=serve, daemon=True).start()
    try:
        yield server.getsockname()[1]
    finally:
        stop.set()
        server.close()


def heard(spark, lines: list[str], make, mode: str = "append") -> DataFrame:
    """make(lines of a socket) as a stream over all the lines."""
    path, seen = scratch(spark), {"rows": 0}

    def write(df, k):
        df.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else k}")

    with served(lines) as port:
        q = make(S.socket_text(spark, "127.0.0.1", port)).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark)).start()
        try:
            for _ in range(600):
                q.processAllAvailable()
                seen["rows"] = sum(int(p["numInputRows"]) for p in (x if isinstance(x, dict) else x.jsonValue for x in q.recentProgress))
                if seen["rows"] >= len(lines):
                    break
                time.sleep(0.1)
        finally:
            q.stop()
    return spark.read.parquet(f"{path}/*")


@query(NATION_LINES)
def s6_socket(spark, d):
    lines = [r[0] for r in table(spark, d, "nation").select("n_name").collect()]  # the 25 nations
    return heard(spark, lines, lambda x: x)


@query(NATION_LINES)
def s5_file_source_stream(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").select("n_name").write.text(f"{path}/t")
    return collected(spark, S.text_file(spark, f"{path}/t", streaming=True))


@query("SELECT CAST(user_id AS VARCHAR) AS id, CAST(floor(value) AS INTEGER) AS vc, (epoch_us(ts) // 1000) AS ts FROM events")
def s7_csv_lines(spark, d):
    lines = sensors(spark, d).select(F.concat_ws(", ", "id", F.col("vc").cast("string"), F.col("ts").cast("string")).alias("value"))
    return S.parse_csv_lines(lines, S.SENSOR)


@query("SELECT CAST(user_id AS VARCHAR) AS id, CAST(floor(value) AS INTEGER) AS vc, (epoch_us(ts) // 1000) AS ts, 'sensors' AS topic FROM events")
def s8_kafka_source(spark, d):
    """No broker here: a frame with the Kafka source's columns stands in for it."""
    rows = sensors(spark, d).select(F.lit(None).cast("binary").alias("key"), F.to_csv(F.struct("id", "vc", "ts")).cast("binary").alias("value"), F.lit("sensors").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"))
    got = S.kafka(spark, S.kafka_options("broker:9092", "sensors", "earliest", "g1", True), source=rows)
    return S.kafka_values(got, S.SENSOR, facts=("topic",))


@query("SELECT range AS id, CAST(range * 1000 AS BIGINT) AS ts FROM range(0, 100)")
def s9_generator(spark, d):
    return S.generated(spark, 100, F.struct("id", (F.col("id") * 1000).alias("ts")).alias("r")).select("r.id", "r.ts")


@query("SELECT range AS id, range * 1000 AS ts FROM range(0, 100)")
def s10_custom_source(spark, d):
    """A source class of its own, registered by name and read in three parts."""
    return S.own_source(spark, S.CountingSource, "id BIGINT, ts BIGINT", rows=100, partitions=3)


@query("SELECT 50 AS n, 50 AS good FROM (VALUES (1)) t")
def s9_random_events(spark, d):
    made = S.random_events(spark, 50)
    good = F.col("user").isin(*S.USERS) & F.col("url").isin(*S.URLS)
    return made.agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(good.cast("int")).cast("int").alias("good"))


@query("SELECT CAST(range + 1 AS INTEGER) AS vc, CAST(8 AS INTEGER) AS len FROM range(0, 20)")
def s11_datagen(spark, d):
    got = S.datagen(spark, "id STRING, vc INT", **{"number-of-rows": 20, "fields.id.length": 8, "fields.vc.kind": "sequence", "fields.vc.start": 1, "fields.vc.end": 1000})
    return got.select("vc", F.length("id").alias("len"))


@query("SELECT n_nationkey AS id, n_name AS name, true AS has_size, true AS is_csv FROM nation")
def s12_csv_with_file_facts(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").write.csv(f"{path}/t")
    got = S.csv_files(spark, f"{path}/t", "id INT, name STRING", {"fs": "file.size", "fmt": "file.modification-time", "fp": "file.path", "fn": "file.name"})
    return got.select("id", "name", (F.col("fs") > 0).alias("has_size"), F.col("fn").endswith(".csv").alias("is_csv"))


@query("SELECT CAST(user_id AS VARCHAR) AS id, CAST(floor(value) AS INTEGER) AS vc, (epoch_us(ts) // 1000) AS ts, 0 AS part, event_id AS at FROM events")
def s13_kafka_table(spark, d):
    rows = sensors(spark, d).select(F.to_csv(F.struct("id", "vc", "ts")).cast("binary").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"))
    return S.kafka_values(rows, S.SENSOR, facts=("partition", "offset")).withColumnsRenamed({"partition": "part", "offset": "at"})


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def s14_table_options(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").write.option("sep", "|").csv(f"{path}/t")
    r = Registry(spark)
    r.sql(f"CREATE TABLE t (id INT, name STRING) WITH ('connector' = 'filesystem', 'path' = '{path}/t', 'format' = 'csv')")
    return r.read("t", options={"sep": "|"})


def derby() -> str:
    """A new database of the driver, in a folder of its own until the driver ends."""
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, True)
    return f"jdbc:derby:{path}/db;create=true"


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@query("SELECT n_nationkey, n_name FROM nation")
def s15_jdbc_scan(spark, d):
    url = derby()
    K.jdbc_append(table(spark, d, "nation").select("n_nationkey", "n_name"), url, "t_nation", **DERBY)
    return S.jdbc(spark, url, "t_nation", ("n_nationkey", 0, 25, 2), **DERBY)


@query("SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey")
def s16_jdbc_lookup_join(spark, d):
    url, path = derby(), scratch(spark)
    K.jdbc_append(table(spark, d, "nation").select("n_nationkey", "n_name"), url, "t_nation", **DERBY)
    dimension = S.Lookup(lambda: S.jdbc(spark, url, "t_nation", **DERBY), ttl=20)
    stream = fed(spark, d, last=False).select("event_id", (F.col("user_id") % 25).alias("k"))
    written(spark, stream, T.lookup_batches(dimension, "k", "n_nationkey", lambda df, k: to_files(path)(df.select("event_id", "n_name"), k)))
    return spark.read.parquet(path).select("event_id", "n_name")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def s17_stream_to_table(spark, d):
    fed(spark, d, last=False).createOrReplaceTempView("t_stream")
    return collected(spark, spark.sql("SELECT event_type, count(*) AS n FROM t_stream GROUP BY event_type"), "complete")


@query("SELECT n_nationkey, n_name FROM nation")
def s18_named_table(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("t_nation")
    return spark.table("t_nation").select("n_nationkey", "n_name")


@query("SELECT 'n_nationkey:int n_name:string' AS schema")
def s19_view_and_schema(spark, d):
    table(spark, d, "nation").select("n_nationkey", "n_name").createOrReplaceTempView("t_view")
    return S.from_elements(spark, " ".join(f"{n}:{k}" for n, k in spark.table("t_view").dtypes), name="schema")


# ---- sinks

TOTALS = "SELECT user_id, CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS total FROM events GROUP BY user_id"


@query("SELECT 'E> (' || event_id || ', ' || chr(39) || event_type || chr(39) || ')' AS line FROM events")
def k1_print(spark, d):
    """The lines that were printed."""
    return printed(spark, lambda: K.print_rows(events(spark, d).select("event_id", "event_type"), "E", limit=None))


@query("SELECT 'P> (' || event_id || ', ' || chr(39) || event_type || chr(39) || ')' AS line FROM events")
def k2_print_connector(spark, d):
    """The print connector's identifier and stream are options of the table."""
    r = Registry(spark)
    r.sql("CREATE TABLE t_print (event_id BIGINT, event_type STRING) WITH ('connector' = 'print', 'print-identifier' = 'P', 'standard-error' = 'true')")
    events(spark, d).createOrReplaceTempView("t_events")
    return printed(spark, lambda: r.sql("INSERT INTO t_print SELECT event_id, event_type FROM t_events"))


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H') AS bucket FROM events")
def k3_row_files(spark, d):
    path = scratch(spark)
    q = K.row_files(fed(spark, d, last=False).select("event_id", "event_type", "ts"), f"{path}/out", f"{path}/cp", "ts", bucket="yyyy-MM-dd HH", interval=None)
    q.awaitTermination()
    return spark.read.schema("event_id BIGINT, event_type STRING, bucket STRING").json(f"{path}/out")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def k4_json_files(spark, d):
    path = scratch(spark)
    r = Registry(spark)
    table(spark, d, "nation").selectExpr("n_nationkey AS id", "n_name AS name").createOrReplaceTempView("t_in")
    r.sql(f"CREATE TABLE t_out (id INT, name STRING) WITH ('connector' = 'filesystem', 'path' = '{path}/t', 'format' = 'json')")
    r.sql("INSERT INTO t_out SELECT id, name FROM t_in")
    return r.read("t_out")


@query("""SELECT CAST(NULL AS VARCHAR) AS key, '{"id":"' || user_id || '","vc":' || CAST(floor(value) AS INTEGER) || '}' AS value FROM events""")
def k5_kafka_values(spark, d):
    got = K.kafka_rows(sensors(spark, d).select("id", "vc"))
    return got.select(F.lit(None).cast("string").alias("key"), "value")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, '{"id":"' || user_id || '","vc":' || CAST(floor(value) AS INTEGER) || '}' AS value FROM events""")
def k6_kafka_keyed(spark, d):
    return K.kafka_rows(sensors(spark, d).select("id", "vc"), key="id")


@query("""SELECT '{"id":"' || user_id || '","vc":' || CAST(floor(value) AS INTEGER) || '}' AS value FROM events""")
def k7_kafka_stream(spark, d):
    """The rows that the streaming Kafka sink is given, through a text file in its place."""
    path = scratch(spark)
    stream = fed(spark, d, last=False).select(F.col("user_id").cast("string").alias("id"), F.floor("value").cast("int").alias("vc"))
    q = K.kafka_rows(stream).writeStream.format("text").option("path", f"{path}/o").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.text(f"{path}/o")


@query(TOTALS)
def k8_upsert_log(spark, d):
    """Update rows by key; the last value of each key is its total."""
    path = scratch(spark)
    stream = fed(spark, d, last=False).groupBy("user_id").agg(F.sum(F.floor("value").cast("int")).alias("total"))
    written(spark, stream, lambda df, k: K.kafka_rows(df, "user_id").withColumn("seq", F.lit(k)).write.mode("overwrite").parquet(f"{path}/b={k}"), "update")
    log = spark.read.parquet(path)
    last = log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return last.select(F.from_json("value", "user_id BIGINT, total BIGINT").alias("v")).select("v.*")


@query("SELECT user_id, event_type FROM events")
def k9_jdbc_append(spark, d):
    url = derby()
    written(spark, fed(spark, d, last=False).select("user_id", "event_type"), K.jdbc_append_batch(url, "t_ws", **DERBY))
    return S.jdbc(spark, url, "t_ws", **DERBY)


def upserted(spark, d, add: tuple[str, ...], stream: DataFrame, mode: str, create: str, keys: list[str]):
    url = derby()
    c = K.jvm_jdbc.connect(spark, url, DERBY)
    K.jvm_jdbc.run(c, create)
    c.close()
    written(spark, stream, K.Upsert(url, "t_sink", keys, add, **DERBY), mode)
    return S.jdbc(spark, url, "t_sink", **DERBY)


@query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def k10_jdbc_upsert(spark, d):
    stream = fed(spark, d, last=False).select("user_id", "event_id", "event_type")
    url = derby()
    c = K.jvm_jdbc.connect(spark, url, DERBY)
    K.jvm_jdbc.run(c, 'CREATE TABLE t_sink ("user_id" BIGINT PRIMARY KEY, "event_type" VARCHAR(40))')
    c.close()
    up = K.Upsert(url, "t_sink", ["user_id"], **DERBY)
    written(spark, stream, lambda df, k: up(R.keep_last(df, ["user_id"], ["event_id"]).select("user_id", "event_type"), k))
    return S.jdbc(spark, url, "t_sink", **DERBY)


@query("SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id")
def k11_jdbc_adding_upsert(spark, d):
    stream = fed(spark, d, last=False).select("user_id")
    url = derby()
    c = K.jvm_jdbc.connect(spark, url, DERBY)
    K.jvm_jdbc.run(c, 'CREATE TABLE t_sink ("user_id" BIGINT PRIMARY KEY, "cnt" BIGINT)')
    c.close()
    up = K.Upsert(url, "t_sink", ["user_id"], ("cnt",), **DERBY)
    written(spark, stream, lambda df, k: [up(df.groupBy("user_id").agg(F.count(F.lit(1)).alias("cnt")), k) for _ in range(2)])  # the second is a replay
    return S.jdbc(spark, url, "t_sink", **DERBY)


@query(TOTALS)
def k12_jdbc_table_upsert(spark, d):
    stream = fed(spark, d, last=False).groupBy("user_id").agg(F.sum(F.floor("value").cast("int")).alias("total"))
    return upserted(spark, d, (), stream, "update", 'CREATE TABLE t_sink ("user_id" BIGINT PRIMARY KEY, "total" BIGINT)', ["user_id"])


class RowFiles:
    """A sink of its own: one file for each task and batch. Its folder has to be mounted on all machines."""

    def __init__(self, path: str):
        self.path, self.file = path, None

    def setup(self) -> None:
        import os

        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        self.file = open(f"{self.path}/{task.getLocalProperty('streaming.sql.batchId')}-{task.partitionId()}", "w")

    def invoke(self, row) -> None:
        self.file.write(f"{row.event_id}\n")

    def teardown(self) -> None:
        self.file.close()


@query("SELECT event_id FROM events")
def k13_custom_sink(spark, d):
    """foreach() with open, process and close: every row goes through the sink. A task writes its rows to one file
    of the shared folder, a repeated task to the same file; the rows read back are what the sink was given."""
    path = shared_folder(spark).removeprefix("file://") + f"/sink-{uuid.uuid4().hex}"
    written_by = RowFiles(path)
    q = fed(spark, d, last=False).writeStream.foreach(K.RowWriter(written_by.invoke, written_by.setup, written_by.teardown)).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id BIGINT").csv(f"file://{path}")


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def k14_insert_select(spark, d):
    path = scratch(spark)
    r = Registry(spark)
    table(spark, d, "nation").createOrReplaceTempView("t_nation")
    r.sql(f"CREATE TABLE t_counts (region INT, n BIGINT) WITH ('connector' = 'filesystem', 'path' = '{path}/t', 'format' = 'json')")
    r.sql("INSERT INTO t_counts SELECT n_regionkey, count(*) FROM t_nation GROUP BY n_regionkey")
    return r.read("t_counts")


@query("""WITH cut AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS half FROM events), a AS (SELECT user_id, count(*) AS n FROM events, cut WHERE ts < half GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT '-U' AS op, a.user_id, a.n FROM a JOIN b USING (user_id) WHERE a.n <> b.n UNION ALL SELECT '+U', b.user_id, b.n FROM a JOIN b USING (user_id) WHERE a.n <> b.n
UNION ALL SELECT '+I', user_id, n FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""")
def k15_changelog(spark, d):
    """From the counts at half time to the counts of all events."""
    e = events(spark, d)
    half = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("half"))
    count = lambda x: x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return K.changelog(count(e.join(F.broadcast(half), F.col("ts") < F.col("half"))), count(e), ["user_id"])


# ---- streams


@query(tumbled("1 HOUR", "event_type"))
def stream_tumble(spark, d):
    got = collected(spark, T.window_counts(fed(spark, d).withWatermark("ts", "0 seconds"), "ts", "1 hour", ["event_type"]))
    return ntz(got.filter("event_type <> 'end'"), "window_start", "window_end")


@query(hopped("10 HOUR", "5 HOUR", 2, "event_type"))
def stream_hop(spark, d):
    got = collected(spark, T.window_counts(fed(spark, d).withWatermark("ts", "2 seconds"), "ts", "10 hours", ["event_type"], "5 hours"))
    return ntz(got.filter("event_type <> 'end'"), "window_start", "window_end")


@query(sessions("6 HOUR", "user_id"))
def stream_session(spark, d):
    from millrace.operators import windows as W

    got = collected(spark, W.session(fed(spark, d).withWatermark("ts", "0 seconds"), "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]))
    return ntz(got.filter("user_id >= 0").select("user_id", "window_start", "window_end", "n"), "window_start", "window_end")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR * k AS window_end, count(*) AS n
FROM events, range(1, 5) r(k) WHERE ts < time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR * k GROUP BY ALL""")
def stream_cumulate(spark, d):
    w = F.window("ts", "1 day")
    df = fed(spark, d).withWatermark("ts", "0 seconds").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4))))
    df = df.filter(F.col("ts") < F.date_trunc("day", "ts") + F.expr("INTERVAL 6 HOURS") * F.col("k"))
    got = collected(spark, df.groupBy(w.alias("w"), "k").agg(F.count(F.lit(1)).alias("n")))
    got = got.select(F.col("w.start").alias("window_start"), (F.col("w.start") + F.expr("INTERVAL 6 HOURS") * F.col("k")).alias("window_end"), "n")
    return ntz(got.filter(F.col("window_start") < FAR), "window_start", "window_end")


@query(TOPN)
def stream_topn(spark, d):
    path = scratch(spark)
    counts = T.window_counts(fed(spark, d).withWatermark("ts", "0 seconds"), "ts", "1 hour", ["event_type"])
    written(spark, counts, T.top_n_batches(2, [F.col("n").desc(), F.col("event_type")], to_files(path)))
    got = spark.read.parquet(path).filter("event_type <> 'end'")
    return ntz(got.select("window_start", "window_end", "event_type", "n", "rk"), "window_start", "window_end")


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR")
def stream_interval_join(spark, d):
    side = lambda kind, p: fed(spark, d).withWatermark("ts", "0 seconds").filter(f"event_type = '{kind}'").select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"))
    joined = R.interval_join(side("click", "left"), side("view", "right"), [("left_user", "right_user")], "left_ts", "right_ts", "2 hours", "2 hours")
    return collected(spark, joined.select("left_id", "right_id"))


@query("SELECT CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS part, count(*) AS n FROM events GROUP BY 1")
def stream_side_outputs(spark, d):
    path = scratch(spark)
    routed = R.route(fed(spark, d, last=False).select("event_type"), {"A": F.col("event_type") == "click"}, rest="B")
    written(spark, routed, K.side_outputs("route", {"A": lambda df, k: df.write.parquet(f"{path}/part=A/b={k}"), "B": lambda df, k: df.write.parquet(f"{path}/part=B/b={k}")}))
    return spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 'on' AS mode FROM events")
def t13_broadcast_state(spark, d):
    path = scratch(spark)
    control = lambda: S.from_elements(spark, "on", name="mode")
    written(spark, fed(spark, d, last=False).select("event_id"), T.control_batches(control, "off", to_files(path)))
    return spark.read.parquet(path).select("event_id", "mode")


LATE_COUNTS = "SELECT window_start, count(*) AS n FROM (SELECT (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 3600000 AS window_start FROM events) GROUP BY window_start"


@query(LATE_COUNTS)
def m9_allowed_lateness(spark, d):
    """Every window is counted once in the end: the last emission of a window is its total."""
    path = scratch(spark)
    stream = fed(spark, d).select(F.unix_millis("ts").alias("t"))
    late = T.LateData(f"{path}/state", "t", [], 3_600_000, 2000, 4000, to_files(f"{path}/out"), to_files(f"{path}/late"))
    written(spark, stream, late)
    got = spark.read.parquet(f"{path}/out").groupBy("window_start").agg(F.max_by("n", "batch").alias("n"))
    return got.filter("window_start < 4000000000000")


MS = "(epoch_us(ts) // 1000)"
HOUR_END = f"({MS} - {MS} % 3600000 + 3600000)"


def arrivals(spark, d, *parts: str) -> DataFrame:
    """events (event_id, event_type, t) as a stream, a part a micro-batch; a part is a condition on its rows."""
    path = scratch(spark)
    e = events(spark, d).select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    for k, part in enumerate(parts):
        e.filter(part).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def late_rows(spark, stream: DataFrame, marks, lateness: int = 0) -> DataFrame:
    path = scratch(spark)
    written(spark, stream, T.LateData(f"{path}/state", "t", [], 3_600_000, 0, lateness, to_files(f"{path}/out"), to_files(f"{path}/late"), marks))
    return spark.read.parquet(f"{path}/late").select("event_id")


VIEWS_LAST = ("event_type IS DISTINCT FROM 'view'", "event_type = 'view'")


@query(f"SELECT event_id FROM events WHERE event_type = 'view' AND {HOUR_END} + 86400000 <= (SELECT max({MS}) FROM events WHERE event_type IS DISTINCT FROM 'view')")
def m10_late_side_output(spark, d):
    """Views come after all the other rows; those whose hour ended a day before are late and go to the side output."""
    return late_rows(spark, arrivals(spark, d, *VIEWS_LAST), T.Watermarks(T.latest("t")), 86_400_000)


@query(f"SELECT event_id FROM events WHERE event_type = 'view' AND {HOUR_END} <= (SELECT max({MS}) - 2000 + 1 FROM events WHERE event_type IS DISTINCT FROM 'view')")
def m4_own_watermark(spark, d):
    """A generator of its own, two seconds behind and exact to the millisecond, decides what is late."""
    return late_rows(spark, arrivals(spark, d, *VIEWS_LAST), T.Watermarks(T.to_the_millisecond("t", 2000)))


@query(f"SELECT event_id FROM events WHERE event_type = 'view' AND {HOUR_END} <= (SELECT max({MS}) + 1 FROM events WHERE event_type = 'click')")
def m5_marked_watermark(spark, d):
    """Only clicks move the watermark; views come last."""
    return late_rows(spark, arrivals(spark, d, *VIEWS_LAST), T.Watermarks(T.marked("t", F.col("event_type") == "click")))


HALF = f"(SELECT min({MS}) + (max({MS}) - min({MS})) // 2 FROM events)"


@query(f"""WITH e AS (SELECT {MS} AS t, {MS} - {MS} % 3600000 AS window_start, {HALF} AS half FROM events), w AS (SELECT window_start, count(*) AS n FROM e GROUP BY window_start)
SELECT 'min' AS policy, window_start, n FROM w WHERE window_start + 3600000 <= (SELECT max(t) FROM e WHERE t < half)
UNION ALL SELECT 'idle', window_start, n FROM w WHERE window_start + 3600000 <= (SELECT max(t) FROM e)""")
def m8_idle_input(spark, d):
    """Two inputs: one gives the first half of the time and falls silent, the other gives the rest. The least of their
    watermarks stays where the first one stopped; with idleness it goes on after fifteen seconds of the clock."""
    lo, hi = events(spark, d).agg(*(F.unix_millis(f("ts").cast("timestamp")) for f in (F.min, F.max))).first()
    lo, hi = lo or 0, hi or 0
    half, late = lo + (hi - lo) // 2, hi - (hi - lo) // 4
    out = None
    for policy, idle in (("min", None), ("idle", 15_000)):
        path, now = scratch(spark), iter(range(0, 1 << 40, 10_000))
        stream = arrivals(spark, d, f"t < {half}", f"t >= {half} AND t < {late}", f"t >= {late}").withColumn("input", F.when(F.col("t") < half, "a").otherwise("b"))
        marks = T.Watermarks(T.latest("t"), "input", ("a", "b"), idle, lambda now=now: next(now))
        written(spark, stream, T.LateData(f"{path}/state", "t", [], 3_600_000, 0, 0, to_files(f"{path}/out"), to_files(f"{path}/late"), marks))
        closed = spark.read.parquet(f"{path}/out").select(F.lit(policy).alias("policy"), "window_start", "n")
        out = closed if out is None else out.union(closed)
    return out


@query(tumbled("1 HOUR", "event_type"))
def m0_assigned_times(spark, d):
    """Event time is assigned from a column of milliseconds; the interval at which watermarks come is the trigger's."""
    stream = fed(spark, d).select("event_type", F.unix_millis("ts").alias("ms"))
    got = collected(spark, T.window_counts(T.with_event_time(stream, "ms", delay="500 milliseconds"), "et", "1 hour", ["event_type"]))
    return ntz(got.filter("event_type <> 'end'"), "window_start", "window_end")


@query(f"SELECT event_id, epoch_ms({MS}) AS et FROM events")
def m3_no_watermark(spark, d):
    stream = fed(spark, d, last=False).select("event_id", F.unix_millis("ts").alias("ms"))
    return ntz(collected(spark, T.with_event_time(stream, "ms", delay=None).select("event_id", "et")), "et")


@query(tumbled("1 HOUR", "event_type").replace("event_type", "event_type AS id", 1))
def m6_ddl_watermark(spark, d):
    """The watermark and the event time are columns of a table's DDL."""
    path = scratch(spark)
    lines = fed(spark, d).select(F.col("event_type").alias("id"), F.unix_millis("ts").alias("ms"))
    collected_lines = lines.writeStream.format("csv").option("path", f"{path}/t").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    collected_lines.awaitTermination()
    r = Registry(spark)
    r.sql(f"CREATE TABLE t_wm (id STRING, ms BIGINT, et AS TO_TIMESTAMP_LTZ(ms, 3), WATERMARK FOR et AS et - INTERVAL '2' SECOND) WITH ('connector' = 'filesystem', 'path' = '{path}/t', 'format' = 'csv')")
    got = collected(spark, T.window_counts(r.read("t_wm", streaming=True), "et", "1 hour", ["id"]))
    return ntz(got.filter("id <> 'end'"), "window_start", "window_end")


@query("SELECT (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 3600000 AS window_start, count(*) AS cnt FROM events GROUP BY 1")
def m11_late_correction(spark, d):
    """Late rows (views, which come after a row far ahead) are windowed again and added to the stored counts."""
    path, state, url = scratch(spark), scratch(spark), derby()
    e = events(spark, d).select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    e.filter(VIEWS_LAST[0]).coalesce(1).write.parquet(f"{path}/0")
    spark.sql("SELECT -1L AS event_id, 'end' AS event_type, 4102444800000L AS t").coalesce(1).write.parquet(f"{path}/1")
    e.filter(VIEWS_LAST[1]).coalesce(1).write.parquet(f"{path}/2")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    c = K.jvm_jdbc.connect(spark, url, DERBY)
    K.jvm_jdbc.run(c, 'CREATE TABLE t_sink ("window_start" BIGINT PRIMARY KEY, "cnt" BIGINT)')
    c.close()
    store, add = K.Upsert(url, "t_sink", ["window_start"], **DERBY), K.Upsert(url, "t_sink", ["window_start"], ("cnt",), **DERBY)
    emit = lambda df, k: store(df.select("window_start", F.col("n").alias("cnt")), 2 * k)
    start = F.col("t") - F.pmod("t", F.lit(3_600_000))
    fix = lambda df, k: add(df.groupBy(start.alias("window_start")).agg(F.count(F.lit(1)).alias("cnt")), 2 * k + 1)
    written(spark, stream, T.LateData(f"{state}/state", "t", [], 3_600_000, 0, 5000, emit, fix))
    return S.jdbc(spark, url, "t_sink", **DERBY).filter("window_start < 4000000000000")


# ---- keyed state on streams

SENSOR_SQL = "SELECT CAST(user_id AS VARCHAR) AS id, CAST(floor(value) AS INTEGER) AS vc, (epoch_us(ts) // 1000) AS ts, event_id FROM events"


def sensor_stream(spark, d, last: bool = False) -> DataFrame:
    return fed(spark, d, last).select(F.col("user_id").cast("string").alias("id"), F.floor("value").cast("int").alias("vc"), F.unix_millis("ts").alias("ts"), F.col("ts").alias("et"))


@query(f"SELECT id, before, vc, ts FROM (SELECT *, lag(vc) OVER (PARTITION BY id ORDER BY ts) AS before FROM ({SENSOR_SQL})) WHERE abs(vc - before) > 10")
def t14_stream_jump_alarm(spark, d):
    return collected(spark, P.keyed(sensor_stream(spark, d), ["id"], P.JumpAlarm(), P.JumpAlarm.SCHEMA))


@query(f"SELECT id, ts, array_to_string(list_slice(list_reverse_sort(list(vc) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING)), 1, 3), ',') AS top FROM ({SENSOR_SQL})")
def t15_stream_top3(spark, d):
    got = collected(spark, P.keyed(sensor_stream(spark, d), ["id"], P.TopValues(), P.TopValues.SCHEMA))
    return got.select("id", "ts", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


@query(f"SELECT id, vc, min(ts) AS ts FROM ({SENSOR_SQL}) GROUP BY id, vc")
def t16_stream_distinct(spark, d):
    return collected(spark, P.keyed(sensor_stream(spark, d), ["id"], P.DistinctValues(), P.DistinctValues.SCHEMA))


@query(f"SELECT id, ts, CAST(sum(vc) OVER w AS BIGINT) AS total, count(*) OVER w AS n, round(avg(vc) OVER w, 6) AS mean FROM ({SENSOR_SQL}) WINDOW w AS (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def t18_stream_running(spark, d):
    got = collected(spark, P.keyed(sensor_stream(spark, d), ["id"], P.RunningAggregate(), P.RunningAggregate.SCHEMA))
    return got.withColumn("mean", F.round("mean", 6))


@query(f"""WITH s AS (SELECT *, ts >= {HALF} AS later FROM ({SENSOR_SQL}))
SELECT 'kept' AS state, id, ts, CAST(sum(vc) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s
UNION ALL SELECT 'expired', id, ts, CAST(sum(vc) OVER (PARTITION BY id, later ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) FROM s""")
def t19_stream_ttl(spark, d):
    """The second half of the events comes a second after the first. With an hour to live nothing is forgotten, with
    half a second all totals of the first half are."""
    out = None
    for state, ttl in (("kept", 3_600_000), ("expired", 500)):
        path, where = scratch(spark), scratch(spark)
        e = sensors(spark, d).select("id", "vc", "ts")
        half = e.agg((F.min("ts") + F.expr("(max(ts) - min(ts)) div 2")).alias("half"))
        e = e.join(F.broadcast(half), F.lit(True), "left")
        schema = "id string, vc int, ts bigint"
        for k, part in enumerate((F.col("ts") < F.col("half"), F.col("ts") >= F.col("half"))):
            e.filter(part).select("id", "vc", "ts").coalesce(1).write.parquet(f"{path}/{k}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")

        def slow(df, k, where=where):
            df.write.mode("overwrite").parquet(f"{where}/{k}")
            time.sleep(1)

        with T.no_idle_batches(spark):
            written(spark, P.keyed(stream, ["id"], P.ExpiringTotal(ttl), P.ExpiringTotal.SCHEMA, time="processingtime"), slow)
        got = spark.read.parquet(f"{where}/*").select(F.lit(state).alias("state"), "id", "ts", "total")
        out = got if out is None else out.union(got)
    return out


@query(f"SELECT DISTINCT id, ts + 5000 AS at FROM ({SENSOR_SQL})")
def t20_stream_timers(spark, d):
    stream = sensor_stream(spark, d, last=True).withWatermark("et", "0 seconds")
    got = collected(spark, P.keyed(stream, ["id"], P.Reminder(5000), P.Reminder.SCHEMA, time="eventtime"))
    return got.filter("id <> '-1'")


@query(f"SELECT DISTINCT id, true AS after_the_row FROM ({SENSOR_SQL})")
def t21_processing_timers(spark, d):
    """Timers of the clock: registered with each row, they have fired by the time of a later batch. Their times differ
    from run to run, so the result is which keys had one, and that it was not before the run began."""
    began = int(time.time() * 1000)
    got = collected(spark, P.keyed(sensor_stream(spark, d, last=True), ["id"], P.Reminder(1, processing=True), P.Reminder.SCHEMA, time="processingtime"), clock=True)
    return got.filter("id <> '-1'").select("id", (F.col("at") > began).alias("after_the_row")).distinct()


@query(f"SELECT id, (k - 1) // 3 AS window_no, CAST(sum(vc) AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS k FROM ({SENSOR_SQL})) GROUP BY id, (k - 1) // 3 HAVING count(*) = 3")
def w9_stream_count_window(spark, d):
    return collected(spark, P.keyed(sensor_stream(spark, d), ["id"], P.CountWindow(3), P.CountWindow.SCHEMA))


@query("SELECT CAST(event_id AS VARCHAR) AS order_id, CASE WHEN event_id % 3 = 0 THEN 'matched' WHEN event_id % 3 = 1 THEN 'third missing' ELSE 'app missing' END AS result FROM events")
def t12_stream_bill_check(spark, d):
    """Each event is an order: a third has both sides two seconds apart, a third only one of them each."""
    e = fed(spark, d).withWatermark("ts", "0 seconds").filter("event_id >= 0 OR event_type = 'end'")
    order = F.col("event_id").cast("string")
    a = F.struct(F.lit("app").alias("side"), F.unix_millis("ts").alias("ts"))
    b = F.struct(F.lit("third").alias("side"), (F.unix_millis("ts") + 2000).alias("ts"))
    sides = F.when(F.col("event_id") % 3 == 0, F.array(a, b)).when(F.col("event_id") % 3 == 1, F.array(a)).otherwise(F.array(b))
    rows = e.select(order.alias("order_id"), F.col("ts").alias("et"), F.explode(sides).alias("s")).select("order_id", "et", "s.side", "s.ts")
    got = collected(spark, P.keyed(rows, ["order_id"], P.BillCheck(), P.BillCheck.SCHEMA, time="eventtime"))
    return got.filter("order_id <> '-1'").select("order_id", "result")
