"""Hand-made cases with known results."""

import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace import sources as S
from millrace import streaming as T
from millrace.ddl import Registry, parse_table
from millrace.operators import relational as R
from millrace.operators import windows as W
from millrace.session import Checkpointing, arguments, is_streaming, supervise
from millrace.sources import sinks as K
from millrace.streaming import processors as P

# user, url, ts of a small click log, out of order
CLICKS = [
    ("Zhangsan", "/home", 1000), ("Lisi", "/cart", 2000), ("Tom", "/cart", 3000), ("Lisi", "/home", 10000), ("Zhangsan", "/home", 4000),
    ("Zhangsan", "/home", 12000), ("Tom", "/cart", 10001), ("Lisi", "/cart", 10000),
]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def timed(spark, data, names="id, v, ts"):
    return spark.createDataFrame(data, "id string, v int, ts bigint").withColumn("et", F.timestamp_millis("ts"))


def test_word_count_drops_trailing_blanks(spark):
    df = spark.createDataFrame([("a b a",), ("b  ",), ("",), (None,)], "value string")
    assert rows(R.word_count(df)) == [("a", 2), ("b", 2)]


def test_windows_and_top_n(spark):
    df = S.from_collection(spark, CLICKS, S.EVENT).withColumn("et", F.timestamp_millis("ts"))
    g = W.grouped(df, F.window("et", "10 seconds"), "et", ["url"], [F.count(F.lit(1)).alias("n")])
    g = g.withColumn("window_start", F.unix_millis("window_start"))
    assert rows(g.select("window_start", "url", "n")) == [(0, "/cart", 2), (0, "/home", 2), (10000, "/cart", 2), (10000, "/home", 2)]
    top = R.top_n(g, ["window_start"], [F.col("n").desc(), "url"], 1)
    assert rows(top.select("window_start", "url")) == [(0, "/cart"), (10000, "/cart")]
    last = R.max_by_record(df.drop("et"), ["user"], ["ts", "url"])
    assert rows(last) == [("Lisi", "/home", 10000), ("Tom", "/cart", 10001), ("Zhangsan", "/home", 12000)]


def test_session_gap_of_exactly_the_gap_merges(spark):
    df = timed(spark, [("s", 1, 0), ("s", 1, 5000), ("s", 1, 10001)])
    got = W.session(df, "et", "5 seconds", ["id"], [F.count(F.lit(1)).alias("n")])
    assert rows(got.select(F.unix_millis("window_start"), F.unix_millis("window_end"), "n")) == [(0, 10000, 2), (10001, 15001, 1)]


def test_over_range_is_inclusive(spark):
    df = timed(spark, [("s1", 100, 1000), ("s1", 50, 3000), ("s1", 7, 5000), ("s1", 9, 15000)])
    got = df.select("ts", W.over_interval("sum(v)", ["id"], "et", "'2' SECOND").alias("s"))
    assert rows(got) == [(1000, 100), (3000, 150), (5000, 57), (15000, 9)]


def test_count_slides_differ_in_their_first_window(spark):
    df = timed(spark, [("s", k, k) for k in range(1, 7)])
    total = {"s": F.sum("v")}
    assert rows(W.count_slide(df, ["id"], ["ts"], 3, 2, total)) == [("s", 2, 3), ("s", 4, 9), ("s", 6, 15)]
    assert rows(W.count_slide(df, ["id"], ["ts"], 3, 2, total, full=True)) == [("s", 3, 6), ("s", 5, 12)]


def test_count_windows_over_all_rows_take_no_single_task(spark):
    ids = [(k * 7919) % 5000 for k in range(5000)]
    df = spark.createDataFrame([(k, k % 13) for k in ids] + [(None, 1)], "id int, v int").repartition(6)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order, values in ((F.col("id"), [1] + [k % 13 for k in range(5000)]), (F.col("id").desc(), [k % 13 for k in range(4999, -1, -1)] + [1])):
            got = rows(W.count_tumble(df, [], [order], 4, [F.sum("v").alias("total")]).select("window_no", "total"))
            assert got == [(k, sum(values[4 * k : 4 * k + 4])) for k in range(1250)]
        most = W._numbered(df, [], ["id"]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert most < 5001
    assert W.count_tumble(df.limit(0), [], ["id"], 4, [F.sum("v").alias("total")]).count() == 0


def test_cumulate_adds_up_to_tumble(spark):
    df = timed(spark, [("s", 1, t) for t in (0, 1999, 2000, 9999)])
    got = W.cumulate(df, "et", "2 seconds", "10 seconds", 5).groupBy("window_end").count()
    assert [r[1] for r in sorted(got.collect())] == [2, 3, 3, 3, 4]


@pytest.mark.parametrize("values,expected", [([5, 5, 3], [(1, 5), (2, 5)]), ([5], [(1, 5)]), ([None], [])])
def test_top2(spark, values, expected):
    df = spark.createDataFrame([(7, v) for v in values], "k bigint, v bigint")
    assert rows(fn.top2(df, "k", "v").select("rank", "v")) == expected
    fn.register(spark)
    df.createOrReplaceTempView("t_top2")
    assert rows(spark.sql("SELECT key, rank, value FROM top2_values(TABLE(t_top2) PARTITION BY k)")) == [(7, *x) for x in expected]


def test_interval_and_window_join_edges(spark):
    a = spark.createDataFrame([("k", 9999)], "ka string, ta bigint").withColumn("ea", F.timestamp_millis("ta"))
    b = spark.createDataFrame([("k", 7999), ("k", 11999), ("k", 12000), ("k", 10000)], "kb string, tb bigint").withColumn("eb", F.timestamp_millis("tb"))
    j = R.interval_join(a, b, [("ka", "kb")], "ea", "eb", "2 seconds", "2 seconds")
    assert rows(j.select("tb")) == [(7999,), (10000,), (11999,)]
    assert rows(R.interval_join(a, b, [("ka", "kb")], "ea", "eb", "2 seconds", "2 seconds", inclusive=False).select("tb")) == [(10000,)]
    assert rows(R.window_join(a, b, [("ka", "kb")], "ea", "eb", "10 seconds").select("tb")) == [(7999,)]


def test_csv_lines_fail_on_bad_rows(spark):
    df = spark.createDataFrame([("s1, 100, 1000",), (" s2,7,2000 ",)], "value string")
    assert rows(S.parse_csv_lines(df, S.SENSOR)) == [("s1", 100, 1000), ("s2", 7, 2000)]
    with pytest.raises(Exception):
        S.parse_csv_lines(spark.createDataFrame([("s1,x,1",)], "value string"), S.SENSOR).collect()


def test_udfs(spark):
    fn.register(spark)
    assert rows(spark.sql("SELECT my_upper(x) FROM VALUES ('ab'), (NULL) t(x)").na.fill("-")) == [("-",), ("AB",)]
    assert rows(spark.sql("SELECT * FROM split_words('hello-world-nihaoa--', '-')")) == [("hello", 5), ("nihaoa", 6), ("world", 5)]
    assert spark.sql("SELECT my_avg(x) FROM VALUES (1), (2), (NULL) t(x)").first()[0] == 1.5


def test_custom_partitioner(spark):
    df = S.from_elements(spark, "Tom", "Jerry", "Lisi", "Zhangsan", name="user")
    dealt = R.partition_by_id(df, 2, F.when(F.col("user").isin("Tom", "Jerry"), 0).otherwise(1))
    assert rows(dealt.select(F.spark_partition_id(), "user")) == [(0, "Jerry"), (0, "Tom"), (1, "Lisi"), (1, "Zhangsan")]


def test_route_null_goes_to_the_rest(spark):
    df = S.from_elements(spark, "Tom", None, "Lisi", name="user")
    assert rows(R.route(df, {"tom": F.col("user") == "Tom"}).na.fill("-").select("user", "route")) == [("-", "main"), ("Lisi", "main"), ("Tom", "tom")]


def test_changelog(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("w", 9)], "k string, n int")
    assert rows(K.changelog(a, b, ["k"])) == [("+I", "w", 9), ("+U", "y", 5), ("-D", "z", 3), ("-U", "y", 2)]


def test_all_rows_come_through_the_custom_sink(spark, sf, monkeypatch):
    from millrace.plans import streams

    class Loses(K.RowWriter):
        def process(self, row):
            if row.event_id < 200:
                self.invoke(row)

    query = streams.k13_custom_sink
    assert query(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count() > 200
    monkeypatch.setattr(streams.K, "RowWriter", Loses)
    assert query(spark, sf).count() == 200


def test_every_event_is_fed_once(spark, sf, tmp_path):
    from millrace.plans import streams

    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_id < 90")
    odd = e.withColumn("event_id", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("event_id") * 1000)).withColumn("ts", F.when(F.col("event_id") % 5000 != 0, F.col("ts")))
    odd.union(odd.limit(7)).write.parquet(f"{tmp_path}/a/events.parquet")
    odd.withColumn("ts", F.lit(None).cast(e.schema["ts"].dataType)).write.parquet(f"{tmp_path}/b/events.parquet")
    for d in ("a", "b"):
        given = spark.read.parquet(f"{tmp_path}/{d}/events.parquet").select("event_id", "user_id")
        got = streams.collected(spark, streams.fed(spark, f"{tmp_path}/{d}", last=False).select("event_id", "user_id"))
        assert got.count() == given.count() and not got.exceptAll(given).count()


def test_processors_run_in_any_session(spark, tmp_path):
    """Sessions that name no state store get Spark's default, which can't hold a processor's states."""
    from millrace.session import BACKEND, BACKENDS, PROVIDER

    spark.createDataFrame([("s", 100, 1), ("s", 116, 3)], "id string, vc int, ts bigint").write.parquet(f"{tmp_path}/in")
    stream = P.keyed(spark.readStream.schema("id string, vc int, ts bigint").parquet(f"{tmp_path}/in"), ["id"], P.JumpAlarm(10), P.JumpAlarm.SCHEMA)
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, BACKEND)}
    try:
        spark.conf.set(PROVIDER, BACKENDS["heap"])
        spark.conf.unset(BACKEND)
        assert rows(T.bounded(spark, stream, f"{tmp_path}/out", f"{tmp_path}/cp")) == [("s", 100, 116, 3)]
        assert spark.conf.get(PROVIDER) == BACKENDS["heap"]
        spark.conf.set(BACKEND, "heap")
        with pytest.raises(ValueError):
            T.bounded(spark, stream, f"{tmp_path}/out2", f"{tmp_path}/cp2")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_query_that_starts_anew_is_added_again(spark):
    """A replayed batch is not added twice; batch 0 of another query is."""
    from millrace.plans.streams import DERBY, derby

    url = derby()
    c = K.jvm_jdbc.connect(spark, url, DERBY)
    K.jvm_jdbc.run(c, 'CREATE TABLE t_sink ("k" BIGINT PRIMARY KEY, "n" BIGINT)')
    c.close()
    df = spark.createDataFrame([(1, 5)], "k bigint, n bigint")
    for run in ("a", "a", "b"):
        K.Upsert(url, "t_sink", ["k"], ("n",), run=run, **DERBY)(df, 0)
    assert rows(S.jdbc(spark, url, "t_sink", **DERBY)) == [(1, 10)]


def test_upserts_of_two_queries_and_a_restart(spark, tmp_path):
    from millrace.plans.streams import DERBY, derby

    url = derby()
    c = K.jvm_jdbc.connect(spark, url, DERBY)
    K.jvm_jdbc.run(c, 'CREATE TABLE t_sink ("k" BIGINT PRIMARY KEY, "n" BIGINT)')
    c.close()
    spark.createDataFrame([(1, 5)], "k bigint, n bigint").write.parquet(f"{tmp_path}/in")
    up = K.Upsert(url, "t_sink", ["k"], ("n",), **DERBY)
    for cp in ("a", "a", "b"):  # the second run finds nothing new, the third reads all again
        stream = spark.readStream.schema("k bigint, n bigint").parquet(f"{tmp_path}/in")
        Checkpointing(f"{tmp_path}/{cp}", interval=None).start(stream, each_batch=lambda df, k: [up(df, k), up(df, k)]).awaitTermination()
    assert rows(S.jdbc(spark, url, "t_sink", **DERBY)) == [(1, 10)]


def test_late_data_keeps_two_batches_of_state(spark, tmp_path):
    op = T.LateData(str(tmp_path / "s"), "t", [], 10, 0, 0, lambda df, k: df.count(), lambda df, k: df.count())
    for k in range(5):
        op(spark.createDataFrame([(k * 7,), (None,)], "t bigint"), k)
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["3", "4"]
    out = []
    op.emit = lambda df, k: out.extend(r.window_start for r in df.collect())
    for _ in range(2):  # a replay gives the same rows
        op(spark.createDataFrame([(100,)], "t bigint"), 5)
    assert out == [20, 20]


def test_watermarks(spark):
    of = lambda *rows_: spark.createDataFrame(list(rows_), "t bigint, kind string, at int, input string")
    one = of((5, "x", 1, "a"), (3, "m", 2, "a"), (None, "m", 3, "a"))
    for column, want in ((T.latest("t", 2), 3), (T.to_the_millisecond("t", 2), 4), (T.marked("t", F.col("kind") == "m"), 4), (T.last_seen("t", "at"), None)):
        assert T.Watermarks(column).advance(one, None)[None][0] == want
    now = iter([0, 10, 20, 30])
    marks, state, seen = T.Watermarks(T.latest("t"), "input", ("a", "b"), 15, lambda: next(now)), None, []
    for batch in (of((5, "", 0, "a")), of((9, "", 0, "b"), (99, "", 0, "c"), (99, "", 0, None)), of((20, "", 0, "b")), of()):
        state = marks.advance(batch, state)
        seen.append(state[None][0])
    assert seen == [None, 5, 20, 20]  # b has given nothing; then the least; a is idle; never back


def test_topic_readers_see_committed_records(spark, tmp_path):
    t = K.Topic(str(tmp_path))
    t(spark.range(3), 0)
    t(spark.range(3), 0)
    spark.range(9).write.parquet(f"{tmp_path}/records/run=x/batch=7")
    assert t.read(spark).count() == 3 and t.read(spark, committed=False).count() == 12


def test_running_top_holds_n_values(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 9), ("a", 4, 7), ("b", 1, 1), (None, 1, 2), (None, 2, 3)], "k string, i int, v int")
    got = R.running_top(df, ["k"], ["i"], "v", 2)
    assert sorted((str(r.k), r.i, r.top) for r in got.collect()) == [("None", 1, [2]), ("None", 2, [3, 2]), ("a", 1, [5]), ("a", 2, [5]), ("a", 3, [9, 5]), ("a", 4, [9, 7]), ("b", 1, [1])]
    assert R.running_top(df.limit(0), ["k"], ["i"], "v", 2).count() == 0


def test_ddl_parts():
    t = parse_table("""CREATE TABLE t1 (id STRING, vc INT, ts BIGINT, pt AS PROCTIME(), et AS TO_TIMESTAMP_LTZ(ts, 3),
      fs BIGINT METADATA FROM 'file.size', WATERMARK FOR et AS et - INTERVAL '2' SECOND, PRIMARY KEY (id) NOT ENFORCED)
      WITH ('connector' = 'filesystem', 'path' = '/x', 'format' = 'csv')""")
    assert [n for n, _ in t.physical] == ["id", "vc", "ts"] and [n for n, _ in t.computed] == ["pt", "et"]
    assert t.facts == [("fs", "BIGINT", "file.size")] and t.watermark == ("et", "2 SECOND") and t.key == ["id"]
    assert parse_table("SELECT 1") is None


def test_ddl_catalogs_and_print(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("s1,100,1000\ns2,7,2000\n")
    r = Registry(spark)
    r.use("cat.db")
    r.sql(f"CREATE TABLE t1 (id STRING, vc INT, ts BIGINT, et AS TO_TIMESTAMP_LTZ(ts, 3)) WITH ('connector'='filesystem', 'path'='{tmp_path}', 'format'='csv')")
    r.sql("CREATE TABLE p (id STRING, vc INT) WITH ('connector'='print', 'print-identifier'='P')")
    assert r.list_tables() == ["p", "t1"]
    assert rows(r.sql("SELECT id, vc FROM t1 WHERE vc >= 100")) == [("s1", 100)]
    r.sql("INSERT INTO p SELECT id, vc FROM t1 WHERE vc < 100")
    assert capsys.readouterr().out == "P> ('s2', 7)\n"
    assert r.read("t1").filter("id = 's1'").first()["et"] == datetime(1970, 1, 1, 0, 0, 1)


def test_settings():
    assert arguments(["--hostname", "h", "--port", "9"]).port == 9
    assert is_streaming("automatic", False) and not is_streaming("automatic", True) and is_streaming("streaming", True)
    with pytest.raises(ValueError):
        is_streaming("batch", False)


def test_supervisor_restarts_from_the_checkpoint(spark, tmp_path):
    """A sink that fails once: the restarted query goes on with the batch that failed, nothing is lost or doubled."""
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    failed = []

    def sink(df, k):
        if k == 1 and not failed:
            failed.append(k)
            raise RuntimeError("x")
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={k}")

    def start():
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return Checkpointing(f"{tmp_path}/cp", interval=None).start(stream, each_batch=sink)

    assert supervise(start, attempts=3, delay=0.1) == 1 and failed == [1]
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count("id"), F.sum("id")).first()[:] == (30, 435)


def test_state_survives_a_restart(spark, tmp_path):
    schema = "id string, vc int, ts bigint"

    def run(batch, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
        stream = P.keyed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), ["id"], P.RunningAggregate(), P.RunningAggregate.SCHEMA)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    run(0, [("s", 5, 1), ("s", 6, 2)])
    run(1, [("s", 10, 3)])
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("ts", "total")) == [(1, 5), (2, 11), (3, 21)]


def test_jump_alarm(spark, tmp_path):
    spark.createDataFrame([("s", 100, 1), ("s", 105, 2), ("s", 116, 3)], "id string, vc int, ts bigint").write.parquet(f"{tmp_path}/in")
    stream = P.keyed(spark.readStream.schema("id string, vc int, ts bigint").parquet(f"{tmp_path}/in"), ["id"], P.JumpAlarm(10), P.JumpAlarm.SCHEMA)
    assert rows(T.bounded(spark, stream, f"{tmp_path}/out", f"{tmp_path}/cp")) == [("s", 105, 116, 3)]


def test_state_expires(spark, tmp_path):
    schema = "id string, vc int, ts bigint"
    got = []
    for k in range(2):
        spark.createDataFrame([("s", 1, k)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = P.keyed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), ["id"], P.ExpiringTotal(1000), P.ExpiringTotal.SCHEMA, time="processingtime")
        got.append([r.total for r in T.bounded(spark, stream, f"{tmp_path}/out{k}", f"{tmp_path}/cp{k}", clock=True).collect()])
        time.sleep(1)
    assert got[0] == [1] and sorted(got[1]) == [1, 2]


def test_lookup_is_read_again_after_its_ttl(spark):
    now, reads = [0.0], []

    def read():
        reads.append(1)
        return spark.range(1)

    look = S.Lookup(read, ttl=20, clock=lambda: now[0])
    look(), look()
    now[0] = 25
    look()
    assert len(reads) == 2


def test_socket_source(spark, tmp_path):
    import socket

    server = socket.socket()
    server.bind(("127.0.0.1", 0))
    server.listen()
    stop = threading.Event()

    def serve():
        c, _ = server.accept()
        c.sendall(b"a b\nb\n")
        stop.wait(20)
        c.close()

    threading.Thread(target=serve, daemon=True).start()
    stream = R.word_count(S.socket_text(spark, "127.0.0.1", server.getsockname()[1]))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("socket_words").start()
    try:
        for _ in range(100):
            q.processAllAvailable()
            if spark.table("socket_words").count() == 2:
                break
            time.sleep(0.2)
        assert rows(spark.table("socket_words")) == [("a", 1), ("b", 2)]
    finally:
        q.stop()
        stop.set()
        server.close()


def test_datagen_stream_and_batch_agree(spark):
    one = S.datagen(spark, "id STRING, vc INT", **{"number-of-rows": 10, "partitions": 1, "fields.id.length": 4})
    two = S.datagen(spark, "id STRING, vc INT", **{"number-of-rows": 10, "partitions": 3, "fields.id.length": 4})
    assert rows(one) == rows(two) and len(rows(one)) == 10


def test_upsert_statements():
    up = K.Upsert("jdbc:mysql://h/d", "t", ["k"], ("n",), dialect="mysql")
    assert up.statement(["k", "n", "u"], "s") == "INSERT INTO t (`k`, `n`, `u`) SELECT `k`, `n`, `u` FROM s ON DUPLICATE KEY UPDATE `n` = `n` + VALUES(`n`), `u` = VALUES(`u`)"


def test_late_data_in_hand_made_batches(spark, tmp_path):
    out, late = [], []
    op = T.LateData(str(tmp_path), "t", [], 10_000, 0, 5000, lambda df, k: out.extend((k, *r) for r in df.collect()), lambda df, k: late.extend(r.t for r in df.collect()))
    for k, ts in enumerate([[1000, 9000], [12000], [2000], [16000], [3000]]):
        op(spark.createDataFrame([(t,) for t in ts], "t bigint"), k)
    # closed by 12000, changed by the late 2000, gone once the watermark is past 15000
    assert out == [(1, 0, 10000, 2), (2, 0, 10000, 3)] and late == [3000]
