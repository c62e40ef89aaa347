"""Environment, run modes, catalogs, fault tolerance and operator state as queries: each runs what it is about and gives rows that say so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace import sources as S
from millrace import streaming as T
from millrace.ddl import Registry
from millrace.operators import relational as R
from millrace.plans.base import events, query, scratch
from millrace.plans.streams import collected, fed, heard, printed, to_files, written
from millrace.session import BACKENDS, PROVIDER, Checkpointing, Settings, arguments, conf_of, is_streaming, supervise
from millrace.sources import sinks as K
from millrace.sources import table

# ---- fault tolerance and operator state


@query("SELECT event_id, 1 AS listed, 3 AS with_union FROM events")
def t10_operator_lists(spark, d):
    """Two subtasks list the events; after a restart with three subtasks each element is in one list, or, united, in all three."""
    path = scratch(spark)
    written(spark, fed(spark, d, last=False).select("event_id"), T.ListState(path, 2))
    both = [T.ListState.lists(spark, path, 3, union).select("event_id", F.lit(union).alias("u")) for union in (False, True)]
    count = lambda u: F.sum((F.col("u") == u).cast("int")).cast("int")
    return both[0].union(both[1]).groupBy("event_id").agg(count(False).alias("listed"), count(True).alias("with_union"))


@query("SELECT range AS subtask, count(*) AS n, count(DISTINCT event_id) AS elements FROM events, range(0, 3) GROUP BY range")
def t11_union_lists(spark, d):
    """Union redistribution: every subtask starts with the lists of all."""
    path = scratch(spark)
    written(spark, fed(spark, d, last=False).select("event_id"), T.ListState(path, 2))
    got = T.ListState.lists(spark, path, 3, union=True)
    return got.groupBy(F.col("subtask").cast("bigint").alias("subtask")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("elements"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS run FROM events")
def t23_checkpoint(spark, d):
    """A query that is stopped, and started again over its checkpoint when views have come, goes on after what it has read."""
    path = scratch(spark)
    e = events(spark, d).select("event_id", "event_type")
    for run, part in enumerate(("event_type IS DISTINCT FROM 'view'", "event_type = 'view'")):
        e.filter(part).write.parquet(f"{path}/in/{run}")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/in/*")
        writer = lambda df, k, run=run: df.write.mode("overwrite").parquet(f"{path}/out/run={run}/b={k}")
        Checkpointing(f"{path}/cp", interval=None, query_name=f"checkpointed{run}").start(stream, each_batch=writer).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "run")


@query("SELECT backend, user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), (VALUES ('heap'), ('rocksdb')) b(backend)")
def t24_state_backends(spark, d):
    """The same aggregate with its state in either store."""
    before, out = spark.conf.get(PROVIDER), None
    try:
        for name, provider in sorted(BACKENDS.items()):
            spark.conf.set(PROVIDER, provider)
            got = collected(spark, fed(spark, d, last=False).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "complete")
            got = got.select(F.lit(name).alias("backend"), "user_id", "n")
            out = got if out is None else out.union(got)
    finally:
        spark.conf.set(PROVIDER, before)
    return out


class FailsOnce:
    """A foreachBatch function whose second batch fails after it has written, the first time that it runs."""

    def __init__(self, write, batch: int = 1):
        self.write, self.batch, self.failed = write, batch, False

    def __call__(self, df: DataFrame, batch: int) -> None:
        self.write(df, batch)
        if batch == self.batch and not self.failed:
            self.failed = True
            raise RuntimeError("failure for the test of recovery")


def restarted(spark, stream: DataFrame, write) -> int:
    cp, sink = scratch(spark), FailsOnce(write)
    return supervise(lambda: Checkpointing(cp, interval=None).start(stream, each_batch=sink), attempts=3, delay=0.1)


@query("SELECT event_id, 1 AS restarts FROM events")
def t25_restart(spark, d):
    """The sink fails once; the query starts again after a fixed delay, and no row is lost or doubled."""
    path = scratch(spark)
    n = restarted(spark, fed(spark, d, last=False).select("event_id"), to_files(path))
    return spark.read.parquet(f"{path}/*").select("event_id", F.lit(n).alias("restarts"))


@query("SELECT event_id, upper(event_type) AS label FROM events")
def t26_exactly_once(spark, d):
    """Topic to topic: the first one's committed records go to the second, whose writer fails once after its records are
    written, and a broken transaction of another writer leaves records without a commit. Readers see each event once."""
    first, second = K.Topic(scratch(spark)), K.Topic(scratch(spark))
    restarted(spark, fed(spark, d, last=False).select("event_id", "event_type"), first)
    path = scratch(spark)
    first.read(spark).write.partitionBy("event_type").parquet(path)
    stream = spark.readStream.schema("event_id BIGINT, event_type STRING").option("maxFilesPerTrigger", 2).parquet(path)
    restarted(spark, stream.select("event_id", F.upper("event_type").alias("label")), second)
    second.read(spark).write.parquet(f"{second.path}/records/run=broken/batch=0")
    return second.read(spark).select("event_id", "label")


# ---- environment


def facts(spark, **of) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in of.items()], "name string, value string")


@query("SELECT * FROM (VALUES ('automatic', 'None'), ('local', 'local[2]'), ('remote', 'spark://host:7077')) t(name, value)")
def e1_environment(spark, d):
    """Where a session runs: what the launcher set, this machine, or a cluster by its address."""
    return facts(spark, **{k: Settings(master=m).master for k, m in (("automatic", None), ("local", "local[2]"), ("remote", "spark://host:7077"))})


@query("SELECT mode, event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), (VALUES ('batch'), ('streaming'), ('automatic')) m(mode)")
def e2_run_modes(spark, d):
    """One program in three modes; automatic runs bounded input as a batch."""
    out = None
    for mode in ("batch", "streaming", "automatic"):
        streams = is_streaming(mode, bounded=True)
        source = fed(spark, d, last=False) if streams else events(spark, d)
        counts = source.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        got = (collected(spark, counts, "complete") if streams else counts).select(F.lit(mode).alias("mode"), "event_type", "n")
        out = got if out is None else out.union(got)
    return out


@query("SELECT '3' AS of_the_session, 5 AS of_the_operator, count(*) AS n FROM events")
def e5_parallelism(spark, d):
    """Parallelism of a session by its settings, and of one operator by its own number."""
    own = events(spark, d).select("user_id").repartition(5).withColumn("task", F.spark_partition_id())
    dealt = own.groupBy("task").agg(F.count(F.lit(1)).alias("m")).agg(F.count(F.lit(1)).cast("int").alias("of_the_operator"), F.sum("m").alias("n"))
    return dealt.select(F.lit(conf_of(Settings(parallelism=3))["spark.sql.shuffle.partitions"]).alias("of_the_session"), "of_the_operator", "n")


@query("SELECT 'memory.shop' AS place, 'nations' AS name, n_name AS value FROM nation UNION ALL SELECT 'disk.archive', 'regions', r_name FROM region")
def e8_catalogs(spark, d):
    """Tables of two catalogs: used by short names inside one, by whole names across them, and listed."""
    path, r, out = scratch(spark), Registry(spark), None
    for place, name, source, column in (("memory.shop", "nations", "nation", "n_name"), ("disk.archive", "regions", "region", "r_name")):
        table(spark, d, source).select(column).write.csv(f"{path}/{name}")
        r.use(place)
        r.sql(f"CREATE TABLE {name} (value STRING) WITH ('connector' = 'filesystem', 'path' = '{path}/{name}', 'format' = 'csv')")
    for place in ("memory.shop", "disk.archive"):
        r.use(place)
        (name,) = r.list_tables()
        got = r.sql(f"SELECT '{place}' AS place, '{name}' AS name, value FROM {name}")
        r.use("")
        assert got.count() == r.sql(f"SELECT value FROM {place}.{name}").count()
        out = got if out is None else out.union(got)
    return out


@query("SELECT * FROM (VALUES ('hostname', 'h'), ('port', '9'), ('mode', 'batch')) t(name, value)")
def e9_arguments(spark, d):
    a = arguments(["--hostname", "h", "--port", "9", "--mode", "batch"])
    return facts(spark, hostname=a.hostname, port=a.port, mode=a.mode)


@query("SELECT * FROM (VALUES ('with a port', 'true 5678'), ('without', 'false')) t(name, value)")
def e10_web_ui(spark, d):
    shown = lambda c: " ".join(c[k] for k in ("spark.ui.enabled", "spark.ui.port") if k in c)
    return facts(spark, **{"with a port": shown(conf_of(Settings(ui_port=5678))), "without": shown(conf_of(Settings()))})


@query("SELECT 'ERROR' AS usual, 'level-WARN' AS set_by_hand")
def e12_log_level(spark, d):
    return spark.createDataFrame([(Settings().log_level, "level-" + Settings(log_level="WARN").log_level)], "usual string, set_by_hand string")


# ---- word count in its forms

WORDS = "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word"


def lines(df: DataFrame) -> DataFrame:
    return df.select(F.translate("text", "\n", " ").alias("text"))


def text_stream(spark, d) -> DataFrame:
    """documents as a stream; the table may be a file or a folder, and a streaming path has to be a folder or a pattern."""
    return spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")


@query(WORDS)
def e11_word_count_stream(spark, d):
    """The bounded input as a stream: the final count of each word."""
    return collected(spark, R.word_count(lines(text_stream(spark, d)), "text").filter("word <> ''"), "complete")


@query("SELECT n_name AS word, count(*) AS count FROM nation GROUP BY n_name")
def e11_word_count_socket(spark, d):
    """Unbounded: lines of a socket, whose host and port are arguments."""
    names = [r[0] for r in table(spark, d, "nation").select("n_name").collect()]  # the 25 nations
    return heard(spark, names, lambda x: R.word_count(x, "value"), "complete")


@query(f"SELECT mode, word, count FROM ({WORDS}), (VALUES ('batch'), ('automatic')) m(mode)")
def e11_word_count_modes(spark, d):
    out = None
    for mode in ("batch", "automatic"):
        source = text_stream(spark, d) if is_streaming(mode, bounded=True) else table(spark, d, "documents")
        got = R.word_count(lines(source), "text").filter("word <> ''").select(F.lit(mode).alias("mode"), "word", "count")
        out = got if out is None else out.union(got)
    return out


class Counter:
    """A function object."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return R.word_count(df, "text")


@query(f"SELECT form, word, count FROM ({WORDS}), (VALUES ('function'), ('lambda'), ('object')) f(form)")
def e11_word_count_forms(spark, d):
    """The counting step as a function, a lambda and an object of a class."""

    def count(df: DataFrame) -> DataFrame:
        return R.word_count(df, "text")

    docs, out = lines(table(spark, d, "documents")), None
    for form, f in (("function", count), ("lambda", lambda df: R.word_count(df, "text")), ("object", Counter())):
        got = fn.mapped(docs, f).filter("word <> ''").select(F.lit(form).alias("form"), "word", "count")
        out = got if out is None else out.union(got)
    return out


@query(WORDS)
def e11_word_count_records(spark, d):
    """Words as records with declared fields."""
    counted = R.word_count(lines(table(spark, d, "documents")), "text").filter("word <> ''")
    return counted.to(S.StructType.fromDDL(S.WORD_COUNT))


@query(WORDS)
def e11_word_count_parallel(spark, d):
    """Each operator with its own number of tasks."""
    words = R.tokens(lines(table(spark, d, "documents").repartition(3)), "text").filter("word <> ''")
    return words.repartition(5, "word").groupBy("word").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT 'W> (' || chr(39) || word || chr(39) || ', ' || count || ')' AS line FROM (" + WORDS + ")")
def e11_word_count_deployed(spark, d):
    """As it is launched from a command line: arguments choose the mode, results are printed."""
    mode = arguments(["--mode", "batch"]).mode
    counted = R.word_count(lines(text_stream(spark, d) if is_streaming(mode, True) else table(spark, d, "documents")), "text").filter("word <> ''")
    return printed(spark, lambda: K.print_rows(counted, "W"))
