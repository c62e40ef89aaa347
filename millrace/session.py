"""Session and environment: masters, run modes, parallelism, checkpoints and restart as one settings object."""

from __future__ import annotations

import argparse
import contextlib
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Values that every session gets; anything in Settings.conf wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
}
PROVIDER, BACKEND = "spark.sql.streaming.stateStore.providerClass", "spark.millrace.state.backend"
BACKENDS = {
    "heap": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


@dataclass
class Settings:
    """How a job runs.

    master: None takes what the launcher set (automatic), "local[n]" is local, "spark://..." remote.
    parallelism: shuffle partitions; None leaves the cluster's value, AQE coalesces.
    ui_port: None switches the web UI off. state_backend: "heap" or "rocksdb".
    """

    app: str = "millrace"
    master: str | None = None
    parallelism: int | None = None
    ui_port: int | None = None
    log_level: str = "ERROR"
    state_backend: str = "rocksdb"
    incremental_state: bool = True
    conf: dict[str, str] = field(default_factory=dict)


def conf_of(s: Settings) -> dict[str, str]:
    """The configuration that settings stand for."""
    conf = dict(DEFAULTS)
    conf[BACKEND] = s.state_backend
    conf[PROVIDER] = BACKENDS[s.state_backend]
    conf["spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"] = str(s.incremental_state).lower()
    conf["spark.ui.enabled"] = str(s.ui_port is not None).lower()
    if s.ui_port is not None:
        conf["spark.ui.port"] = str(s.ui_port)
    if s.parallelism is not None:
        conf["spark.sql.shuffle.partitions"] = str(s.parallelism)
    return conf | s.conf


def open_session(settings: Settings | None = None) -> SparkSession:
    s = settings or Settings()
    builder = SparkSession.builder.appName(s.app).config(map=conf_of(s))
    spark = (builder.master(s.master) if s.master else builder).getOrCreate()
    spark.sparkContext.setLogLevel(s.log_level)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir.

    Where that is unset a folder is made here if all executors are on this machine, as in tests; elsewhere
    it is an error, as other machines would not see the folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that all executors see")
    return tempfile.mkdtemp(prefix="millrace-")


def with_checkpoints(spark: SparkSession) -> None:
    """Lets DataFrame.checkpoint() write below the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


@contextlib.contextmanager
def state_for(df: DataFrame) -> Iterator[None]:
    """What a query over df needs of the session while it is started, put back after.

    Keyed processors keep several states under one key, which only the RocksDB store can do. Sessions that
    were opened with state_backend="heap" say so, and a processor in them is an error.
    """
    spark = df.sparkSession
    if "TransformWithState" not in df._jdf.queryExecution().analyzed().toString():
        yield
        return
    if spark.conf.get(BACKEND, "rocksdb") == "heap":
        raise ValueError('a keyed processor needs state_backend="rocksdb", and this session asks for "heap"')
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, BACKENDS["rocksdb"])
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """--hostname and --port of a socket source, --mode of the run."""
    p = argparse.ArgumentParser()
    p.add_argument("--hostname", default="localhost")
    p.add_argument("--port", type=int, default=8888)
    p.add_argument("--mode", choices=("batch", "streaming", "automatic"), default="automatic")
    return p.parse_args(argv)


def is_streaming(mode: str, bounded: bool) -> bool:
    """batch and streaming are taken at their word; automatic runs bounded input as a batch."""
    if mode == "batch" and not bounded:
        raise ValueError("an unbounded source can't run as a batch")
    return mode == "streaming" or (mode == "automatic" and not bounded)


@dataclass
class Checkpointing:
    """What a streaming query keeps for recovery, and how often.

    interval: trigger interval ("0 seconds": as fast as it goes; None: all available data, then stop).
    Each micro-batch is one atomic step of sources, state and sink log, so alignment, timeouts between
    barriers and the number of concurrent checkpoints are not to be set.
    """

    location: str
    interval: str | None = "5 seconds"
    query_name: str | None = None

    def start(self, df: DataFrame, mode: str = "append", sink: str | None = None, each_batch: Callable[[DataFrame, int], None] | None = None, **options):
        w = df.writeStream.outputMode(mode).option("checkpointLocation", self.location).options(**options)
        w = w.queryName(self.query_name) if self.query_name else w
        w = w.trigger(availableNow=True) if self.interval is None else w.trigger(processingTime=self.interval)
        w = w.foreachBatch(each_batch) if each_batch is not None else w.format(sink) if sink else w
        with state_for(df):
            return w.start()


def supervise(start: Callable[[], object], attempts: int = 3, delay: float = 2.0, fatal: tuple[type[BaseException], ...] = ()) -> int:
    """Fixed-delay restart: runs start().awaitTermination(), and again after a failure, up to `attempts`
    restarts. A restarted query goes on from its checkpoint. Returns the number of restarts."""
    for k in range(attempts + 1):
        try:
            query = start()
            query.awaitTermination()
            return k
        except fatal:
            raise
        except Exception:
            if k == attempts:
                raise
            time.sleep(delay)
    raise AssertionError
