"""Queries on executors that are other JVMs than the driver, beside their oracle SQL."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from compare import database, differences
from conftest import ROOT

from millrace import plans
from millrace.sources import jvm_jdbc

NAMES = (
    "s15_jdbc_scan",
    "s16_jdbc_lookup_join",
    "k9_jdbc_append",
    "k10_jdbc_upsert",
    "k11_jdbc_adding_upsert",
    "k12_jdbc_table_upsert",
    "m11_late_correction",
)
RUN = """
import json, sys
from millrace import plans
from millrace.session import Settings, open_session
sf, work, *names = sys.argv[1:]
spark = open_session(Settings(master="local-cluster[2,1,1024]", parallelism=4, conf={"spark.checkpoint.dir": f"file://{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse", "spark.driver.host": "127.0.0.1"}))
said = {}
for name in names:
    try:
        plans.queries()[name](spark, sf).write.parquet(f"{work}/{name}")
    except Exception as e:
        said[name] = str(e)[:2000]
open(f"{work}/said", "w").write(json.dumps(said))
spark.stop()
"""


@pytest.fixture(scope="module")
def ran(sf, tmp_path_factory):
    work = tmp_path_factory.mktemp("cluster")
    (work / "home/work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write to work in Spark's home
        if p.name != "work":
            (work / "home" / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env |= {"SPARK_HOME": str(work / "home"), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", RUN, sf, str(work), *NAMES], env=env, cwd=work, check=True, timeout=600, capture_output=True)
    return work


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster(spark, sf, ran, name):
    assert json.loads((ran / "said").read_text()).get(name, "") == ""
    assert differences(spark, sf, lambda s, _: s.read.parquet(f"{ran}/{name}"), plans.oracle_sql()[name], database(sf)) == ""


def test_embedded_databases():
    for url in ("jdbc:derby:memory:x;create=true", "jdbc:derby:/a/b", "jdbc:derby://a/b", "jdbc:h2:mem:x", "jdbc:hsqldb:file:x", "jdbc:sqlite:x"):
        assert jvm_jdbc.is_embedded(url) == (url != "jdbc:derby://a/b")
    for url in ("jdbc:mysql://h/d", "jdbc:postgresql://h/d", "jdbc:h2:tcp://h/x", "jdbc:hsqldb:hsql://h/x", "jdbc:derby:net://h/x"):
        assert not jvm_jdbc.is_embedded(url)
