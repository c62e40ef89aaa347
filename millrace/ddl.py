"""Tables by DDL: CREATE TABLE ... WITH (...) over files, generators, JDBC and Kafka; INSERT INTO; views; catalogs.

A statement's columns may be physical, computed (`name AS expression`), facts of the source (`name TYPE
METADATA FROM 'key'`), one WATERMARK and a PRIMARY KEY. Everything else is Spark SQL and goes to it as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sources as S
from millrace.sources import sinks as K


@dataclass
class Table:
    name: str
    physical: list[tuple[str, str]]
    computed: list[tuple[str, str]] = field(default_factory=list)
    facts: list[tuple[str, str, str]] = field(default_factory=list)
    watermark: tuple[str, str] | None = None
    key: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self.physical)


def parts_of(text: str) -> list[str]:
    """Split at commas that are outside brackets and quotes."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'`\"":
            quote = c
        elif c in "(<":
            depth += 1
        elif c in ")>":
            depth -= 1
        if c == "," and depth == 0 and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [x for x in [*out, now.strip()] if x]


def parse_table(sql: str) -> Table | None:
    """The table of a CREATE TABLE ... WITH statement, None for any other statement."""
    m = re.fullmatch(r"\s*CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+)\s*\((.*)\)\s*WITH\s*\((.*)\)\s*;?\s*", sql, re.I | re.S)
    if not m:
        return None
    t = Table(m[1].replace("`", ""), [])
    t.options = {k: v for k, v in re.findall(r"'([^']*)'\s*=\s*'([^']*)'", m[3])}
    for column in parts_of(m[2]):
        if x := re.fullmatch(r"WATERMARK\s+FOR\s+`?(\w+)`?\s+AS\s+`?\w+`?(?:\s*-\s*INTERVAL\s*'?([\d.]+)'?\s*(\w+))?", column, re.I):
            t.watermark = (x[1], f"{x[2]} {x[3]}" if x[2] else "0 seconds")
        elif x := re.fullmatch(r"PRIMARY\s+KEY\s*\(([^)]*)\)\s*(?:NOT\s+ENFORCED)?", column, re.I):
            t.key = [k.strip(" `") for k in x[1].split(",")]
        elif x := re.fullmatch(r"`?(\w+)`?\s+(\S+)\s+METADATA(?:\s+FROM\s+'([^']*)')?(?:\s+VIRTUAL)?", column, re.I):
            t.facts.append((x[1], x[2], x[3] or x[1]))
        elif x := re.fullmatch(r"`?(\w+)`?\s+AS\s+(.+)", column, re.I | re.S):
            t.computed.append((x[1], x[2]))
        elif x := re.fullmatch(r"`?(\w+)`?\s+(.+?)(\s+NOT\s+NULL)?", column, re.I | re.S):
            t.physical.append((x[1], x[2]))
        else:
            raise ValueError(f"not a column: {column}")
    return t


def translated(expression: str) -> str:
    """PROCTIME() and TO_TIMESTAMP_LTZ(x, 3) in Spark's words."""
    e = re.sub(r"\bPROCTIME\s*\(\s*\)", "current_timestamp()", expression, flags=re.I)
    return re.sub(r"\bTO_TIMESTAMP_LTZ\s*\(\s*([^,()]+)\s*,\s*3\s*\)", r"timestamp_millis(\1)", e, flags=re.I)


class Registry:
    """Tables of one session. Names may be qualified (catalog.database.table); use() sets the default prefix."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.prefix = spark, {}, ""

    def use(self, prefix: str) -> None:
        self.prefix = prefix

    def qualified(self, name: str) -> str:
        return name if "." in name or not self.prefix else f"{self.prefix}.{name}"

    def list_tables(self) -> list[str]:
        head = f"{self.prefix}." if self.prefix else ""
        return sorted(n.removeprefix(head) for n in self.tables if n.startswith(head))

    def sql(self, text: str, streaming: bool = False) -> DataFrame | None:
        if t := parse_table(text):
            self.tables[self.qualified(t.name)] = t
            return None
        if m := re.fullmatch(r"\s*INSERT\s+INTO\s+([\w.`]+)\s+(.*)", text, re.I | re.S):
            if (name := self.qualified(m[1].replace("`", ""))) in self.tables:
                self.insert(name, self.sql(m[2], streaming))
                return None
        for name in sorted(self.tables, key=len, reverse=True):  # tables that the statement names become views
            short = name.removeprefix(f"{self.prefix}.") if self.prefix else name
            if re.search(rf"(?<![\w.`]){re.escape(short)}(?![\w.`])", text):
                view = short.replace(".", "__")
                self.read(name, streaming).createOrReplaceTempView(view)
                text = re.sub(rf"(?<![\w.`]){re.escape(short)}(?![\w.`])", view, text)
        return self.spark.sql(text)

    def read(self, name: str, streaming: bool = False, options: dict[str, str] | None = None, source: DataFrame | None = None) -> DataFrame:
        """The table's rows; options override its own for this read."""
        t = self.tables[self.qualified(name)]
        o = t.options | (options or {})
        kind = o.get("connector", "filesystem")
        if kind == "filesystem":
            extra = {k: v for k, v in o.items() if k not in ("connector", "path", "format")}
            facts = {n: k for n, _, k in t.facts}
            if o.get("format", "csv") == "csv":
                df = S.csv_files(self.spark, o["path"], t.schema, facts, streaming, **extra)
            else:
                reader = (self.spark.readStream if streaming else self.spark.read).schema(t.schema).options(**extra)
                df = reader.format(o["format"]).load(o["path"]).select(*(f"`{n}`" for n, _ in t.physical), *(F.col(f"_metadata.{S.FILE_FACTS[k]}").alias(n) for n, k in facts.items()))
        elif kind == "datagen":
            df = S.datagen(self.spark, t.schema, streaming, **{k: v for k, v in o.items() if k != "connector"})
        elif kind == "jdbc":
            df = S.jdbc(self.spark, o["url"], o["table-name"], **{k: v for k, v in o.items() if k in ("driver", "user", "password")})
        elif kind in ("kafka", "upsert-kafka"):
            start = {"earliest-offset": "earliest", "latest-offset": "latest"}.get(o.get("scan.startup.mode", "latest-offset"), "latest")
            raw = S.kafka(self.spark, S.kafka_options(o["properties.bootstrap.servers"], o["topic"], start, o.get("properties.group.id")), streaming, source)
            df = S.kafka_values(raw, t.schema, o.get("format", o.get("value.format", "csv")), tuple(k for _, _, k in t.facts)).withColumnsRenamed({k: n for n, _, k in t.facts})
        else:
            raise ValueError(f"connector {kind}")
        for n, type_, _ in t.facts:
            df = df.withColumn(n, F.col(n).cast(type_.replace("TIMESTAMP_LTZ(3)", "TIMESTAMP")))
        for n, e in t.computed:
            df = df.withColumn(n, F.expr(translated(e)))
        return df.withWatermark(*t.watermark) if t.watermark and streaming else df

    def insert(self, name: str, df: DataFrame, checkpoint: str | None = None, mode: str = "append"):
        """Rows into the table, by position. A stream needs a checkpoint folder; the started query is returned."""
        t = self.tables[self.qualified(name)]
        o = t.options
        df = df.toDF(*(n for n, _ in t.physical)).select(*(F.col(n).cast(k).alias(n) for n, k in t.physical))
        kind = o.get("connector", "filesystem")
        if kind == "print":
            writer = K.print_batch(o.get("print-identifier", ""), o.get("standard-error", "false") == "true")
        elif kind == "jdbc":
            login = {k: v for k, v in o.items() if k in ("driver", "user", "password")}
            writer = K.Upsert(o["url"], o["table-name"], t.key, **login) if t.key else K.jdbc_append_batch(o["url"], o["table-name"], **login)
        elif kind in ("kafka", "upsert-kafka"):
            if df.isStreaming:
                return K.kafka_sink(df, o["properties.bootstrap.servers"], o["topic"], checkpoint, t.key[0] if t.key else None, o.get("format", o.get("value.format", "json")), mode)
            out = K.kafka_rows(df, t.key[0] if t.key else None, o.get("format", "json"))
            return out.write.format("kafka").option("kafka.bootstrap.servers", o["properties.bootstrap.servers"]).option("topic", o["topic"]).save()
        else:
            fmt = o.get("format", "json")
            if df.isStreaming:
                return df.writeStream.format(fmt).option("path", o["path"]).option("checkpointLocation", checkpoint).start()
            return df.write.format(fmt).mode("append").save(o["path"])
        if df.isStreaming:
            return df.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint).start()
        return writer(df, 0)
