"""Window queries over events, hours in place of seconds (an hour holds some thirty events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.plans.base import events, query, sql_query


def rows_n() -> list:
    return [F.count(F.lit(1)).alias("n")]


def tumbled(size: str, keys: str = "", aggs: str = "count(*) AS n") -> str:
    k = f", {keys}" if keys else ""
    return f"SELECT time_bucket(INTERVAL {size}, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL {size}, ts, TIMESTAMP '1970-01-01') + INTERVAL {size} AS window_end{k}, {aggs} FROM events GROUP BY ALL"


def hopped(size: str, slide: str, n: int, keys: str = "", aggs: str = "count(*) AS n") -> str:
    k = f", {keys}" if keys else ""
    start = f"time_bucket(INTERVAL {slide}, ts, TIMESTAMP '1970-01-01') - INTERVAL {slide} * k"
    return f"SELECT {start} AS window_start, {start} + INTERVAL {size} AS window_end{k}, {aggs} FROM events, range(0, {n}) r(k) GROUP BY ALL"


def sessions(gap: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    g = f"{keys}, s" if keys else "s"
    return f"""SELECT {k}min(ts) AS window_start, max(ts) + INTERVAL {gap} AS window_end, count(*) AS n FROM (
SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL {gap} THEN 1 ELSE 0 END) OVER ({part} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, lag(ts) OVER ({part} ORDER BY ts) AS before FROM events)) GROUP BY {g}"""


@query(tumbled("1 HOUR", "event_type"))
def w1_tumble_keyed(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "1 hour"), "ts", ["event_type"], rows_n())


@query(tumbled("5 HOUR"))
def w2_tumble_all(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "5 hours"), "ts", [], rows_n())


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 16:00:00') AS window_start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 16:00:00') + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY ALL")
def w3_tumble_offset(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "1 day", "1 day", "16 hours"), "ts", [], rows_n())


@query(hopped("10 HOUR", "5 HOUR", 2, "event_type"))
def w4_hop_keyed(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "10 hours", "5 hours"), "ts", ["event_type"], rows_n())


@query(hopped("10 HOUR", "5 HOUR", 2))
def w5_hop_all(spark, d):
    """Processing-time windows are the same operator over the arrival time, which is given here as ts."""
    return W.hop(events(spark, d), "ts", "10 hours", "5 hours").groupBy("window_start", "window_end").agg(*rows_n())


@query(sessions("6 HOUR", "user_id"))
def w6_session_keyed(spark, d):
    return W.session(events(spark, d), "ts", "6 hours", ["user_id"], rows_n())


@query(sessions("10 MINUTE"))
def w7_session_all(spark, d):
    return W.session(events(spark, d), "ts", "10 minutes", [], rows_n())


@query("SELECT user_id, count(*) AS n, max(ts) AS latest FROM events GROUP BY user_id")
def w8_global_window(spark, d):
    return events(spark, d).groupBy("user_id").agg(*rows_n(), F.max("ts").alias("latest"))


COUNTED = """SELECT user_id, CAST((k - 1) // 3 AS BIGINT) AS window_no, CAST(sum(v) AS BIGINT) AS total FROM (
SELECT user_id, CAST(floor(value) AS INTEGER) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY user_id, (k - 1) // 3 HAVING count(*) = 3"""


def numbers(spark, d):
    return events(spark, d).select("user_id", "event_id", F.floor("value").cast("int").alias("v"))


@query(COUNTED)
def w9_count_tumble(spark, d):
    return W.count_tumble(numbers(spark, d), ["user_id"], ["event_id"], 3, [F.sum("v").alias("total")]).select("user_id", F.col("window_no").cast("bigint").alias("window_no"), "total")


@query("""SELECT CAST((k - 1) // 3 AS BIGINT) AS window_no, CAST(sum(v) AS BIGINT) AS total FROM (
SELECT CAST(floor(value) AS INTEGER) AS v, row_number() OVER (ORDER BY event_id) AS k FROM events) GROUP BY (k - 1) // 3 HAVING count(*) = 3""")
def w9_count_tumble_all(spark, d):
    return W.count_tumble(numbers(spark, d), [], ["event_id"], 3, [F.sum("v").alias("total")]).select(F.col("window_no").cast("bigint").alias("window_no"), "total")


SLID = """SELECT user_id, CAST(k AS INTEGER) AS upto, CAST(total AS BIGINT) AS total FROM (
SELECT user_id, sum(CAST(floor(value) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS total,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE """


@query(SLID + "k % 2 = 0")
def w10_count_slide(spark, d):
    return W.count_slide(numbers(spark, d), ["user_id"], ["event_id"], 3, 2, {"total": F.sum("v")})


@query(COUNTED)
def w11_rows_tumble(spark, d):
    return W.count_tumble(numbers(spark, d), ["user_id"], ["event_id"], 3, [F.sum("v").alias("total")]).select("user_id", F.col("window_no").cast("bigint").alias("window_no"), "total")


@query(SLID + "k >= 3 AND (k - 3) % 2 = 0")
def w12_rows_slide_full(spark, d):
    return W.count_slide(numbers(spark, d), ["user_id"], ["event_id"], 3, 2, {"total": F.sum("v")}, full=True)


TOTAL = "CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS total"


def sum_v() -> list:
    return [F.sum(F.floor("value").cast("int")).alias("total")]


@query(tumbled("10 HOUR", "user_id", TOTAL))
def w13_table_tumble(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "10 hours"), "ts", ["user_id"], sum_v())


@query(hopped("10 HOUR", "5 HOUR", 2, "user_id", TOTAL))
def w14_table_slide(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "10 hours", "5 hours"), "ts", ["user_id"], sum_v())


@query(sessions("5 HOUR", "user_id"))
def w15_table_session(spark, d):
    return W.session(events(spark, d), "ts", "5 hours", ["user_id"], rows_n())


sql_query("w16_sql_tumble", "SELECT window.start AS window_start, window.end AS window_end, user_id, sum(CAST(floor(value) AS INT)) AS total FROM events GROUP BY window(ts, '10 hours'), user_id", tumbled("10 HOUR", "user_id", TOTAL), ("events",))
sql_query("w17_sql_hop", "SELECT window.start AS window_start, window.end AS window_end, user_id, sum(CAST(floor(value) AS INT)) AS total FROM events GROUP BY window(ts, '10 hours', '5 hours'), user_id", hopped("10 HOUR", "5 HOUR", 2, "user_id", TOTAL), ("events",))
sql_query("w18_sql_session", "SELECT session_window.start AS window_start, session_window.end AS window_end, user_id, count(*) AS n FROM events GROUP BY session_window(ts, '5 hours'), user_id", sessions("5 HOUR", "user_id"), ("events",))


@query("SELECT event_id, time_bucket(INTERVAL 10 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 10 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 10 HOUR AS window_end FROM events")
def w19_tvf_tumble(spark, d):
    return W.tumble(events(spark, d), "ts", "10 hours").select("event_id", "window_start", "window_end")


@query("SELECT event_id, time_bucket(INTERVAL 5 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 HOUR * k AS window_start, time_bucket(INTERVAL 5 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 HOUR * k + INTERVAL 10 HOUR AS window_end FROM events, range(0, 2) r(k)")
def w20_tvf_hop(spark, d):
    return W.hop(events(spark, d), "ts", "10 hours", "5 hours").select("event_id", "window_start", "window_end")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR * k AS window_end, count(*) AS n
FROM events, range(1, 5) r(k) WHERE ts < time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR * k GROUP BY ALL""")
def w21_tvf_cumulate(spark, d):
    return W.cumulate(events(spark, d), "ts", "6 hours", "1 day", 4).groupBy("window_start", "window_end").agg(*rows_n())


@query(sessions("5 HOUR", "user_id"))
def w22_tvf_session(spark, d):
    return W.session(events(spark, d), "ts", "5 hours", ["user_id"], rows_n()).select("user_id", "window_start", "window_end", "n")


@query(tumbled("1 HOUR", "event_type", "max(event_id) AS last_id"))
def w23_window_columns(spark, d):
    return W.tumble(events(spark, d), "ts", "1 hour").groupBy("window_start", "window_end", "event_type").agg(F.max("event_id").alias("last_id"))


@query(tumbled("5 HOUR", "user_id", "round(sum(value), 4) AS total"))
def w24_window_sum(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "5 hours"), "ts", ["user_id"], [F.round(F.sum("value"), 4).alias("total")])


@query(tumbled("10 HOUR", aggs="count(*) AS pv"))
def w25_window_reduce(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "10 hours"), "ts", [], [F.count(F.lit(1)).alias("pv")])


@query("""SELECT 'window [' || epoch_ms(s) || ',' || epoch_ms(s) + 28800000 || ') user ' || user_id || ' clicks ' || n AS line FROM (
SELECT time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') AS s, user_id, count(*) AS n FROM events GROUP BY ALL)""")
def w26_full_window_function(spark, d):
    g = W.grouped(events(spark, d), F.window("ts", "8 hours"), "ts", ["user_id"], rows_n())
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return g.select(F.format_string("window [%d,%d) user %d clicks %d", ms("window_start"), ms("window_end"), "user_id", "n").alias("line"))


@query("""SELECT s AS window_start, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS counts FROM (
SELECT time_bucket(INTERVAL 10 HOUR, ts, TIMESTAMP '1970-01-01') AS s, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY s""")
def w27_full_window_all(spark, d):
    g = W.grouped(events(spark, d), F.window("ts", "10 hours"), "ts", ["event_type"], rows_n())
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type", "n")))
    return g.groupBy("window_start").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string"))), ",").alias("counts"))


@query("SELECT epoch_ms(s) AS window_start, epoch_ms(s) + 28800000 AS window_end, event_type AS url, n AS count FROM (SELECT time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') AS s, event_type, count(*) AS n FROM events GROUP BY ALL)")
def w28_url_view_count(spark, d):
    g = W.grouped(events(spark, d), F.window("ts", "8 hours"), "ts", ["event_type"], [F.count(F.lit(1)).alias("count")])
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return g.select(ms("window_start").alias("window_start"), ms("window_end").alias("window_end"), F.col("event_type").alias("url"), "count")
