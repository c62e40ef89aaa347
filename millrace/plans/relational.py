"""Projections, joins, aggregates, OVER frames, top-N, dedup, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import relational as R
from millrace.operators import windows as W
from millrace.plans.base import events, query, sensors, sql_query
from millrace.sources import table

# ---- projection, filter, row transforms

sql_query("p1_sql_filter", "SELECT event_id, user_id, value FROM events WHERE value >= 100", "SELECT event_id, user_id, value FROM events WHERE value >= 100", ("events",))


@query("SELECT event_id, user_id, value FROM events WHERE value >= 50")
def p2_frame_filter(spark, d):
    return events(spark, d).where(F.col("value") >= 50).select("event_id", "user_id", "value")


sql_query("p3_cte", "WITH big AS (SELECT * FROM events WHERE value >= 100) SELECT event_type, count(*) AS n FROM big GROUP BY event_type", "WITH big AS (SELECT * FROM events WHERE value >= 100) SELECT event_type, count(*) AS n FROM big GROUP BY event_type", ("events",))


@query("SELECT DISTINCT user_id FROM events")
def p4_distinct(spark, d):
    return events(spark, d).select("user_id").distinct()


@query("""SELECT event_id, '{"ts":' || (epoch_us(ts) // 1000) || ',"url":"' || event_type || '","user":"' || user_id || '"}' AS line FROM events""")
def p5_map_to_json(spark, d):
    e = events(spark, d)
    row = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("url"), F.col("user_id").cast("string").alias("user"))
    return e.select("event_id", F.to_json(row).alias("line"))


@query("SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view')")
def p6_filter_out(spark, d):
    return events(spark, d).filter(~F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))).select("event_id", "event_type")


@query("""SELECT event_id, unnest([CAST(user_id AS VARCHAR), event_type, CAST((epoch_us(ts) // 1000) AS VARCHAR)]) AS word
FROM events WHERE user_id NOT IN (1, 2)""")
def p7_flat_map(spark, d):
    e = events(spark, d).filter(~F.col("user_id").isin(1, 2))
    return e.select("event_id", F.explode(F.array(F.col("user_id").cast("string"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))).alias("word"))


@query("SELECT unnest(string_split(rtrim(c_name || ' ' || c_mktsegment), ' ')) AS word FROM customer")
def p8_tokenize(spark, d):
    return R.tokens(table(spark, d, "customer").select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("line")), "line")


@query("SELECT event_id, upper(event_type) AS label FROM events")
def p9_function_forms(spark, d):
    e = events(spark, d)
    return fn.mapped(e, lambda df: df.select("event_id", F.upper("event_type").alias("label")))


@query("SELECT event_id, value * 2 AS doubled FROM events")
def p10_rich_function(spark, d):
    return fn.with_resource(events(spark, d).select("event_id", "value"), fn.Doubler(), "event_id bigint, doubled double")


@query("SELECT event_id, value AS v, value * 10 AS v10, (epoch_us(ts) // 1000) AS ms FROM events")
def p11_computed_columns(spark, d):
    return events(spark, d).select("event_id", F.col("value").alias("v"), (F.col("value") * 10).alias("v10"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("SELECT 'click' AS part, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'view', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'rest', count(*) FROM events WHERE event_type NOT IN ('click', 'view')")
def p12_split_by_filters(spark, d):
    e = events(spark, d)
    parts = {"click": e.filter("event_type = 'click'"), "view": e.filter("event_type = 'view'"), "rest": e.filter("event_type NOT IN ('click', 'view')")}
    counts = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, p in parts.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("SELECT CASE WHEN event_type = 'click' THEN 'click' WHEN event_type = 'view' THEN 'view' ELSE 'main' END AS route, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def p13_side_outputs(spark, d):
    routed = R.route(events(spark, d), {k: F.col("event_type") == k for k in ("click", "view")})
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT event_id, CASE WHEN value > 100 THEN 'alarm' ELSE 'main' END AS route, event_type || ':' || user_id AS message FROM events")
def p14_process_function(spark, d):
    routed = R.route(events(spark, d), {"alarm": F.col("value") > 100})
    return routed.select("event_id", "route", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("message"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def p15_key_by(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


# ---- joins


@query("SELECT o_orderkey, o_orderdate, l_linenumber, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def j1_inner_join(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "l_linenumber", "l_shipdate")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def j2_left_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 200000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000")
def j3_right_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 300000")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT a.c_custkey AS rich, b.o_orderkey AS big FROM (SELECT * FROM customer WHERE c_acctbal > 5000) a FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) b ON a.c_custkey = b.o_custkey")
def j4_full_join(spark, d):
    c, o = table(spark, d, "customer").filter("c_acctbal > 5000"), table(spark, d, "orders").filter("o_totalprice > 250000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select(F.col("c_custkey").alias("rich"), F.col("o_orderkey").alias("big"))


INTERVAL_JOIN = "SELECT o_orderkey, o_orderdate, l_linenumber, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 2 DAY AND o_orderdate + INTERVAL 2 DAY"
sql_query("j5_interval_join_sql", INTERVAL_JOIN, INTERVAL_JOIN, ("orders", "lineitem"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate - INTERVAL 2 DAY AND l_shipdate < o_orderdate + INTERVAL 2 DAY")
def j6_interval_join_exclusive(spark, d):
    joined = R.interval_join(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")], "o_orderdate", "l_shipdate", "2 days", "2 days", inclusive=False)
    return joined.select("o_orderkey", "l_linenumber")


@query("""SELECT time_bucket(INTERVAL 10 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS window_start, o_orderkey, l_linenumber FROM orders JOIN lineitem
ON o_orderkey = l_orderkey AND time_bucket(INTERVAL 10 DAY, o_orderdate, TIMESTAMP '1970-01-01') = time_bucket(INTERVAL 10 DAY, l_shipdate, TIMESTAMP '1970-01-01')""")
def j7_window_join(spark, d):
    joined = R.window_join(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")], "o_orderdate", "l_shipdate", "10 days")
    return joined.select("window_start", "o_orderkey", "l_linenumber")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j8_lookup_join(spark, d):
    return R.lookup_join(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey").select("c_custkey", "n_name")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate FROM orders), l AS (SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_linenumber = 1)
SELECT coalesce(o_orderkey, l_orderkey) AS order_id, o_orderdate AS app_time, l_shipdate AS third_time,
CASE WHEN l_orderkey IS NULL THEN 'third missing' WHEN o_orderkey IS NULL THEN 'app missing' ELSE 'matched' END AS result
FROM o FULL JOIN l ON o_orderkey = l_orderkey AND l_shipdate <= o_orderdate + INTERVAL 30 DAY AND o_orderdate <= l_shipdate + INTERVAL 30 DAY""")
def j9_bill_check(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "order_id")
    li = table(spark, d, "lineitem").filter("l_linenumber = 1").withColumnRenamed("l_orderkey", "order_id")
    return R.bill_check(o, li, "order_id", "o_orderdate", "l_shipdate", "30 days")


@query("SELECT p_partkey, w AS word, CAST(length(w) AS INTEGER) AS len FROM part, LATERAL (SELECT unnest(string_split(p_name, ' ')) AS w) t")
def j10_lateral_inner(spark, d):
    fn.register(spark)
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, word, len FROM part, LATERAL split_words(p_name, ' ')")


@query("SELECT s_suppkey, w AS word, CAST(length(w) AS INTEGER) AS len FROM supplier LEFT JOIN LATERAL (SELECT unnest(string_split(s_name, '#')) AS w) t ON true WHERE w <> '' OR w IS NULL")
def j11_lateral_left(spark, d):
    fn.register(spark)
    table(spark, d, "supplier").createOrReplaceTempView("supplier")
    return spark.sql("SELECT s_suppkey, word, len FROM supplier LEFT JOIN LATERAL split_words(s_name, '#') ON true WHERE word <> '' OR word IS NULL")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j12_semi_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j13_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# ---- aggregates


@query("SELECT CAST(sum(floor(value)) AS BIGINT) AS total FROM events")
def a1_global_sum(spark, d):
    return sensors(spark, d).agg(F.sum("vc").alias("total"))


@query("SELECT user_id, CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS total FROM events GROUP BY user_id")
def a2_grouped_sum(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.sum(F.floor("value").cast("int")).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a3_count(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, CAST(sum(CAST(floor(value) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def a4_rolling_sum(spark, d):
    e = events(spark, d).withColumn("v", F.floor("value").cast("int"))
    return R.running(e, ["user_id"], ["event_id"], {"total": F.sum("v")}).select("event_id", "user_id", "total")


@query("SELECT CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS total, count(*) AS n FROM events")
def a5_constant_key(spark, d):
    return events(spark, d).groupBy(F.lit(True).alias("k")).agg(F.sum(F.floor("value").cast("int")).alias("total"), F.count(F.lit(1)).alias("n")).drop("k")


@query("SELECT user_id, max(value) AS value, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def a6_max_field(spark, d):
    return R.max_field(events(spark, d).select("user_id", "event_id", "event_type", "value"), ["user_id"], "value", ["event_id"]).select("user_id", "value", "event_type")


LAST_VISIT = "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


@query(LAST_VISIT)
def a7_max_by_record(spark, d):
    return R.max_by_record(events(spark, d).select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def a8_min_by_record(spark, d):
    return R.min_by_record(events(spark, d).select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, min(value) AS value, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def a8_min_field(spark, d):
    return R.min_field(events(spark, d).select("user_id", "event_id", "event_type", "value"), ["user_id"], "value", ["event_id"]).select("user_id", "value", "event_type")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS clicks FROM events")
def a9_reduce(spark, d):
    return R.running(events(spark, d), ["user_id"], ["event_id"], {"clicks": F.count(F.lit(1))}).select("event_id", "user_id", "clicks")


@query("SELECT word, count(*) AS count FROM (SELECT unnest(string_split(n_name, ' ')) AS word FROM nation) GROUP BY word")
def a10_batch_word_sum(spark, d):
    return R.word_count(table(spark, d, "nation"), "n_name")


GROUPING = "SELECT event_type, user_id % 3 AS u, hour(ts) % 4 AS h, CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS amount FROM events GROUP BY "
SETS = "GROUPING SETS ((event_type, user_id % 3, hour(ts) % 4), (event_type, user_id % 3), (event_type, hour(ts) % 4), (user_id % 3, hour(ts) % 4), (event_type), (user_id % 3), (hour(ts) % 4), ())"
sql_query("a11_grouping_sets", GROUPING + SETS, GROUPING + SETS, ("events",))


@query("SELECT event_type, user_id % 3 AS u, CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS amount FROM events GROUP BY CUBE (event_type, user_id % 3)")
def a12_cube(spark, d):
    e = events(spark, d).select("event_type", (F.col("user_id") % 3).alias("u"), F.floor("value").cast("int").alias("v"))
    return e.cube("event_type", "u").agg(F.sum("v").alias("amount"))


@query("SELECT event_type, user_id % 3 AS u, hour(ts) % 4 AS h, CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS amount FROM events GROUP BY ROLLUP (event_type, user_id % 3, hour(ts) % 4)")
def a13_rollup(spark, d):
    e = events(spark, d).select("event_type", (F.col("user_id") % 3).alias("u"), (F.hour("ts") % 4).alias("h"), F.floor("value").cast("int").alias("v"))
    return e.rollup("event_type", "u", F.col("h").cast("bigint").alias("h")).agg(F.sum("v").alias("amount"))


@query("SELECT event_type, user_id % 3 AS u, CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS amount FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3))")
def a14_union_of_groupings(spark, d):
    e = events(spark, d).select("event_type", (F.col("user_id") % 3).alias("u"), F.floor("value").cast("int").alias("v"))
    a = e.groupBy("event_type").agg(F.sum("v").alias("amount")).select("event_type", F.lit(None).cast("bigint").alias("u"), "amount")
    b = e.groupBy("u").agg(F.sum("v").alias("amount")).select(F.lit(None).cast("string").alias("event_type"), "u", "amount")
    return a.unionAll(b)


@query("SELECT time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 8 HOUR AS window_end, count(*) AS pv FROM events GROUP BY ALL")
def a15_incremental_window(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "8 hours"), "ts", [], [F.count(F.lit(1)).alias("pv")])


@query("SELECT time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(DISTINCT user_id) AS uv FROM events GROUP BY ALL")
def a16_distinct_users(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "8 hours"), "ts", [], [F.count_distinct("user_id").alias("uv")]).drop("window_end")


@query("SELECT time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, round(count(*) / count(DISTINCT user_id), 6) AS ratio FROM events GROUP BY ALL")
def a17_pv_uv(spark, d):
    return W.grouped(events(spark, d), F.window("ts", "8 hours"), "ts", [], [F.round(F.count(F.lit(1)) / F.size(F.collect_set("user_id")), 6).alias("ratio")]).drop("window_end")


@query("SELECT user_id, round(avg(CAST(floor(value) AS INTEGER)), 6) AS mean FROM events GROUP BY user_id")
def a18_average(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.round(F.avg(F.floor("value").cast("int")), 6).alias("mean"))


# ---- OVER frames


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def o1_rows_unbounded(spark, d):
    return events(spark, d).select("event_id", F.round(F.sum("value").over(W.over_rows(["user_id"], ["ts"])), 4).alias("total"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 2 PRECEDING), 4) AS total FROM events")
def o2_rows_preceding(spark, d):
    return events(spark, d).select("event_id", F.round(F.sum("value").over(W.over_rows(["user_id"], ["ts"], 2)), 4).alias("total"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) RANGE UNBOUNDED PRECEDING), 4) AS total FROM events")
def o3_range_unbounded(spark, d):
    return events(spark, d).select("event_id", F.round(F.sum("value").over(W.over_range(["user_id"], F.date_trunc("hour", "ts"))), 4).alias("total"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW), 4) AS total FROM events")
def o4_range_interval(spark, d):
    return events(spark, d).select("event_id", F.round(W.over_interval("sum(value)", ["user_id"], "ts", "'2' HOUR"), 4).alias("total"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 4) AS total FROM events")
def o5_rows_following(spark, d):
    from pyspark.sql import Window

    return events(spark, d).select("event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(0, 1)), 4).alias("total"))


@query("SELECT event_id, min(value) OVER w AS low, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def o6_sum_and_min(spark, d):
    return events(spark, d).select("event_id", W.over_interval("min(value)", ["user_id"], "ts", "'1' HOUR").alias("low"), F.round(W.over_interval("sum(value)", ["user_id"], "ts", "'1' HOUR"), 4).alias("total"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS rn FROM events")
def o7_row_number(spark, d):
    return R.top_n(events(spark, d), ["user_id"], ["ts", "event_id"], 1 << 30, "rn").select("event_id", "rn")


# ---- sort, limit, top-N, dedup


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id")
def t1_order_by_time(spark, d):
    return events(spark, d).select("event_id", "ts").orderBy("ts", "event_id")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 10")
def t2_limit(spark, d):
    return events(spark, d).select("event_id", "ts").orderBy("ts", "event_id").limit(10)


TOPN = """SELECT window_start, window_end, event_type, n, CAST(rk AS INTEGER) AS rk FROM (
SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) AS rk FROM (
SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM events GROUP BY ALL)) WHERE rk <= 2"""


@query(TOPN)
def window_topn(spark, d):
    counts = W.grouped(events(spark, d), F.window("ts", "1 hour"), "ts", ["event_type"], [F.count(F.lit(1)).alias("n")])
    return R.top_n(counts, ["window_start", "window_end"], [F.col("n").desc(), "event_type"], 2)


sql_query(
    "t3_window_topn_sql",
    """SELECT window_start, window_end, event_type, n, rk FROM (
SELECT *, row_number() OVER (PARTITION BY window_start, window_end ORDER BY n DESC, event_type) AS rk FROM (
SELECT w.start AS window_start, w.end AS window_end, event_type, n FROM (
SELECT window(ts, '1 hour') AS w, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type))) WHERE rk <= 2""",
    TOPN,
    ("events",),
)


@query("""SELECT window_start, string_agg(event_type || '=' || n, ',' ORDER BY rk) AS top FROM (
SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) AS rk FROM (
SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rk <= 2 GROUP BY window_start""")
def t4_topn_full_window(spark, d):
    counts = W.grouped(events(spark, d), F.window("ts", "1 day"), "ts", ["event_type"], [F.count(F.lit(1)).alias("n")])
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type", "n")))
    top = counts.groupBy("window_start").agg(F.slice(ranked, 1, 2).alias("t"))
    return top.select("window_start", F.array_join(F.transform("t", lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string"))), ",").alias("top"))


@query("""SELECT window_end, event_type, n, CAST(rk AS INTEGER) AS rk FROM (
SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY n DESC, event_type) AS rk FROM (
SELECT time_bucket(INTERVAL 5 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 5 HOUR * k AS window_end, event_type, count(*) AS n
FROM events, range(1, 3) r(k) GROUP BY ALL)) WHERE rk <= 2""")
def t5_topn_by_window_end(spark, d):
    counts = W.grouped(events(spark, d), F.window("ts", "10 hours", "5 hours"), "ts", ["event_type"], [F.count(F.lit(1)).alias("n")])
    return R.top_n(counts, ["window_end"], [F.col("n").desc(), "event_type"], 2).select("window_end", "event_type", "n", "rk")


@query("""SELECT event_id, window_start, event_type, ts FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def t6_dedup_keep_last(spark, d):
    return R.keep_last(W.tumble(events(spark, d), "ts", "1 hour"), ["window_start", "event_type"], ["ts", "event_id"]).select("event_id", "window_start", "event_type", "ts")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def t6_dedup_keep_first(spark, d):
    return R.keep_first(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


TOP2 = """SELECT user_id, CAST(rk AS INTEGER) AS rank, vc FROM (SELECT user_id, CAST(floor(value) AS INTEGER) AS vc,
row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC) AS rk FROM events) WHERE rk <= 2"""


@query(TOP2)
def t7_top2_table_aggregate(spark, d):
    return R.top_n(events(spark, d).select("user_id", F.floor("value").cast("int").alias("vc")), ["user_id"], [F.col("vc").desc()], 2, "rank")


@query("""SELECT event_id, array_to_string(list_slice(list_reverse_sort(list(CAST(floor(value) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 1, 3), ',') AS top FROM events""")
def t8_running_top3(spark, d):
    e = events(spark, d).withColumn("vc", F.floor("value").cast("int"))
    return R.running_top(e, ["user_id"], ["event_id"], "vc", 3).select("event_id", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


# ---- set operations and several streams

A = "SELECT user_id, event_type FROM events"
B = "SELECT o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'click' WHEN 'O' THEN 'view' ELSE 'other' END AS event_type FROM orders"
for _n, _op in (("x1_union", "UNION"), ("x1_union_all", "UNION ALL"), ("x2_intersect", "INTERSECT"), ("x2_intersect_all", "INTERSECT ALL"), ("x3_except", "EXCEPT"), ("x3_except_all", "EXCEPT ALL")):
    sql_query(_n, f"{A} {_op} {B}", f"{A} {_op} {B}", ("events", "orders"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'view'")
def x4_stream_union(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    return e.filter("event_type = 'click'").unionByName(e.filter("event_type = 'view'"))


@query("SELECT 'left' AS side, c_custkey, CAST(NULL AS BIGINT) AS s_suppkey FROM customer UNION ALL SELECT 'right', NULL, s_suppkey FROM supplier")
def x5_connect(spark, d):
    return R.connect(table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier").select("s_suppkey")).select("side", "c_custkey", "s_suppkey")


# ---- scalar functions


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ms, epoch_ms((epoch_us(ts) // 1000)) AS et FROM events")
def f1_millis_to_time(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events(spark, d).select("event_id", ms.alias("ms"), F.timestamp_millis(ms).cast("timestamp_ntz").alias("et"))


@query("SELECT event_id, true AS has_time FROM events")
def f2_processing_time(spark, d):
    return events(spark, d).select("event_id", (F.current_timestamp() > F.lit("2000-01-01").cast("timestamp")).alias("has_time"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def f3_watermark_of_source(spark, d):
    e = events(spark, d)
    latest = e.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("wm"))
    return e.join(F.broadcast(latest), F.col("ts") >= F.col("wm")).select("event_id")


sql_query("f4_interval_arithmetic", "SELECT event_id, ts + INTERVAL '2' SECOND AS later, value BETWEEN 10 AND 20 AS inside, value <= 10 AS low FROM events", "SELECT event_id, ts + INTERVAL '2' SECOND AS later, value BETWEEN 10 AND 20 AS inside, value <= 10 AS low FROM events", ("events",))
sql_query(
    "f5_window_bounds",
    "SELECT window.start AS window_start, window.end AS window_end, count(*) AS n FROM events GROUP BY window(ts, '1 hour')",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL",
    ("events",),
)
sql_query("f6_split_function", "SELECT c_custkey, array_join(split(c_name, '#'), '|') AS parts FROM customer", "SELECT c_custkey, array_to_string(string_split(c_name, '#'), '|') AS parts FROM customer", ("customer",))
sql_query("f7_upper", "SELECT event_id, upper(event_type) AS label FROM events", "SELECT event_id, upper(event_type) AS label FROM events", ("events",))
sql_query("f8_split_length", "SELECT c_custkey, w AS word, length(w) AS len FROM customer LATERAL VIEW explode(split(c_name, '#')) t AS w", "SELECT c_custkey, w AS word, CAST(length(w) AS INTEGER) AS len FROM customer, LATERAL (SELECT unnest(string_split(c_name, '#')) AS w) t", ("customer",))
sql_query("f9_json", "SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS j FROM nation", """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS j FROM nation""", ("nation",))


@query("SELECT count(*) AS n, count(*) AS distinct_ids, true AS in_range FROM events")
def f10_uuid_and_random(spark, d):
    e = events(spark, d).select(F.expr("uuid()").alias("u"), F.rand(1).alias("r"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("distinct_ids"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"))


sql_query("f11_abs_concat", "SELECT event_id, abs(value - 50) AS gap, concat(event_type, '-', user_id) AS label FROM events", "SELECT event_id, abs(value - 50) AS gap, concat(event_type, '-', user_id) AS label FROM events", ("events",))


@query("SELECT event_id, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 10000 AS window_start FROM events")
def f12_window_start(spark, d):
    return events(spark, d).select("event_id", fn.window_start(F.unix_millis(F.col("ts").cast("timestamp")), 10_000).alias("window_start"))


# ---- keyed state, bounded form


@query("SELECT event_id, user_id, before, vc FROM (SELECT event_id, user_id, CAST(floor(value) AS INTEGER) AS vc, lag(CAST(floor(value) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE abs(vc - before) > 10")
def t14_alarm_on_jump(spark, d):
    e = events(spark, d).withColumn("vc", F.floor("value").cast("int"))
    return R.alarm_on_jump(e, ["user_id"], ["event_id"], "vc", 10).select("event_id", "user_id", "before", "vc")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT CAST(floor(value) AS INTEGER))), ',') AS seen FROM events GROUP BY user_id")
def t16_distinct_values(spark, d):
    s = F.array_sort(F.collect_set(F.floor("value").cast("int")))
    return events(spark, d).groupBy("user_id").agg(F.array_join(F.transform(s, lambda x: x.cast("string")), ",").alias("seen"))


@query("SELECT event_id, CAST(sum(CAST(floor(value) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def t17_running_sum(spark, d):
    e = events(spark, d).withColumn("vc", F.floor("value").cast("int"))
    return R.running(e, ["user_id"], ["event_id"], {"total": F.sum("vc")}).select("event_id", "total")


@query("SELECT event_id, round(avg(CAST(floor(value) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS mean FROM events")
def t18_running_average(spark, d):
    e = events(spark, d).withColumn("vc", F.floor("value").cast("int"))
    return R.running(e, ["user_id"], ["event_id"], {"m": F.avg("vc")}).select("event_id", F.round("m", 6).alias("mean"))


# ---- user-defined functions


@query("SELECT event_id, upper(event_type) AS label FROM events")
def u1_scalar_udf(spark, d):
    fn.register(spark)
    events(spark, d).createOrReplaceTempView("events")
    return spark.sql("SELECT event_id, my_upper(event_type) AS label FROM events")


@query("SELECT user_id, round(avg(CAST(floor(value) AS INTEGER)), 6) AS mean FROM events GROUP BY user_id")
def u2_aggregate_udf(spark, d):
    fn.register(spark)
    events(spark, d).createOrReplaceTempView("events")
    return spark.sql("SELECT user_id, round(my_avg(CAST(floor(value) AS INT)), 6) AS mean FROM events GROUP BY user_id")


@query("SELECT n_nationkey, w AS word, CAST(length(w) AS INTEGER) AS len FROM nation, LATERAL (SELECT unnest(string_split(n_name, '_')) AS w) t")
def u3_table_udf(spark, d):
    fn.register(spark)
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, word, len FROM nation, LATERAL split_words(n_name, '_')")


@query("SELECT event_id, CAST(length(event_type) AS INTEGER) AS n FROM events")
def u4_typed_udf(spark, d):
    return events(spark, d).select("event_id", fn.typed_length("event_type").alias("n"))


@query(TOP2)
def u6_table_aggregate(spark, d):
    """The user-defined table aggregate itself, a partition a user; t7 is the built-in form."""
    fn.register(spark)
    events(spark, d).select("user_id", F.floor("value").alias("vc")).createOrReplaceTempView("t_vc")
    got = spark.sql("SELECT key AS user_id, rank, CAST(value AS INT) AS vc FROM top2_values(TABLE(t_vc) PARTITION BY user_id)")
    return got


# ---- distribution


@query("SELECT CAST(CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS INTEGER) AS part, count(*) AS n FROM events GROUP BY 1")
def e4_custom_partitioner(spark, d):
    dealt = R.partition_by_id(events(spark, d), 2, F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1))
    return dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events)
SELECT 'rebalance' AS partitioner, n, users, 4 AS parts, true AS holds FROM e UNION ALL SELECT 'rescale', n, users, 2, true FROM e UNION ALL SELECT 'key group', n, users, 4, true FROM e
UNION ALL SELECT 'shuffle', n, users, 4, true FROM e UNION ALL SELECT 'broadcast', 4 * n, users, 4, true FROM e UNION ALL SELECT 'global', n, users, 1, true FROM e UNION ALL SELECT 'forward', n, users, 4, true FROM e""")
def e3_partitioners(spark, d):
    """Every way of dealing rows to tasks: no row is lost (broadcast gives each task all of them), the number of tasks is the
    one asked for, and what the partitioner promises holds (counted by task, then added up)."""
    e, out = events(spark, d).select("event_id", "user_id"), None
    for kind in R.PARTITIONERS:
        dealt = R.dealt(e.repartition(4) if kind in ("forward", "rescale") else e, kind, 1 if kind == "global" else 2 if kind == "rescale" else 4, ["user_id"])
        task = dealt.withColumn("part", F.spark_partition_id()).groupBy("part", "user_id").agg(F.count(F.lit(1)).alias("n"))
        total = task.agg(F.sum("n").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("part").cast("int").alias("parts"), F.count(F.lit(1)).alias("pairs"), F.max("n").alias("most"))
        holds = {"key group": F.col("pairs") == F.col("users"), "broadcast": F.col("pairs") == 4 * F.col("users"), "global": F.col("pairs") == F.col("users")}.get(kind, F.lit(True))
        row = total.select(F.lit(kind).alias("partitioner"), "n", "users", "parts", holds.alias("holds"))
        out = row if out is None else out.union(row)
    return out


@query("SELECT word, count(*) AS count FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def e11_word_count(spark, d):
    return R.word_count(table(spark, d, "documents").select(F.translate("text", "\n", " ").alias("text")), "text").filter("word <> ''")
