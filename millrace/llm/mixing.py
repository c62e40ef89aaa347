"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order fixed by a hash, gets a virtual finish time: the tokens
of its source up to and with it, divided by the source's target. A source may be gone through more than
once (repeats). All finish times are then range-sorted together and cut where the total budget is spent.

Running sums are made in two levels (hash range inside a source, then row), so a source that holds a
third of all rows is spread over many tasks. The cut is found by a histogram that is narrowed until the
range with the cut is small; only that range is put in full order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import body, checkpoint

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one (source, hash range), and of the range that is sorted in full.
ROWS_A_RANGE = 65536
#: Hash ranges at least; finish-time ranges of one round of the search for the cut.
LEAST_RANGES, CUTS = 64, 1000


def words(text: str) -> Column:
    """Number of runs of characters other than the six ASCII white-space characters."""
    return F.regexp_count(body(text), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """source, source_key, source_size to the same with target.

    Sources in code point order, null last, take the weights in turn. Their targets share `share` times
    the total in proportion to the weights, none above `repeats` times its source's size: the level at
    which weight times level fills the total is raised until no further source reaches its cap. Each
    round is one aggregate over the sources; nothing but sums reaches the driver.
    """
    spark = sizes.sparkSession
    ordered = sizes.sort(F.col("source").asc_nulls_last()).select("source", "source_key", "source_size")
    ranked = checkpoint(spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "source string, source_key string, source_size bigint, rank bigint"))
    given = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source_key", "source_size", given.alias("weight"), (F.col("source_size") * float(repeats)).alias("cap"))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    level = budget / weight if weight else 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        spent, rest = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:  # every source is at its cap
            break
        higher = (budget - (spent or 0.0)) / rest
        if higher <= level:
            break
        level = higher
    return ranked.select("source_key", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """One row per input row: its id, size, source_size, target, times and taken (size x times), row.

    row is monotonically_increasing_id() over df, by which take() finds the rows again. Null text has
    size 0. Null source is a source of its own, last in order. Null and repeated ids are ordinary rows:
    order inside a source is by (hash of id and size, id, row). Rows of size 0 take nothing and are
    never emitted. If all sizes are 0 all targets are 0. An empty table gives no rows. Reruns agree.
    """
    key = F.coalesce(F.concat(F.lit("v"), F.col(source_col)), F.lit("n"))
    size = words(text_col)
    base = checkpoint(
        df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), key.alias("source_key"), size.alias("size"), F.monotonically_increasing_id().alias("row")).withColumn("order", F.xxhash64(F.lit(seed), "id", "size"))
    )
    n = base.count()
    bits = max(LEAST_RANGES - 1, n // ROWS_A_RANGE).bit_length()
    base = base.withColumn("range", F.shiftrightunsigned("order", 64 - bits))
    sums = checkpoint(base.groupBy("source", "source_key", "range").agg(F.sum("size").alias("range_size")))
    goals = targets(sums.groupBy("source", "source_key").agg(F.sum("range_size").alias("source_size")), weights, share, repeats)
    before = F.sum("range_size").over(Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("source_key", "range", F.coalesce(before, F.lit(0)).alias("start")).join(goals, "source_key")
    inside = F.sum("size").over(Window.partitionBy("source_key", "range").orderBy("order", "id", "row").rowsBetween(Window.unboundedPreceding, 0))
    placed = checkpoint(base.withColumn("upto", inside).join(starts, ["source_key", "range"]).select("id", "source_key", "size", "row", "order", "source_size", "target", (F.col("start") + F.col("upto")).alias("upto")))

    every = placed.filter("size > 0 and target > 0").select("source_key", "order", "row", "size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"), "upto", "source_size", "target")
    every = every.select("size", "turn", "source_key", "order", "row", ((F.col("upto") + F.col("turn") * F.col("source_size")) / F.col("target")).alias("finish"))
    budget = goals.agg(F.sum("target")).first()[0] or 0.0
    times = F.lit(0)
    cut = cut_at(every, budget)
    if cut is not None:
        for turn in range(repeats):
            finish = (F.col("upto") + turn * F.col("source_size")) / F.col("target")
            here = F.struct(finish.alias("a"), F.col("order").alias("b"), F.col("source_key").alias("c"), F.lit(turn).alias("d"), F.col("row").alias("e"))
            last = F.struct(*(F.lit(v).cast(t).alias(a) for a, v, t in zip("abcde", cut, ("double", "bigint", "string", "int", "bigint"), strict=True)))
            times = times + F.when((F.col("size") > 0) & (F.col("target") > 0) & (here <= last), 1).otherwise(0)
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", times.cast("bigint").alias("times"), (F.col("size") * times).cast("bigint").alias("taken"), "row")


def narrowed(rows: DataFrame, by: str, spent: int, budget: float) -> tuple[DataFrame, object, object, int]:
    """The rows of the range of `by` in which the budget is spent, that range's ends, and what is spent before it. The
    range is narrowed by histograms of CUTS parts until it has few rows or one value."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    inside = rows
    while True:
        width = (float(high) - float(low)) / CUTS
        if width <= 0 or float(low) + width <= float(low):
            return inside, low, high, spent
        at = F.greatest(F.least(F.floor((F.col(by).cast("double") - float(low)) / width), F.lit(CUTS - 1)), F.lit(0)).cast("int")
        counts = sorted(inside.groupBy(at.alias("at")).agg(F.sum("size"), F.count(F.lit(1)), F.min(by), F.max(by)).collect())  # CUTS rows
        for k, (_, size, n, first, last) in enumerate(counts):
            if spent + size > budget or k == len(counts) - 1:
                break
            spent += size
        inside = rows.filter(F.col(by).between(first, last))
        if n <= ROWS_A_RANGE or (first, last) == (low, high):
            return inside, first, last, spent
        low, high = first, last


def cut_at(every: DataFrame, budget: float) -> tuple | None:
    """(finish, order, source_key, turn, row) of the last copy within the budget; None if none is.

    Sources of one document finish at the same time, so a finish time may have as many copies as there are sources; they are
    in order of their hash, and that range is narrowed as well.
    """
    if every.isEmpty():
        return None
    inside, first, last, spent = narrowed(every, "finish", 0, budget)
    before = F.col("finish") < first
    if first == last and inside.count() > ROWS_A_RANGE:
        inside, least, _, spent = narrowed(inside, "order", spent, budget)
        before = before | ((F.col("finish") == first) & (F.col("order") < least))
    by = ["finish", "order", "source_key", "turn", "row"]
    inside = inside.withColumn("total", F.sum("size").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    within = inside.filter(F.col("total") + spent <= budget).orderBy(*(F.col(c).desc() for c in by)).select(*by).first()
    if within is None:  # the last one before this range
        within = every.filter(before).orderBy(*(F.col(c).desc() for c in by)).select(*by).first() if spent else None
    return tuple(within) if within else None


def take(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each row of df as many times as it is taken, with its own columns."""
    names = df.columns
    inner = df.toDF(*(f"_m_{i}" for i in range(len(names))))
    at = {c: f"_m_{names.index(how.pop(c, d))}" for c, d in (("text_col", "text"), ("source_col", "source"))}
    found = mix(inner, f"_m_{names.index(id_col)}", at["text_col"], at["source_col"], **how)
    chosen = found.filter("times > 0").select(F.col("row").alias("_m_row"), "times")
    kept = inner.withColumn("_m_row", F.monotonically_increasing_id()).join(chosen, "_m_row")
    return kept.withColumn("_m_turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*(F.col(f"_m_{i}").alias(n) for i, n in enumerate(names)))


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
