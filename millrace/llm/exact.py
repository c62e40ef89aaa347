"""Exact dedup: rows grouped by a 128-bit content hash, bytes compared inside each group.

The grouping key is (hash, text). The text in the key is the comparison of bytes: two texts that share
a hash stay two groups. Counts and the kept id are combined on the map side, so a text that fills a
third of the table reaches the shuffle as one row a task. Each row then finds its group by
(hash, SHA-256), a plain equi-join of two exchanges, which adaptive execution splits where it is skewed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import body


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, hash_of: Callable[[Column], Column] = md5_128, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, its group's keep_id and group_size, kept, text_sha256, then carry.

    keep is "smallest" or "largest" id. normalise maps the text before it is compared (none: bytes as
    they are). Null text counts as empty, so null and empty texts are one group. Null ids never win over
    a non-null id; a group whose ids are all null has a null keep_id. Of rows that repeat the kept id in
    one group exactly one is kept. An empty table gives no rows. Other columns of df are read only if
    named in carry; no column name of df can clash with the inner ones, which start with "_x_". The
    input must give the same rows in the same order when it is read twice (a table, not an unordered
    shuffle). hash_of is open so that tests can force collisions.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: smallest or largest, not {keep!r}")
    best, at_best = (F.max, F.max_by) if keep == "largest" else (F.min, F.min_by)
    text = (normalise or (lambda c: c))(body(text_col))
    rows = df.select(F.col(id_col).alias("_x_id"), text.alias("_x_text"), F.monotonically_increasing_id().alias("_x_row"), *(F.col(c).alias(f"_x_c_{c}") for c in carry))
    groups = (
        rows.select("_x_id", "_x_text", "_x_row", hash_of(F.col("_x_text")).alias("_x_hash"))
        .groupBy("_x_hash", "_x_text")
        .agg(F.count(F.lit(1)).alias("_x_n"), best("_x_id").alias("_x_keep"), F.coalesce(at_best("_x_row", "_x_id"), F.max("_x_row")).alias("_x_keep_row"))
        .select("_x_hash", F.sha2("_x_text", 256).alias("_x_sha"), "_x_n", "_x_keep", "_x_keep_row")
    )
    keyed = rows.select("_x_id", "_x_row", hash_of(F.col("_x_text")).alias("_x_hash"), F.sha2("_x_text", 256).alias("_x_sha"), *(f"_x_c_{c}" for c in carry))
    return keyed.join(groups, ["_x_hash", "_x_sha"]).select(
        F.col("_x_id").alias(id_col),
        F.col("_x_keep").alias("keep_id"),
        F.col("_x_n").alias("group_size"),
        (F.col("_x_row") == F.col("_x_keep_row")).alias("kept"),
        F.col("_x_sha").alias("text_sha256"),
        *(F.col(f"_x_c_{c}").alias(c) for c in carry),
    )


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **how) -> DataFrame:
    """The kept rows with all their columns. Cases as in classes()."""
    names = df.columns
    inner = df.toDF(*(f"_d_{i}" for i in range(len(names))))
    found = classes(inner, f"_d_{names.index(id_col)}", f"_d_{names.index(text_col)}", keep, carry=tuple(c for i, c in enumerate(inner.columns) if names[i] != id_col), **how)
    return found.filter("kept").select(*(F.col(f"_d_{i}").alias(n) for i, n in enumerate(names)))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
