"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

Each distinct line has a HyperLogLog sketch of the sites it stands on; sketches are merged by aggregation,
so a line on a third of all rows reaches the shuffle as one small sketch a task. A line whose estimate is
near the threshold is counted exactly. Lines at or above it are removed wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import body, checkpoint

SITES = 10
#: log2 of a sketch's buckets, and the relative distance from the threshold within which lines are counted
#: exactly: four standard errors of the sketch.
LG_K, NEAR = 9, 4 * 1.04 / 2**4.5


def spread(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """lines(key, site) to the keys that stand on at least `sites` distinct sites. Null sites don't count."""
    sketched = checkpoint(lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("about")).filter(F.col("about") >= sites * (1 - NEAR) - 1))
    above = F.col("about") > sites * (1 + NEAR) + 1
    near = checkpoint(sketched.filter(~above).select("key"))
    # by another expression than the join's, so the count has its own exchange and a hot line's join can be split
    pairs = lines.join(near, "key", "left_semi").select(F.hex("key").alias("hex"), "site").distinct()
    exact = pairs.groupBy("hex").agg(F.count("site").alias("n")).filter(F.col("n") >= sites).select(F.unhex("hex").alias("key"))
    return checkpoint(sketched.filter(above).select("key").union(exact))


def remove_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """One row per input row: id, n_lines, n_removed, kept_text.

    Lines end at line feeds and are compared without white space at their ends. Blank lines are never
    removed. Null text is one blank line. Rows of a null site lose lines but count for no line. Ids may be
    null or repeat: the sites of a line count, not its rows. An empty table gives no rows. df must give the
    same rows in the same order when read twice.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), body(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    each = rows.select("site", "row", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    each = each.select("site", "row", "place", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).filter("line <> ''")
    each = checkpoint(each.select("site", "row", "place", F.unhex(F.md5("line")).alias("key")))
    found = spread(each.select("key", "site"), sites)
    bad = checkpoint(each.join(found, "key", "left_semi").groupBy("row").agg(F.collect_list("place").alias("bad")))
    joined = rows.join(bad, "row", "left").select("id", F.split("text", "\n").alias("lines"), "bad")
    n = F.size("lines")
    good = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("bad", F.array().cast("array<int>")))
    joined = joined.select("id", "lines", good.alias("good"))
    return joined.select(F.col("id").alias(id_col), F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("good")).cast("bigint").alias("n_removed"), F.array_join(F.transform("good", lambda i: F.get("lines", i)), "\n").alias("kept_text"))


def op4_line_spread(spark, sf_dir: str) -> DataFrame:
    found = remove_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
s AS (SELECT *, regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS bare FROM l),
b AS (SELECT bare FROM s WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
f AS (SELECT s.*, b.bare IS NOT NULL AS gone FROM s LEFT JOIN b ON s.bare = b.bare)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
