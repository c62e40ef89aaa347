"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

A candidate is a run of LEAST or more characters of the alphabets that keys are written in; a token may
hold several, and the parts of name=value, or of a dotted token, are judged apart. Its length, character
transitions, dictionary coverage, path and neighbouring words are built-in expressions, and so is the forest:
each tree is a nested CASE. The trees are grown in numpy on the driver from labelled findings, of which a
bounded number is used. The dictionary is learned from the documents that are scanned: words that stand in many of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import made_secrets
from millrace.llm.common import body

#: Characters that a candidate has at least.
LEAST = 12
CANDIDATE = rf"[A-Za-z0-9+/_=\-]{{{LEAST},}}"
#: Characters either side of a candidate, in its token, that are looked at.
NEAR = 64
TREES, DEPTH, LEAST_LEAF, FINDINGS = 15, 6, 5, 8000
#: A word of the dictionary; its cells; in how many rows a cell's words stand together at least, as one in so many.
WORD, CELL_BITS, ONE_IN = "[a-zà-ÿ]{4,}", 16, 200
#: Letter pairs that are frequent in English, French, German and Spanish prose.
COMMON_PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur", "ei", "ie", "un", "qu", "ue", "el", "la", "os", "ai", "au")
FEATURES = ("length", "transitions", "common_pairs", "digits", "upper", "distinct", "hex", "dictionary", "path_test", "near_names_secret", "near_assigns", "quoted", "after_prose", "near_names_digest", "placeholder")


def cell(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - CELL_BITS).cast("int")


def dictionary(df: DataFrame, text_col: str = "text", one_in: int = ONE_IN) -> bytes:
    """Which words are usual, as a byte for each of 2^CELL_BITS cells that words are hashed to: 1 if the cell's
    words stand in one of `one_in` rows or more. All rows are counted, each word once a row; null and empty texts
    have none, no rows give no words. 64 KB at any size.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(body(text_col)), F.lit(WORD), F.lit(0)))
    rows = df.select(F.array_distinct(F.transform(words, cell)).alias("c"))
    n = F.lit(-1)  # a cell that every row has counts the rows
    counted = rows.select(F.explode(F.array_append("c", n)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()  # 2^16 + 1 rows at most
    total = next((r.n for r in counted if r.c == -1), 0)
    out = bytearray(1 << CELL_BITS)
    for r in counted:
        if r.c >= 0 and r.n * one_in >= total:
            out[r.c] = 1
    return bytes(out)


def features(candidate: Column, token: Column, before: Column, before2: Column, after: Column, path: Column, usual: bytes) -> list[Column]:
    """Numbers of FEATURES, in that order. No words around it, or no path, count as empty ones."""
    n = F.greatest(F.char_length(candidate), F.lit(1))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    low = F.lower(candidate)
    near = F.lower(F.concat_ws(" ", F.right(before2, F.lit(NEAR)), F.right(before, F.lit(NEAR)), token))
    known = lambda w: F.substring(F.lit(usual), cell(w) + 1, F.lit(1)) == F.lit(b"\x01")
    covered = F.aggregate(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.lit(0), lambda s, w: s + F.when(known(w), F.char_length(w)).otherwise(0))
    return [
        n.cast("double"),
        count(candidate, r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^a-zA-Z0-9](?=[a-zA-Z0-9])") / n,
        count(low, f"(?={'|'.join(COMMON_PAIRS)})") / n,
        count(candidate, "[0-9]") / n,
        count(candidate, "[A-Z]") / n,
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        candidate.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        covered / n,
        F.coalesce(F.lower(path).rlike("test|example|sample|fixture|mock|docs?/"), F.lit(False)).cast("double"),
        near.rlike("token|secret|passw|api.?key|access.?key|credential|auth|bearer|private").cast("double"),
        near.rlike("[=:]").cast("double"),
        token.rlike("[\"'`]").cast("double"),
        F.coalesce(after.rlike(r"^[a-zà-ÿA-ZÀ-Ý]+[.,;]?$"), F.lit(False)).cast("double"),
        near.rlike("commit|sha|integrity|checksum|digest|revision").cast("double"),
        low.rlike("example|change|dummy|your|test|sample|placeholder|1234567|(.)\\1{7}").cast("double"),
    ]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree: a share of positives, or (feature, threshold, left, right); left is below the threshold."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAST_LEAF or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y) - 1e-9, None)
    for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        cost = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
        cost[(v[1:] == v[:-1]) | (n < LEAST_LEAF) | (len(y) - n < LEAST_LEAF)] = np.inf
        k = int(np.argmin(cost))
        if cost[k] < best[0]:
            best = (cost[k], (int(f), float((v[k] + v[k + 1]) / 2)))
    if best[1] is None:
        return share
    f, at = best[1]
    low = x[:, f] < at
    return f, at, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def train(findings: DataFrame, usual: bytes, limit: int = FINDINGS) -> list:
    """A forest of findings(candidate, token, before, before2, after, path, label 0/1), with a dictionary.

    At most `limit` findings are learned from, those with the least hashes. Null labels and candidates are left
    out; no findings, no trees (all scores 0).
    """
    cols = [F.col(c) for c in ("candidate", "token", "before", "before2", "after", "path")]
    rows = findings.filter("label is not null and candidate is not null").select(*(f.alias(f"f{i}") for i, f in enumerate(features(*cols, usual))), "label", F.xxhash64("candidate", "before", "after").alias("h"))
    got = np.array([tuple(map(float, r)) for r in rows.orderBy("h", *(f"f{i}" for i in range(len(FEATURES)))).limit(limit).collect()]).reshape(-1, len(FEATURES) + 2)
    x, y = got[:, : len(FEATURES)], got[:, len(FEATURES)]
    if not len(y):
        return []
    rng = np.random.default_rng(4)
    pick = [rng.integers(0, len(y), len(y)) for _ in range(TREES)]
    return [grow(x[p], y[p], rng, DEPTH) for p in pick]


def voted(forest: list, names: list[str]) -> Column:
    """Mean share of positives of the leaves that a row comes to. A null feature is not below any threshold."""

    def of(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, at, low, high = tree
        return F.when(F.col(names[f]) < at, of(low)).otherwise(of(high))

    return sum((of(t) for t in forest), F.lit(0.0)) / max(1, len(forest))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, place (number of its token, from 0), nth (number in its token, from 0),
    token (the candidate with up to NEAR characters of its token either side), candidate, the two words
    before its token, the word after it, path. Null text has none.

    A run is divided at each = that is not at its end (padding), and its parts of LEAST or more characters
    are candidates; a run without such a part is one as a whole. Shorter runs are not looked at.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.split(body(text_col), r"\s+").alias("t"))
    at = F.filter(F.transform("t", lambda w, i: F.when(F.length(w) >= LEAST, i)), lambda i: i.isNotNull())
    rows = rows.select("id", "path", "t", F.explode(at).alias("place"))
    word = lambda k: F.get("t", F.col("place") + k)
    rows = rows.select("id", "path", "place", word(0).alias("w"), word(-1).alias("before"), word(-2).alias("before2"), word(1).alias("after"))
    # runs[i] stands between between[i] and between[i + 1]; neither array is carried into the rows of a long token
    rows = rows.withColumns({"runs": F.regexp_extract_all("w", F.lit(CANDIDATE), F.lit(0)), "between": F.split("w", CANDIDATE, -1)}).filter(F.size("runs") > 0)
    ahead = lambda i: F.concat(F.when(i > 0, F.right(F.get("runs", i - 1), F.lit(NEAR))).otherwise(""), F.get("between", i))
    around = lambda r, i: F.concat(F.right(ahead(i), F.lit(NEAR)), r, F.left(F.get("between", i + 1), F.lit(NEAR)))

    def parts(r: Column, i: Column) -> Column:
        long = F.filter(F.split(r, "=+(?!=|$)"), lambda p: F.char_length(p) >= LEAST)
        return F.transform(F.when(F.size(long) > 0, long).otherwise(F.array(r)), lambda p: F.struct(around(r, i).alias("token"), p.alias("candidate")))

    found = F.flatten(F.transform("runs", parts))
    return rows.select("id", "path", "place", "before", "before2", "after", F.posexplode(found).alias("nth", "f")).select("id", "path", "place", "nth", "f.token", "before", "before2", "after", "f.candidate")


def scan(df: DataFrame, forest: list, usual: bytes, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", above: float = 0.5) -> DataFrame:
    """candidates() with score (0 to 1) and is_secret. Rows are independent: null and repeated ids stay as
    they are, null path matches no path word, a long text is split into its words in one task."""
    rows = candidates(df, id_col, text_col, path_col)
    names = [f"_f_{f}" for f in FEATURES]
    cols = [F.col(c) for c in ("candidate", "token", "before", "before2", "after", "path")]
    rows = rows.select("*", *(f.alias(n) for f, n in zip(features(*cols, usual), names, strict=True)))
    rows = rows.withColumn("score", F.round(voted(forest, names), 6))
    return rows.select(F.col("id").alias(id_col), "place", "nth", "token", "candidate", "before", "after", "score", (F.col("score") >= above).alias("is_secret"))


def findings(spark, n: int = 1500, seed: int = 11) -> DataFrame:
    """Labelled candidates of n documents that are written for it (see made_secrets)."""
    written = made_secrets.documents(spark, n, seed)
    return made_secrets.labelled(candidates(written), written)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    usual = dictionary(docs)
    found = scan(docs, train(findings(spark), usual), usual)
    return found.select("doc_id", "place", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.char_length("candidate").alias("n_chars"), "score", "is_secret")
