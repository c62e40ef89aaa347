"""Language ID: averaged hashed subword embeddings with a linear softmax, calibrated rejection.

A text is the mean of the embeddings of its subwords: letter n-grams of one to four characters, which may
take in one word boundary on either side, hashed into buckets. A softmax layer on that mean gives the
language. Both are trained by stochastic gradient descent in numpy, on fragments of a bounded sample of
labelled rows. The layers being linear, a bucket's share in every language's score is one row of a
matrix, so prediction is a gather and a segmented sum over the whole text.

Calibration: a temperature is fitted on sampled documents held out of the descent, so scores are
probabilities; below the score that all but a small part of their fragments of its length exceed, a text
is rejected. Lengths are classes of the number of subwords, by powers of four: a few words of a learned
language may score little more than chance, so short texts have a low level and long ones a high one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import body, ship

UNKNOWN = "und"
BUCKETS, WIDTH, LONGEST = 1 << 15, 16, 4
#: Lengths in characters of the fragments that one sampled document gives, at places chosen by its hash.
FRAGMENTS = (8, 24, 96, 400)
BLOCK_CHARS = 1 << 20
#: Classes of length, and the fragments of one class from which on it has a level of its own.
CLASSES, LEAST = 12, 400


@dataclass
class Model:
    languages: list[str]
    votes: np.ndarray  # a bucket's share in each language's score
    bias: np.ndarray
    temperature: float
    levels: np.ndarray  # per class of length: texts that score less are rejected

    def level(self, counts: np.ndarray) -> np.ndarray:
        return self.levels[length_class(counts)]


def length_class(counts: np.ndarray) -> np.ndarray:
    """floor(log4(number of subwords)), 0 for none."""
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) // 2, CLASSES - 1)


def levels(top: np.ndarray, counts: np.ndarray, keep: float, least: int = LEAST) -> np.ndarray:
    """Per class of length the score that a share keep of its fragments exceeds.

    A class with fewer than `least` fragments takes the level of the next shorter class that has enough, or
    of all fragments if none has; no class has a higher level than a longer one.
    """
    found, now, at = np.empty(CLASSES), np.quantile(top, 1 - keep), length_class(counts)
    for c in range(CLASSES):
        if (at == c).sum() >= least:
            now = np.quantile(top[at == c], 1 - keep)
        found[c] = now
    return np.minimum.accumulate(found[::-1])[::-1]


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


_LETTER: list[np.ndarray] = []


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all texts in one array, and how many each text has (0: no letters)."""
    if not _LETTER:
        _LETTER.append(_letters())
    lowered = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, lowered), np.int64, len(texts)))
    codes = np.where(_LETTER[0][codes], codes, 0).astype(np.uint32)
    on = np.ones(len(codes), bool)
    on[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])  # one boundary between words, and each text's own
    codes, owner = codes[on], owner[on]
    letter = codes != 0
    found, of = [], []
    h = np.zeros(len(codes), np.uint32)
    inner = np.ones(len(codes), bool)  # all but the first and the last are letters
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        if n > 2:
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        fit = inner[:m] & (owner[:m] == owner[n - 1 :]) & (letter[:m] | letter[n - 1 :])
        mixed = h[fit]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append((mixed >> np.uint32(17)).astype(np.int32))
        of.append(owner[:m][fit])
    if not found:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    buckets, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return buckets[order], np.bincount(of, minlength=len(texts))


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each text's languages (rows of zeros: no letters) and the number of subwords."""
    out, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    begin = 0
    while begin < len(texts):
        stop, chars = begin, 0
        while stop < len(texts) and (stop == begin or chars + len(texts[stop]) <= BLOCK_CHARS):
            chars += len(texts[stop])
            stop += 1
        buckets, n = subwords(texts[begin:stop])
        counts[begin:stop] = n
        have = np.flatnonzero(n)
        if len(have):
            starts = (np.cumsum(n) - n)[have]
            z = np.stack([np.add.reduceat(model.votes[:, k][buckets], starts) for k in range(len(model.languages))], 1) / n[have][:, None] + model.bias
            z /= model.temperature
            z = np.exp(z - z.max(1, keepdims=True))
            out[begin + have] = z / z.sum(1, keepdims=True)
        begin = stop
    return out, counts


def train(texts: list[str], labels: list[str], keys: list[int], epochs: int = 6, rate: float = 0.5, keep: float = 0.999) -> Model:
    """Texts are fragments; keys group those of one document, a fifth of which calibrate."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    held = np.array([k % 5 == 0 for k in keys], bool)
    if held.all():
        held[:] = False
    buckets, n = subwords(texts)
    ends = np.cumsum(n)
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    rows = np.flatnonzero(~held & (n > 0))
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(rows):
            at, count = np.unique(buckets[ends[i] - n[i] : ends[i]], return_counts=True)
            share = (count / n[i])[:, None]
            mean = (embed[at] * share).sum(0)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            lr = rate * (1 - step / steps)
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            embed[at] -= lr * len(at) ** 0.5 * share * back
            step += 1
    model = Model(languages, (embed @ out).astype(np.float32), bias.astype(np.float32), 1.0, np.zeros(CLASSES))
    check = np.flatnonzero(held & (n > 0)) if (held & (n > 0)).any() else rows
    if len(check):
        own = [texts[i] for i in check]
        loss = []
        for t in (grid := np.geomspace(0.25, 8, 21)):
            model.temperature = float(t)
            p, _ = scores(model, own)
            loss.append(-np.log(np.maximum(p[np.arange(len(check)), y[check]], 1e-9)).mean())
        model.temperature = float(grid[int(np.argmin(loss))])
        p, _ = scores(model, own)
        model.levels = levels(p.max(1), n[check], keep)
    return model


def held_out(id_col: str) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000, fragments: tuple[int, ...] = FRAGMENTS, **how) -> Model | None:
    """A model of the labelled rows that are not held out; None if there are none.

    About sample_rows rows are learned from (the same expected number of each language, all if it has
    fewer), chosen by a hash of the text. Of each only fragments of the lengths in `fragments` come to the driver, so
    what is gathered is bounded by sample_rows times a kilobyte or two, however long the texts are.
    """
    rows = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull()).select(body(text_col).alias("_x_text"), F.col(lang_col).cast("string").alias("_x_lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("_x_lang").count().collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    wanted = F.create_map(*(F.lit(x) for k, c in counts.items() for x in (k, min(1.0, each / c))))
    share = F.try_element_at(wanted, F.col("_x_lang"))
    key = F.xxhash64(F.lit(5), "_x_text")
    rows = rows.withColumn("_x_key", key).filter(F.pmod("_x_key", F.lit(1 << 20)) < share * (1 << 20))
    n = F.char_length("_x_text")
    cut = [F.substring("_x_text", (F.pmod(F.xxhash64(F.lit(size), "_x_key"), F.greatest(n - size, F.lit(0)) + 1) + 1).cast("int"), F.lit(size)) for size in fragments]
    found = sorted(tuple(r) for r in rows.select(F.pmod("_x_key", F.lit(1 << 40)).alias("k"), "_x_lang", *cut).distinct().collect())
    texts = [(t, lang, k) for k, lang, *own in found for t in own]
    return train(*(list(x) for x in zip(*texts, strict=True)), **how) if texts else None


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), reject: bool = False) -> DataFrame:
    """id, lang_pred, score, rejected, then the columns in keep.

    lang_pred is `und`, score 0 and rejected true if text is null or has no letters, or if there is no
    model. With reject, texts with a score under the level of their length are `und` too. Whole texts are read,
    however long; rows are independent, so repeated and null ids are as they are.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers
    schema = df.select(F.col(id_col).alias("id"), *keep).schema
    ddl = ", ".join([f"`{id_col}` {schema['id'].dataType.simpleString()}", "lang_pred string", "score double", "rejected boolean", *(f"`{c}` {schema[c].dataType.simpleString()}" for c in keep)])

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score, out = np.array([UNKNOWN] * n, object), np.zeros(n), np.ones(n, bool)
            if m is not None and n:
                p, counts = scores(m, batch.column(1).to_pylist())
                score = p.max(1)
                out = (counts == 0) | (score < m.level(counts))
                lang = np.array([*m.languages, UNKNOWN], object)[np.where(counts == 0, len(m.languages), p.argmax(1))]
                if reject:
                    lang[out] = UNKNOWN
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(out), *(batch.column(2 + i) for i in range(len(keep)))], [id_col, "lang_pred", "score", "rejected", *keep])

    return df.select(F.col(id_col), body(text_col).alias("_x_text"), *keep).mapInArrow(run, ddl)


def keep_known(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df that are not rejected, with their own columns."""
    spark = df.sparkSession
    ship(spark)
    names = df.columns
    inner = df.toDF(*(f"_l_{i}" for i in range(len(names))))
    own = {c: f"_l_{names.index(c)}" for c in (id_col, text_col, lang_col)}
    model = fit(inner, own[id_col], own[text_col], own[lang_col])
    shared = spark.sparkContext.broadcast(model)
    at = names.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            if m is None or not batch.num_rows:
                continue
            p, counts = scores(m, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array((counts > 0) & (p.max(1) >= m.level(counts))))

    return inner.mapInArrow(run, inner.schema).toDF(*names)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
