"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Five-word shingles weigh term frequency times inverse document frequency, 1 + ln(rows / rows with the shingle).
Frequencies are counted over all rows in a hashed table of fixed size. A shingle's frequency below COMMON of the rows
is taken as COMMON, so collisions of the table (far below it, at any size) do not matter and weights do not depend
on the number of rows. What near copies share is no boilerplate, however many there are: texts that share their least
shingle hash, where these are more than a ten-thousandth of all rows, count as one row together.

Each of BANDS x ROWS hash functions samples one shingle of a text in proportion to weight (Ioffe 2010); its
random draws come from a fixed pool by the shingle's hash. Texts that agree in a whole band share a bucket.
Buckets hold distinct texts only, and buckets with the same members are one bucket. Inside a bucket the
weighted Jaccard similarity of the texts themselves decides, by a search that visits each text once. Large
buckets are searched in chunks that share some members. Texts that this leaves outside the bucket's largest component
meet the others by prefixes: of the rarest shingles of a text, those that make up a fifth of its weight. Two texts whose
similarity reaches 0.8 share a shingle of their prefixes, so texts are only compared with those of the
bucket that have one of theirs; what is common in a bucket is in no prefix. (A bucket with no more than CHUNK of them is read
once, against all of them.) Links become classes by connected components.
"""

from __future__ import annotations

import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import graph
from millrace.llm.common import HOT_KEYS, body, checkpoint, parts, ship, split_join

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
TABLE_BITS, TABLE_BLOCKS = 18, 64
#: Share of rows below which all shingles weigh the same.
COMMON = 0.1
POOL_BITS = 14
#: Distance of weights that draw alike, and up to which level their draws are kept in tables (4 MB each).
STEP, TABLES = 0.25, 12
#: Texts of one chunk of a bucket, members that all chunks of a bucket share, words that a task remembers, bits of the filter of prefixes.
CHUNK, SHARED, MEMORY_WORDS, FILTER_BITS = 256, 8, 200_000, 20
BLOCK_CHARS = 1 << 18
#: Rows with a frequent least hash that are named to the tasks one by one (8 MB).
LISTED = 1_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Words(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def least_hashes(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least scrambled hash of each run of shingles that is not empty."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return np.minimum.reduceat(mix(shingles ^ U(0x9E3779B97F4A7C15)), starts) if len(starts) else np.empty(0, U)


class Shingler:
    """Shingle hashes of texts; words are runs without white space, lower-case."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.words = size, Words()
        self.factors = mix(np.arange(1, size + 1, dtype=U)) | U(1)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of all texts in text order, and how many each text has. A text of fewer words than a shingle is one."""
        if len(self.words) > MEMORY_WORDS:
            self.words.clear()
        flat, ends = array.array("Q"), []
        known = self.words.__getitem__
        for t in texts:
            flat.extend(map(known, t.lower().split()))
            ends.append(len(flat))
        flat = np.append(np.frombuffer(flat, U), np.zeros(self.size - 1, U))
        ends = np.array(ends, np.int64)
        lens = np.diff(ends, prepend=0)
        n = np.where(lens > 0, np.maximum(lens - self.size + 1, 1), 0)
        total = int(ends[-1]) if len(ends) else 0
        every = np.zeros(total, U)  # at each word, whatever texts the next words are of
        for j in range(self.size):
            every += flat[j : j + total] * self.factors[j]
        place = np.repeat(ends - lens, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        h = every[place]
        short = np.flatnonzero((lens > 0) & (lens < self.size))
        for j in range(1, self.size):  # take the words of the next texts out again
            over = short[lens[short] <= j]
            h[(np.cumsum(n) - n)[over]] -= flat[(ends - lens)[over] + j] * self.factors[j]
        return mix(h), n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of all texts in one array (ascending in each text), their counts, how many each text has."""
        h, n = self.grams(texts)
        owner = np.repeat(np.arange(len(texts), dtype=np.uint16 if len(texts) < 1 << 16 else np.int64), n)
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        return h[new], np.diff(np.append(start, len(h))), np.bincount(owner[new], minlength=len(texts))


class Weights:
    """Inverse document frequencies from the hashed table; no rows, no shingle is common."""

    def __init__(self, table: np.ndarray, rows: float):
        self.share = (table / max(rows, 1)).astype(np.float32)
        self.idf = 1 - np.log(np.clip(self.share, COMMON, 1).astype(float))

    def cell(self, shingles: np.ndarray) -> np.ndarray:
        return (shingles >> U(64 - TABLE_BITS)).astype(np.int64)

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.idf[self.cell(shingles)]

    def prefix(self, shingles: np.ndarray, counts: np.ndarray, similar: float) -> np.ndarray:
        """Of one text's shingles the rarest, up to where the others weigh less than `similar` of the whole."""
        w = self(shingles, counts)
        order = np.lexsort((shingles, self.share[self.cell(shingles)]))
        left = w.sum() - np.cumsum(w[order])
        return shingles[order[: int(np.argmax(left < similar * w.sum() - 1e-9)) + 1]]


class Sampler:
    """Consistent weighted samples. Weights are taken to the next of a grid, STEP apart in their logarithm, so what a shingle
    draws comes from a table of its weight's level; the similarity that decides afterwards has the weights themselves."""

    def __init__(self):
        rng = np.random.default_rng(20)
        n = BANDS * ROWS
        self.r = rng.gamma(2, 1, (n, 1 << POOL_BITS))
        self.c = np.log(rng.gamma(2, 1, (n, 1 << POOL_BITS)))
        self.b = rng.random((n, 1 << POOL_BITS))
        self.factors = mix(np.arange(101, 101 + n, dtype=U)) | U(1)
        self.tables = {}

    def draws(self, j, at, level: int) -> np.ndarray:
        """ln a of Ioffe's sampling as a number that sorts in the same order."""
        r, b = self.r[j][at], self.b[j][at]
        t = np.floor(level * STEP / r + b)
        bits = (self.c[j][at] - r * (t - b) - r).astype(np.float32).view(np.uint32)
        return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))

    def table(self, level: int) -> np.ndarray:
        if level not in self.tables:
            self.tables[level] = np.stack([self.draws(j, slice(None), level) for j in range(BANDS * ROWS)])
        return self.tables[level]

    def bands(self, shingles: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """BANDS keys for each text that has shingles."""
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        levels = np.maximum(np.rint(np.log(weights) / STEP), 0).astype(np.int64)
        found, times = np.unique(levels, return_counts=True)
        most = int(found[np.argmax(times)]) if len(found) and found[np.argmax(times)] <= TABLES else 0
        others = [(int(x), np.flatnonzero(levels == x)) for x in found if x != most]
        low = shingles & U(0xFFFFFFFF)
        keys = np.zeros((len(starts), BANDS), U)
        spot, draw, v = np.empty(len(shingles), U), np.empty(len(shingles), np.uint32), np.empty(len(shingles), U)
        at = spot.view(np.int64)
        for j in range(BANDS * ROWS):
            np.multiply(shingles, self.factors[j], out=spot)
            np.right_shift(spot, U(64 - POOL_BITS), out=spot)
            np.take(self.table(most)[j], at, out=draw, mode="clip")  # all are inside; clip spares a copy
            for level, which in others:
                draw[which] = self.table(level)[j][at[which]] if level <= TABLES else self.draws(j, at[which], level)
            np.left_shift(draw, U(32), out=v)
            np.bitwise_or(v, low, out=v)
            least = np.minimum.reduceat(v, starts)
            band = j // ROWS
            keys[:, band] = mix(keys[:, band] * U(0x9E3779B97F4A7C15) + least + U(band + 1))
        return keys.view(np.int64)


def in_blocks(texts: list[str]):
    begin = chars = 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= BLOCK_CHARS:
            yield begin, k + 1
            begin, chars = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def document_frequencies(rows: DataFrame, hot: int = HOT_KEYS, listed: int = LISTED) -> tuple[np.ndarray, float]:
    """Number of rows by hashed shingle, over all rows; number of rows. Rows with the same least shingle hash, where these
    are more than a hot-th of all rows (so fewer than `hot` hashes at any size), count as one row together.

    Each text is read once, for its shingles and its least hash; what rows with a frequent least hash count too much is
    taken off in a second pass over these rows (over all rows, where they are more than `listed`). Tasks' tables are
    summed by block.
    """
    spark = rows.sparkSession

    def tables(table):
        pack = zstandard.ZstdCompressor(level=1)
        return [pack.compress(x.astype(np.float32).tobytes()) for x in table.reshape(TABLE_BLOCKS, -1)]

    def count(batches):
        shingler, table = Shingler(), np.zeros(1 << TABLE_BITS)
        for batch in batches:
            texts, begun = batch.column(0).to_pylist(), 0
            for a, b in in_blocks(texts):
                found, _, sizes = shingler(texts[a:b])
                table += np.bincount((found >> U(64 - TABLE_BITS)).astype(np.int64), minlength=1 << TABLE_BITS)
                least = np.zeros(b - a, np.int64)
                least[sizes > 0] = least_hashes(found, sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(begun, b - a), pa.array(least, mask=sizes == 0), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names)
                begun = b
        none = pa.nulls(TABLE_BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(range(TABLE_BLOCKS), pa.int32()), pa.array(tables(table), pa.binary())], names)

    def add(batches):
        sums = {}
        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.float32)
                sums[k] = sums[k] + own if k in sums else own.astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "table"])

    def summed(blocks: DataFrame) -> np.ndarray:
        table = np.zeros((TABLE_BLOCKS, (1 << TABLE_BITS) // TABLE_BLOCKS))
        for r in blocks.repartition(TABLE_BLOCKS, "block").mapInArrow(add, schema).collect():  # 2 MB at any size
            table[r.block] = np.frombuffer(r.table, np.float64)
        return table.ravel()

    schema, names = "block int, table binary", ["row", "least", "block", "table"]
    counted = checkpoint(rows.select("text", "row").mapInArrow(count, f"row bigint, least bigint, {schema}"))
    table = summed(counted.filter("block IS NOT NULL").select("block", "table"))
    total = counted.filter("block IS NULL").count()
    often = checkpoint(counted.filter("least IS NOT NULL").groupBy("least").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("n") * hot > total)))
    many = {r.least: r.n for r in often.collect()}
    if not many:
        return table, total
    held = spark.sparkContext.broadcast((np.array(sorted(many), np.int64), np.array([many[k] for k in sorted(many)], np.int64)))

    def excess(batches):
        keys, times = held.value
        shingler, table = Shingler(), np.zeros(1 << TABLE_BITS)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_blocks(texts):
                found, _, sizes = shingler(texts[a:b])
                least, part = least_hashes(found, sizes).view(np.int64), np.zeros(b - a)
                at = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
                part[sizes > 0] = np.where(keys[at] == least, 1 - 1 / times[at], 0)
                table += np.bincount((found >> U(64 - TABLE_BITS)).astype(np.int64), np.repeat(part, sizes), minlength=1 << TABLE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(TABLE_BLOCKS), pa.int32()), pa.array(tables(table), pa.binary())], ["block", "table"])

    chosen = rows.select("text", "row")
    if sum(many.values()) <= listed:
        own = counted.join(F.broadcast(often.select("least")), "least", "left_semi").select("row")  # least: fewer than `hot`
        chosen = chosen.join(F.broadcast(own), "row", "left_semi")
    return table - summed(chosen.select("text").mapInArrow(excess, schema)), total - sum(many.values()) + len(many)


def linked(texts: list[str], weights: Weights, shingler: Shingler, similar: float, pairs_of=None) -> np.ndarray:
    """For each text the first text of its component under `similar`; pairs_of: only texts in different parts are compared."""
    sh, counts, sizes = shingler(texts)
    w = weights(sh, counts)
    uid = np.unique(sh, return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    total = np.array([w[a : a + n].sum() for a, n in zip(starts, sizes, strict=True)])
    label, open_ = np.full(len(texts), -1), np.flatnonzero(sizes > 0)
    dense = np.zeros(int(uid.max()) + 1 if len(uid) else 0)
    label[sizes == 0] = np.flatnonzero(sizes == 0)
    while len(open_):
        seed, open_ = open_[0], open_[1:]
        label[seed] = seed
        queue = [seed]
        while queue and len(open_):
            q = queue.pop()
            own = slice(starts[q], starts[q] + sizes[q])
            dense[uid[own]] = w[own]
            near = open_[(np.minimum(total[open_], total[q]) >= similar * np.maximum(total[open_], total[q]) - 1e-9)]
            if len(near):
                n = sizes[near]
                upto = np.cumsum(n)
                at = np.repeat(starts[near] - (upto - n), n) + np.arange(int(upto[-1]))
                common = np.add.reduceat(np.minimum(w[at], dense[uid[at]]), upto - n)
                hit = near[common >= similar * (total[near] + total[q] - common) - 1e-9]
                if len(hit):
                    label[hit] = seed
                    queue += hit.tolist()
                    open_ = open_[~np.isin(open_, hit)]
            dense[uid[own]] = 0
    return label


def verify(grouped: DataFrame, weights, similar: float) -> DataFrame:
    """Rows (key, chunk, node, packed text), to links (a, b) between texts of one (key, chunk)."""

    def run(batches):
        w, shingler = weights.value, Shingler()
        group, nodes, texts = None, [], []
        unpack = zstandard.ZstdDecompressor()

        def close():
            label = linked(texts, w, shingler, similar)
            at = np.flatnonzero(label != np.arange(len(label)))
            ids = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], ["a", "b"])

        for batch in batches:
            for key, chunk, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, chunk) != group:
                    if len(nodes) > 1:
                        yield close()
                    group, nodes, texts = (key, chunk), [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    texts.append(unpack.decompress(text).decode())
        if len(nodes) > 1:
            yield close()

    n = parts(grouped.sparkSession)
    dealt = grouped.select("key", "chunk", "node", "packed").repartition(n, "key", "chunk").sortWithinPartitions("key", "chunk", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per input row: the id, class_id (least id of its class), class_size (rows), kept (one row of each class), row.

    A class is a connected component of texts that are equal or have a weighted Jaccard similarity of at
    least `similar`. Null counts as empty; texts without words are alike only if equal. Texts of fewer
    than five words are one shingle. Null ids are least in order only if a class has no other (its
    class_id is then null); of rows that repeat the least id one is kept. An empty table gives no rows.
    df must be a table or another input that gives the same rows in the same order when read twice.
    row is monotonically_increasing_id() over df.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("id"), body(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    table, n = document_frequencies(rows)
    weights = spark.sparkContext.broadcast(Weights(table, n))  # 2 MB

    def sign(batches):
        w, shingler = weights.value, Shingler()
        sampler = Sampler()
        for batch in batches:
            texts, begun = batch.column(0).to_pylist(), 0
            for a, b in in_blocks(texts):
                sh, counts, sizes = shingler(texts[a:b])
                keys = np.zeros((b - a, 0), np.int64)
                have = sizes > 0
                keys = sampler.bands(sh, w(sh, counts), sizes) if have.any() else np.zeros((0, BANDS), np.int64)
                offsets = np.concatenate(([0], np.cumsum(have * BANDS))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begun, b - a) for i in (1, 2, 3)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["id", "row", "hash", "bands"])
                begun = b

    schema = f"id {rows.schema['id'].dataType.simpleString()}, row bigint, hash binary, bands array<bigint>"
    signed = checkpoint(rows.select("text", "id", "row", F.unhex(F.md5("text")).alias("hash")).mapInArrow(sign, schema))
    texts = checkpoint(signed.groupBy("hash").agg(F.min("row").alias("node")))  # one row a distinct text
    first = signed.join(texts.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    first = checkpoint(first)
    mark = F.xxhash64("node")
    buckets = first.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftrightunsigned(mark, 24)).alias("y")).filter("n > 1")
    buckets = checkpoint(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    members = first.join(buckets, "key")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    big = F.col("n") > CHUNK
    own = F.when(big, F.pmod(F.xxhash64("node", F.lit(3)), chunks).cast("int")).otherwise(0)
    pilot = big & (F.pmod(F.xxhash64("node", "key"), F.col("n")) < SHARED)
    where = F.when(pilot, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))
    wanted = checkpoint(members.groupBy("node").agg(F.collect_list(F.struct("key", "n", where.alias("chunks"))).alias("in")))

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["node", "packed"])

    packed = rows.select("row", "text").mapInArrow(pack, "node bigint, packed binary")
    dealt = checkpoint(packed.join(wanted, "node").select("node", "packed", F.explode("in").alias("at")).select("node", "packed", "at.key", "at.n", "at.chunks"))
    links = checkpoint(verify(dealt.withColumn("chunk", F.explode("chunks")), weights, similar))
    found = checkpoint(graph.components(links))
    large = dealt.filter(F.col("n") > CHUNK).select("key", "node", "packed")
    if not large.isEmpty():
        more = rest(large, found, weights, similar)
        if more is not None and not more.isEmpty():
            stars = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))  # the components so far
            found = checkpoint(graph.components(stars.union(more)))

    named = signed.join(texts, "hash").select("id", "row", "node")
    named = named.join(found, "node", "left").select("id", "row", F.coalesce("component", "node").alias("component"))
    named = checkpoint(named)
    info = checkpoint(named.groupBy("component").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.coalesce(F.min_by("row", "id"), F.min("row")).alias("first")))
    return named.join(info, "component").select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept"), "row")


def rest(large: DataFrame, found: DataFrame, weights, similar: float) -> DataFrame | None:
    """Links that the chunks of large buckets may have missed, None if there can be none.

    Texts outside their bucket's largest component are queries. Up to CHUNK queries are compared with each chunk of their
    bucket, which is read once. More of them meet only texts of the bucket that share a shingle of their prefixes, which loses no pair of at least `similar`: a filter of fixed size keeps the shingles that
    are in no query's prefix from being shuffled, texts that share a shingle are a group, groups with the same members are
    one, and in a group of more than CHUNK texts blocks of queries are compared with chunks of the group.
    """
    spark = large.sparkSession
    named = checkpoint(large.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), "packed"))
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    most = checkpoint(sizes.groupBy("key").agg(F.max_by("component", "m").alias("largest"), F.sum("m").alias("all"), F.max("m").alias("m")).filter("m < all"))
    if most.isEmpty():
        return None
    named = split_join(named, most, ["key"], "all").select("key", "node", (F.col("component") != F.col("largest")).alias("query"), "packed", "all", (F.col("all") - F.col("m")).alias("asked"))
    named = checkpoint(named)
    chunks = F.ceil(F.col("all") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), chunks).cast("int")
    few = named.filter(F.col("asked") <= CHUNK).withColumn("chunk", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))))
    more = verify(few, weights, similar)
    named = named.filter(F.col("asked") > CHUNK).select("key", "node", "query", "packed")
    if named.isEmpty():
        return checkpoint(more)

    def prefixes(chosen):
        def run(batches):
            w, shingler, unpack = weights.value, Shingler(), zstandard.ZstdDecompressor()
            bits = None if chosen is None else chosen.value
            for batch in batches:
                for key, node, query, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sh, counts, _ = shingler([unpack.decompress(text).decode()])
                    own = mix(w.prefix(sh, counts, similar) ^ U(key & 0xFFFFFFFFFFFFFFFF))
                    if bits is not None:
                        own = own[bits[(own >> U(64 - FILTER_BITS)).astype(np.int64)]]
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), node)), pa.array(np.full(len(own), query))], ["sub", "node", "query"])

        return run

    kind = "sub bigint, node bigint, query boolean"
    asked = named.filter("query").mapInArrow(prefixes(None), kind).select(F.shiftrightunsigned("sub", 64 - FILTER_BITS).cast("int").alias("bit")).distinct()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[[r.bit for r in asked.collect()]] = True  # 2^FILTER_BITS rows at most
    held = spark.sparkContext.broadcast(bits)  # 1 MB
    subs = checkpoint(named.mapInArrow(prefixes(held), kind).groupBy("sub", "node").agg(F.bool_or("query").alias("query")))
    mark = F.xxhash64("node")
    groups = subs.groupBy("sub").agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("asked"), F.bit_xor(mark).alias("x"), F.sum(F.shiftrightunsigned(mark, 24)).alias("y")).filter("n > 1 AND asked > 0")
    groups = checkpoint(groups.groupBy("n", "asked", "x", "y").agg(F.min("sub").alias("sub")).select("sub", "n", "asked"))
    members = split_join(subs, groups, ["sub"], "n")
    chunks, blocks = F.ceil(F.col("n") / CHUNK).cast("int"), F.ceil(F.col("asked") / CHUNK).cast("int")
    own, block = F.pmod(F.xxhash64("node", F.lit(3)), chunks).cast("int"), F.pmod(F.xxhash64("node", F.lit(9)), blocks).cast("int")
    as_row = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: b * chunks + own)
    as_query = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: block * chunks + c)).otherwise(F.array().cast("array<int>"))
    wanted = checkpoint(members.groupBy("node").agg(F.collect_list(F.struct(F.col("sub").alias("key"), F.array_union(as_row, as_query).alias("chunks"))).alias("in")))
    texts = named.groupBy("node").agg(F.any_value("packed").alias("packed"))
    grouped = texts.join(wanted, "node").select("node", "packed", F.explode("in").alias("at")).select("node", "packed", "at.key", F.explode("at.chunks").alias("chunk"))
    return checkpoint(more.union(verify(grouped, weights, similar)))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class with its own columns."""
    names = df.columns
    inner = df.toDF(*(f"_w_{i}" for i in range(len(names))))
    found = classes(inner, f"_w_{names.index(id_col)}", f"_w_{names.index(text_col)}", **how)
    kept = checkpoint(found.filter("kept").select(F.col("row").alias("_w_row")))
    return inner.withColumn("_w_row", F.monotonically_increasing_id()).join(kept, "_w_row", "left_semi").select(*(F.col(f"_w_{i}").alias(n) for i, n in enumerate(names)))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "kept")
