"""Suffix-array dedup: bytes covered by a string of L bytes that also occurs elsewhere.

Longest-previous-factor (LPF) arrays decide. In suffix order, the nearest smaller position before or after a
suffix is where its longest earlier match starts, and the longer of the two common prefixes is its LPF; the
nearest larger positions give its longest later match in the same way. Only whether a match has L bytes
matters, so suffixes are sorted, and LPF is counted, to depth L.

To sort only what can repeat, and no text as a whole in one task, candidates are found by winnowing: each
window of L bytes has one anchor, the gram of GRAM bytes with the least hash in it (rightmost of equals).
Equal windows have equal anchors, so windows meet by anchor. The windows of one anchor follow each other;
what they cover is a stretch. Copies of a whole stretch are grouped by a 128-bit hash, partial counts first:
all but the first of them have an earlier match for each of their windows, whatever the order, so one copy
of each stretch goes to the suffix sort, where different stretches around the same anchor meet.

No key is dealt to one task whole. Keys that hold more than a ten-thousandth of the rows are at most ten
thousand; they are broadcast and their rows stay where they are. An anchor with more than LARGE different
stretches (the edge of a passage that stands in very many texts) is too much for one sort; its windows are
dealt by content instead, under a 128-bit hash, and counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import body, checkpoint, parts, ship, split_join

LENGTH, GRAM = 400, 64
#: Different stretches of an anchor that are sorted together; bytes of one suffix sort; bytes of one anchor search.
LARGE, SORT_BYTES = 2048, 1 << 19
U = np.uint64


def ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of the suffixes of data by their first `length` bytes: equal prefixes have equal ranks. Then the ranks by
    the first 1, 2, 4, ... bytes, each with -1 behind the end.

    Prefix doubling. A suffix shorter than the depth is ordered by what it has.
    """
    levels, n = [], len(data)

    def keep(r: np.ndarray, h: int) -> None:
        levels.append((h, np.append(r, -1).astype(np.int32)))

    def join(r: np.ndarray, by: int) -> np.ndarray:
        right = np.zeros(n, np.int64)
        if by < n:
            right[: n - by] = r[by:]
        return r * (int(r.max(initial=0)) + 1) + right

    r, h = data.astype(np.int64) + 1, 1
    keep(r, h)
    while h < 4 and h * 2 <= length:  # packed bytes are their own order: 9 bits each
        right = np.zeros(n, np.int64)
        right[: max(0, n - h)] = r[h:]
        r, h = (r << (9 * h)) | right, h * 2
        if h < 4:
            keep(r, h)
    r = np.unique(r, return_inverse=True)[1].astype(np.int64) + 1  # 0 is what stands behind the end
    if h == 4:
        keep(r, h)
    while h < length:
        by = min(h, length - h)
        r, h = np.unique(join(r, by), return_inverse=True)[1].astype(np.int64) + 1, h + by
        if by * 2 == h:
            keep(r, h)
    return r, levels


def common(levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i and at j (different places), `length` at most."""
    k = np.zeros(len(i), np.int64)
    for h, r in reversed(levels):
        k += np.where(r[i + k] == r[j + k], h, 0)
    return np.minimum(k, length)


def previous_smaller(order: np.ndarray) -> np.ndarray:
    """For each place of a suffix order, the nearest earlier place with a smaller position, -1 if none.

    All places look at once: one that finds a greater position goes on from what that one has found.
    """
    found, open_ = np.arange(-1, len(order) - 1), np.arange(len(order))
    while len(open_):
        at = found[open_]
        open_ = open_[(at >= 0) & (order[at] > order[open_])]
        found[open_] = found[found[open_]]
    return found


def factors(order: np.ndarray, levels: list[tuple[int, np.ndarray]], length: int, later: bool = False) -> np.ndarray:
    """LPF of each suffix of a suffix order, in that order, `length` at most: the longest match that starts earlier
    (later: the longest that starts later)."""
    by = -order if later else order
    out = np.zeros(len(order), np.int64)
    back = previous_smaller(by)
    front = len(order) - 1 - previous_smaller(by[::-1])[::-1]
    for near, has in ((back, back >= 0), (front, front < len(order))):
        out[has] = np.maximum(out[has], common(levels, order[has], order[near[has]], length))
    return out


def longest_previous(data: bytes) -> np.ndarray:
    """LPF array of a text: for each position the length of the longest match that starts earlier."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    depth = 4
    while depth < n:
        depth *= 2
    r, levels = ranks(np.frombuffer(data, np.uint8), depth)
    order = np.argsort(r, kind="stable")
    out = np.zeros(n, np.int64)
    out[order] = factors(order, levels, depth)
    return out


def repeated(texts: list[bytes], length: int, starts: list[int], first: bool) -> list[np.ndarray]:
    """For each text, which of its first `starts` windows of `length` bytes have an LPF of length or more;
    without `first`, which have an earlier or a later match. Texts are in order of position."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    count = np.array(starts, np.int64)
    at = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    r, levels = ranks(data, length)
    turn = np.argsort(r[at], kind="stable")  # suffix order of the windows, equal ones by position
    order = at[turn]
    found = np.zeros(len(at), bool)
    found[turn] = factors(order, levels, length) >= length
    if not first:
        found[turn] |= factors(order, levels, length, later=True) >= length
    return np.split(found, np.cumsum(count)[:-1])


class Anchors:
    """Anchors of all windows of a text. A text shorter than a window has none; any bytes may come, zeros as well."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        rng = np.random.default_rng(9)
        self.byte = rng.integers(0, 1 << 63, 256, np.uint64) * U(2) + U(1)
        self.factor = int(rng.integers(1, 1 << 62)) * 2 + 1

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with the same anchor: anchor's hash, first and last start, anchor's place."""
        n, span = len(data), self.length - self.gram + 1
        if n < self.length:
            e = np.empty(0, np.int64)
            return e, e, e, e
        h, size, f = self.byte[np.frombuffer(data, np.uint8)], 1, self.factor
        while size * 2 <= self.gram:
            h = h[:-size] * U(f) + h[size:]
            size, f = size * 2, f * f & 0xFFFFFFFFFFFFFFFF
        if size < self.gram:  # overlap: equal grams have equal hashes all the same
            h = h[: len(h) - (self.gram - size)] * U(f) + h[self.gram - size :]
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        out = []
        step = (1 << 22) - span
        for a in range(0, len(h) - span + 1, step):  # places fit in 22 bits of a packed number
            own = h[a : a + step + span - 1]
            m = (own & ~U(0x3FFFFF)) | (U(0x3FFFFF) - np.arange(len(own), dtype=U))
            size = 1
            while size * 2 <= span:
                m = np.minimum(m[:-size], m[size:])
                size *= 2
            if size < span:
                m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
            cut = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            place = (U(0x3FFFFF) - (m[cut] & U(0x3FFFFF))).astype(np.int64)
            out.append((own[place].view(np.int64), a + cut, a + np.append(cut[1:], len(m)) - 1, a + place))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: str = "first", spans: bool = True, large: int = LARGE) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, then kept and removed (spans).

    keep "first" removes the bytes of windows that have an earlier copy (in order of df's rows, then of
    position) and so keeps the first; "none" removes all copies. Matches never cross rows. Windows are
    judged on the input. Null counts as empty; texts shorter than `length` lose nothing. Ids may be null or
    repeat: a row that repeats another as a whole is another copy of its text. An empty table gives no
    rows. kept is binary (the cut may fall inside a character), removed the list of [begin, end) in bytes.
    df is read once: its rows are numbered and packed into a checkpoint, which all later steps read. (A table read
    again may be split otherwise, when executors have come or gone or settings have changed, and rows get other numbers.)
    """
    if keep not in ("first", "none") or not 0 < gram < length < gram + 1024:
        raise ValueError("keep: first or none; 0 < gram < length < gram + 1024")
    spark = df.sparkSession
    ship(spark)
    n, first = parts(spark), keep == "first"
    rows = df.select(F.col(id_col).alias("id"), body(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packer.compress(t.as_py().encode()) for t in batch.column(2)], pa.binary())], ["row", "id", "packed"])

    packed = checkpoint(rows.select("row", "id", "text").mapInArrow(pack, f"row bigint, id {rows.schema['id'].dataType.simpleString()}, packed binary"))

    def search(batches):
        find, unpack = Anchors(length, gram), zstandard.ZstdDecompressor()
        for batch in batches:
            held, size = [], 0
            for data, row in zip(batch.column(0), batch.column(1), strict=True):
                data = unpack.decompress(data.as_py())
                anchor, a, b, q = find(data)
                if not len(a):
                    continue
                view = memoryview(data)
                digest = np.frombuffer(b"".join([hashlib.blake2b(view[i : j + length], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                fresh = np.zeros(len(a), bool)  # the first of equal stretches of one row
                fresh[np.unique(digest[:, 0], return_index=True)[1]] = True
                at = np.full(len(a), row.as_py() * 2) + ~fresh
                held.append((anchor, digest[:, 0], digest[:, 1], at, (a << 20) | ((b - a) << 10) | (q - a)))
                size += len(a)
                if size > 50_000:
                    yield stretch_batch(held)
                    held, size = [], 0
            if held:
                yield stretch_batch(held)

    keys = ["anchor", "h1", "h2"]
    stretches = checkpoint(packed.select("packed", "row").mapInArrow(search, "anchor bigint, h1 bigint, h2 bigint, at bigint, loc bigint"))
    shared = checkpoint(stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    found = checkpoint(split_join(stretches, shared, ["anchor"], "n", "left_semi"))
    kinds = checkpoint(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.min_by("loc", "at").alias("loc")))
    again = checkpoint(kinds.filter("n > 1").select(*keys, "n", F.col("at").alias("first_at"), F.col("loc").alias("first_loc")))
    settled = split_join(found, again, keys, "n")
    if first:
        settled = settled.filter("at <> first_at or loc <> first_loc")
    begin, more, row = F.shiftright("loc", 20), F.shiftright("loc", 10).bitwiseAND(1023), F.shiftright("at", 1)
    settled = settled.select(row.alias("row"), begin.alias("a"), (begin + more + length).alias("b"))

    mixed = checkpoint(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    open_ = split_join(kinds, mixed, ["anchor"], "kinds").select("anchor", "at", "loc", "n", "kinds")
    open_ = checkpoint(open_.groupBy(row.alias("row")).agg(F.collect_list(F.struct("anchor", "at", "loc", "n", "kinds")).alias("in")))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, own in zip(batch.column(0), batch.column(1), strict=True):
                data, own = unpack.decompress(data.as_py()), own.as_py()
                out = [data[(i := x["loc"] >> 20) : i + (x["loc"] >> 10 & 1023) + length] for x in own]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in own], pa.int64()) for k in ("anchor", "at", "loc", "n", "kinds")), pa.array(out, pa.binary())], ["anchor", "at", "loc", "n", "kinds", "data"])

    pieces = packed.select("row", "packed").join(open_, "row").select("packed", "in").mapInArrow(cut, "anchor bigint, at bigint, loc bigint, n bigint, kinds bigint, data binary")
    pieces = checkpoint(pieces)

    def solve(batches):
        held, total, anchor = [], 0, None
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x[0] != anchor and total >= SORT_BYTES:
                    yield solved(held, length, first)
                    held, total = [], 0
                anchor = x[0]
                held.append(x[1:])
                total += len(x[4])
        if held:
            yield solved(held, length, first)

    spans_of = "row bigint, a bigint, b bigint"
    small = pieces.filter(F.col("kinds") <= large).select("anchor", "at", "loc", "n", "data")
    sorted_ = small.repartition(n, "anchor").sortWithinPartitions("anchor", "at", "loc").mapInArrow(solve, spans_of)
    over = pieces.filter(F.col("kinds") > large).select("at", "loc", "n", "data")
    single = divided(over, length, first) if not over.isEmpty() else None
    every = settled.union(sorted_).union(single) if single is not None else settled.union(sorted_)
    every = checkpoint(every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("in")))

    whole = packed.join(every, "row", "left").select("id", "packed", "in")

    def apply(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [[] for _ in range(6)]
            for data, own in zip(batch.column(1), batch.column(2), strict=True):
                data, runs = unpack.decompress(data.as_py()), []
                for x in own.as_py() or []:
                    if runs and x["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["b"])
                    else:
                        runs.append([x["a"], x["b"]])
                edges = [0, *(e for r in runs for e in r), len(data)]
                left = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                for k, v in enumerate((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left, runs)):
                    out[k].append(v)
            arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[: 6 if spans else 4]], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "removed"] if spans else [])])

    ddl = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary, removed array<array<bigint>>" * spans
    return whole.mapInArrow(apply, ddl)


def stretch_batch(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["anchor", "h1", "h2", "at", "loc"])


def covers(found: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges of runs of windows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
    return [(start + a, start + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def solved(held: list[tuple], length: int, first: bool) -> pa.RecordBatch:
    """(at, loc, n, data) of whole anchors, in order, to byte ranges. A stretch that occurs more than once is
    settled but for its first copy."""
    found = repeated([x[3] for x in held], length, [(x[1] >> 10 & 1023) + 1 for x in held], first)
    out = [(at >> 1, *span) for (at, loc, n, _), f in zip(held, found, strict=True) if (n == 1 or first) and f.any() for span in covers(f, loc >> 20, length)]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["row", "a", "b"])


def divided(over: DataFrame, length: int, first: bool) -> DataFrame:
    """Byte ranges of windows of very frequent anchors, each window by itself."""

    def windows(batches):
        for batch in batches:
            for at, loc, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view, begin, count = memoryview(data), loc >> 20, (loc >> 10 & 1023) + 1
                digest = np.frombuffer(b"".join([hashlib.blake2b(view[i : i + length], digest_size=16).digest() for i in range(count)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.full(count, at)), pa.array(np.arange(begin, begin + count)), pa.array(np.full(count, n))], ["h1", "h2", "at", "place", "n"])

    each = checkpoint(over.mapInArrow(windows, "h1 bigint, h2 bigint, at bigint, place bigint, n bigint"))
    counted = checkpoint(each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("at", "place")).alias("f")).filter("m > 1").select("h1", "h2", "m", F.col("f.at").alias("first_at"), F.col("f.place").alias("first_place")))
    hit = split_join(each, counted, ["h1", "h2"], "m")
    hit = hit.filter("at <> first_at or place <> first_place") if first else hit.filter("n = 1")
    return hit.select(F.shiftright("at", 1).alias("row"), F.col("place").alias("a"), (F.col("place") + length).alias("b"))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="none", spans=False)
