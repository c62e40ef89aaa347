"""Document fingerprints by winnowing, in DataFrame functions only.

A gram is K neighbouring bytes of the UTF-8 text, at any place, so scripts without spaces, shifted text and
inserted letters need no special care. Its hash is a polynomial over its four-byte symbols (their CRC-32, which
tells all four-byte strings apart) modulo a prime, and rolls: the hash at place i + 4 is the one at i without
its first symbol, times the base, plus one new symbol. SQL arrays have no scan, so the sums are written out per
place over shared symbols, with the same values.

Of every W neighbouring grams the one with the smallest hash is chosen, the rightmost of equals: a hash and its
place are packed in one number, the place counting down in the low bits, so one minimum decides both. Two texts
that share K + W - 1 bytes share a chosen gram, and the kept places say where.

Every window holds a whole block of W / 2 grams, so what it chooses is not above that block's least. About a tenth
of the grams are left by that, and among them the chosen ones are found by neighbours (chosen()).

Long texts are worked on in segments that overlap by a window, one after the other, so a task holds arrays of
one segment, small enough for a core's cache; places are counted over the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import body, parts

K, WINDOW = 16, 36
SYMBOL = 4
#: A prime below 2^47 and a base below 2^15, so products fit in a long (fixed values).
PRIME, BASE = (1 << 47) - 115, 28_657
#: Windows of one segment; a place in a segment needs PLACE_BITS.
SEGMENT, PLACE_BITS = 1 << 12, 16
LAST_PLACE = (1 << PLACE_BITS) - 1
#: Ranges of ids for each shuffle partition, and rows that are looked at to find the bounds of one.
RANGES_A_PARTITION, LOOKS_A_RANGE = 2, 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once. The sum over no elements starts from it; a transform would copy the result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, use)


def gram_hashes(data: Column, k: int = K, mark: Callable[[Column, Column], Column] = lambda h, i: h) -> Column:
    """mark(hash, place) of the k bytes (k a multiple of four, at least eight) at each place of a binary; one hash of all where there
    are fewer than k."""
    n = F.octet_length(data)
    short = F.array(mark((F.crc32(data) * BASE + n) % PRIME, F.lit(0)))
    symbols = F.transform(F.sequence(F.lit(1), F.greatest(n - (SYMBOL - 1), F.lit(1))), lambda i: F.crc32(F.substring(data, i, F.lit(SYMBOL))))

    def rolled(v: Column, i: Column) -> Column:
        total = F.get(v, i) * BASE + F.get(v, i + SYMBOL)  # below 2^47, so the next product fits as it is
        for j in range(2 * SYMBOL, k, SYMBOL):
            total = (total * BASE + F.get(v, i + j)) % PRIME
        return total if k > 2 * SYMBOL else total % PRIME

    return F.when(n < k, short).otherwise(let(symbols, lambda v: F.transform(F.sequence(F.lit(0), n - k), lambda i: mark(rolled(v, i), i))))


def marked(h: Column, i: Column) -> Column:
    """Hash and place in one number, of which the least is the smallest hash and of equals the rightmost."""
    return F.shiftleft(h, PLACE_BITS) + (LAST_PLACE - i)


def chosen(grams: Column, w: int = WINDOW) -> Column:
    """The least of the marked hashes of each window of w, once where windows that follow each other choose the same; fewer
    than w are one window. Places are below 2^PLACE_BITS.

    A gram is left out if it is above the least of its own block of w / 2 and of both blocks beside it, as each window has
    one of the three in it, or if it lies before what the first window chooses or behind what the last one does. Of the rest
    one that is above both its neighbours is in no window without one of them, unless they are more than w places apart:
    it goes. What goes has a smaller one on either side, so the nearest smaller ones of those that stay are never lost, and when
    nothing more goes the chosen ones are left. Each turn takes at least the greatest of any that have to go between two
    smaller ones, so w - 1 turns are enough; the turns end with the first that changes nothing.
    """
    size = max(1, w // 2)

    def low(a: Column, n: Column) -> Column:
        block = lambda i: F.slice(a, i * size + 1, F.lit(size))
        least = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.array_min(block(i)))
        below = lambda i, top: F.filter(block(i), lambda x: x <= top)
        return let(least, lambda m: F.flatten(F.transform(m, lambda x, i: let(F.greatest(x, F.get(m, i - 1), F.get(m, i + 1)), lambda top: below(i, top)))))

    def between(a: Column, n: Column) -> Column:
        place = lambda x: x.bitwiseAND(LAST_PLACE)  # noqa: E731  counts down
        first, last = F.array_min(F.slice(a, 1, w)), F.array_min(F.slice(a, F.greatest(n - w, F.lit(0)) + 1, F.lit(w)))
        return let(place(first), lambda f: let(place(last), lambda t: F.filter(low(a, n), lambda x: (place(x) <= f) & (place(x) >= t))))

    def fewer(c: Column) -> Column:
        def goes(x: Column, i: Column) -> Column:
            before, after = F.get(c, i - 1), F.get(c, i + 1)
            return (before < x) & (after < x) & (before.bitwiseAND(LAST_PLACE) - after.bitwiseAND(LAST_PLACE) <= w)

        return F.filter(c, lambda x, i: ~F.coalesce(goes(x, i), F.lit(False)))

    state = lambda c, done: F.struct(c.alias("c"), done.alias("done"))
    turn = lambda s, _: F.when(s["done"], s).otherwise(let(fewer(s["c"]), lambda c: state(c, F.size(c) == F.size(s["c"]))))
    turns = F.sequence(F.lit(1), F.lit(max(1, w - 1)))
    return let(grams, lambda a: F.aggregate(turns, state(between(a, F.size(a)), F.lit(False)), turn, lambda s: s["c"]))


def winnow(text: Column, k: int = K, w: int = WINDOW, segment: int = SEGMENT) -> Column:
    """The chosen grams of a text in text order: array of (hash, place), place in bytes from 0.

    Null and empty text have none: an empty array. A text of fewer than k bytes is one gram, one of fewer
    than w grams one window. Needs about 100 bytes a place of one segment, and the text.
    """

    def of_segment(data: Column, s: Column) -> Column:
        begin = s * segment
        own = F.substring(data, begin + 1, F.lit(segment + w + k - 2))
        found = let(own, lambda b: chosen(gram_hashes(b, k, marked), w))
        return F.transform(found, lambda x: F.struct(F.shiftright(x, PLACE_BITS).alias("hash"), (begin + LAST_PLACE - x.bitwiseAND(LAST_PLACE)).cast("bigint").alias("place")))

    def of_text(data: Column) -> Column:
        windows = F.greatest(F.octet_length(data) - (k + w - 2), F.lit(1))
        parts_ = F.sequence(F.lit(0), F.floor((windows - 1) / segment).cast("int"))
        every = F.flatten(F.transform(parts_, lambda s: of_segment(data, s)))
        return let(every, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["place"] != F.get(a, i - 1)["place"])))  # windows of two segments may choose the same

    none = F.array().cast("array<struct<hash:bigint,place:bigint>>")
    return F.when(F.octet_length(text) > 0, let(text.cast("binary"), of_text)).otherwise(none)


def chosen_by(grams: Column, last: Column, w: int = WINDOW) -> Column:
    """Of a fingerprint, the grams that windows choose which begin at place `last` or before.

    What the next window chooses is either smaller (or equal), and chosen as soon as a window reaches it, or greater, and chosen
    when the gram before is no longer in the window. So the list alone says which window chose a gram first.
    """

    def first_window(x: Column, before: Column) -> Column:
        return F.when(x["hash"] <= before["hash"], x["place"] - (w - 1)).otherwise(before["place"] + 1)

    return F.filter(grams, lambda x, i: F.when(i == 0, 0).otherwise(first_window(x, F.get(grams, i - 1))) <= last)


def joined(a: str, a_bytes: str, b: str, b_bytes: str, text: str, k: int = K, w: int = WINDOW, segment: int = SEGMENT) -> Column:
    """winnow(text) where the text is the first a_bytes bytes of a text with fingerprint a, and then the first b_bytes bytes
    of one with fingerprint b: only windows over the seam are looked at again."""
    window = w + k - 1
    at, more, data = F.col(a_bytes), F.col(b_bytes), F.col(text).cast("binary")
    tail = F.least(at, F.lit(window - 1))
    move = lambda grams, by: F.transform(grams, lambda x: F.struct(x["hash"].alias("hash"), (x["place"] + by).alias("place")))
    none = F.array().cast("array<struct<hash:bigint,place:bigint>>")
    seam = F.substring(data, at - tail + 1, tail + F.least(more, F.lit(window - 1)))
    over = F.when((at > 0) & (more > 0), move(winnow(seam, k, w, segment), at - tail)).otherwise(none)
    every = F.concat(chosen_by(F.col(a), at - window, w), over, move(chosen_by(F.col(b), more - window, w), at))
    once = let(every, lambda g: F.filter(g, lambda x, i: (i == 0) | (x["place"] != F.get(g, i - 1)["place"])))
    return F.when(at + more < window, winnow(F.col(text), k, w, segment)).otherwise(once)


def written(grams: Column) -> Column:
    """A fingerprint as text: its hashes in text order, hexadecimal, with blanks between."""
    return F.array_join(F.transform(grams, lambda x: F.lower(F.hex(x["hash"]))), " ")


def hashes(grams: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(grams, lambda x: x["hash"]))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, 1.0).otherwise(common / either)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """id, hashes, places and the written fingerprint of each row. Cases as in winnow().

    Rows are independent: repeated and null ids are kept as they are, other columns are not read.
    """
    rows = df.select(F.col(id_col), winnow(body(text_col), k, w, segment).alias("_x_fp"))
    return rows.select(id_col, F.transform("_x_fp", lambda x: x["hash"]).alias("hashes"), F.transform("_x_fp", lambda x: x["place"]).alias("places"), written(F.col("_x_fp")).alias("fingerprint"))


def with_next(df: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """_n_id, _n_text, _n_key, _n_copy, _n_range: rows dealt by ranges of descending id, each range with the first row
    of the next one (of the first, after the last) as a marked copy at its end.

    Null ids come last. Rows with the same id are in order of their text's hash, then of their place in df; as rows
    equal in both have the same text, that last order changes no result, and it lets the bounds of ranges fall inside
    any number of rows of one id. Bounds are rows of df: of about LOOKS_A_RANGE * ranges rows, picked by the hash of their place.
    They only decide how rows are dealt, so any pick is right, and each bound is its range's first row. They go to the tasks as one
    row of arrays (some 40 bytes a range).
    """
    spark = df.sparkSession
    # struct of (is null, descending id, text's hash, place)
    key = F.struct(F.col(id_col).isNull().alias("z"), F.coalesce(F.bitwise_not(F.col(id_col).cast("bigint")), F.lit(0)).alias("k"), F.xxhash64("_n_text").alias("h"), F.col("_n_row").alias("r"))
    rows = df.select(F.col(id_col), body(text_col).alias("_n_text"), F.monotonically_increasing_id().alias("_n_row"))
    rows = rows.select(F.col(id_col).alias("_n_id"), "_n_text", key.alias("_n_key"))
    least, n = rows.agg(F.min("_n_key"), F.count(F.lit(1))).first()
    looked = int(LOOKS_A_RANGE * ranges / max(n, 1) * (1 << 40))
    seen = rows.select("_n_key").filter(F.pmod(F.xxhash64("_n_key.r"), F.lit(1 << 40)) < looked).collect() if least else []
    seen = sorted({tuple(r[0]) for r in seen} - {tuple(least or ())})
    bounds = ([tuple(least)] if least else []) + seen[:: max(1, -(-len(seen) // ranges))]
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    kind = rows.schema["_n_key"].dataType.simpleString()
    table = spark.createDataFrame([(0, groups, [g[0] for g in groups])], f"_n_one int, _n_groups array<array<{kind}>>, _n_heads array<{kind}>")
    rows = rows.withColumn("_n_one", F.lit(0)).join(F.broadcast(table), "_n_one")
    # the range is the number of bounds that are not above the key, less one: the group first, then the place in it
    not_above = lambda a, x: F.size(F.filter(a, lambda b: b <= x))
    rows = rows.withColumn("_n_group", not_above(F.col("_n_heads"), F.col("_n_key")) - 1)
    rows = rows.withColumn("_n_own", F.get("_n_groups", F.col("_n_group"))).withColumn("_n_in", not_above(F.col("_n_own"), F.col("_n_key")) - 1)
    at = (F.col("_n_group") * width + F.col("_n_in")).alias("_n_at")
    rows = rows.select("_n_id", "_n_text", "_n_key", at, (F.get("_n_own", F.col("_n_in")) == F.col("_n_key")).alias("_n_first"))
    here = F.struct(F.lit(False).alias("copy"), F.col("_n_at").alias("range"))
    there = F.struct(F.lit(True).alias("copy"), F.when(F.col("_n_at") > 0, F.col("_n_at") - 1).otherwise(len(bounds) - 1).alias("range"))
    dealt = F.explode(F.when(F.col("_n_first"), F.array(here, there)).otherwise(F.array(here)))
    return rows.select("_n_id", "_n_text", "_n_key", dealt.alias("_n_to")).select("_n_id", "_n_text", "_n_key", F.col("_n_to.copy").alias("_n_copy"), F.col("_n_to.range").alias("_n_range"))


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last floor(n/2) characters are those that the
    next document (by descending id, cyclically) begins with; likeness to that and to the next document, and the
    places of the chosen grams of both.

    One shuffle deals the texts by ranges of ids; the fingerprint of each text is made once, after it, and that of the edited
    text is put together from those of its two halves' texts, with the windows over the seam looked at again. A single row is its own next. An empty table gives no rows. df must be a table or another input that gives
    the same rows in the same order when read twice.
    """
    n = parts(df.sparkSession)
    rows = with_next(df, id_col, text_col, n * RANGES_A_PARTITION).withColumn("_n_part", F.col("_n_range") % n).repartitionById(n, "_n_part")
    rows = rows.withColumn("_n_fp", winnow(F.col("_n_text"), k, w, segment))
    order = Window.partitionBy("_n_part", "_n_range").orderBy("_n_copy", "_n_key")
    rows = rows.withColumns({"_n_next": F.lead("_n_text").over(order), "_n_next_fp": F.lead("_n_fp").over(order)}).filter(~F.col("_n_copy"))
    chars = F.char_length("_n_text")
    half = F.floor(chars / 2).cast("int")
    rows = rows.withColumns({"n_chars": chars.cast("bigint"), "_n_head": F.substring("_n_text", F.lit(1), chars - half), "_n_tail": F.substring("_n_next", F.lit(1), half)})
    rows = rows.select("_n_id", "n_chars", "_n_fp", "_n_next_fp", F.octet_length("_n_head").alias("_n_at"), F.octet_length("_n_tail").alias("_n_more"), F.concat("_n_head", "_n_tail").alias("_n_new"))
    rows = rows.withColumn("_n_new_fp", joined("_n_fp", "_n_at", "_n_next_fp", "_n_more", "_n_new", k, w, segment))
    rows = rows.withColumns({"_n_set": hashes(F.col("_n_fp")), "_n_next_set": hashes(F.col("_n_next_fp")), "_n_new_set": hashes(F.col("_n_new_fp"))})
    return rows.select(
        F.col("_n_id").alias(id_col),
        "n_chars",
        F.sha2("_n_new", 256).alias("edited_sha256"),
        written(F.col("_n_fp")).alias("fingerprint"),
        written(F.col("_n_new_fp")).alias("edited_fingerprint"),
        likeness("_n_set", "_n_new_set").alias("near_edited"),
        likeness("_n_set", "_n_next_set").alias("near_next"),
        F.transform("_n_fp", lambda x: x["place"]).alias("places"),
        F.transform("_n_new_fp", lambda x: x["place"]).alias("edited_places"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
