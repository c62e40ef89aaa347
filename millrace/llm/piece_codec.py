"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into words between which no piece of the vocabulary reaches. The distinct words of a block
are laid out as one flat array of symbols. Each round finds the smallest pair rank of every word
(a segmented minimum), merges all its leftmost occurrences at once, and compacts the array; words with no
pair left are taken out, until none remains. Where a merge could make a pair of the same or a smaller
rank, only the leftmost occurrence is merged in that round, so the order of merges is the library's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import body, ship

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Text of one vectorised block, and distinct words that a task remembers.
BLOCK_CHARS, MEMORY_WORDS = 1 << 21, 200_000


class Vocabulary:
    """Tables of a BPE model with byte fallback: pieces, ranks of pairs, bytes of pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        spec = model_spec(model)
        if (self.byte_ids < 0).any() or any(sp.is_unused(i) for i in range(n)) or spec["type"] != 2 or spec["normalizer"] or spec["user"]:
            raise ValueError("only BPE models with byte fallback, without normalisation, user-defined or unused pieces")
        self.dummy_prefix, self.trim = spec["dummy_prefix"], spec["trim"]
        if self.trim:
            raise ValueError("models that remove extra white space are not supported")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        ids = {pieces[i]: i for i in plain}
        alone = {p: i for p, i in ids.items() if len(p) == 1}
        symbols = dict(ids)
        for c in {c for p in ids for c in p} - alone.keys():
            symbols[c] = n + len(symbols)  # a character of pieces that is no piece itself
        self.extra = {v: k for k, v in symbols.items() if v >= n}
        scores = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        self.base = max(symbols.values()) + 1
        best = {}  # rank of the best pair that a symbol takes part in
        for p, i in ids.items():
            r = scores[sp.get_score(i)]
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (r, i)
                    for x in (a, b):
                        best[x] = min(best.get(x, r), r)
        keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()], np.int64)
        # all occurrences may be merged at once if no pair with the new symbol is as good as its own
        self.at_once = np.array([best.get(i, NONE) > r for r, i in zip(self.rank.tolist(), self.merged.tolist(), strict=True)], bool)
        self._hash(keys)
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        inside = {c for p in ids if len(p) > 1 for c in p}
        after_space = any(SPACE in p.lstrip(SPACE) for p in ids)
        # no piece reaches from a character to a following space, nor over a line end
        self.words = None if after_space else re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if "\n" not in inside else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        raw = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.raw_flat = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_off = np.cumsum(self.raw_len) - self.raw_len
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.plain = np.zeros(n, bool)
        self.plain[plain] = True
        self.starts_with_space = np.array([p.startswith(SPACE) for p in pieces]) & self.plain
        self.shown = self.raw_len > 0

    def _hash(self, keys: np.ndarray) -> None:
        """Open addressing in an array of 2^k slots: slot to key and to index."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.slot_key, self.slot_at = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slot_key[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_at[at[put]] = keys[todo[put]], todo[put]
            todo, at = todo[~put], (at[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in rank and merged, -1 if it is no pair."""
        keys = left * self.base + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        got = self.slot_key[at]
        found = np.where(got == keys, self.slot_at[at], -1)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            at = (at[todo] + 1) & ((1 << self.bits) - 1) if at.shape == keys.shape else (at + 1) & ((1 << self.bits) - 1)
            got, want = self.slot_key[at], keys[todo]
            hit = got == want
            found[todo[hit]] = self.slot_at[at[hit]]
            on = ~hit & (got >= 0)
            todo, at = todo[on], at[on]
        return found

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_char[chars]
        unknown = sym < 0
        sym[unknown] = -1 - chars[unknown]
        seg = np.repeat(np.arange(len(words)), lens)
        pair = self._pairs(sym, seg, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            start = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            over = least == NONE
            if over.any():
                out = np.repeat(over, length)
                done.append((seg[out], sym[out]))
                on = ~out
                sym, seg, pair, rank = sym[on], seg[on], pair[on], rank[on]
                least, length = least[~over], length[~over]
                if not len(sym):
                    break
                start = np.cumsum(length) - length
            cand = np.flatnonzero(rank == np.repeat(least, length))
            owner = seg[cand]
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            # of a run of overlapping pairs every other one is merged, from the left
            new_run = first | np.concatenate(([True], cand[1:] != cand[:-1] + 1))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(cand)), 0))
            even = (np.arange(len(cand)) - run_start) % 2 == 0
            cautious = np.logical_or.reduceat(~self.at_once[pair[cand]], np.flatnonzero(first))
            chosen = cand[even & (first | ~np.repeat(cautious, np.diff(np.append(np.flatnonzero(first), len(cand)))))]
            sym[chosen] = self.merged[pair[chosen]]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            moved = chosen - np.arange(len(chosen))
            sym, seg, pair = sym[keep], seg[keep], pair[keep]
            touched = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            pair[touched] = self._pairs(sym, seg, touched)
        seg = np.concatenate([s for s, _ in done]) if done else np.empty(0, np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.empty(0, np.int64)
        order = np.argsort(seg, kind="stable")
        seg, sym = seg[order], sym[order]
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.raw_len)))
        if len(odd):  # characters without a piece become their bytes
            text = [chr(-1 - s) if s < 0 else self.extra[s] for s in sym[odd].tolist()]
            raw = [np.frombuffer(c.encode(), np.uint8) for c in text]
            grow = np.ones(len(sym), np.int64)
            grow[odd] = [len(r) for r in raw]
            at = np.cumsum(grow) - grow
            sym, seg = np.repeat(sym, grow), np.repeat(seg, grow)
            for i, r in zip(at[odd].tolist(), raw, strict=True):
                sym[i : i + len(r)] = self.byte_ids[r]
        return sym.astype(np.int32), np.bincount(seg, minlength=len(words)).astype(np.int64)

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index of the pair that starts at each place, -1 where there is none."""
        right = np.minimum(at + 1, len(sym) - 1)
        found = self.find(sym[at], sym[right])
        found[(right == at) | (seg[right] != seg[at])] = -1
        return found

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        return self.words.findall(text) if self.words else [text]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids; ends are the runs' ends. Bytes that form no character become U+FFFD."""
        size = self.raw_len[ids]
        total = int(size.sum())
        upto = np.cumsum(size)
        flat = self.raw_flat[np.repeat(self.raw_off[ids] - (upto - size), size) + np.arange(total)].tobytes()
        stop = np.concatenate(([0], upto))[ends].tolist()
        first = np.concatenate(([0], ends[:-1]))
        out, begin = [], 0
        for k, (a, b, end) in enumerate(zip(first.tolist(), ends.tolist(), stop, strict=True)):
            raw = flat[begin:end]
            begin = end
            lead = a
            while lead < b and not self.shown[ids[lead]]:
                lead += 1
            drop = self.dummy_prefix and lead < b and bool(self.starts_with_space[ids[lead]])
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                raw = self._repair(ids[a:b])
            out.append(raw[1:] if drop else raw)
        return out

    def _repair(self, ids: np.ndarray) -> bytes:
        out, run = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.raw_flat[self.raw_off[i] : self.raw_off[i] + 1].tobytes()
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode("utf-8").encode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    del run[:1]
            if i >= 0:
                out.append(self.raw_flat[self.raw_off[i] : self.raw_off[i] + self.raw_len[i]].tobytes())
        return b"".join(out)


def model_spec(model: bytes) -> dict:
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    return {"type": m.trainer_spec.model_type, "normalizer": bool(m.normalizer_spec.precompiled_charsmap), "dummy_prefix": m.normalizer_spec.add_dummy_prefix, "trim": m.normalizer_spec.remove_extra_whitespaces, "user": any(p.type == 4 for p in m.pieces)}


class Encoder:
    """Encodes texts block by block and remembers the words that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.len = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, without begin and end, in one array, and the end of each text's ids in it."""
        if len(self.known) > MEMORY_WORDS:
            self.forget()
        known, fresh, at, counts = self.known, [], [], []
        for t in texts:
            words = self.v.split(t)
            counts.append(len(words))
            for w in words:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    fresh.append(w)
                at.append(k)
        if fresh:
            ids, lens = self.v.encode_words(fresh)
            self.ids, self.len = np.concatenate((self.ids, ids)), np.concatenate((self.len, lens))
        off = np.cumsum(self.len) - self.len
        at = np.array(at, np.int64)
        size = self.len[at]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(off[at] - (upto - size), size) + np.arange(int(size.sum()))]
        return ids, np.concatenate(([0], upto))[np.cumsum(np.array(counts, np.int64))]


def blocks(texts: list[str]) -> Iterator[slice]:
    """Slices of about BLOCK_CHARS characters."""
    begin = chars = 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= BLOCK_CHARS:
            yield slice(begin, k + 1)
            begin, chars = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def transcode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True, arrays: bool = True, digests: bool = False) -> DataFrame:
    """Encodes each text and decodes it again: id, n_tokens, then ids and decoded (arrays), then
    ids_sha256 and decoded_sha256 (digests; of ids as little-endian unsigned 32-bit integers, of UTF-8).

    Null text counts as empty, which has only the begin and end ids. Ids of rows may be null or repeat;
    rows are independent, an empty table gives no rows, and no other column is read. Memory is bounded by
    a block of about two million characters (or one text) and 200,000 remembered words.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(model))  # as large as the vocabulary
    kind = df.schema[id_col].dataType
    out = [(id_col, None), ("n_tokens", pa.int64()), *([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if arrays else []), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [])]
    ddl = ", ".join(f"`{n}` {s}" for n, s in [(id_col, kind.simpleString()), ("n_tokens", "bigint"), *([("ids", "array<int>"), ("decoded", "string")] if arrays else []), *([("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [])])

    def run(batches):
        v = shared.value
        encoder = Encoder(v)
        head, tail = np.array([v.bos] * begin, np.int32), np.array([v.eos] * end, np.int32)
        for batch in batches:
            texts = batch.column(1)
            begun = 0
            for part in blocks_of(texts):
                docs = texts.slice(begun, part).to_pylist()
                ids, ends = encoder.encode(docs)
                decoded = v.decode(ids, ends)
                each = np.split(ids, ends[:-1]) if docs else []
                each = [np.concatenate((head, x, tail)) for x in each]
                columns = [batch.column(0).slice(begun, part), pa.array([len(x) for x in each], pa.int64())]
                if arrays:
                    columns += [pa.array(each, pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
                if digests:
                    columns += [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                begun += part
                yield pa.RecordBatch.from_arrays(columns, [n for n, _ in out])

    return df.select(F.col(id_col).alias(id_col), body(text_col).alias("_x_text")).mapInArrow(run, ddl)


def blocks_of(texts: pa.Array) -> Iterator[int]:
    """Numbers of rows that hold about BLOCK_CHARS bytes together."""
    ends = np.cumsum(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1][1:] - np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1][:-1]) if pa.types.is_string(texts.type) else np.cumsum([len(t.as_py()) for t in texts])
    begin, before = 0, 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
        yield stop - begin
        begin, before = stop, int(ends[stop - 1])


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return transcode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), arrays=False, digests=True)
