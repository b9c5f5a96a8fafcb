"""Operator 3: token-ID output in wavelet-matrix shards.

Documents are dealt by ranges of doc_id and encoded inside the tasks that write them. A task closes a
shard once it holds `shard_tokens` ids; each shard is one file with a wavelet matrix of its ids: one
bit-plane per id bit with a rank directory, which answers access, count, rank and select from the file
alone, next to the ids and lengths of its documents. Spark's writer commits the files, so a retried task
leaves no half shard behind.

Defined results: null text is encoded as the empty string (the end id alone); null doc_id comes first;
rows of equal doc_id are ordered by a hash of their text, and repeated rows are written as often as they
came; an empty table gives no shard and no row; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_dir, text_hash

END_ID = 2
SHARD_TOKENS = 1 << 20
_BLOCK = 512
#: Documents that are encoded together.
_DOCS = 256

SHARD_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """A sequence of unsigned ids as bit-planes, the highest bit first.

    At each level the ids with a 0 bit move before those with a 1 bit, both in order; zeros[l] counts the
    former. ranks[l] holds the number of ones before every block of 512 bits.
    """

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        x = ids.astype(np.uint16 if width <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(width - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            blocks = np.bitwise_count(np.pad(packed, (0, -len(packed) % (_BLOCK // 8))).reshape(-1, _BLOCK // 8)).sum(1)
            ranks.append(np.concatenate([[0], np.cumsum(blocks)]).astype("<u4").tobytes())
            planes.append(packed.tobytes())
            low = np.compress(~bit, x)
            zeros.append(len(low))
            x = np.concatenate([low, np.compress(bit, x)])
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, start = self.ranks[level][i // _BLOCK], i // _BLOCK * (_BLOCK // 8)
        count = int(block) + int(np.bitwise_count(self.planes[level][start : i >> 3]).sum())
        return count + (int(self.planes[level][i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the value's occurrences among the first `end` ids stand after the last level."""
        low = 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, end)
            low, end = (zeros + a, zeros + b) if value >> (len(self.zeros) - 1 - level) & 1 else (low - a, end - b)
        return low, end

    def rank(self, value: int, end: int) -> int:
        """Occurrences of value among the first `end` ids."""
        if value >> len(self.zeros):
            return 0
        low, high = self._range(value, end)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, counted from 0; -1 if there are fewer."""
        low, high = self._range(value, self.n) if not value >> len(self.zeros) else (0, 0)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = value >> (len(self.zeros) - 1 - level) & 1
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def _find(self, level: int, one: int, k: int) -> int:
        """Position of the k-th bit of that kind, by the rank directory and then inside its block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * _BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * (_BLOCK // 8)
        bits = np.unpackbits(self.planes[level][start : start + _BLOCK // 8], bitorder="little")[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def decode(self) -> np.ndarray:
        """All ids in order: the levels are undone from the last to the first."""
        x = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up, one = np.empty_like(x), np.array(1 << (len(self.zeros) - 1 - level), x.dtype)
            up[np.flatnonzero(bit)] = x[self.zeros[level] :] | one
            up[np.flatnonzero(~bit)] = x[: self.zeros[level]]
            x = up
        return x


_NEWLINE_ID = 198
#: Bytes with which a text isn't cut: control characters that are, or may be taken for, white space.
_CONTROL = np.isin(np.arange(256), [0, 9, 11, 12, 13, 28, 29, 30, 31])
#: UTF-8 of white space above ASCII, by lead byte: ranges of what follows.
_WIDE_SPACE = {0xC2: [(0x85, 0x85), (0xA0, 0xA0)], 0xE1: [(0x9A80, 0x9A80)], 0xE2: [(0x8080, 0x808A), (0x80A8, 0x80A9), (0x80AF, 0x80AF), (0x819F, 0x819F)], 0xE3: [(0x8080, 0x8080)]}
_LETTER = np.array([bytes([i]).isalnum() for i in range(256)])
#: The low n bytes of a 64-bit word.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PIECE = 16


class _Pieces:
    """A hash table from pieces of at most 16 bytes, held whole as two 64-bit words, to runs of ids; longer ones are in a dict."""

    def __init__(self) -> None:
        self.words, self.entry = np.zeros((2, 1 << 12), np.uint64), np.full(1 << 12, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.n, self.used = 0, 0
        # Ids that fit in two bytes take two; a table of a million pieces takes about 50 MB.
        self.start, self.count, self.pool = np.zeros(1 << 10, np.uint32), np.zeros(1 << 10, np.uint32), np.zeros(1 << 12, np.uint16)

    def _slots(self, w: np.ndarray) -> np.ndarray:
        h = (w[0] ^ (w[1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(len(self.entry) - 1)).astype(np.int64)

    def find(self, w: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none."""
        at, out = self._slots(w), np.full(w.shape[1], -1, np.int64)
        todo = np.arange(w.shape[1])
        while len(todo):
            slot = at[todo]
            e = self.entry[slot]
            hit = (e >= 0) & (self.words[0, slot] == w[0, todo]) & (self.words[1, slot] == w[1, todo])
            out[todo[hit]] = e[hit]
            todo = todo[~hit & (e >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.entry) - 1)
        return out

    def _place(self, w: np.ndarray, e: np.ndarray) -> None:
        """Different pieces that aren't in the table."""
        at, todo = self._slots(w), np.arange(len(e))
        while len(todo):
            free = self.entry[at[todo]] < 0
            mine, rest = todo[free], todo[~free]
            self.entry[at[mine]] = e[mine]
            won = self.entry[at[mine]] == e[mine]
            self.words[:, at[mine[won]]] = w[:, mine[won]]
            todo = np.concatenate([rest, mine[~won]])
            at[todo] = (at[todo] + 1) & (len(self.entry) - 1)

    def add(self, w: np.ndarray | None, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries of `counts` ids each; w has the words of those that go to the table."""
        n, m = len(counts), len(ids)
        grown = lambda a, size: a if size <= len(a) else np.concatenate([a, np.zeros(max(size - len(a), len(a) // 2), a.dtype)])
        if m and self.pool.dtype == np.uint16 and ids.max() >= 1 << 16:
            self.pool = self.pool.astype(np.uint32)
        self.start, self.count, self.pool = grown(self.start, self.n + n), grown(self.count, self.n + n), grown(self.pool, self.used + m)
        self.pool[self.used : self.used + m] = ids
        self.start[self.n : self.n + n] = self.used + np.cumsum(counts) - counts
        self.count[self.n : self.n + n] = counts
        entries = np.arange(self.n, self.n + n)
        self.n, self.used = self.n + n, self.used + m
        if w is not None:
            if 4 * self.n > 3 * len(self.entry):
                held = self.entry >= 0
                old, size = (self.words[:, held], self.entry[held]), len(self.entry)
                while 4 * self.n > 3 * size:
                    size *= 2
                self.words, self.entry = np.zeros((2, size), np.uint64), np.full(size, -1, np.int32)
                self._place(*old)
            self._place(w, entries)
        return entries


class Encoder:
    """Encodes whole texts with a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer never joins across a blank or a line end, so the pieces between those are encoded
    once by the library, several at a time, and remembered, `keep` of them at most. Texts are cut, and pieces
    looked up, as arrays of bytes. Texts for which the cut isn't evident, and all texts of other tokenizers,
    are encoded in one go.
    """

    def __init__(self, path: str, keep: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_file(path), keep
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.special_starts = sorted({t.encode()[0] for t in added if t})
        probe = "a b\nc\nd e"
        pre = self.tok.pre_tokenizer
        self.pieces = self.tok.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self._ids("\n") == [_NEWLINE_ID] and [p for p, _ in pre.pre_tokenize_str(probe)] == ["a", "Ġb", "Ċ", "c", "Ċ", "d", "Ġe"]
        self.known = _Pieces()

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _library(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, which hold no line end, in a row, and how many each has. They are joined by line
        ends, which stay tokens of their own; a few thousand at a time suit the library's cache."""
        ids, counts = [], []
        for at in range(0, len(parts), 4000):
            text = b"\n".join(parts[at : at + 4000]).decode()
            # Without offsets, which only the batch call can leave out.
            got = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            line = got == _NEWLINE_ID
            ids.append(got[~line])
            counts.append(np.diff(np.flatnonzero(line), prepend=-1, append=len(got)) - 1)
        return np.concatenate(ids), np.concatenate(counts)

    def _odd(self, b: np.ndarray, blank: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> np.ndarray:
        """Which texts go to the library whole: white space other than single blanks and line ends between words, or special tokens."""
        odd = np.zeros(len(ends), bool)
        some = ends > starts
        odd[some] = blank[starts[some]] | blank[ends[some] - 1]
        marks = [np.flatnonzero(_CONTROL[b]), np.flatnonzero(blank[:-1] & blank[1:])]
        for lead, ranges in _WIDE_SPACE.items():
            at = np.flatnonzero(b == lead)
            if len(at):
                after = lambda k, at=at: b[np.minimum(at + k, len(b) - 1)].astype(np.int64)
                follows = after(1) if lead == 0xC2 else after(1) << 8 | after(2)
                marks.append(at[np.any([(follows >= low) & (follows <= high) for low, high in ranges], axis=0)])
        odd[np.searchsorted(ends, np.concatenate(marks), side="right")] = True
        for first in self.special_starts:
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(b == first), side="right")):
                odd[i] |= self.special.search(raw[starts[i] : ends[i]].decode()) is not None
        return odd

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; null is the empty text."""
        texts = pa.array(["" if t is None else t for t in texts.to_pylist()], pa.string()) if texts.null_count else texts.cast(pa.string())
        if not self.pieces or not len(texts):
            each = [np.array(self._ids(t), np.uint32) for t in texts.to_pylist()]
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.array([len(x) for x in each], np.int64)
        if self.known.n > self.keep or not self.known.n:
            self.known = _Pieces()
            self.known.add(np.array([[10], [0]], np.uint64), np.array([_NEWLINE_ID], np.uint32), np.array([1]))
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = bytes(memoryview(texts.buffers()[2])[edges[0] : edges[-1]]) if edges[-1] > edges[0] else b""
        starts, ends = edges[:-1] - edges[0], edges[1:] - edges[0]
        padded = np.frombuffer(raw + bytes(2 * _PIECE), np.uint8)
        b = padded[: len(raw)]
        blank = (b == 32) | (b == 10)
        odd = self._odd(b, blank, starts, ends, raw) if raw else np.zeros(len(ends), bool)

        new = blank.copy()
        new[1:] |= b[:-1] == 10
        new[starts[ends > starts]] = True
        # A comma or full stop that ends a piece, behind a letter or digit, is a piece of its own.
        last = np.zeros(len(b), bool)
        last[:-1] = blank[1:]
        last[ends[ends > starts] - 1] = True
        mark = np.flatnonzero(last & ((b == 44) | (b == 46)) & ~new)
        before, lead = b[mark - 1], b[np.maximum(mark - 2, 0)]
        new[mark[_LETTER[before] | (lead == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 0x80)]] = True

        at = np.flatnonzero(new)
        first, behind = np.searchsorted(at, starts), np.searchsorted(at, ends)
        size = np.diff(at, append=len(b))
        skip = np.zeros(len(at), bool)
        for i in np.flatnonzero(odd):
            skip[first[i] : behind[i]] = True
        entry = self._entries(padded, raw, at, size, skip)
        count = np.where(skip, 0, self.known.count[entry].astype(np.int64))
        before = np.concatenate([[0], np.cumsum(count)])
        flat = self.known.pool[np.repeat(self.known.start[entry].astype(np.int64) - before[:-1], count) + np.arange(before[-1])].astype(np.uint32)
        n = before[behind] - before[first]
        if not odd.any():
            return flat, n
        parts, done = [], 0
        for i in np.flatnonzero(odd).tolist():
            whole = np.array(self._ids(raw[starts[i] : ends[i]].decode()), np.uint32)
            parts += [flat[done : before[first[i]]], whole]
            done, n[i] = before[first[i]], len(whole)
        return np.concatenate([*parts, flat[done:]]), n

    def _entries(self, padded: np.ndarray, raw: bytes, at: np.ndarray, size: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """The entry of each piece; what isn't known is learnt first."""
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        w = np.stack([eight[at] & _LOW[np.minimum(size, 8)], eight[at + 8] & _LOW[np.clip(size - 8, 0, 8)]])
        entry, short = np.zeros(len(at), np.int64), (size <= _PIECE) & ~skip
        mine = np.flatnonzero(short)
        entry[mine] = self.known.find(w[:, mine])
        fresh = mine[entry[mine] < 0]
        if len(fresh):
            fresh = fresh[np.lexsort(w[:, fresh])]
            other = np.ones(len(fresh), bool)
            other[1:] = (w[:, fresh[1:]] != w[:, fresh[:-1]]).any(0)
            kinds = fresh[other]
            got = self.known.add(w[:, kinds], *self._library([raw[a : a + n] for a, n in zip(at[kinds].tolist(), size[kinds].tolist(), strict=True)]))
            entry[fresh] = got[np.cumsum(other) - 1]
        long = np.flatnonzero((size > _PIECE) & ~skip)
        if len(long):
            parts = [raw[a : a + n] for a, n in zip(at[long].tolist(), size[long].tolist(), strict=True)]
            missing = list(set(parts).difference(self.known.long))
            if missing:
                self.known.long.update(zip(missing, self.known.add(None, *self._library(missing)).tolist(), strict=True))
            entry[long] = [self.known.long[x] for x in parts]
        return entry

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        flat, n = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        return [flat[e - k : e].astype("<u4").tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes docs to the folder `out`, one file per shard; (part, seq) is the order of doc_id."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        data: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            wm = WaveletMatrix.build(np.concatenate(data))
            whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            row = {"part": part, "seq": seq, "n_tokens": wm.n, "zeros": wm.zeros, "planes": [p.tobytes() for p in wm.planes], "ranks": [r.tobytes() for r in wm.ranks]}
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()))
            made = {k: pa.array([v], t) for (k, v), t in zip(row.items(), types, strict=True)}
            made |= {"doc_ids": whole(pa.concat_arrays(ids)), "lengths": whole(pa.array(np.concatenate(lengths), pa.int64()))}
            names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

        enc = encoder(tokenizer_path)
        for batch in batches:
            for some in (batch.slice(at, _DOCS) for at in range(0, batch.num_rows, _DOCS)):
                flat, n = enc.encode_column(some.column("text"))
                ends = np.cumsum(n + 1)
                out = np.full(len(flat) + len(n), end_id, np.uint32)
                text = np.ones(len(out), bool)
                text[ends - 1] = False
                out[text] = flat
                done = 0
                while done < len(n):
                    # A shard takes documents until it has its tokens.
                    base = int(ends[done - 1]) if done else 0
                    to = min(len(n), int(np.searchsorted(ends, base + shard_tokens - held)) + 1)
                    ids.append(some.column("doc_id").slice(done, to - done))
                    lengths.append(n[done:to] + 1)
                    data.append(out[base : ends[to - 1]])
                    held += int(ends[to - 1]) - base
                    done = to
                    if held >= shard_tokens:
                        yield flush()
                        seq, held = seq + 1, 0
                        ids.clear()
                        lengths.clear()
                        data.clear()
        if ids:
            yield flush()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), text_hash(F.col("text")).alias("h"))
    dealt = dealt.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows = dealt.mapInArrow(shards, SHARD_SCHEMA)
    rows.write.option("maxRecordsPerFile", 1).option("parquet.enable.dictionary", "false").parquet(out)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, start): the number of ids in all shards before each shard."""
    sizes = spark.read.schema(SHARD_SCHEMA).parquet(path).select("part", "seq", "n_tokens")
    # One row per writing task; the running sum over those few is the only globally ordered step.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    shards = sizes.select("part", "seq", F.coalesce(within, F.lit(0)).alias("shard_start"))
    return shards.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("start"))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]).decode().astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(documents, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(spark, path), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards and returns decoded() of them."""
    spark = docs.sparkSession
    out = out or shared_dir(spark, "token-shards")
    write_shards(docs, tokenizer_path, out, end_id, shard_tokens)
    return decoded(spark, out)


def byte_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents"), byte_bpe())
