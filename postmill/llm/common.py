"""Shared parts of the training-data operators: table access, word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, shared_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that the Arrow stages turn into arrays at a time; one longer text is taken alone.
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """df with a broadcast hint if its row count is within the bound; the planner decides otherwise."""
    return F.broadcast(df) if rows <= bound else df


#: Ids of rows to drop that are broadcast, at most (under 100 bytes each); beyond, they are joined by shuffling.
DROP_IDS = 1_000_000


def row_keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text) of all rows, key being unique: the id, or where ids are null or repeated a number of the row.

    Numbers are given once, in a table, so that they stay the same whatever is run again."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    if rows.where("id IS NULL").isEmpty() and rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows.select(F.col("id").alias("key"), "id", "text")
    return materialize(rows.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "keyed-rows")


def without(docs: DataFrame, dropped: DataFrame, id_col: str, same, other: str) -> DataFrame:
    """docs but for the rows of `dropped` (id, null included, and other): same id, and `same`, an expression of docs, equal to other.

    Columns of docs may have any name: the joined ones get names that docs doesn't have."""
    mine, theirs = (free_name(docs, f"drop_{x}") for x in ("id", "other"))
    dropped = materialize(dropped.select(F.col("drop_id").alias(mine), F.col(other).alias(theirs)).distinct(), "dropped")
    return docs.join(small(dropped, dropped.count(), DROP_IDS), docs[id_col].cast("bigint").eqNullSafe(dropped[mine]) & (same == dropped[theirs]), "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_hash(text_col: str):
    """64 bits that tell apart texts which share an id."""
    return F.xxhash64(F.col(text_col).cast("string"))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most `limit` text bytes, one row at least."""
    n = batch.num_rows
    if not n:
        return
    off = offsets(batch.column(text))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to


def offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after another and the row offsets; null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    off = offsets(arr)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _FOLD[data]


#: Bytes that part runs of letters: ASCII other than letters (a byte beyond ASCII counts as part of a letter).
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words in data, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~space[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    edges = off[(off > 0) & (off < len(data))]
    before[edges] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another, each followed by one space, and their new starts and ends."""
    lengths = ends - starts + 1
    to = np.cumsum(lengths)
    begin = to - lengths
    out = np.append(data, np.uint8(32))[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - begin, lengths)]
    out[to - 1] = 32
    return out, begin, to - 1


_MASK = (1 << 64) - 1
_POWERS: dict[int, list[np.ndarray]] = {}
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _powers(base: int, n: int) -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept and enlarged."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            made.append(p)
        have = made
        if size <= 1 << 23:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of runs of a uint64 sequence: equal runs have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray, base: int):
        forward, self.back = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * forward[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


#: Bytes of a word that are hashed eight at a time, all words side by side; longer words are hashed one by one.
SIDE_BYTES = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; those of other seeds are independent."""
    n = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))  # the eight bytes from each place on
    out = mix(n.astype(np.uint64) + np.uint64(BYTE_BASE * (seed + 1) & _MASK))
    left = np.arange(len(n))
    for at in range(0, SIDE_BYTES, 8):
        left = left[n[left] > at] if at else left
        if not len(left):
            break
        part = eight[starts[left] + at] & _KEEP[np.minimum(n[left] - at, 8)]
        out[left] = mix(out[left] ^ mix(part + np.uint64(WORD_BASE)))
    for i in np.flatnonzero(n > SIDE_BYTES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed)
    return out


class Slots:
    """A table of distinct uint64 keys that finds many at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._first(keys)
        while len(left):
            free = left[self.at[slot[left]] < 0]
            self.at[slot[free]], self.keys[slot[free]] = free, keys[free]  # of keys that meet in a slot one stays
            left = left[self.at[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._first(keys)
        out = self.at[slot]
        left = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.at[slot[left]]
            left = left[(self.keys[slot[left]] != keys[left]) & (out[left] >= 0)]
        return out


def crc_mod(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod
