"""Token ids in binary block files: canonical length-limited Huffman codes, decoded by table.

A file set is a folder with `header` (code lengths and the ids before each range part) and `blocks`
(Parquet rows of one binary block each, in one folder per range part of ascending ids). A block holds
whole documents: their ids, places and lengths, the coded bits, and the bit offset of every STEP-th
token. A block can be read without any other, and all its checkpoints are decoded side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, shared_dir, table, text_bytes
from .tokens import END_ID, Encoder, tokenizer_path

#: Longest code; the decoding table has 2**MAX_BITS entries.
MAX_BITS, STEP, BLOCK_IDS = 18, 128, 1 << 20
#: Bytes of ids in a batch: what 32-bit offsets can tell.
BATCH_BYTES = (1 << 31) - 1


def code_lengths(counts: np.ndarray, longest: int = MAX_BITS) -> np.ndarray:
    """Package-merge: the lengths of an optimal prefix code of at most `longest` bits; 0 for unused ids."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("too many ids for the longest code")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, merged = [], leaves
    for _ in range(longest):
        levels.append(merged)
        packed = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packed])
        sort = np.argsort(both, kind="stable")
        levels[-1] = (levels[-1], sort)
        merged = both[sort]
    take = 2 * len(leaves) - 2
    for depth in range(longest - 1, 0, -1):
        leaf = int((levels[depth - 1][1][:take] < len(leaves)).sum())
        out[order[:leaf]] += 1
        take = 2 * (take - leaf)
    out[order[: min(take, len(leaves))]] += 1
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    counts = np.bincount(lengths, minlength=256)
    for bits in np.flatnonzero(counts[1:]) + 1:
        code <<= int(bits) - last
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, last = code + len(ids), int(bits)
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For every MAX_BITS-bit window: id << 8 | code length."""
    ids = np.flatnonzero(lengths)
    order = ids[np.argsort(canonical_codes(lengths)[ids] << (MAX_BITS - lengths[ids].astype(np.uint64)), kind="stable")]
    spread = np.repeat((order.astype(np.uint32) << 8) | lengths[order], 1 << (MAX_BITS - lengths[order].astype(np.int64)))
    return np.pad(spread, (0, (1 << MAX_BITS) - len(spread)), constant_values=1).astype(np.uint32)


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset of each STEP-th one."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    begins = ends - bits
    code, word = codes[ids], begins >> 6
    over = (begins & 63) + bits - 64
    here = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(ends[-1] >> 6) + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        out[word[first]] = np.bitwise_or.reduceat(here, first)
        spill = np.flatnonzero(over > 0)
        out[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
    return out.astype(">u8").tobytes(), begins[::STEP]


def unpack(blob: bytes, marks: np.ndarray, n: int, lookup: np.ndarray) -> np.ndarray:
    """The n ids of a block: one lane for each checkpoint, all lanes a token further at each step."""
    b = np.frombuffer(blob, np.uint8).astype(np.uint32)
    windows = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    at = marks.astype(np.int64)
    out = np.zeros((len(marks), STEP), np.uint32)
    limit = len(windows) - 1
    for step in range(STEP):
        window = windows[np.minimum(at >> 3, limit)] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)
        found = lookup[window & np.uint32((1 << MAX_BITS) - 1)]
        out[:, step] = found >> 8
        at += found & 255
    return out.ravel()[:n]


_IDS = "part int, id bigint, start bigint, n bigint, ids binary, tokens array<int>, counts array<bigint>"


def _binary(values: np.ndarray, ends: np.ndarray, doc) -> pa.Array:
    """Binary values that lie one after another and end at `ends` (items of `values`)."""
    cuts = np.concatenate([[0], ends]) * values.itemsize
    if cuts[-1] > BATCH_BYTES:
        raise ValueError(f"the ids of document {doc} take {cuts[-1]} bytes, more than the {BATCH_BYTES} that one value can have")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(values)])


def _encode(path: str):
    """A row for each text, and at the end of a part one with the counts of its ids, n being null and start their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder.at(path), TaskContext.get().partitionId(), 0
        total = np.zeros(encoder.tokenizer.get_vocab_size(), np.int64)
        names = [c.split()[0] for c in _IDS.split(", ")]
        lists = [pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            for piece in pieces(batch):
                flat, cuts = encoder.encode_all(piece.column("text"))
                n, ids = np.diff(cuts) + 1, np.insert(flat, cuts[1:], END_ID)
                begin = start + np.cumsum(n) - n
                start += len(ids)
                total += np.bincount(ids, minlength=len(total))
                blobs = _binary(ids, np.cumsum(n), piece.column("id")[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), piece.column("id"), pa.array(begin), pa.array(n), blobs, *(pa.nulls(len(n), t) for t in lists)], names)
        if start:
            used = np.flatnonzero(total)
            row = [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([start], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*row, pa.array([used.tolist()], lists[0]), pa.array([total[used].tolist()], lists[1])], names)

    return run


_BLOCK = "part int, first bigint, docs array<bigint>, starts array<bigint>, sizes array<bigint>, bits binary, marks binary"


def _blocks(kind: str, lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.frombuffer(lengths, np.uint8)
        codes = canonical_codes(of)
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            part, docs, starts, sizes, ids = zip(*held, strict=True)
            bits, marks = pack(np.concatenate(ids), of, codes)
            row = [[part[0]], [starts[0]], [docs], [starts], [sizes], [bits], [marks.tobytes()]]
            kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        size = 0
        for batch in batches:
            data, off = text_bytes(batch.column("ids"))
            ids = np.split(data.view(kind), off[1:-1] // np.dtype(kind).itemsize)
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "start", "n")), ids, strict=True):
                if held and (size + row[3] > BLOCK_IDS or row[0] != held[-1][0] or row[2] != held[-1][2] + held[-1][3]):
                    yield block()
                    size = 0
                held.append(row)
                size += row[3]
        if held:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Encode every text (null: empty) with an end id, and write the block files in ascending id order.

    Null ids come first; rows that share an id stand in order of their text's hash. An empty table
    gives files without blocks. Other columns are ignored."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    encoder = Encoder.at(tokenizer)
    kind, size = np.dtype(encoder.kind).name, encoder.tokenizer.get_vocab_size()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", F.xxhash64("text"))
    ids = materialize(ordered.mapInArrow(_encode(tokenizer), _IDS), "token-ids", "zstd")
    ends = ids.where("n IS NULL")
    counts = np.zeros(size, np.int64)
    each = ends.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    for token, n in each.groupBy("x.tokens").agg(F.sum("x.counts")).collect():  # at most the vocabulary
        counts[token] = n
    lengths = code_lengths(counts).tobytes()
    sums = sorted((r[0], r[1]) for r in ends.select("part", "start").collect())  # one row for each part
    before = np.cumsum([0, *(n for _, n in sums)]).tolist()
    header = [(lengths, [p for p, _ in sums], before[:-1])]
    spark.createDataFrame(header, "lengths binary, parts array<int>, before array<bigint>").write.parquet(f"{path}/header")
    rows = ids.where("n IS NOT NULL").select("part", "id", "start", "n", "ids")
    rows.mapInArrow(_blocks(kind, lengths), _BLOCK).write.partitionBy("part").parquet(f"{path}/blocks")


def _unblock(lengths: bytes, before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ids = unpack(row["bits"], np.frombuffer(row["marks"], np.int64), int(sizes.sum()), lookup)
                cuts = np.concatenate([[0], np.cumsum(sizes)]) * 4
                starts = np.array(row["starts"], np.int64) + before[row["part"]]
                flat, at = ids.astype("<u4"), 0
                while at < len(sizes):  # as many texts as one batch can hold
                    to = int(np.searchsorted(cuts, cuts[at] + BATCH_BYTES, side="right")) - 1
                    if to == at:
                        raise ValueError(f"the ids of document {row['docs'][at]} take {sizes[at] * 4} bytes, more than the {BATCH_BYTES} that one value can have")
                    blobs = _binary(flat[cuts[at] // 4 : cuts[to] // 4], (cuts[at + 1 : to + 1] - cuts[at]) // 4, row["docs"][at])
                    yield pa.RecordBatch.from_arrays([pa.array(row["docs"][at:to], pa.int64()), pa.array(starts[at:to]), pa.array(sizes[at:to]), blobs], ["doc_id", "start", "n_tokens", "ids"])
                    at = to

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bit)."""
    head = spark.read.parquet(f"{path}/header").first()
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    return blocks.select(*[c.split()[0] for c in _BLOCK.split(", ")]).mapInArrow(_unblock(bytes(head.lengths), dict(zip(head.parts, head.before, strict=True))), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of documents as token files, and what is read back from them for each document."""
    path = f"{shared_dir(spark)}/postmill/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
