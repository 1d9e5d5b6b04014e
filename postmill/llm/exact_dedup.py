"""Exact dedup by a Golomb-coded fingerprint exchange.

Each partition of the input hashes its normalised texts, and sends to every owner of a hash range
the sorted distinct fingerprints as a Rice-coded blob. Owners decode, find the fingerprints that
more than one partition (or one partition twice) holds, and answer each blob with a bitmap. Only the
rows under set bits are suspects; their texts alone are compared byte by byte. What a partition
keeps at home (ids, digests) and what it sends is one table in the shared folder, so a lost
executor costs no consistency.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, free_name, materialize, small, table, without

#: Bits of a fingerprint; a clash only makes a suspect, which byte verification clears.
BITS = 52
#: Suspect ids up to this many are broadcast (under 100 bytes each); beyond, they are joined by shuffling.
BROADCAST_IDS = 1_000_000

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct values as gaps: all unary quotients, then all k-bit remainders."""
    gaps = np.diff(values, prepend=values[:1] * 0).astype(np.int64)
    quotients, n = gaps >> k, len(gaps)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
    return np.packbits(np.concatenate([unary, rest])).tobytes()


def rice_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n] if n else np.zeros(0, np.int64)
    quotients = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1 if n else 0
    rest = bits[at : at + n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
    return np.cumsum((quotients.astype(np.int64) << k) + rest)


def _rice_parameter(n: int, span: int) -> int:
    return max(0, int(span * 0.69 / max(n, 1)).bit_length() - 1)


_HOME = "src int, owner int, n int, k int, code binary, twice binary, ranks array<int>, ids array<bigint>, shas array<binary>"


def _send(owners: int, bits: int):
    span = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, ids, shas = TaskContext.get().partitionId(), [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            shas += [hashlib.sha256((t or "").encode().translate(_TO_LOWER)).digest() for t in batch.column("text").to_pylist()]
        if not ids:
            return
        prints = np.frombuffer(b"".join(shas), dtype=">u8")[::4].astype(np.uint64) >> np.uint64(64 - bits)
        prints = prints.astype(np.int64)
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        cuts = np.searchsorted(prints, np.arange(owners + 1) * span)
        rows = []
        for owner in range(owners):
            a, b = int(cuts[owner]), int(cuts[owner + 1])
            if a == b:
                continue
            distinct, rank, count = np.unique(prints[a:b] - owner * span, return_inverse=True, return_counts=True)
            k = _rice_parameter(len(distinct), span)
            mine = order[a:b].tolist()
            rows.append((src, owner, len(distinct), k, rice_encode(distinct, k), np.packbits(count > 1).tobytes(), rank.tolist(), [ids[i] for i in mine], [shas[i] for i in mine]))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        names = [c.split()[0] for c in _HOME.split(", ")]
        for at in range(0, len(rows), 256):
            cols = list(zip(*rows[at : at + 256], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _answer(blobs: pa.Table) -> pa.Table:
    """For one owner: which of the fingerprints in each blob are held elsewhere too, or twice there."""
    rows = blobs.to_pylist()
    decoded = [rice_decode(r["code"], r["n"], r["k"]) for r in rows]
    every = np.concatenate(decoded)
    own = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8))[: r["n"]] for r in rows])
    _, rank, count = np.unique(every, return_inverse=True, return_counts=True)
    held = (count[rank] > 1) | (own > 0)
    cuts = np.cumsum([0] + [r["n"] for r in rows])
    maps = [np.packbits(held[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"src": blobs["src"], "owner": blobs["owner"], "dups": pa.array(maps, pa.binary())})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, owners: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts
    the row with the largest id stays (a null id is the smallest; of rows that repeat an id, one).
    An empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    home = materialize(rows.mapInArrow(_send(owners, bits), _HOME), "exact-home")
    answers = home.select("src", "owner", "n", "k", "code", "twice").groupBy("owner").applyInArrow(_answer, "src int, owner int, dups binary")
    bit = F.expr("(cast(conv(hex(substring(dups, (r div 8) + 1, 1)), 16, 10) as int) >> (7 - r % 8)) & 1")
    each = (
        home.select("src", "owner", "ranks", "ids", "shas")
        .join(answers, ["src", "owner"])
        .select("src", "owner", "dups", F.posexplode(F.arrays_zip("ranks", "ids", "shas")).alias("pos", "x"))
        .select("dups", F.col("x.ranks").alias("r"), F.col("x.ids").alias("id"), F.col("x.shas").alias("sha"), F.struct("src", "owner", "pos").alias("place"))
        .select("id", "sha", "place", (bit == 1).alias("suspect"))
    )
    each = materialize(each, "exact-suspects")
    suspects = each.where("suspect")
    ids = suspects.select(F.col("id").alias("sid")).distinct()
    n = suspects.count()
    bytes_ = rows.join(small(ids, n, BROADCAST_IDS), F.col("id").eqNullSafe(F.col("sid")), "left_semi").select(ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    checked = bytes_.groupBy("norm").agg(F.count("*").alias("group_size")).select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    keepers = suspects.groupBy("sha").agg(F.max(F.struct("id", "place")).alias("keep"))
    groups = materialize(keepers.join(checked, "sha"), "exact-groups")
    final = ["id", "keep_id", "group_size", "kept", "sha"]
    grouped = suspects.join(groups, "sha").select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("place") == F.col("keep.place"))).alias("kept"), "sha")
    alone = each.where(~F.col("suspect")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.select(final).unionByName(grouped.select(final)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of equal texts, that with the largest id; of rows that repeat an id too, one."""
    report = exact_dedup(docs, id_col, text_col, **how)
    report = materialize(report.where("NOT kept"), "exact-dropped")
    gone = report.where("NOT keep_id <=> doc_id").select(F.col("doc_id").alias("drop_id"), "text_sha256")
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    left = without(docs, gone, id_col, sha, "text_sha256")
    repeated = report.where("keep_id <=> doc_id")
    if repeated.isEmpty():
        return left
    mine, theirs = free_name(docs, "same_id"), free_name(docs, "same_sha")
    again = materialize(repeated.select(F.col("doc_id").alias(mine), F.col("text_sha256").alias(theirs)).distinct(), "exact-repeated")
    same = left[id_col].cast("bigint").eqNullSafe(again[mine]) & (sha == again[theirs])
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "inner").dropDuplicates([mine, theirs]).select(docs.columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row of documents which of the rows with an equal text stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
