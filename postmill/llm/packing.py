"""Sequence packing: shortest-pack-first over the histogram of lengths.

Each document is cut at multiples of the sequence length; full pieces are sequences of their own, and
the rests are packed. Only the histogram of rests (as many rows as the sequence is long) comes to the
driver; it places lengths longest first, each into the shortest pack that it fits, a run of equal packs
at a time. That gives runs of ranks of each length; a document finds its place by its rank among all
documents of its length, which is a rank within its chunk plus the counts of the chunks before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, table
from .tokens import END_ID, Encoder, tokenizer_path


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, rank from, rank to, first sequence, offset) runs, and the number of sequences."""
    open_packs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: (first sequence, count)
    runs, sequences, widest = [], 0, 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            while widest and not open_packs[widest]:
                widest -= 1
            if widest >= length:
                first, count = open_packs[widest].pop()
                used = min(count, left)
                if count > used:
                    open_packs[widest].append((first + used, count - used))
                free = widest
            else:
                first, used, free = sequences, left, capacity
                sequences += left
            runs.append((length, rank, rank + used, first, capacity - free))
            open_packs[free - length].append((first, used))
            widest = max(widest, free - length)
            rank, left = rank + used, left - used
    return runs, sequences


_CUT = "chunk int, id bigint, n bigint, rest int, rank bigint, full bigint, full_before bigint, crcs array<bigint>"


def _cut(path: str, capacity: int, release: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk = Encoder.at(path), TaskContext.get().partitionId()
        seen, fulls = np.zeros(capacity, np.int64), 0
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                flat, cuts = encoder.encode_all(piece.column("text"))
                ids = np.insert(flat, cuts[1:], END_ID).astype("<u4")
                ends = (cuts[1:] + np.arange(1, len(cuts))).tolist()
                for doc, a, b in zip(piece.column("id").to_pylist(), [0, *ends], ends, strict=False):
                    full, rest = divmod(b - a, capacity)
                    rows.append((chunk, doc, b - a, rest, int(seen[rest]), full, fulls, [zlib.crc32(ids[at : min(at + capacity, b)]) for at in range(a, b, capacity)]))
                    seen[rest] += 1
                    fulls += full
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _CUT.split(", ")])
        if release:
            encoder.release()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None, release: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text (null: empty) is its token ids and one end id, so each document has a piece. Documents of
    one length are interchangeable: which of them shares a sequence with which depends on the order of
    the input files. Ids may be null or repeated; rows are packed as they come. An empty table gives an
    empty result; other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = materialize(rows.mapInArrow(_cut(tokenizer or tokenizer_path(), capacity, release), _CUT), "pieces")
    counts = cut.where("rest > 0").groupBy("rest", "chunk").agg(F.count("*").alias("c")).union(cut.groupBy("chunk").agg(F.sum("full").alias("c")).select(F.lit(capacity), "chunk", "c"))
    counts = materialize(counts.toDF("length", "chunk", "c"), "piece-counts")
    histogram = {r.length: r.n for r in counts.where(F.col("length") < capacity).groupBy("length").agg(F.sum("c").alias("n")).collect()}  # below capacity rows
    runs, sequences = shortest_pack_first(histogram, capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    rests = offsets.where(F.col("length") < capacity).select(F.col("length").alias("rest"), "chunk", F.col("before").alias("rest_offset"))
    fulls = offsets.where(F.col("length") == capacity).select("chunk", F.col("before").alias("full_offset"))
    placed = cut.join(fulls, "chunk").join(rests, ["rest", "chunk"], "left")
    each = placed.select("*", F.posexplode("crcs").alias("i", "ids_crc32"))
    each = each.withColumn("whole", F.col("i") < F.col("full")).withColumn("place", F.when(~F.col("whole"), F.col("rank") + F.col("rest_offset")))
    plan = F.broadcast(spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length int, low bigint, high bigint, first bigint, at bigint"))
    joined = each.join(plan, (F.when(~F.col("whole"), F.col("rest")) == F.col("length")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")), "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        (F.col("i").cast("bigint") * capacity).alias("start"),
        F.when(F.col("whole"), F.lit(capacity)).otherwise(F.col("rest")).cast("bigint").alias("length"),
        "ids_crc32",
        F.col("n").alias("doc_tokens"),
        F.when(F.col("whole"), F.lit(sequences) + F.col("full_before") + F.col("full_offset") + F.col("i")).otherwise(F.col("first") + F.col("place") - F.col("low")).alias("sequence_id"),
        F.when(F.col("whole"), F.lit(0)).otherwise(F.col("at")).cast("bigint").alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of documents cut and packed into sequences of at most 1024 tokens: one row a piece."""
    return pack_documents(table(spark, sf_dir, "documents"))
