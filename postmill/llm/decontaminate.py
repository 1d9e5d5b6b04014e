"""Benchmark decontamination by spaced seeds.

Fixed masks pick some word positions of a span and ignore the others, so a hash of the picked words
survives substitutions at the ignored places. The hashes of all benchmark positions are joined with
those of every text position; hits are verified on their diagonal, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BASE, fold, mix, pieces, table, text_bytes, text_hash, without, word_hashes, words

#: Positions that each mask looks at (fixed values, found by a greedy cover). Items of 13 words or more: any 13 to 25
#: words with up to a fifth of them changed keep one placement of one mask; a longer overlap holds a part of such a
#: size that agrees as well. Shorter items, which must be there whole: masks for each length, in the same way, and
#: below five words, where 0.8 allows no change, all words.
MASKS = ["11101111", "11010010111", "111110011", "1100110001011", "1111111", "1100001011011", "111101011"]
SHORT_MASKS = {
    5: ["1111", "10111", "11101", "11011"], 6: ["10111", "11101"], 7: ["110111", "11111", "111101"], 8: ["1011111", "11101101", "1111011"], 9: ["1110111", "11011011"],
    10: ["1111011", "11001111", "110110011", "11110101", "10101111"], 11: ["1110111", "111001011", "1001011101", "11110011"], 12: ["11101011", "101100111", "101001111"],
}
#: Words of the benchmark that are searched at a time; a longer benchmark is taken in slices.
SLICE_WORDS = 2_000_000
FILTER_BITS = 22


def _hash_at(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    n = len(hashes) - len(mask) + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1" and n > 0:
            total += hashes[i : i + n] * np.uint64((WORD_BASE * (2 * i + 1) + 2 * number) & (1 << 64) - 1 | 1)
    return mix(total)


def _item_words(texts: list[str]) -> list[np.ndarray]:
    data, off = text_bytes(pa.array(texts, pa.string()))
    data = fold(data)
    starts, ends, at = words(data, off)
    hashes = word_hashes(data, starts, ends)
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Index:
    """The seeds of some benchmark items: for each mask sorted hashes with item and place, and a bit filter."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        lengths = {len(w) for w in items}
        short = [(m, {n}) for n in range(1, 13) if n in lengths for m in SHORT_MASKS.get(n, ["1" * n])]
        self.tables = []
        for number, (mask, of) in enumerate([*((m, {n for n in lengths if n > 12}) for m in MASKS), *short]):
            use = [i for i, w in enumerate(items) if len(w) in of]
            found = [_hash_at(items[i], mask, number) for i in use]
            keys = np.concatenate([np.zeros(0, np.uint64), *found])
            item = np.repeat(np.array(use, np.int32), [len(f) for f in found])
            place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(f), dtype=np.int32) for f in found)])
            order = np.argsort(keys, kind="stable")
            if not len(keys):
                continue
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[keys & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.tables.append((mask, number, keys[order], item[order], place[order], bits))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in hashes, item, place in item) of every equal seed."""
        out = []
        for mask, number, keys, item, place, bits in self.tables:
            seeds = _hash_at(hashes, mask, number)
            at = np.flatnonzero(bits[(seeds & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            low, high = np.searchsorted(keys, seeds[at]), np.searchsorted(keys, seeds[at], side="right")
            n = high - low
            pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(at, n), item[pick], place[pick]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def best_overlap(item: np.ndarray, doc: np.ndarray, shift: int, similarity: float, need: int = 0) -> tuple[int, int, int]:
    """On one diagonal, of the stretches of `need` words at least, the one with most agreement: (start in doc,
    words, agreeing words); no words if none reaches the similarity. Scores are whole numbers, so 0.8 is exact."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b - a < need:
        return a + shift, 0, 0
    same = item[a:b] == doc[a + shift : b + shift]
    part = Fraction(str(similarity))
    score = np.concatenate([[0], np.cumsum(np.where(same, part.denominator - part.numerator, -part.numerator))])
    low = np.minimum.accumulate(score[: len(score) - need])  # the least prefix that is `need` words back or more
    gain = score[need:] - low
    end = int(np.argmax(gain))
    if gain[end] < 0:
        return a + shift, 0, 0
    start = int(np.argmin(score[: end + 1]))
    return a + shift + start, end + need - start, int(same[start : end + need].sum())


_FOUND = "doc_id bigint, th bigint, item_id bigint, start bigint, n_words bigint, n_same bigint"


def _search(index, item_ids: list[int], least: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            for piece in pieces(batch):
                data, off = text_bytes(piece.column("text"))
                data = fold(data)
                starts, ends, at = words(data, off)
                hashes = word_hashes(data, starts, ends)
                place, item, inside = held.hits(hashes)
                row = np.searchsorted(at, place, side="right") - 1
                tried = np.unique(np.stack([row, item, place - at[row] - inside], axis=1), axis=0) if len(row) else []
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for r, i, shift in (x.tolist() for x in tried):
                    need = min(least, len(held.items[i]))
                    found = best_overlap(held.items[i], hashes[at[r] : at[r + 1]], shift, similarity, need)
                    if found[2] > best.get((r, i), (0, 0, 0))[2]:
                        best[r, i] = found
                if best:
                    rows = pa.array([r for r, _ in best])
                    cols = [piece.column("id").take(rows), piece.column("th").take(rows), pa.array([item_ids[i] for _, i in best], pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*best.values(), strict=True))]
                    yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _FOUND.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least: int = 13, similarity: float = 0.8) -> DataFrame:
    """One row per text and benchmark item that overlap: doc_id, th (hash of the text), item_id, start, n_words, n_same.

    An overlap is a stretch of `least` words at least (or a whole shorter item) in which at least
    `similarity` of the words agree place by place, A-Z lower-cased, found from a seed hit on its
    diagonal; the best one of each pair is told. With 13 words and 0.8 or more every such overlap has a hit;
    with smaller values some are missed. Null and empty texts and items overlap nothing. Rows may repeat and ids may be null; each row is told by
    itself. The benchmark is searched in slices of SLICE_WORDS words, each against all texts; only one
    slice is held at a time by a worker."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", text_hash("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").orderBy("item_id", "text")
    slices, held, size = [], [], 0
    for row in items.toLocalIterator():
        n = row.text.count(" ") + row.text.count("\n") + 1
        if held and size + n > SLICE_WORDS:
            slices, held, size = [*slices, held], [], 0
        held.append((row.item_id, row.text))
        size += n
    out = None
    for some in [*slices, held]:
        index = spark.sparkContext.broadcast(Index(_item_words([t for _, t in some])))
        found = rows.mapInArrow(_search(index, [i for i, _ in some], least, similarity), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose text overlaps a benchmark item.

    Null and empty texts overlap nothing and stay, as do all rows if the benchmark is empty. Rows that repeat an id are judged by their own
    texts; rows with a null id too. How often or how well a text overlaps makes no difference."""
    found = contaminated(docs, benchmark, id_col, text_col, **how)
    gone = found.select(F.col("doc_id").alias("drop_id"), "th")
    return without(docs, gone, id_col, text_hash(text_col), "th")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that overlap, with the best overlap of each."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")
