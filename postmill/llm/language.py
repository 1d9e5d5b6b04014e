"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has, at each position, one bit for every language; the AND over the positions
of an n-gram is the set of all languages that contain it. A text's languages are counted bit by bit,
each count is corrected for the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_LETTER, crc_mod, materialize, mix, pieces, table, text_bytes

#: Positions of the filter (its size is fixed) and hashes of an n-gram.
POSITIONS, HASHES = 1 << 20, 4
GRAM = 3
#: A language contains an n-gram that is at least this share of its training n-grams; less is noise, such as words of other languages.
#: So a language has 1 / LEAST_SHARE n-grams at most, which bounds what the driver builds the filter from.
LEAST_SHARE = 3e-4


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (packed bytes) of the lower-cased letters of each text, word ends marked, and where each text's begin."""
    data, off = text_bytes(pc.utf8_lower(texts))
    n = len(off) - 1
    flat = np.full(len(data) + 2 * n, 32, np.uint64)  # two blanks after each text
    row = np.repeat(np.arange(n), np.diff(off))
    flat[np.arange(len(data)) + 2 * row + 1] = np.where(NO_LETTER[data], 32, data)
    starts = off + 2 * np.arange(n + 1)
    if len(flat) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    packed = flat[:-2] << np.uint64(16) | flat[1:-1] << np.uint64(8) | flat[2:]
    good = np.flatnonzero(flat[1:-1] != 32)
    return packed[good], np.searchsorted(good, starts)


def positions(packed: np.ndarray) -> list[np.ndarray]:
    h = mix(packed)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(POSITIONS - 1)).astype(np.int64) for i in range(HASHES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for piece in pieces(batch):
            packed, at = grams(piece.column("text"))
            langs = np.array(piece.column("lang").to_pylist(), object)
            row = np.repeat(np.arange(len(langs)), np.diff(at))
            for lang in set(langs.tolist()):
                keys, counts = np.unique(packed[np.isin(row, np.flatnonzero(langs == lang))], return_counts=True)
                new = np.stack([keys.astype(np.int64), counts])
                if lang in totals:
                    both = np.concatenate([totals[lang], new], axis=1)
                    keys, back = np.unique(both[0], return_inverse=True)
                    new = np.stack([keys, np.bincount(back, weights=both[1]).astype(np.int64)])
                totals[lang] = new
    for lang, both in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * both.shape[1], pa.string()), pa.array(both[0]), pa.array(both[1])], ["lang", "gram", "n"])


class Filter:
    """Bit slices of 64 languages each, and each language's false-positive rate."""

    def __init__(self, langs: list[str], held: list[tuple[int, int]]):
        self.langs = langs
        self.slices = np.zeros((-(-len(langs) // 64), POSITIONS), np.uint64)
        packed, lang = np.array([g for g, _ in held], np.uint64), np.array([i for _, i in held], np.int64)
        for at in positions(packed):
            np.bitwise_or.at(self.slices, (lang // 64, at), np.uint64(1) << (lang % 64).astype(np.uint64))
        fill = [((self.slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false = np.array(fill) ** HASHES

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the corrected share of n-grams contained; and the numbers of n-grams."""
        packed, at = grams(texts)
        n = np.diff(at)
        at_each = positions(packed)
        out = np.zeros((len(n), len(self.langs)))
        full = np.flatnonzero(n)
        for s, bits in enumerate(self.slices):
            mask = bits[at_each[0]]
            for place in at_each[1:]:
                mask &= bits[place]
            for i in range(s * 64, min(s * 64 + 64, len(self.langs))):
                one = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
                if len(full):
                    out[full, i] = np.add.reduceat(one, at[:-1][full]) / n[full]
        return np.clip((out - self.false) / (1 - self.false), 0, 1), n


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Filter = held.value
        for batch in batches:
            for piece in pieces(batch):
                shares, n = found.shares(piece.column("text"))
                texts = piece.column("text")
                data, off = text_bytes(texts)
                plain = np.diff(np.concatenate([[0], np.cumsum(~NO_LETTER[data] & (data < 128))])[off]) > 0
                none = ~plain & (n == 0)
                for r in np.flatnonzero(~plain & (n > 0)):  # only signs beyond ASCII: are any of them letters?
                    none[r] = not any(c.isalpha() for c in texts[int(r)].as_py())
                best = shares.argmax(axis=1) if len(found.langs) else np.zeros(len(n), np.int64)
                total = shares.sum(axis=1)
                score = np.where(total > 0, shares.max(axis=1, initial=0) / np.maximum(total, 1e-12), 0.0)
                lang = ["und" if x or not found.langs else found.langs[i] for x, i in zip(none, best, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("held_out"), pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the winner's part of all corrected shares).

    Learns from the texts with a known language whose crc32 of the id isn't 1 modulo 3; a language is never
    an input otherwise. `und` with score 0 for a null text or one without a letter, and for all if no language
    is known; equal shares go to the language with more n-grams in training. Rows may repeat and ids may be
    null; other columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("held_out", crc_mod("id", 3) == 1)
    counts = rows.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    kept = counts.join(F.broadcast(totals), "lang").where(share >= LEAST_SHARE).select("lang", "gram", "total").collect()  # totals: one row for each language
    langs = [lang for lang, _ in sorted({r.lang: r.total for r in kept}.items(), key=lambda x: (-x[1], x[0]))]
    number = {lang: i for i, lang in enumerate(langs)}
    held = spark.sparkContext.broadcast(Filter(langs, [(r.gram, number[r.lang]) for r in kept]))
    return rows.select("id", "held_out", "text").mapInArrow(_predict(held), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of documents, learned from two thirds of the rows."""
    return identify(table(spark, sf_dir, "documents"))
