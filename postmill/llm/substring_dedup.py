"""Substring dedup on a compacted De Bruijn graph of words.

Every run of `window` words is an edge from its first to its last `window` - 1 words. Edges come in pieces: consecutive
edges of a text that share their minimizer (the smallest-hashed `seed`-word part of the window) are one piece, and
equal edges always have equal minimizers at equal places. Pieces whose minimizer occurs once hold no repeat and go. A
piece that occurs twice as a whole is an edge of the graph of repeats; where pieces with one minimizer differ, their
single windows that occur twice are. Joins on the edges then tell the branching ones: an edge has one next edge if the
same one follows it wherever it occurs, and one edge before it likewise. Where that holds on both sides of a node,
the two are joined, so that each maximal nonbranching path becomes one long span wherever it occurs, from its first
word to its last. Coordinates (row, first word) lead each span back to its text, where a 128-bit digest of its words
must be that of another occurrence of the path. If that fails anywhere, hashes have clashed, and all windows of the
candidate pieces are told apart by digests of their words instead. A passage that a third of the documents holds is
only ever counted, never paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_BASE, WORD_BASE_2, Rolling, compact, discard, materialize, mix, pieces, row_keyed, table, text_bytes, word_hashes, words

SEED_WORDS = 12
#: `at` holds the first word (of 2**32 at most) and below it a count of windows under 64.
N_BITS = 6
#: A step of a path: `at`, then whether it is a whole piece or a window, has one edge before it and one after it.
STEP_BITS = 3


def _word_arrays(piece: pa.RecordBatch, seed: int = 0):
    data, off = text_bytes(piece.column("text"))
    starts, ends, at = words(data, off)
    return data, starts, ends, at, word_hashes(data, starts, ends, seed)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _path_pieces(hashes: np.ndarray, at: np.ndarray, window: int, seed: int):
    """(row, first word, number of windows, place of the minimizer, hash of the minimizer) of each piece."""
    n = len(hashes)
    if n < window:
        return None
    seeds = Rolling(hashes, WORD_BASE)
    first = np.arange(n - seed + 1)
    of_seed = seeds.of(first, first + seed)
    place = _sliding_min((of_seed & np.uint64(0xFFFFFFFF00000000)) | first.astype(np.uint64), window - seed + 1) & np.uint64(0xFFFFFFFF)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    valid = np.flatnonzero(np.arange(n - window + 1) + window <= at[1:][row[: n - window + 1]])
    if not len(valid):
        return None
    place = place[valid].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    count = np.diff(np.append(new, len(valid)))
    start = valid[new]
    return row[start], start, count, place[new], of_seed[place[new]]


def _seeds(window: int, seed: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, starts, ends, at, hashes = _word_arrays(piece)
                found = _path_pieces(hashes, at, window, seed)
                if found is None:
                    continue
                row, start, count, place, anchor = found
                cols, names = [pa.array(anchor.view(np.int64))], ["anchor"]
                if whole:
                    shape = ((place - start) * 64 + count).astype(np.uint64)
                    second = Rolling(word_hashes(data, starts, ends, 1), WORD_BASE_2)
                    end = start + count - 1 + window
                    cols += [pa.array(mix(Rolling(hashes, WORD_BASE).of(start, end) ^ shape).view(np.int64)), pa.array(second.of(start, end).view(np.int64)), piece.column("key").take(pa.array(row)), pa.array((start - at[row]) << N_BITS | count)]
                    names += ["a", "b", "key", "at"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _listed(piece: pa.RecordBatch, at: np.ndarray, shift: int = 0):
    """(row, first word, number of windows, the packed value) of all entries of `ats`."""
    lists = piece.column("ats")
    packed = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
    value = packed >> shift
    return row, at[row] + (value >> N_BITS), value & ((1 << N_BITS) - 1), packed


def _windows(window: int, digests: bool = False):
    """The single windows of the pieces listed in `ats` for each text: hashes a and b, or halves of a digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, starts, ends, at, hashes = _word_arrays(piece)
                row, start, count, _ = _listed(piece, at)
                begin = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
                row = np.repeat(row, count)
                if digests:
                    a, b = _digests(*compact(data, starts, ends), begin, begin + window)
                else:
                    a, b = Rolling(hashes, WORD_BASE).of(begin, begin + window), Rolling(word_hashes(data, starts, ends, 1), WORD_BASE_2).of(begin, begin + window)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), piece.column("key").take(pa.array(row)), pa.array((begin - at[row]) << N_BITS | 1)], ["a", "b", "key", "at"])

    return run


def _digests(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit digest of the words first up to last, joined by one space."""
    view, digest = memoryview(flat.tobytes()), hashlib.blake2b
    spans = zip(begin[first].tolist(), end[last - 1].tolist(), strict=True)
    both = np.frombuffer(b"".join([digest(view[a:b], digest_size=16).digest() for a, b in spans]), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


_SPAN = "path bigint, n bigint, a bigint, b bigint"


def _spans(window: int):
    """The maximal nonbranching paths of each text: first edge, windows, digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, off = text_bytes(piece.column("text"))
                starts, ends, at = words(data, off)
                row, start, count, packed = _listed(piece, at, STEP_BITS)
                if not len(row):
                    continue
                edge = piece.column("edges").flatten().to_numpy()
                flags = packed & ((1 << STEP_BITS) - 1)
                order = np.lexsort((start, flags >> 2, row))  # row by row, whole pieces and single windows by themselves
                row, start, count, edge, flags = row[order], start[order], count[order], edge[order], flags[order]
                joined = (row[1:] == row[:-1]) & (flags[1:] >> 2 == flags[:-1] >> 2) & (start[1:] == start[:-1] + count[:-1])
                joined &= (flags[:-1] & 1 == 1) & (flags[1:] & 2 == 2)
                first = np.flatnonzero(np.concatenate([[True], ~joined]))
                n = np.add.reduceat(count, first)
                a, b = _digests(*compact(data, starts, ends), start[first], start[first] + n - 1 + window)
                yield pa.RecordBatch.from_arrays([pa.array(edge[first]), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["path", "n", "a", "b"])

    return run


_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:int,end:int>>"


def _remove(window: int, shift: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, off = text_bytes(piece.column("text"))
                starts, ends, at = words(data, off)
                _, begin, count, _ = _listed(piece, at, shift)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + count - 1 + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.flatnonzero(~gone)
                lengths = ends[kept] - starts[kept] + 1
                to = np.cumsum(lengths)
                flat = np.append(data, np.uint8(32))[np.arange(to[-1] if len(to) else 0) + np.repeat(starts[kept] - (to - lengths), lengths)]
                flat[to - 1] = 32
                cuts = np.concatenate([[0], to])[np.searchsorted(kept, at)]
                blob = flat.tobytes()
                texts = [blob[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                n = np.diff(at)
                removed = n - np.diff(np.searchsorted(kept, at))
                turn = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                firsts, lasts = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                spans = [[] if not r else _runs(gone[a:b]) for a, b, r in zip(at[:-1].tolist(), at[1:].tolist(), removed.tolist(), strict=True)] if len(firsts) or len(lasts) else [[]] * len(n)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(n), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, span)], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return run


def _runs(gone: np.ndarray) -> list[dict]:
    turn = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)]


def _by_text(listed: DataFrame, *more) -> DataFrame:
    """The coordinates of each text, in one list: as long as the text at most."""
    return listed.groupBy("key").agg(F.collect_list("at").alias("ats"), *more)


def _flagged(steps: DataFrame) -> DataFrame:
    """The steps (key, kind, at, edge) with STEP_BITS more: the kind, and whether the edge before and after is one and the same wherever the edge occurs.

    An edge at which a run of repeats begins or ends somewhere has none there, which is another."""
    line = Window.partitionBy("key", "kind").orderBy("at")
    start, count = F.shiftright("at", N_BITS), F.col("at").bitwiseAND((1 << N_BITS) - 1)
    line_up = steps.select("edge", start.alias("start"), (start + count).alias("end"), F.lag("edge").over(line).alias("last"), F.lag(start + count).over(line).alias("last_end"), F.lead("edge").over(line).alias("next"), F.lead(start).over(line).alias("next_start"))
    near = line_up.select("edge", F.when(F.col("last_end") == F.col("start"), F.col("last")).alias("last"), F.when(F.col("next_start") == F.col("end"), F.col("next")).alias("next"))
    one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    degrees = near.groupBy("edge").agg(F.coalesce(one("last"), F.lit(False)).alias("one_in"), F.coalesce(one("next"), F.lit(False)).alias("one_out"))
    inner = materialize(degrees.where("one_in OR one_out"), "inner-edges")
    bits = F.shiftleft("at", STEP_BITS) + F.col("kind") * 4 + F.coalesce(F.col("one_in").cast("bigint"), F.lit(0)) * 2 + F.coalesce(F.col("one_out").cast("bigint"), F.lit(0))
    return steps.join(inner, "edge", "left").select("key", bits.alias("at"), "edge")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed: int = SEED_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, removed (word spans).

    A word goes if it lies in a run of `window` words that also starts anywhere else, in the same text
    or another, as the input stands. Words are runs of bytes other than space and tab to carriage
    return; kept ones are joined by one space. Null and empty texts have no words. A row that occurs
    twice repeats itself. Ids may be null or repeated: each row is judged by itself and keeps its id. Texts may
    be of any length; other columns are ignored. `window` is at most 62 + seed words. An empty table gives an empty result."""
    if not seed <= window < 63 + seed:
        raise ValueError("window must be at least seed and below seed + 63")
    rows = row_keyed(docs, id_col, text_col)
    pieces_ = rows.select("key", "text").mapInArrow(_seeds(window, seed, True), "anchor bigint, a bigint, b bigint, key bigint, at bigint")
    anchors = rows.select("text").mapInArrow(_seeds(window, seed, False), "anchor bigint")
    repeated = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated-anchors")
    again = materialize(pieces_.join(repeated, "anchor", "left_semi"), "path-pieces")
    paths = materialize(again.groupBy("anchor", "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one")), "paths")
    whole = again.join(paths.where("n > 1").select("anchor", "a", "b"), ["anchor", "a", "b"], "left_semi")
    branching = materialize(paths.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "branching")
    branches = paths.join(branching, "anchor", "left_semi").select("one.key", "one.at")
    single = rows.select("key", "text").join(_by_text(branches), "key").mapInArrow(_windows(window), "a bigint, b bigint, key bigint, at bigint")
    single = materialize(single, "branch-windows")
    twice = materialize(single.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "repeated-windows")
    single_again = single.join(twice, ["a", "b"], "left_semi")
    steps = whole.select("key", F.lit(0).alias("kind"), "at", F.xxhash64("anchor", "a", "b").alias("edge"))
    steps = materialize(steps.union(single_again.select("key", F.lit(1), "at", F.xxhash64("a", "b"))), "steps")
    discard(repeated, paths, branching, single, twice)
    listed = _by_text(_flagged(steps), F.collect_list("edge").alias("edges"))
    none = F.array().cast("array<bigint>")
    held = materialize(rows.join(listed, "key", "left").select("key", "id", "text", F.coalesce("ats", none).alias("ats"), F.coalesce("edges", none).alias("edges")), "texts-with-paths")
    spans = held.where(F.size("ats") > 0).select("text", "ats", "edges").mapInArrow(_spans(window), _SPAN)
    if spans.groupBy("path", "n", "a", "b").count().where("count = 1").isEmpty():
        discard(again, steps)
        return held.select("id", "text", "ats").mapInArrow(_remove(window, STEP_BITS), _RESULT)
    every = materialize(rows.select("key", "text").join(_by_text(again), "key").mapInArrow(_windows(window, True), "a bigint, b bigint, key bigint, at bigint"), "window-digests")
    same = materialize(every.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "repeated-digests")
    parts = _by_text(every.join(same, ["a", "b"], "left_semi"))
    return rows.join(parts, "key", "left").select("id", "text", F.coalesce("ats", none).alias("ats")).mapInArrow(_remove(window, 0), _RESULT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents without the words of windows of 35 words that start anywhere else: counts and a digest of what is left."""
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS p FROM d),
k AS (SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(w[p : p + 34], ' ')) AS n FROM s),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 34)) AS i FROM k WHERE n > 1),
t AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
r AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept, count(*) AS m FROM t ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(m, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
