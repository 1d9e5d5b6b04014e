"""Toxicity by weak supervision.

Many voters look at a text: one for each lexicon word (a fixed list, and words that the training labels
bring up), and patterns. A generative label model with a latent class estimates by EM how often each voter
fires in either class, and which voters fire together beyond that; the human label is one more, noisy,
voter. A linear classifier is then trained on the posterior labels, and alone scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_LETTER, crc_mod, fold, pieces, table, text_bytes, word_hashes, words

#: Labelled rows of each class that the fit takes, at most: those with the smallest hash of the id.
MAX_FIT = 10_000
#: Lexicon words that the training labels may bring up, at most.
MAX_MINED = 200
#: How often the human label is right: the one voter whose accuracy is given, which anchors the classes.
LABEL_ACCURACY = 0.97
#: Words that vote for toxic wherever they stand.
LEXICON = ["asshole", "bastard", "bitch", "clown", "crap", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "idiota", "imbecile", "imbécil", "jerk", "loser", "moron", "pathetic", "scum", "shit", "stupid", "stupide", "trash", "ugly", "vermin", "worthless", "blöd", "dumm", "abschaum", "basura", "ordure", "estúpido"]
PATTERNS = ["p:shouting", "p:exclamations", "p:any", "p:two_or_more", "p:dense"]


def _letters(piece: pa.RecordBatch):
    raw, off = text_bytes(piece.column("text"))
    data = fold(raw)
    starts, ends, at = words(data, off, NO_LETTER)
    return raw, off, data, starts, ends, at


def _hashes_of(terms: list[str]) -> np.ndarray:
    blob = "\n".join(terms).encode()
    data, off = np.frombuffer(blob, np.uint8), np.array([0, len(blob)])
    starts, ends, _ = words(data, off)
    return word_hashes(data, starts, ends)


def voter_counts(piece: pa.RecordBatch, keys: np.ndarray, order: np.ndarray, strong: int) -> np.ndarray:
    """For each text: occurrences of each lexicon word, then the pattern voters (0 or 1).

    Patterns of words look at the first `strong` lexicon words."""
    raw, off, data, starts, ends, at = _letters(piece)
    rows, n = len(off) - 1, np.diff(at)
    out = np.zeros((rows, len(keys) + len(PATTERNS)), np.float32)
    if not len(starts):
        return out
    hashes = word_hashes(data, starts, ends)
    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
    hit = np.flatnonzero(keys[place] == hashes) if len(keys) else place
    row = np.searchsorted(at, hit, side="right") - 1
    np.add.at(out, (row, order[place[hit]]), 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    shouted = (raw[starts] < 91) & (raw[ends - 1] < 91) & (raw[starts] > 64) & (raw[ends - 1] > 64) & (ends - starts > 2)
    marks = np.diff(np.concatenate([[0], np.cumsum(raw == 33)])[off])
    hits = out[:, :strong].sum(axis=1)
    out[:, len(keys) :] = np.stack([sums(shouted) * 20 > n, marks * 20 > n, hits > 0, hits > 1, hits * 50 > n], axis=1)
    return out


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text of the fit, once a text, counted by class."""
    counts: dict[bytes, list[int]] = {}
    for batch in batches:
        for piece in pieces(batch):
            _, _, data, starts, ends, at = _letters(piece)
            blob, classes = data.tobytes(), piece.column("toxic").to_pylist()
            for r, toxic in enumerate(classes):
                for word in {blob[a:b] for a, b in zip(starts[at[r] : at[r + 1]].tolist(), ends[at[r] : at[r + 1]].tolist(), strict=True) if 2 < b - a < 40}:
                    counts.setdefault(word, [0, 0])[toxic] += 1
    if counts:
        clean, toxic = zip(*counts.values(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["word", "clean", "toxic"])


def _votes(lexicon: list[str], strong: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes_of(lexicon)
        order = np.argsort(hashes)
        for batch in batches:
            for piece in pieces(batch):
                found = voter_counts(piece, hashes[order], order, strong)
                yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array([x.tobytes() for x in found], pa.binary())], ["toxic", "votes"])

    return run


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over a latent class: posterior of class 1, firing rates [voter, class], weights against correlation.

    votes: 0 or 1 for each voter; the label is the last voter, of known accuracy. A voter's log odds count by the inverse of
    how much it fires together with others beyond what the class explains."""
    fired = np.column_stack([votes, labels]).astype(float)
    post = np.clip(labels * 0.9 + 0.05, 0, 1)
    weights = np.ones(fired.shape[1])
    rates = np.zeros((fired.shape[1], 2))
    for turn in range(rounds):
        mass = np.stack([1 - post, post], axis=1)
        rates = np.clip((fired.T @ mass + [0.5, 0.5]) / (mass.sum(axis=0) + 1), 1e-4, 1 - 1e-4)
        rates[-1] = 1 - LABEL_ACCURACY, LABEL_ACCURACY
        if turn % 10 == 0:
            rest = fired - mass @ rates.T
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
            together = np.abs((rest.T @ rest) / len(rest) / np.outer(spread, spread))
            np.fill_diagonal(together, 0)
            together[-1] = together[:, -1] = 0
            weights = 1 / (1 + np.where(together > 0.1, together, 0).sum(axis=1))
            weights[-1] = 1
        prior = np.clip(mass.mean(axis=0), 1e-3, 1)
        odds = np.log(prior[1] / prior[0]) + fired @ (weights * np.log(rates[:, 1] / rates[:, 0])) + (1 - fired) @ (weights * np.log((1 - rates[:, 1]) / (1 - rates[:, 0])))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, rates, weights


def _features(votes: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(votes), np.ones(len(votes), votes.dtype)])


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 25, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    beta = np.zeros(x.shape[1])
    total = weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - target)) / total + ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x / total + ridge * np.eye(len(beta))
        beta -= np.linalg.solve(hess, grad)
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[str], int, np.ndarray]:
    """Lexicon, how many of its first words are strong, and weights, from docs (id, text, crc) and labels (id, toxic) with crc not 0."""
    spark = docs.sparkSession
    known = labels.where("toxic IN (0, 1)").where(crc_mod("id", 5) != 0).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return list(LEXICON), len(LEXICON), np.concatenate([np.full(len(LEXICON), 3.0), np.zeros(len(PATTERNS)), [-2.0]])
    pick = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(MAX_FIT) for c in (0, 1)]
    chosen = pick[0].union(pick[1])
    rows = docs.select("id", "text").join(F.broadcast(chosen), "id").select("text", "toxic")  # 2 * MAX_FIT ids at most
    words_ = rows.mapInArrow(_mine, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n1, n0 = min(sizes[1], MAX_FIT), min(sizes[0], MAX_FIT)
    lift = (F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("clean") + 0.5) / (n0 + 1))
    mined = words_.where(F.col("toxic") >= max(10, n1 // 50)).where(lift > 8).orderBy(F.desc("toxic"), "word").limit(MAX_MINED).collect()
    lexicon = sorted({*LEXICON, *(r.word for r in mined if r.toxic >= n1 / 10)})
    strong = len(lexicon)
    lexicon += sorted({r.word for r in mined}.difference(lexicon))
    got = rows.mapInArrow(_votes(lexicon, strong), "toxic int, votes binary").collect()  # the bounded sample, a few hundred bytes a row
    votes = np.stack([np.frombuffer(r.votes, np.float32) for r in got]) if got else np.zeros((0, len(lexicon) + len(PATTERNS)), np.float32)
    toxic = np.array([r.toxic for r in got])
    if not len(got) or toxic.min() == toxic.max():
        return lexicon, strong, np.concatenate([np.full(len(lexicon), 3.0), np.zeros(len(PATTERNS)), [-2.0]])
    post, _, _ = label_model(votes > 0, toxic)
    weight = np.where(toxic == 1, sizes[1] / n1, sizes[0] / n0)
    return lexicon, strong, fit_linear(_features(votes).astype(float), post, weight)


def _score(lexicon: list[str], strong: int, beta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes_of(lexicon)
        order = np.argsort(hashes)
        for batch in batches:
            for piece in pieces(batch):
                z = _features(voter_counts(piece, hashes[order], order, strong)) @ beta
                cols = [piece.column(c) for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*(c for c in piece.schema.names if c != "text"), "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, th (hash of the text).

    Null and empty texts get the score of a text without any vote. Only labels of rows whose crc32 of the
    id isn't 0 modulo 5 are used (of repeated ids the largest label; nulls and other values none); if one
    class has none, the fixed lexicon alone decides. Rows may repeat, ids may be null; other columns are
    ignored; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    lexicon, strong, beta = fit(rows, labels.select(F.col(id_col).cast("bigint").alias("id"), F.col("toxic")))
    scored = rows.withColumns({"held_out": crc_mod("id", 5) == 0, "th": F.hash("text")}).mapInArrow(_score(lexicon, strong, beta), "id bigint, held_out boolean, th int, score double")
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "th")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns pass through one scan.

    A null text counts as empty. Rows are judged one by one by their texts, so repeated ones fare alike, whatever their ids; a score of
    just 0.5 goes. Labels of null ids, or of ids that docs doesn't have, teach nothing. An empty table stays empty."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    lexicon, strong, beta = fit(plain, labels.select(F.col(id_col).cast("bigint").alias("id"), F.col("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes_of(lexicon)
        order = np.argsort(hashes)
        for batch in batches:
            for piece in pieces(batch, text_col):
                only = pa.RecordBatch.from_arrays([piece.column(text_col)], ["text"])
                z = _features(voter_counts(only, hashes[order], order, strong)) @ beta
                yield piece.filter(pa.array(z < 0))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each text of documents is toxic, learned from the labels of rows that aren't held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")
