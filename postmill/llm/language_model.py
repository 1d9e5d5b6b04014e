"""Language-model scoring: a gated recurrent network with a class-factored softmax, in numpy.

Word counts are taken over all training texts and stay distributed. The most frequent words are the
network's own: each has a row of the input table, a class, and an output vector. Every other word, seen or
not, belongs to one of TAIL classes by its last letters, within which it has its add-one share of the
counts. So log P(word) = log P(class | state) + log P(word | class, state) for own words, and the second
part is a count for the rest. The network is fitted on all training texts, each of which is read once: the texts are dealt over a few
rounds by hash, in each round every task fits a copy to its own texts by truncated backpropagation, and the
copies are averaged by their tokens. Scoring
carries the state from the first word of a text to its end.

Counts of the HEAD_WORDS most frequent words (a fixed bound) are broadcast; the other words of each text
are joined with the count table by shuffling.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slots, crc_mod, fold, materialize, mix, pieces, table, text_bytes, word_hashes, words

#: Words whose counts are broadcast; words of the network; its classes of own words and of others; its state.
HEAD_WORDS, OWN_WORDS, CLASSES, TAIL, HIDDEN = 1 << 19, 4096, 28, 64, 24
#: Rounds of the fit, each on its own share of the training texts; lanes and steps of a window, the rate at all lanes, and the
#: windows over which a copy reaches it; windows of a lane at least, fewer lanes being taken for fewer tokens.
ROUNDS, LANES, STEPS, RATE, WARM, LANE_WINDOWS = 4, 384, 24, 0.016, 16, 16
#: Tokens that a task of the fit has at least where there are so many (a copy of the network is about as large as
#: half of them), tokens that it holds at a time, and numbers of a row in which a copy is passed on.
TASK_TOKENS, BLOCK_TOKENS, CHUNK = 2_000_000, 1 << 20, 1 << 13
#: Bytes of text that are scored side by side.
SCORE_BYTES = 24 << 20
END_KEY = np.uint64(0x5E4D3C2B1A090800)
_CLASS = np.uint64(TAIL - 1)


def token_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word of each text and its end: 58 bits of the word's hash, 6 bits of tail class."""
    data, off = text_bytes(texts)
    data = fold(data)
    starts, ends, at = words(data, off)
    tail = data[ends - 1].astype(np.uint64) + np.uint64(31) * np.where(ends - starts > 1, data[ends - 2], 0).astype(np.uint64)
    keys = (word_hashes(data, starts, ends) & ~_CLASS) | (mix(tail) & _CLASS)
    n = len(off) - 1
    out = np.empty(len(keys) + n, np.uint64)
    cuts = at + np.arange(n + 1)
    last = np.zeros(len(out), bool)
    last[cuts[1:] - 1] = True
    out[last], out[~last] = END_KEY, keys
    return out, cuts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(counts[order], first))], ["key", "n"])

    for batch in batches:
        for piece in pieces(batch):
            held.append(np.unique(token_keys(piece.column("text"))[0], return_counts=True))
            size += len(held[-1][0])
            if size > 3_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Moments:
    """The running means of the gradients and their squares, and the windows that they were taken over."""

    def __init__(self, model: Model):
        self.t = 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.p.items() if k != "x"} for _ in range(2))
        self.rows = np.zeros(len(model.p["x"]), np.float32)


class Model:
    """The network and the counts that it needs; ids below len(own) are own words, then come tail classes."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, total: int, distinct: int, tail_totals: dict[int, tuple[int, int]]):
        order = np.argsort(-counts, kind="stable")[:OWN_WORDS].tolist()
        if (end := np.flatnonzero(head == END_KEY)).size and int(end[0]) not in order:
            order[-1] = int(end[0])
        self.own = len(order)
        own_keys, own_counts = head[order], counts[order].astype(float)
        sort = np.argsort(head)
        ids = np.full(len(head), -1, np.int64)
        ids[order] = np.arange(self.own)
        self.keys, self.counts, self.ids = head[sort], counts[sort], ids[sort]
        self.slots: Slots | None = None
        self.total, self.distinct = total, distinct
        self.tail_mass, self.tail_words = (np.array([tail_totals.get(k, (0, 0))[i] for k in range(TAIL)], float) for i in (0, 1))
        np.subtract.at(self.tail_mass, (own_keys & _CLASS).astype(int), own_counts)
        np.subtract.at(self.tail_words, (own_keys & _CLASS).astype(int), 1)
        share = np.cumsum(np.sqrt(own_counts))
        cls = np.unique(np.minimum((share - np.sqrt(own_counts)) / share[-1] * CLASSES, CLASSES - 1).astype(int), return_inverse=True)[1] if self.own else np.zeros(0, int)
        self.n_classes = int(cls.max(initial=0)) + 1
        self.starts = np.searchsorted(cls, np.arange(self.n_classes + 1))  # own words stand class by class
        self.cls = np.concatenate([cls, self.n_classes + np.arange(TAIL)])
        rng = np.random.default_rng(7)
        h, n = HIDDEN, self.own + TAIL
        self.p = {
            "x": rng.normal(0, 0.1, (n, 3 * h)), "u": rng.normal(0, 0.7 / h**0.5, (h, 3 * h)), "b": np.zeros(3 * h),
            "c": rng.normal(0, 0.05, (h, self.n_classes + TAIL)), "cb": np.log(np.bincount(self.cls, np.concatenate([own_counts, self.tail_mass + 1]), self.n_classes + TAIL) + 0.5),
            "w": np.zeros((self.own, h)), "wb": np.log(own_counts + 0.5),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Network ids, and counts (-1: not among the broadcast words)."""
        if self.slots is None:  # made where it is used, not broadcast
            self.slots = Slots(self.keys)
        at = self.slots.find(keys)
        found = at >= 0
        ids = np.where(found, self.ids[at], -1) if len(self.keys) else np.full(len(keys), -1, np.int64)
        counts = np.where(found, self.counts[at], -1) if len(self.keys) else np.full(len(keys), -1, np.int64)
        return np.where(ids >= 0, ids, self.own + (keys & _CLASS).astype(np.int64)), counts

    def step(self, h: np.ndarray, x: np.ndarray):
        """The next state from h and the words' rows of x (with b), and the gates that it went through."""
        s, a = HIDDEN, h @ self.p["u"]
        g = x[:, : 2 * s] + a[:, : 2 * s]
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        n = g[:, s:] * a[:, 2 * s :]
        n += x[:, 2 * s :]
        np.tanh(n, out=n)
        out = h - n
        out *= g[:, :s]
        out += n
        return out, g, n, a[:, 2 * s :]

    def _bounded(self) -> tuple[bool, bool]:
        """Whether the logits of classes, and of words, can neither overflow nor vanish in exp: states lie within -1 and 1,
        so the weights bound them. Where the bound is too loose, each row is shifted by its largest."""
        return tuple(bool((np.abs(w).sum(axis=axis) + np.abs(b)).max(initial=0) < 60) for w, b, axis in ((self.p["c"], self.p["cb"], 0), (self.p["w"], self.p["wb"], 1)))

    @staticmethod
    def _exp(logits: np.ndarray, bounded: bool) -> np.ndarray:
        """exp(logits) in place and what they were shifted by."""
        if bounded:
            return np.exp(logits, out=logits), np.float32(0)
        top = logits.max(axis=1)
        logits -= top[:, None]
        return np.exp(logits, out=logits), top

    def outputs(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None, bounded: tuple[bool, bool] | None = None):
        """log P of ids given states h; with grads also the gradient at h, and of the output weights into grads."""
        bounded = bounded or self._bounded()
        order = np.argsort(self.cls[ids].astype(np.uint8), kind="stable")  # class by class; tail classes come last
        h, ids = h[order], ids[order]
        rows, cls = np.arange(len(ids)), self.cls[ids]
        logits = h @ self.p["c"]
        logits += self.p["cb"]
        out = logits[rows, cls]
        e, top = self._exp(logits, bounded[0])
        norm = e @ np.ones(e.shape[1], np.float32)
        out = out - top - np.log(norm)
        if grads is not None:
            e *= (1 / norm)[:, None]
            e[rows, cls] -= 1
            grads["c"], grads["cb"] = h.T @ e, np.ones(len(e), np.float32) @ e
            back = e @ self.p["c"].T
            grads["w"], grads["wb"] = np.zeros_like(self.p["w"]), np.zeros_like(self.p["wb"])
        cuts = np.searchsorted(cls, np.arange(self.n_classes + 1)).tolist()
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            a, b = self.starts[k], self.starts[k + 1]
            if lo == hi or b - a < 2:
                continue
            some, w, wb = h[lo:hi], self.p["w"][a:b], self.p["wb"][a:b]
            inner = some @ w.T
            inner += wb
            pick = (rows[: hi - lo], ids[lo:hi] - a)
            chosen = inner[pick]
            e, top = self._exp(inner, bounded[1])
            norm = e @ np.ones(b - a, np.float32)
            out[lo:hi] += chosen - top - np.log(norm)
            if grads is not None:
                e *= (1 / norm)[:, None]
                e[pick] -= 1
                grads["w"][a:b], grads["wb"][a:b] = e.T @ some, np.ones(hi - lo, np.float32) @ e
                back[lo:hi] += e @ w
        found = np.empty_like(out)
        found[order] = out
        if grads is None:
            return found
        at_h = np.empty_like(back)
        at_h[order] = back
        return found, at_h

    def fit(self, ids: np.ndarray, end: int) -> None:
        state = Moments(self)
        for turn in range(ROUNDS):
            part = ids[turn * len(ids) // ROUNDS : (turn + 1) * len(ids) // ROUNDS]
            self.fit_block(part, end, state, (turn / ROUNDS, (turn + 1) / ROUNDS))

    def fit_block(self, ids: np.ndarray, end: int, state: Moments, progress: tuple[float, float]) -> None:
        """Truncated backpropagation: each lane reads its part of the tokens, and keeps its state between windows;
        what the lanes leave over is read by one more."""
        lanes = max(1, min(LANES, len(ids) // (LANE_WINDOWS * STEPS)))
        whole, s = len(ids) // lanes * lanes, HIDDEN
        for lane in (ids[:whole].reshape(lanes, -1), ids[whole:].reshape(1, -1)):
            h = np.zeros((len(lane), s), np.float32)
            for at in range(0, lane.shape[1], STEPS):
                part = np.ascontiguousarray(lane[:, at : at + STEPS].T)
                x = self.p["x"][part]
                x += self.p["b"]
                go = (part != end).astype(np.float32)[:, :, None]
                shape = (*part.shape, s)
                states, z, r, n, a = (np.empty(shape, np.float32) for _ in range(5))
                for j in range(len(part)):
                    states[j] = h
                    h, g, n[j], a[j] = self.step(h, x[j])
                    z[j], r[j] = g[:, :s], g[:, s:]
                    h *= go[j]
                grads: dict[str, np.ndarray] = {}
                _, back = self.outputs(states.reshape(-1, s), part.ravel(), grads)
                back = back.reshape(shape)
                of_n, of_z, of_r = (1 - z) * (1 - n * n), (states - n) * z * (1 - z), a * r * (1 - r)
                dx, inner, dh = np.empty((*part.shape, 3 * s), np.float32), np.empty((*part.shape, 3 * s), np.float32), np.zeros_like(h)
                for j in range(len(part) - 1, -1, -1):
                    d = dh * go[j]
                    dn = np.multiply(d, of_n[j], out=dx[j, :, 2 * s :])
                    np.multiply(d, of_z[j], out=dx[j, :, :s])
                    np.multiply(dn, of_r[j], out=dx[j, :, s : 2 * s])
                    inner[j, :, : 2 * s] = dx[j, :, : 2 * s]
                    np.multiply(dn, r[j], out=inner[j, :, 2 * s :])
                    dh = inner[j] @ self.p["u"].T
                    d *= z[j]
                    dh += d
                    dh += back[j]
                dx = dx.reshape(-1, 3 * s)
                grads["u"], grads["b"] = states.reshape(-1, s).T @ inner.reshape(-1, 3 * s), np.ones(len(dx), np.float32) @ dx
                order = np.argsort((flat := part.ravel()).astype(np.uint16 if len(self.cls) < 1 << 16 else np.int32), kind="stable")
                first = np.flatnonzero(np.diff(flat[order], prepend=-1))
                seen = flat[order][first]
                grads["x"] = np.add.reduceat(dx[order], first)
                state.t += 1
                rate = RATE * (lanes / LANES) ** 0.5 * min(1.0, state.t / WARM) * (1 - 0.9 * (progress[0] + (progress[1] - progress[0]) * at / lane.shape[1]))
                for k, g in grads.items():
                    g *= 1 / lanes
                    np.clip(g, -1, 1, out=g)
                    if k == "x":  # a word's row moves only in windows with the word, by the running size of its gradients
                        v = state.rows[seen]
                        v += 0.01 * (np.einsum("ij,ij->i", g, g) / g.shape[1] - v)
                        state.rows[seen] = v
                        g *= (-rate / (np.sqrt(v / (1 - 0.99**state.t)) + 1e-6))[:, None]
                        self.p[k][seen] += g
                        continue
                    m, v = state.m[k], state.v[k]
                    m += 0.1 * (g - m)
                    g *= g
                    v += 0.01 * (g - v)
                    root = np.sqrt(v * (1 / (1 - 0.99**state.t)))
                    root += 1e-6
                    self.p[k] -= np.divide(m, root, out=root) * (rate / (1 - 0.9**state.t))

    def score(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Natural log probability of each token row cuts[i]:cuts[i+1], its state carried from start to end."""
        sizes = np.diff(cuts)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = cuts[:-1][order], sizes[order]
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1)) if len(sizes) else np.zeros(0, int)
        total, h, states, targets, rows, held = np.zeros(len(sizes)), np.zeros((len(sizes), HIDDEN), np.float32), [], [], [], 0
        x, bounded = self.p["x"] + self.p["b"], self._bounded()
        for t, n in enumerate(live.tolist()):
            h = h[:n]
            now = ids[starts[:n] + t]
            states.append(h)
            targets.append(now)
            rows.append(np.arange(n))
            held += n
            if t + 1 < len(live):
                h = self.step(h[: live[t + 1]], x[now[: live[t + 1]]])[0]
            if held >= 16384 or t + 1 == len(live):
                got = self.outputs(np.concatenate(states), np.concatenate(targets), bounded=bounded)
                total += np.bincount(np.concatenate(rows), got, len(total))
                states, targets, rows, held = [], [], [], 0
        out = np.zeros(len(total))
        out[order] = total
        return out


_COPY = "chunk int, task int, n bigint, part binary"


def _fit(held, progress: float, expected: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = copy.copy(held.value)
        model.p = {k: v.copy() for k, v in model.p.items()}
        end = int(model.look_up(np.array([END_KEY]))[0][0])
        state, waiting, size, n = Moments(model), [], 0, 0

        def block(at: int) -> None:
            nonlocal waiting, size, n
            ids = np.concatenate(waiting)
            span = tuple(progress + min(1.0, x / expected) / ROUNDS for x in (n, n + at))
            model.fit_block(ids[:at], end, state, span)
            waiting, size, n = [ids[at:]], size - at, n + at

        for batch in batches:
            for piece in pieces(batch):
                waiting.append(model.look_up(token_keys(piece.column("text"))[0])[0].astype(np.int32))
                size += len(waiting[-1])
                while size >= BLOCK_TOKENS:
                    block(BLOCK_TOKENS)
        if size:
            block(size)
        if n:
            flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)])
            parts = [flat[i : i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]
            task = [TaskContext.get().partitionId()] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(task, pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], [c.split()[0] for c in _COPY.split(", ")])

    return run


def _mean(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("task")
    n = rows["n"].to_pylist()
    mean = sum(k * np.frombuffer(p.as_py(), np.float32).astype(np.float64) for k, p in zip(n, rows["part"], strict=True)) / sum(n)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(n)], pa.int32()), pa.array([sum(n)], pa.int64()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], [c.split()[0] for c in _COPY.split(", ")])


def fit_all(texts: DataFrame, model: Model, total: int) -> list[int]:
    """Fit model to all texts, which have `total` tokens; returns the tokens that each round read. Copies of a text with
    other ids (further columns) are dealt over the rounds.

    The rate falls over the rounds, and within each over the tokens that a task has on average."""
    read: list[int] = []
    texts = texts.withColumn("round", F.pmod(F.xxhash64(*texts.columns), F.lit(ROUNDS)))
    texts = texts.coalesce(max(1, total // ROUNDS // TASK_TOKENS))
    expected = total / ROUNDS / texts.rdd.getNumPartitions()
    for turn in range(ROUNDS):
        held = texts.sparkSession.sparkContext.broadcast(model)
        copies = texts.where(F.col("round") == turn).select("text").mapInArrow(_fit(held, turn / ROUNDS, expected), _COPY)
        means = sorted(copies.groupBy("chunk").applyInArrow(_mean, _COPY).collect())  # one copy of the network
        held.unpersist()
        if not means:  # no text in this round
            read.append(0)
            continue
        flat = np.frombuffer(b"".join(bytes(r.part) for r in means), np.float32)
        cuts = np.cumsum([model.p[k].size for k in sorted(model.p)])[:-1]
        model.p = {k: x.reshape(model.p[k].shape).copy() for k, x in zip(sorted(model.p), np.split(flat, cuts), strict=True)}
        read.append(means[0].n)
    return read


_SCORED = "uid bigint, id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>"


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        uid = TaskContext.get().partitionId() << 33
        tail_norm = np.log(model.tail_mass + model.tail_words + 1)
        for batch in batches:
            for large in pieces(batch, limit=SCORE_BYTES):
                parts = [token_keys(p.column("text")) for p in pieces(large)]
                keys = np.concatenate([k for k, _ in parts])
                sizes = np.concatenate([np.diff(c) for _, c in parts])
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                ids, counts = model.look_up(keys)
                rare = counts < 0
                logp = model.score(ids, cuts)
                known = counts > 0
                logs = np.log(np.maximum(counts, 0) + 1.0)
                base = np.where(known, logs / np.log(10) - np.log10(model.total + model.distinct + 1.0), 0.0)
                extra = np.where(known & (ids >= model.own), logs - tail_norm[(keys & _CLASS).astype(int)], 0.0)
                sums = [np.add.reduceat(x, cuts[:-1]) for x in (known.astype(np.int64), base, extra)]
                n_rare = np.add.reduceat(rare.astype(np.int64), cuts[:-1])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), pa.array(keys[rare].view(np.int64)))
                n = large.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(n)), large.column("id"), large.column("held_out"), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array((logp + sums[2]) / np.log(10)), lists], [c.split()[0] for c in _SCORED.split(", ")])
                uid += n

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words with A-Z lower-cased and one end; a null text is empty. Training texts are those
    whose crc32 of the id isn't 2 modulo 7. score is the log10 probability of the text's tokens, the end
    included; an unseen word has the share that add-one leaves in its tail class. Words are told apart by
    58 bits. Rows may repeat and ids may be null; other columns are ignored. Without training texts all
    counts are 0; an empty table gives an empty result."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", crc_mod("id", 7) == 2)
    counts = rows.where("NOT held_out").select("text").mapInArrow(_count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word-counts")
    totals = counts.groupBy(F.col("key").bitwiseAND(TAIL - 1).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # TAIL rows
    total, distinct = sum(r.n for r in totals), sum(r.v for r in totals)
    step = F.floor(F.log2("n") * 16)
    most, low = 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect(), reverse=True):  # 16 rows for each doubling
        most += r.v
        if most > HEAD_WORDS:
            low = r.step + 1
            break
    head = counts.where(step >= low).toArrow()  # the most frequent words, HEAD_WORDS at most
    model = Model(head["key"].to_numpy().view(np.uint64), head["n"].to_numpy(), total, distinct, {r.k: (r.n, r.v) for r in totals})
    if total:
        fit_all(rows.where("NOT held_out").select("id", "text"), model, total)
    held = spark.sparkContext.broadcast(model)
    each = materialize(rows.select("id", "held_out", "text").mapInArrow(_score(held), _SCORED), "lm-scores")
    norm = np.log10(model.tail_mass + model.tail_words + 1).tolist()
    rare = each.select("uid", F.explode("rare").alias("key")).join(counts, "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    part = F.log10(F.col("c") + 1) - F.array(*[F.lit(float(x)) for x in norm])[F.col("key").bitwiseAND(TAIL - 1).cast("int")]
    sums = rare.groupBy("uid").agg(F.sum((F.col("c") > 0).cast("bigint")).alias("k"), F.sum(F.log10(F.col("c") + 1) - float(np.log10(total + distinct + 1))).alias("b"), F.sum(part).alias("s"))
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return each.drop("rare").join(sums, "uid", "left").select(F.col("id").alias("doc_id"), "held_out", "n_tokens", add("n_known", "k").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), add("base", "b").alias("base_score"), add("score", "s").alias("score"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every text of documents, learned from those that aren't held out."""
    return lm_scores(table(spark, sf_dir, "documents"))
