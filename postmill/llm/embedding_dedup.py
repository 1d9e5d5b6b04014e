"""Embedding near-dedup by sorted projection passes.

Each pass draws its own random hyperplanes; the signs of a vector's projections, one after another, are its code.
All vectors are sorted by code, so that similar ones, which agree in the leading bits with high probability, come
to stand near each other, and each is compared with the next WINDOW rows only. Verified pairs of all passes are united.

A window is too short where more vectors than it holds share the leading bits of a code, as in a large
group of near copies. Such crowded buckets are compared whole, in tiles: every tile meets every other one in a task of
its own, which sends back numbers of links and a spanning forest, never the pairs. A pair that shares the leading bits in
several passes counts in the first of them, and all others are told apart by their keys; so each link counts once.

The leading bits follow from the size of the largest label, the passes from the bits and the wanted
recall: at the threshold, two vectors agree in a sign with probability 1 - angle / pi.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, table
from .components import components
from ..storage import discard

THRESHOLD = 0.98
#: Rows that each vector is compared with, in each pass and direction.
WINDOW = 64
#: Chance that a pair just at the threshold shares the leading bits of some pass, at least.
RECALL = 0.995
#: Signs of a code.
SIGNS = 62
#: Rows of a tile of a crowded bucket.
TILE = 1024
SEED = 42
#: Rows of a partition of the sorted vectors, at most about.
PART_ROWS = 500_000
#: Rows of crowded buckets and of groups of equal vectors that are broadcast, at most.
BROADCAST_ROWS = 1_000_000

_ROW = "dim int, label string, code bigint, key bigint, mult bigint, crowd bigint, vec array<double>, codes array<bigint>"
_FOUND = "u bigint, v bigint, links bigint, kind string"
_EDGE = "part int, at bigint, side string, " + _ROW


def plan(largest: int, threshold: float, window: int, recall: float) -> tuple[int, int]:
    """Leading bits and passes for labels of at most `largest` different vectors."""
    bits = min(SIGNS, max(0, math.ceil(math.log2(max(1, 2 * largest / window)))))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if agree >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros (they are compared among themselves only)."""
    off = column.offsets.to_numpy()
    n = np.diff(off)
    flat = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    out = np.zeros((len(n), int(n.max()) if len(n) else 0), flat.dtype)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def _coder(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            codes = np.zeros((batch.num_rows, passes), np.int64)
            x = _matrix(batch.column("vec"))
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * SIGNS))
                rows = np.flatnonzero(dims == dim)
                signs = (x[rows, :dim] @ planes[dim] >= 0).reshape(len(rows), passes, SIGNS)
                codes[rows] = signs @ weights
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, passes, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])

    return run


class _Rows:
    """Vectors of a batch as arrays; lead holds the leading bits of their codes."""

    def __init__(self, batch, shift: int):
        self.key, self.mult, self.crowd = (batch.column(c).to_numpy() for c in ("key", "mult", "crowd"))
        self.dim, self.label = batch.column("dim").to_numpy(), _one(batch.column("label")).dictionary_encode().indices.to_numpy()
        self.x = _matrix(_one(batch.column("vec")))
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.lead = _matrix(_one(batch.column("codes"))) >> np.int64(shift)


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _tell(rows: _Rows, i: np.ndarray, j: np.ndarray, turn: int) -> Iterator[tuple]:
    """(u, v, kind) of verified pairs that this pass has to tell: those that share leading bits here first, unless the bucket is crowded, and those that share none anywhere."""
    same = rows.lead[i] == rows.lead[j]
    first = np.where(same.any(axis=1), same.argmax(axis=1), -1)
    for kind, told in (("first", (first == turn) & (rows.crowd[i] == 0)), ("apart", first < 0)):
        a, b = rows.key[i[told]], rows.key[j[told]]
        if len(a):
            yield np.minimum(a, b), np.maximum(a, b), kind


def _found(u: np.ndarray, v: np.ndarray, kind: str, links: np.ndarray | None = None) -> pa.RecordBatch:
    counts = pa.array(links if links is not None else np.zeros(len(u), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), counts, pa.array([kind] * len(u), pa.string())], [c.split()[0] for c in _FOUND.split(", ")])


def _near(rows: _Rows, begin: int, window: int, threshold: float, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j and j >= begin, of at most `window` places apart that are of one label and similar enough."""
    out_i, out_j, n = [], [], len(rows.key)
    for a in range(0, n, 256):
        b, to = min(a + 256, n), min(a + 256 + window, n)
        lo = max(a + 1, begin)
        if lo >= to:
            continue
        dots = rows.x[a:b] @ rows.x[lo:to].T
        i, j = np.nonzero(dots >= threshold * rows.norm[a:b, None] * rows.norm[None, lo:to] * (1 - 1e-9))
        cos = dots[i, j] / (rows.norm[a + i] * rows.norm[lo + j])
        i, j = i + a, j + lo
        gap = place[j] - place[i] if place is not None else j - i
        ok = (j > i) & (gap > 0) & (gap <= window) & (cos >= threshold) & (rows.label[i] == rows.label[j]) & (rows.dim[i] == rows.dim[j])
        out_i.append(i[ok])
        out_j.append(j[ok])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or empty), np.concatenate(out_j or empty)


def _sorted_pass(turn: int, shift: int, window: int, threshold: float, out_names: list[str]):
    """Compares the rows of a sorted partition within the window; sends the partition's first and last rows along, for its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, tail = TaskContext.get().partitionId(), 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                new = whole.slice(at, 4096)
                if seen < window:
                    yield _border(new.slice(0, window - seen), part, seen, "head", out_names)
                begin = tail.num_rows if tail is not None else 0
                both = new if tail is None else pa.Table.from_batches([tail, new]).combine_chunks().to_batches()[0]
                rows = _Rows(both, shift)
                i, j = _near(rows, begin, window, threshold)
                for u, v, kind in _tell(rows, i, j, turn):
                    yield _pairs(u, v, kind, new.schema, out_names)
                seen += new.num_rows
                tail = both.slice(max(0, both.num_rows - window))
        if tail is not None:
            yield _border(tail, part, seen - tail.num_rows, "tail", out_names)

    return run


def _border(rows: pa.RecordBatch, part: int, at: int, side: str, names: list[str]) -> pa.RecordBatch:
    n = rows.num_rows
    extra = {"part": pa.array([part] * n, pa.int32()), "at": pa.array(range(at, at + n), pa.int64()), "side": pa.array([side] * n, pa.string())}
    nothing = {"u": pa.nulls(n, pa.int64()), "v": pa.nulls(n, pa.int64()), "kind": pa.nulls(n, pa.string())}
    have = {**extra, **nothing, **{c: rows.column(c) for c in rows.schema.names}}
    return pa.RecordBatch.from_arrays([have[c] for c in names], names)


def _pairs(u: np.ndarray, v: np.ndarray, kind: str, schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    n = len(u)
    kinds = {f.name: f.type for f in schema} | {"part": pa.int32(), "at": pa.int64(), "side": pa.string()}
    have = {"u": pa.array(u), "v": pa.array(v), "kind": pa.array([kind] * n, pa.string())}
    return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(n, kinds[c]) for c in names], names)


def _border_block(turn: int, shift: int, window: int, threshold: float):
    """Compares border rows of different partitions; the block's own rows with those up to `window` places behind."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        rows, part, place = _Rows(block, shift), block.column("part").to_numpy(), block.column("place").to_numpy()
        own = block.column("own").to_numpy(zero_copy_only=False)
        i, j = _near(rows, 0, window, threshold, place)
        across = own[i] & (part[i] != part[j])
        told = [_found(u, v, kind) for u, v, kind in _tell(rows, i[across], j[across], turn)]
        return pa.Table.from_batches(told or [_found(*[np.zeros(0, np.int64)] * 2, "first")])

    return run


def _forest(near: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, others reached from it) for each component of a symmetric relation."""
    left = near.any(axis=1)
    while left.any():
        start = int(left.argmax())
        reached, front = np.zeros(len(near), bool), np.array([start])
        reached[start] = True
        while len(front):
            new = near[front].any(axis=0) & ~reached
            reached |= new
            front = np.flatnonzero(new)
        left &= ~reached
        reached[start] = False
        yield start, np.flatnonzero(reached)


def _tile_pair(turn: int, shift: int, threshold: float):
    """Compares two tiles of a crowded bucket, or one with itself: links that no earlier pass has counted, and a forest of all."""

    def run(block: pa.Table) -> pa.Table:
        rows = _Rows(block, shift)
        tile, a, b = block.column("tile").to_numpy(), block["a"][0].as_py(), block["b"][0].as_py()
        n = len(tile)
        near, links = np.zeros((n, n), bool), np.zeros(n, np.int64)
        for at in range(0, n, 256):
            to = min(at + 256, n)
            cos = (rows.x[at:to] @ rows.x.T) / (rows.norm[at:to, None] * rows.norm[None])
            ok = cos >= threshold
            ok[np.arange(to - at), np.arange(at, to)] = False
            if a != b:
                ok &= tile[at:to, None] != tile[None]
            near[at:to] = ok
            for earlier in range(turn):
                ok = ok & (rows.lead[at:to, earlier, None] != rows.lead[None, :, earlier])
            links[at:to] = ok @ rows.mult
        near |= near.T
        told = [_found(rows.key, rows.key, "count", links)]
        for start, others in _forest(near):
            told.append(_found(np.full(len(others), rows.key[start]), rows.key[others], "edge"))
        return pa.Table.from_batches(told)

    return run


def _pass(vectors: DataFrame, turn: int, bits: int, window: int, tile: int, threshold: float, parts: int) -> DataFrame:
    """What one pass finds, as a table of (u, v, links, kind): pairs of kind first and apart, counts of crowded buckets (u alone), edges."""
    spark, shift = vectors.sparkSession, SIGNS - bits
    code = F.element_at("codes", turn + 1)
    lead = F.shiftright(code, shift)
    crowded = vectors.groupBy("dim", "label", lead.alias("lead")).agg(F.count("*").alias("crowd")).where(F.col("crowd") > window + 1)
    crowded = materialize(crowded.select(F.col("dim").alias("c_dim"), F.col("label").alias("c_label"), "lead", "crowd"), "emb-crowded")
    n = crowded.count()
    rows = vectors.withColumn("code", code)
    rows = rows.join(small(crowded, n, BROADCAST_ROWS), (F.col("dim") == F.col("c_dim")) & (F.col("label") == F.col("c_label")) & (F.shiftright("code", shift) == F.col("lead")), "left") if n else rows.withColumn("crowd", F.lit(None).cast("bigint"))
    rows = rows.select("dim", "label", "code", "key", "mult", F.coalesce("crowd", F.lit(0).cast("bigint")).alias("crowd"), "vec", "codes")
    by = ["dim", "label", "code", "key"]
    schema = "u bigint, v bigint, kind string, " + _EDGE
    names = [c.split()[0] for c in schema.split(", ")]
    swept = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_sorted_pass(turn, shift, window, threshold, names), schema)
    swept = materialize(swept, "emb-sweep")
    ends = swept.where("part IS NOT NULL").drop("u", "v", "kind")
    sizes = ends.where("side = 'tail'").groupBy("part").agg((F.max("at") + 1).alias("n")).orderBy("part").collect()  # one row for each partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["n"]
    found = [swept.where("u IS NOT NULL").select("u", "v", F.lit(0).cast("bigint").alias("links"), "kind")]
    if len(starts) > 1:
        offset = F.broadcast(spark.createDataFrame(starts, "o_part int, o_at bigint"))
        block = 8 * window
        placed = ends.where(f"side = 'head' OR at >= {window}").join(offset, F.col("part") == F.col("o_part")).withColumn("place", F.col("at") + F.col("o_at"))
        home, before = F.expr(f"place div {block}"), F.expr(f"(place - {window}) div {block}")
        dealt = placed.select("part", "place", *[c.split()[0] for c in _ROW.split(", ")], F.explode(F.when((home != before) & (home > 0), F.array(F.struct(home.alias("block"), F.lit(True).alias("own")), F.struct((home - 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(home.alias("block"), F.lit(True).alias("own"))))).alias("to"))
        found.append(dealt.select("*", "to.block", "to.own").drop("to").groupBy("block").applyInArrow(_border_block(turn, shift, window, threshold), _FOUND))
    if n:
        tiles = F.ceil(F.col("crowd") / tile).cast("int")
        mine = F.pmod(F.xxhash64("key"), tiles).cast("int")
        tiled = rows.where("crowd > 0").withColumn("tile", mine).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        tiled = tiled.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other")).drop("other")
        found.append(tiled.withColumn("lead", F.shiftright("code", shift)).groupBy("dim", "label", "lead", "a", "b").applyInArrow(_tile_pair(turn, shift, threshold), _FOUND))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = materialize(out, f"emb-pass-{turn}")
    discard(swept, crowded)
    return out


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, tile: int = TILE, seed: int = SEED
) -> DataFrame:
    """One row for each input row: vec_id, n_links, component_id, kept.

    Rows are compared if their labels are equal and not null, and linked if their cosine, in double precision, is at least
    `threshold` (above 0). A vector that is null, empty, zero or holds a null or a non-finite component links with nothing,
    and vectors of different lengths don't link. Equal vectors of a label stand for one another and are linked with each
    other. component_id is the smallest id that links reach; of rows that share an id, or have none, each
    is a row of its own, and a null id is larger than any other. kept says whether vec_id is component_id; rows that repeat
    that id are all kept. Labels are compared as strings. An empty table gives an empty result; other columns are ignored."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    raw = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    fits = F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    unique = raw.where("id IS NULL").isEmpty() and raw.groupBy("id").count().where("count > 1").isEmpty()
    key = F.col("id") if unique else F.monotonically_increasing_id()
    rows = materialize(raw.select(key.alias("key"), "id", F.col("label").cast("string").alias("label"), F.when(fits, F.transform("vec", lambda x: x + 0.0)).alias("vec")), "emb-rows")
    alike = rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("key").alias("rep"), F.count("*").alias("mult"))
    alike = materialize(alike.select(F.size("vec").alias("dim"), "label", F.col("rep").alias("key"), "mult", "vec"), "emb-distinct")
    sizes = alike.groupBy("label", "dim").count().agg(F.max("count"), F.sum("count")).first()
    bits, passes = plan(sizes[0] or 0, threshold, window, recall)
    coded = materialize(alike.mapInArrow(_coder(passes, seed), "dim int, label string, key bigint, mult bigint, vec array<double>, codes array<bigint>"), "emb-coded")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes[1] or 0) // PART_ROWS))
    found = [_pass(coded, turn, bits, window, tile, threshold, parts) for turn in range(passes)]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    copies = materialize(alike.where("mult > 1").select("label", "vec", F.col("key").alias("rep"), "mult"), "emb-copies")
    n_copies = copies.count()
    pairs = every.where("kind = 'first'").select("u", "v").union(every.where("kind = 'apart'").select("u", "v").distinct())
    times = small(copies.select(F.col("rep").alias("v"), "mult"), n_copies, BROADCAST_ROWS)
    both = pairs.union(pairs.select("v", "u")).join(times, "v", "left").select("u", F.coalesce("mult", F.lit(1)).cast("bigint").alias("links"))
    links = both.union(every.where("kind = 'count'").select("u", "links")).groupBy(F.col("u").alias("l_key")).agg(F.sum("links").alias("links"))
    roots = components(every.where("kind <> 'count'"), "u", "v").select(F.col("node").alias("r_key"), "root")
    groups = small(copies.select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), "rep", "mult"), n_copies, BROADCAST_ROWS)
    told = rows.join(groups, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec")), "left").select("key", "id", F.coalesce("rep", "key").alias("rep"), F.coalesce("mult", F.lit(1)).alias("mult"))
    reps = links.join(roots, F.col("l_key") == F.col("r_key"), "full").select(F.coalesce("l_key", "r_key").alias("m_rep"), "links", "root")
    out = told.join(materialize(reps, "emb-links"), F.col("rep") == F.col("m_rep"), "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("bigint").alias("n_links"), F.coalesce("root", "rep").alias("root"))
    if unique:  # then a key is an id, and the root the smallest
        out = out.withColumn("component_id", F.col("root"))
    else:
        out = materialize(out, "emb-out")
        out = out.join(materialize(out.groupBy("root").agg(F.min("id").alias("component_id")), "emb-roots"), "root")
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all embeddings of a label at a cosine of 0.98 or more: links, component and kept of each vector."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
