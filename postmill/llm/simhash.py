"""SimHash near-dedup with pigeonring candidate filtering.

Fingerprints are made in Arrow batches; equal ones are one node. Candidates share the exact segments
that a pigeonring chain demands (32 of 64 bits), must then keep the proportional budget of every
chain prefix, and only then have their whole Hamming distance taken. Groups are found as connected
components, so a large group of near copies is never expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DROP_IDS, WORD_BASE, Rolling, compact, fold, materialize, mix, pieces, small, table, text_bytes, text_hash, without, word_hashes, words
from .components import components

SEED = 42


def majority_bits(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each run hashes[cuts[i]:cuts[i+1]]: the bits set in over half of it; 0 for an empty run."""
    out = np.zeros(len(cuts) - 1, np.uint64)
    sizes = np.diff(cuts)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    per = -(-sizes[full] // 255)
    first = np.cumsum(per) - per
    blocks = np.repeat(cuts[:-1][full], per) + (np.arange(per.sum()) - np.repeat(first, per)) * 255
    for shift in range(8):  # eight counters of a byte side by side, for at most 255 hashes at a time
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101), blocks)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (counts * 2 > sizes[full][:, None]).astype(np.uint64)
        out[full] |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64) << np.uint64(shift)
    return out


def fingerprints(data: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    data = fold(data)
    starts, ends, at = words(data, off)
    flat, begin, end = compact(data, starts, ends)
    n = np.diff(at)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    cuts = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - cuts[:-1], count) + np.arange(cuts[-1])
    last = first + np.repeat(np.minimum(n, shingle), count) - 1
    view, digest = memoryview(flat.tobytes()), xxhash.xxh64_intdigest
    spans = zip(begin[first].tolist(), end[last].tolist(), strict=True)
    return majority_bits(np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, cuts[-1]), cuts)


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                prints = fingerprints(*text_bytes(piece.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("th"), pa.array(prints.view(np.int64))], ["id", "th", "fp"])

    return run


SEGMENTS, WIDTH = 8, 8
#: A bucket of up to this many fingerprints is compared pair by pair; a larger one is refined first.
BUCKET = 256


def _bits(segments: list[int], width: int = WIDTH) -> int:
    return sum(((1 << width) - 1) << (width * (s % (64 // width))) for s in segments)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_masks(distance: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Pigeonring keys: (start, mask of bits that must agree, budgets of the chain from start).

    If two fingerprints differ in `distance` bits at most, then from some segment on, every chain of
    l consecutive segments (round the ring) differs in l * distance / SEGMENTS bits at most. The first
    segments have budget 0 and agree; those after them, as long as the budget is below 2, differ in
    one bit at most together, so that all but one of them agree."""
    budget = [length * distance // SEGMENTS for length in range(1, SEGMENTS + 1)]
    exact, loose = budget.count(0), budget.count(0) + budget.count(1)
    out = []
    for start in range(SEGMENTS):
        ring = [start + i for i in range(SEGMENTS)]
        chain = [(_bits(ring[:length]), budget[length - 1]) for length in range(1, SEGMENTS + 1)]
        tail = ring[exact:loose]
        for skip in tail if distance else tail[:1]:
            out.append((start, _bits(ring[:exact] + [s for s in tail if s != skip or not distance]), chain))
    return out


def _buckets(members: DataFrame, keys: list[str]) -> DataFrame:
    """members (distinct, with a column fp) whose bucket holds two or more, and its size n."""
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return members.join(sizes, keys)


def _pairs(members: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Pairs within a bucket that pass keep; with a column root only those of different roots."""
    grouped = "root" in members.columns
    other = members.select(*keys, F.col("fp").alias("gp"), *([F.col("root").alias("other_root")] if grouped else []))
    pairs = members.join(other, keys).where("fp < gp").where(keep)
    return (pairs.where("root <> other_root") if grouped else pairs).select("fp", "gp")


def fingerprint_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (fp, gp) that connect all fingerprints at `distance` or fewer bits, for distinct fp.

    Small buckets are compared pair by pair: first the chain budgets, then the whole distance. In a
    bucket of more than BUCKET the bits beyond its key are cut into 4-bit parts, of which all but
    `distance` must agree: finer buckets, with 4 * distance free bits. One that is still large isn't
    expanded into pairs: members that agree but for the same `distance` free bits are all linked to the
    smallest of them. No bucket is cut short. If prints has a column root, links within a root aren't looked for."""
    masks = chain_masks(distance)
    known = ["root"] if "root" in prints.columns else []
    keyed = prints.select("fp", *known, F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, (_, mask, _) in enumerate(masks)])).alias("x")).select("fp", *known, "x.slot", "x.key")
    shared = materialize(_buckets(keyed, ["slot", "key"]), "buckets")
    differ = "bit_count(fp ^ gp)"
    budgets = " ".join(f"WHEN {i} THEN " + " AND ".join(f"bit_count((fp ^ gp) & {_signed(m)}) <= {b}" for m, b in chain if b < distance) for i, (_, _, chain) in enumerate(masks)) if distance else ""
    chained = f"(CASE slot {budgets} END) AND {differ} <= {distance}" if distance else f"{differ} = 0"
    links = _pairs(shared.where(f"n <= {BUCKET}"), ["slot", "key"], chained)
    large = shared.where(f"n > {BUCKET}")
    if large.isEmpty():
        return links.distinct()
    finer = []
    for i, (_, mask, _) in enumerate(masks):
        free = [p for p in range(16) if not (mask >> (4 * p)) & 15]
        finer += [(i, mask | _bits([p for p in free if p not in out], 4)) for out in combinations(free, distance)]
    table = F.create_map(*[x for i in range(len(masks)) for x in (F.lit(i), F.array(*[F.lit(_signed(m)) for j, m in finer if j == i]))])
    fine = large.select("fp", *known, "slot", F.explode(table[F.col("slot")]).alias("mask")).select("fp", *known, "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    fine = materialize(_buckets(fine.distinct(), ["mask", "part"]), "buckets-fine")
    links = links.union(_pairs(fine.where(f"n <= {BUCKET}"), ["mask", "part"], f"{differ} <= {distance}"))
    dense = fine.where(f"n > {BUCKET}")
    if dense.isEmpty():
        return links.distinct()
    open_bits = F.expr("filter(sequence(0, 63), i -> (shiftright(mask, i) & 1) = 0)")
    choose = dense.select("fp", "mask", open_bits.alias("open"))
    cleared = F.lit(0).cast("bigint")
    for k in range(distance):
        choose = choose.select("*", F.posexplode("open").alias(f"p{k}", f"b{k}")).where(f"p{k} > p{k - 1}" if k else "true")
        cleared = cleared.bitwiseOR(F.expr(f"shiftleft(1L, b{k})"))
    hub = choose.select("fp", F.col("fp").bitwiseAND(F.bitwise_not(cleared)).alias("hub"), cleared.alias("cleared")).distinct()
    centre = hub.groupBy("hub", "cleared").agg(F.min("fp").alias("gp"))
    return links.union(hub.join(centre, ["hub", "cleared"]).where("fp <> gp").select("gp", "fp")).distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, text_hash.

    Shingles are `shingle` words of the text with A-Z lower-cased (fewer words: the whole sequence; no
    word, or null: fingerprint zero, linked like any other). component_id is the smallest id that can be
    reached by links of `distance` or fewer bits; null ids don't count for it. Equal fingerprints are
    one node, so copies of any number cost one. An empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", text_hash("text"))
    each = materialize(rows.mapInArrow(_fingerprint(shingle), "id bigint, th bigint, fp bigint"), "simhash")
    nodes = materialize(each.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(fingerprint_links(nodes.select("fp"), distance), "fp", "gp")
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return each.join(classes, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("th").alias("text_hash"))


#: Min-hash bands and their rows: texts of Jaccard similarity s share a band with probability 1 - (1 - s**5)**24.
BANDS, BAND_ROWS = 24, 5
#: In a band's bucket of more texts a few of them are compared with all others, round by round, before the rest is.
BAND_BUCKET = 32
#: Texts of a large bucket, outside its largest group, that a round compares with all of it.
CENTRES = 8
#: Bits of a text's sketch: bit i tells whether an odd number of its different shingles falls on i.
SKETCH = 1024
_MULTIPLIERS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _shingles(piece: pa.RecordBatch, shingle: int):
    """(hashes of the word shingles, where each text's begin, a hash of each text's words)."""
    data, off = text_bytes(piece.column("text"))
    data = fold(data)
    starts, ends, at = words(data, off)
    roll = Rolling(word_hashes(data, starts, ends), WORD_BASE)
    n = np.diff(at)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    cuts = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - cuts[:-1], count) + np.arange(cuts[-1])
    return roll.of(first, first + np.repeat(np.minimum(n, shingle), count)), cuts, roll.of(at[:-1], at[1:])


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set of different hashes, SKETCH / 64 int64 a row.

    Two sketches differ in no more bits than the sets have elements that only one of them holds."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bits = (mix(np.concatenate([*sets, np.zeros(0, np.uint64)])) >> np.uint64(40)).astype(np.int64) % SKETCH
    odd = (np.bincount(owner * SKETCH + bits, minlength=len(sets) * SKETCH) & 1).astype(np.uint8).reshape(len(sets), SKETCH)
    return np.packbits(odd, axis=1).view(np.int64)


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                hashes, cuts, node = _shingles(piece, shingle)
                full = np.flatnonzero(np.diff(cuts))
                keys = np.zeros((len(full), BANDS), np.uint64)
                for band in range(BANDS if len(full) else 0):
                    for row in range(BAND_ROWS):
                        low = np.minimum.reduceat(hashes * _MULTIPLIERS[band * BAND_ROWS + row], cuts[:-1][full])
                        keys[:, band] = mix(keys[:, band] + low)
                bands: list = [[] for _ in node]
                for r, k in zip(full.tolist(), keys.view(np.int64).tolist(), strict=True):
                    bands[r] = k
                prints = majority_bits(hashes, cuts)
                sets = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                cols = [piece.column("id"), piece.column("th"), pa.array(node.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64()), pa.array(list(sketches(sets)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "th", "node", "fp", "bands", "held", "sketch"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                hashes, cuts, _ = _shingles(piece, shingle)
                each = [np.unique(hashes[a:b]).view(np.int64).tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(each, pa.list_(pa.int64()))], ["node", "s"])

    return run


def _verified(rows: DataFrame, texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have at least that Jaccard similarity; only their texts are moved."""
    pairs = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(texts, "node").select("node", F.col("one.id").alias("nid"), F.col("one.th").alias("nth"))
    need = materialize(need, "candidate-texts")
    held = rows.join(small(need, need.count(), DROP_IDS), F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth"))).select("node", "text")
    sets = materialize(held.mapInArrow(_sets(shingle), "node bigint, s array<bigint>").dropDuplicates(["node"]), "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "near-links")


def _close(similarity: float) -> str:
    """That the sketches of two texts, (ha, sa) and (held, sketch), allow that Jaccard similarity.

    At it, the elements that only one of the sets holds are (1 - s) / (1 + s) of both sizes together at most, and
    the sketches show no more of them than there are: no pair that has the similarity is ever passed over."""
    differ = " + ".join(f"bit_count(sa[{i}] ^ sketch[{i}])" for i in range(SKETCH // 64))
    return f"least(ha, held) >= {similarity} * greatest(ha, held) - 1e-6 AND ({differ}) * {1 + similarity} <= (ha + held) * {1 - similarity} + 1e-6"


def _allowed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes, once each, whose sketches allow the similarity."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = texts.select(F.col("node").alias("a"), F.col("held").alias("ha"), F.col("sketch").alias("sa"))
    other = texts.select(F.col("node").alias("b"), "held", "sketch")
    return pairs.join(first, "a").join(other, "b").where(_close(similarity)).select("a", "b")


def _placed(many: DataFrame, roots: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """The members of buckets with their sketches, their groups and that of most of the bucket; how many are outside that."""
    known = texts.select("node", "held", "sketch")
    placed = materialize(many.join(roots, "node", "left").join(known, "node").select("band", "key", "node", "held", "sketch", F.coalesce("root", "node").alias("root")), "members")
    sizes = placed.groupBy("band", "key", "root").agg(F.count("*").alias("n")).groupBy("band", "key").agg(F.max(F.struct("n", "root")).alias("x"))
    placed = materialize(placed.join(materialize(sizes.select("band", "key", F.col("x.root").alias("home")), "homes"), ["band", "key"]), "placed")
    return placed, placed.where("root <> home").count()


def _across(some: DataFrame, placed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of some members and all of their buckets outside their groups, whose sketches allow the similarity."""
    some = some.select("band", "key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("held").alias("ha"), F.col("sketch").alias("sa"))
    both = some.join(placed.select("band", "key", F.col("node").alias("b"), "root", "held", "sketch"), ["band", "key"])
    return both.where(f"ra <> root AND {_close(similarity)}").select("a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, text_hash, component_id, in groups of texts linked by Jaccard similarity.

    64 SimHash bits can't tell 0.8 from less: such pairs differ in up to 19 bits, more than any pigeonring
    key bears. So fingerprints within three bits are candidates, and texts that share a band of min-hashes
    of the same shingles too; sketches, which never pass over a pair that is similar, leave few candidate pairs, whose
    shingle sets are then compared. Texts with the
    same words are one node. In each bucket every text is compared with the smallest; in a large one, as long as that
    halves the texts outside the bucket's largest group, a few of those are compared with all of the bucket; then all
    that are left outside, with all of the bucket outside their own group. So no link between groups is lost and a
    group of near copies isn't expanded into its pairs. Texts without
    words, null ones included, are one node, linked to nothing else. component_id is the smallest id of the group (null ids don't count)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", text_hash("text"))
    each = materialize(rows.mapInArrow(_sign(shingle), "id bigint, th bigint, node bigint, fp bigint, bands array<bigint>, held bigint, sketch array<bigint>"), "signatures")
    texts = materialize(each.groupBy("node").agg(F.min(F.struct("id", "th")).alias("one"), F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("held").alias("held"), F.first("sketch").alias("sketch")), "signature-nodes")
    some = texts.where(F.size("bands") > 0)
    centre = materialize(some.groupBy("fp").agg(F.min("node").alias("node")), "fingerprint-nodes")
    stars = some.join(centre.withColumnRenamed("node", "c"), "fp").select(F.col("node").alias("a"), F.col("c").alias("b"))
    keyed = some.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("c")).where("n > 1")
    shared = materialize(keyed.join(materialize(sizes, "band-sizes"), ["band", "key"]), "band-buckets")
    first = stars.union(shared.select(F.col("node").alias("a"), F.col("c").alias("b")))
    good = _verified(rows, texts, _allowed(first, texts, similarity), shingle, similarity)
    roots = components(good, "a", "b")
    large, before, outside = shared.where(f"n > {BAND_BUCKET}"), None, 0
    if not large.isEmpty():
        placed, outside = _placed(large, roots, texts)
    while outside and (before is None or outside < before / 2):  # while some texts of each bucket draw most others in
        some = placed.where("root <> home").groupBy("band", "key", F.pmod(F.hash("node"), F.lit(CENTRES)).alias("i")).agg(F.min(F.struct("node", "root", "held", "sketch")).alias("x"))
        good = good.union(_verified(rows, texts, _across(some.select("band", "key", "x.*"), placed, similarity), shingle, similarity))
        roots = components(good, "a", "b")
        before, (placed, outside) = outside, _placed(large, roots, texts)
    placed, _ = _placed(shared.where("n > 2"), roots, texts)
    prints = materialize(centre.join(roots, "node", "left").select("fp", "node", F.coalesce("root", "node").alias("root")), "fingerprint-roots")
    links = fingerprint_links(prints.select("fp", "root"))
    near = links.join(prints.select("fp", F.col("node").alias("a")), "fp").join(prints.select(F.col("fp").alias("gp"), F.col("node").alias("b")), "gp").select("a", "b")
    left = _across(placed.where("root <> home"), placed, similarity).union(_allowed(near, texts, similarity))
    good = good.union(_verified(rows, texts, left, shingle, similarity))
    roots = components(good, "a", "b")
    rooted = materialize(texts.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    classes = rooted.join(least, "root").select("node", "component_id")
    return each.select("id", "th", "node").join(materialize(classes, "classes"), "node").select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of similar texts: that with the smallest id.

    A row without an id goes if its group has an id, and stays otherwise. Texts without words, null ones included, are one
    group and similar to nothing else; rows that repeat the smallest id with the same text all stay (exact dedup takes them out). An empty table stays empty."""
    report = similar_groups(docs, id_col, text_col, **how)
    gone = report.where("component_id IS NOT NULL AND NOT doc_id <=> component_id").select(F.col("doc_id").alias("drop_id"), "text_hash")
    return without(docs, gone, id_col, text_hash(text_col), "text_hash")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text of documents, links being three differing bits or fewer."""
    return simhash_dedup(table(spark, sf_dir, "documents"))
