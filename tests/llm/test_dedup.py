import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from postmill.llm import exact_dedup, simhash, substring_dedup
from postmill.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Ünïcode wörds"), (6, "x" * 300_000), (None, "no id"), (None, "no id"), (7, "same row"), (7, "same row"), (8, "a\x00b   c")]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def text_of(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@given(st.sets(st.integers(0, 1 << 40), min_size=1, max_size=200), st.integers(0, 39))
def test_rice_round_trip(values, k):
    x = np.array(sorted(values), np.int64)
    if (x >> k).max() < 1 << 16:
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(x, k), len(x), k) == x).all()


def test_exact_dedup_edges(docs):
    got = exact_dedup.exact_dedup(docs([*EDGE, (9, "SAME ROW"), (10, "ÜNÏCODE WÖRDS")]), bits=8, owners=3).collect()
    assert len(got) == len(EDGE) + 2
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in by[sha("")]} == {(1, 2, 2, False), (2, 2, 2, True)}
    assert {r.keep_id for r in by[sha("same row")]} == {9} and len(by[sha("same row")]) == 3
    assert len(by[sha("Ünïcode wörds")]) == 1  # only A-Z are folded
    assert all(sum(r.kept for r in rows) == 1 for rows in by.values())


def test_exact_dedup_empty_and_drop(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    left = exact_dedup.drop_duplicates(docs([(1, "a"), (2, "A"), (2, "A"), (3, "b")]))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]


def brute_substring(rows, window):
    toks = [tokens(t) for _, t in rows]
    count = {}
    for w in toks:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for (doc, _), w in zip(rows, toks, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [14, 35])
def test_substring_dedup_against_brute_force(docs, window):
    rng = random.Random(window)
    shared = [text_of(rng, n) for n in (window - 1, window, window + 1, 90)]
    rows = [(i, f"{text_of(rng, rng.randrange(60))} {rng.choice(shared)}\n{text_of(rng, rng.randrange(60))} {rng.choice(shared)}") for i in range(60)]
    rows += [(100, "the " * 100), (101, "a b " * 60), (102, shared[3]), (103, shared[3] + " tail"), *EDGE]
    got = substring_dedup.substring_dedup(docs(rows), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_substring(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def thue_morse(first, second, n):
    return [(first, second)[bin(i).count("1") % 2] for i in range(n)]


def test_substring_dedup_tells_words_apart_that_polynomials_do_not(docs):
    rng = random.Random(2)
    context = [f"w{rng.randrange(10**6)}" for _ in range(34)]
    rows = [(i, " ".join([*context[:17], "".join(thue_morse(a, b, 1024)), *context[17:]])) for i, (a, b) in enumerate([("a", "b"), ("b", "a")])]
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs(rows)).collect()] == [0, 0]


def test_substring_dedup_of_many_rows_without_ids(docs):
    rng = random.Random(3)
    clean = [(None, text_of(rng, 50, 10**6)) for _ in range(3000)]
    got = substring_dedup.substring_dedup(docs([*clean, (None, clean[0][1]), (None, None)]).repartition(6)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == sorted([(0, 0), *[(50, 0)] * 2999, *[(50, 50)] * 2])


def test_substring_dedup_with_clashing_hashes(docs, monkeypatch, spark):
    """Digests of the words decide where hashes clash."""
    rng = random.Random(4)
    shared = text_of(rng, 40)
    rows = [(i, text_of(rng, 50, 10**6) + " " + rng.choice([shared, text_of(rng, 40, 10**6)])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")

    def clash(batches):
        for b in substring_dedup_spans(batches):
            yield pa.RecordBatch.from_arrays([b["path"], b["n"], pa.array(range(b.num_rows), pa.int64()), b["b"]], b.schema.names)

    substring_dedup_spans = substring_dedup._spans(35)
    monkeypatch.setattr(substring_dedup, "_spans", lambda window: clash)
    got = substring_dedup.substring_dedup(frame).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_substring(rows, 35)


def test_paths_are_compacted_to_the_ends_of_the_repeat(docs, monkeypatch):
    rng, seen = random.Random(5), []
    shared = text_of(rng, 300, 10**6)
    rows = [(i, f"{text_of(rng, 20, 10**6)} {shared} {text_of(rng, 20, 10**6)}") for i in range(3)]
    made = substring_dedup.materialize

    def keep(df, label, *a):
        seen.append((label, made(df, label, *a)))
        return seen[-1][1]

    monkeypatch.setattr(substring_dedup, "materialize", keep)
    substring_dedup.substring_dedup(docs(rows)).collect()
    spans = dict(seen)["texts-with-paths"].select("text", "ats", "edges").mapInArrow(substring_dedup._spans(35), substring_dedup._SPAN).collect()
    assert sum(r.n for r in spans) == 3 * (300 - 34)
    assert len({r.path for r in spans}) <= 3 and max(r.n for r in spans) > 200  # the ends, told as single windows, and one long span


def test_substring_dedup_empty(docs):
    assert substring_dedup.substring_dedup(docs([])).count() == 0


def brute_fingerprint(text, shingle=3):
    w = tokens((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_against_brute_force(docs):
    rng = random.Random(5)
    base = [text_of(rng, 60) for _ in range(6)]
    rows = [(i, " ".join(x if rng.random() > 0.01 else "edit" for x in rng.choice(base).split())) for i in range(60)] + [(100 + i, t) for i, (_, t) in enumerate(EDGE)]
    got = {r.doc_id: r for r in simhash.simhash_dedup(docs(rows)).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    for (doc, _), value, root in zip(rows, prints, label, strict=True):
        assert got[doc].fingerprint == f"{value:016x}"
        assert got[doc].component_id == min(d for (d, _), r in zip(rows, label, strict=True) if r == root)
    assert simhash.simhash_dedup(docs([])).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_pigeonring_keys_lose_no_pair(distance):
    rng = random.Random(distance)
    masks = simhash.chain_masks(distance)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance)))
        assert any(not flips & mask and all((flips & m).bit_count() <= b for m, b in chain) for _, mask, chain in masks)


def test_dense_buckets_are_exact(spark, monkeypatch):
    rng = random.Random(3)
    values = sorted({rng.getrandbits(64) for _ in range(3)} | {0xABCDEF << 30 | sum(1 << b for b in rng.sample(range(14), 4)) for _ in range(120)})
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    monkeypatch.setattr(simhash, "BUCKET", 4)
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(frame), "fp", "gp").collect()}
    label = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for i in range(len(values)):
        for j in range(i):
            assert (label[i] == label[j]) == (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j]))


@pytest.mark.parametrize("bucket", [1, 32])
def test_similar_groups_against_brute_force(docs, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BAND_BUCKET", bucket)
    rng = random.Random(9)
    base = [text_of(rng, n, 5000) for n in (40, 80, 200)]
    rows = [(i, " ".join(x if rng.random() > rng.choice([0.002, 0.01, 0.03]) else f"e{rng.random()}" for x in rng.choice(base).split())) for i in range(50)]
    rows += [(200, None), (201, ""), (202, "two words"), (203, "two words."), (204, "Two Words")]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := tokens((t or "").translate(LOWER))) else None for _, t in rows]
    label = brute_components(sets, lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b) or (a is None and b is None))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(rows)).collect()}
    assert got == {d: min(x for (x, _), r in zip(rows, label, strict=True) if r == root) for (d, _), root in zip(rows, label, strict=True)}
    assert simhash.drop_near_duplicates(docs(rows)).count() == len(set(label))
    assert simhash.similar_groups(docs([])).count() == 0


def test_sketches_never_pass_over_a_similar_pair():
    rng = np.random.default_rng(5)
    for size in (0, 1, 4, 9, 100, 1500, 20_000):
        for share in (1.0, 0.9, 0.8, 0.6):
            common = rng.integers(0, 1 << 63, int(size * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n, dtype=np.uint64)])) for n in (size - len(common), 0))
            x, y = simhash.sketches([a, b]).view(np.uint64)
            differ, apart = int(np.bitwise_count(x ^ y).sum()), len(np.setxor1d(a, b))
            assert differ <= apart and differ % 2 == apart % 2
    assert simhash.sketches([]).shape == (0, simhash.SKETCH // 64)


def test_families_of_changed_copies_group_as_brute_force_does(spark):
    """More texts than a bucket holds, all changed copies of one, at similarities on both sides of the bound."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base)), (1, None), (2, ""), (3, "a b c d e")]
    for i in range(4, 160):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in rows for w in [(t or "").split()]}
    group = {d: d for d, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert got == group
