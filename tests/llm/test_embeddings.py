import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import embedding_dedup as ed

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "key", "mult", "code", "root"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def brute(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of rows with unique ids."""
    vec = {}
    for i, v, label in rows:
        fits = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vec[i] = np.array(v, np.float32).astype(float) if fits else None
    label = {i: x for i, _, x in rows}
    near = {i: set() for i in vec}
    for a in vec:
        for b in vec:
            if a < b and vec[a] is not None and vec[b] is not None and label[a] == label[b] and len(vec[a]) == len(vec[b]):
                if vec[a] @ vec[b] / (np.linalg.norm(vec[a]) * np.linalg.norm(vec[b])) >= threshold:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for i in vec:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(near[i]), min(seen), i == min(seen)))
    return sorted(out)


def clustered(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.standard_normal((6, dim))
    for i in range(420):
        c = i % 12
        v = rng.standard_normal(dim) if c > 5 else centre[c] + rng.standard_normal(dim) * (0.1 + 0.02 * c)
        rows.append((i * 3, v.tolist(), [0, 0, 0, 1, 1, 2][c % 6]))  # a third of the rows and more in one label
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)]  # copies
    rows += [(3000 + i, [2 * x for x in rows[17][1]], rows[17][2]) for i in range(3)]  # same direction
    return rows


@pytest.mark.parametrize(("window", "tile"), [(4, 8), (16, 50), (64, 1024)])
def test_links_and_components_against_brute_force(spark, window, tile):
    rows = clustered(window)
    got = ed.embedding_dedup(table_of(spark, rows), window=window, tile=tile, recall=1 - 1e-5)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_link_is_made_up_and_few_are_lost(spark):
    rows = clustered(5, dim=24)
    got = {r.vec_id: r for r in ed.embedding_dedup(table_of(spark, rows), window=8, tile=16).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert all(got[i].n_links <= want[i][1] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(w[1] for w in want.values())


def test_odd_vectors_and_labels(spark):
    one, nan, inf = [1.0, 2.0, 0.0], float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 0.0], 1), (5, [nan, 1.0, 0.0], 1), (6, [inf, 1.0, 0.0], 1), (7, one, None), (8, one, None), (9, one, 1), (10, [2.0, 4.0, 0.0], 1)]
    rows += [(11, one, 2), (12, [1.0, 2.0], 1), (13, [1.0, 2.0, 0.0, 0.0], 1), (14, [1.0, 2.0, -0.0], 1), (15, [-1.0, -2.0, 0.0], 1)]
    got = ed.embedding_dedup(table_of(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert {r.vec_id for r in got.where("n_links = 2").collect()} == {9, 10, 14}
    assert ed.embedding_dedup(table_of(spark, [])).collect() == []


def test_null_and_repeated_ids(spark):
    one, other = [1.0, 2.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, one, 1), (None, one, 1), (5, one, 1), (5, [1.0, 2.0, 0.01], 1), (None, other, 1), (7, other, None), (7, other, 2)]
    got = ed.embedding_dedup(table_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 3, 5, False), (None, 3, 5, False), (5, 3, 5, True), (5, 3, 5, True), (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True)], key=str)


def test_plan_grows_with_the_data():
    assert ed.plan(0, 0.98, 64, 0.995) == (0, 1) and ed.plan(32, 0.98, 64, 0.995) == (0, 1)
    for n in (10**3, 10**6, 10**9):
        bits, passes = ed.plan(n, 0.98, 64, 0.995)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert n / 2**bits <= 32 and 1 - (1 - agree) ** passes >= 0.995


def test_bad_threshold(spark):
    with pytest.raises(ValueError):
        ed.embedding_dedup(table_of(spark, []), threshold=0)
