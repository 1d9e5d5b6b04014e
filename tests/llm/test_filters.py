import hashlib
import re
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import fill_in_middle as fim
from postmill.llm import filter_audit as fa
from postmill.llm import registry

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_fill_in_middle"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.SQL[name])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def brute_audit(docs, labels):
    told = {}
    for i, q, t in labels:
        g, x = told.get(i, (False, False))
        told[i] = (g or q == 1, x or t == 1)
    least, rows = {}, []
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _, part in docs:
        t = t or ""
        w = re.findall("[^ \t-\r]+", t)
        fails = {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and least[t] < i else set()
        rows.append((part or "", fails, *(told.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                gone = [r for r in here if c in r[1] and not r[1] & set(order[:k])]
                share[c] += len(gone)
                out[part, order, k + 1] = [sum(not r[1] & set(order[: k + 1]) for r in here), len(gone), sum(c in r[1] and bool(r[1] & set(order[:k])) for r in here), sum(r[1] == {c} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(share[order[k - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_against_brute_force(spark, docs):
    long = " ".join(f"w{i}" for i in range(60))
    given = [(1, None, "en", None), (2, "", "en", "a"), (3, long, "en", "a"), (4, long, "en", "b"), (4, long, "en", "b"), (None, long, "en", "a"), (None, "", "en", ""), (5, "X " * 70, "en", "a"), (6, long + " #", "en", "a")]
    given += [(7, long + " #", "en", "a"), (8, "word " * 40_000, "en", "c"), (9, "ÄÖ" * 30, "en", "a"), (10, "ABC D $ &", "en", "a")]
    told = [(1, 1, 0), (1, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (6, 1, 1), (7, 0, 1), (99, 1, 1)]
    got = fa.filter_audit(docs(given).withColumn("part", F.lit("clash")).withColumn("mask", F.lit(1)), spark.createDataFrame(told, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(0)))
    rows = got.collect()
    assert len(rows) == 4 * 600 and {tuple(r) for r in rows} == brute_audit(given, told)


def test_audit_of_no_documents(spark, docs):
    assert fa.filter_audit(docs([]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []


def test_transform_of_other_numbers_of_filters(spark):
    masks = [(p, m, m % 3 == 0) for p in ("x", None) for m in [0, 1, 1, 2, 3, 3, 3]]
    got = {tuple(r) for r in fa.audit(spark.createDataFrame(masks, "part string, mask int, good boolean"), "part", ["A", "B"], ["good"]).collect()}
    want = {(p, o, s, *v) for p in ("x", None) for (o, s), v in {("AB", 1): (2, 5, 0, 2, 3, 7), ("AB", 2): (1, 1, 3, 1, 0, 5), ("BA", 1): (3, 4, 0, 1, 3, 5), ("BA", 2): (1, 2, 3, 2, 0, 7)}.items()}
    assert got == want
    with pytest.raises(ValueError):
        fa.audit(spark.createDataFrame(masks, "part string, mask int, good boolean"), "part", list("ABCDEFG"), [])


def brute_fim(doc_id, text, rate=50, spm=80):
    text = text or ""
    u = [m[0] for m in UNIT.finditer(text)]
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


ODD = ["", " ", "a", " a ", "\n\n", "a b c", "😀 😀😀\t x", "tail \x0b\x0c", "x <P> y", "<S", "a <M>", "é é z", "\x1f \x1c a", "word " * 30_000, "x" * 200_000, "\x85 a b c", "a\x00b c"]


def test_fill_in_middle_against_brute_force_and_round_trip(spark, docs):
    rows = [(i * 100 + k, t) for i, t in enumerate(ODD) for k in range(12)] + [(None, "no id here"), (None, None), (7, "same row twice"), (7, "same row twice")]
    df = docs(rows).withColumn("fim_form", F.lit("clash")).withColumn("fim_pieces", F.lit("clash"))
    got = fim.fill_in_middle(df, rate=90, spm_rate=50).withColumn("back", fim.restored(F.col("fim_output"), F.col("fim_form"), fim.Sentinels())).collect()
    assert len(got) == len(rows) and {r.fim_form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.fim_units, r.fim_form, r.fim_prefix, r.fim_middle, r.fim_suffix, r.fim_output) == brute_fim(r.doc_id, r.text, 90, 50)
        assert r.back == (r.text or "") and r.fim_pieces == "clash"
    assert fim.fill_in_middle(docs([])).count() == 0


def test_units_of_the_other_grammars(spark):
    cut = lambda text, unit: spark.createDataFrame([(text,)], "t string").select(fim.units(F.col("t"), fim.GRAMMARS[unit])).first()[0]
    assert cut("a\nb\n\nc", "line") == ["a\n", "b\n", "\n", "c"] and cut("x\n", "line") == ["x\n"]
    assert cut("One. Two! Three", "sentence") == ["One.", " Two!", " Three"] and cut("好。坏", "sentence") == ["好。", "坏"]
    assert cut("a😀é", "character") == ["a", "😀", "é"] and cut("", "character") == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab <>PSM\n\t é😀", max_size=30), min_size=1, max_size=30))
def test_any_text_comes_back(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = fim.fill_in_middle(df, rate=100).withColumn("back", fim.restored(F.col("fim_output"), F.col("fim_form"), fim.Sentinels()))
    assert all(r.back == r.text and (r.fim_units, r.fim_form) == brute_fim(r.doc_id, r.text, 100)[:2] for r in got.collect())
