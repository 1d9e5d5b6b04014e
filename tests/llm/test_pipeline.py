import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from postmill.llm import toxicity
from postmill.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_in_order_against_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], SF).collect() or [], stage(spark, kept[-1], SF).schema))
    for df in kept[:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.collect()} for df in kept]
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids[1] == {r.doc_id for r in scored if not r.predicted}
    rows = {r.doc_id: r.text for r in kept[1].collect()}
    last = {}
    for doc, text in sorted(rows.items()):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")] = doc
    assert ids[2] == set(last.values())
    words = {d: (rows[d] or "").lower().split() for d in ids[2]}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert ids[3] <= ids[2] and not any(a in ids[3] and b in ids[3] for a, b in near)
    assert ids[2] - ids[3] == {b for _, b in near}
    grams = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [r.text.lower().split()] for i in range(max(1, len(w) - 12))}
    assert ids[3] - ids[4] >= {d for d in ids[3] if any(tuple(words[d][i : i + 13]) in grams for i in range(len(words[d])))}
    encoder = Encoder.at(tokenizer_path()).tokenizer
    total = {}
    for r in kept[5].collect():
        x = np.array([*encoder.encode(rows[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert set(total) == ids[4]


def odd_docs(spark, rows):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("drop_id", "drop_other", "drop_hash", "same_id", "same_sha", "th", "id", "toxic", "x"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_stages_on_empty_tables_null_ids_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (2, ""), (None, "no id here"), (None, "no id here"), (3, long), (3, long), (4, long + " end"), (5, "One"), (6, "one"), (None, long + " tail"), (7, "x" * 50_000)]
    for given in ([], rows):
        docs = odd_docs(spark, given)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            if given and name == "exact dedup":
                assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted({(2, ""), (None, "no id here"), (3, long), (4, long + " end"), (6, "one"), (None, long + " tail"), (7, "x" * 50_000)}, key=str)
        if given:  # the group's smallest id stays; rows without an id go with a group that has one
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 2, 3, 6, 7]
        else:
            assert docs.isEmpty()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.count() >= docs.count()


def test_mined_words_do_not_depend_on_partitions(spark):
    rows = [(f"same words here number{i % 7}", int(i % 2)) for i in range(600)]
    found = []
    for n in (1, 4, 8):
        df = spark.createDataFrame(rows, "text string, toxic int").repartition(n)
        got = df.mapInArrow(toxicity._mine, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] == found[2] and ("same", 300, 300) in found[0]
