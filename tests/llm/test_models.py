import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.llm import decontaminate, language, language_model, toxicity, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1001, None), (1002, ""), (1003, "123 ... !"), (1004, "x" * 200_000), (None, "no id"), (1005, "same"), (1005, "same")]


def crc(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode())


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def words_of(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# decontamination


def test_decontamination_finds_substitutions_and_leaves_clean_texts(spark, docs):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [words_of(rng, vocabulary, 40) for _ in range(12)] + ["three words only", "", None]
    rows = []
    for i in range(60):
        item = items[i % 12].split()
        if i < 36:  # every ninth word differs in some, part of the item in others
            part = [f"s{i}" if i % 3 == 1 and j % 9 == 4 else w.upper() if i % 3 == 2 else w for j, w in enumerate(item)][: 20 if i % 4 == 3 else 40]
            rows.append((i, f"{words_of(rng, vocabulary, 50)} {' '.join(part)}\n{words_of(rng, vocabulary, 50)}"))
        else:
            rows.append((i, f"{words_of(rng, vocabulary, 50)} {' '.join(item[:8])} {words_of(rng, vocabulary, 50)}"))
    rows += [(900, "has three words only here"), *EDGE]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontaminate.contaminated(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 12) for i in range(36)} | {(900, 12)}
    assert all(r.n_same >= 0.8 * r.n_words for r in got)
    assert decontaminate.drop_contaminated(docs(rows), bench).count() == len(rows) - 37
    assert decontaminate.contaminated(docs([]), bench).count() == 0
    assert decontaminate.contaminated(docs(rows), bench.where("false")).count() == 0


def test_decontamination_in_slices_is_the_same(spark, docs, monkeypatch):
    rng = random.Random(4)
    items = [words_of(rng, [f"v{i}" for i in range(500)], 30) for _ in range(9)]
    rows = [(i, f"a b c {items[i % 9]} d e") for i in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    whole = {tuple(r) for r in decontaminate.contaminated(docs(rows), bench).collect()}
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 60)
    assert {tuple(r) for r in decontaminate.contaminated(docs(rows), bench).collect()} == whole


def test_best_overlap_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, doc = rng.integers(0, 3, 12).astype(np.uint64), rng.integers(0, 3, 20).astype(np.uint64)
        shift = int(rng.integers(-8, 16))
        start, n, same = decontaminate.best_overlap(item, doc, shift, 0.8)
        pairs = [(i, i + shift) for i in range(12) if 0 <= i + shift < 20]
        best = max((sum(0.2 if item[i] == doc[j] else -0.8 for i, j in pairs[a:b]) for a in range(len(pairs)) for b in range(a, len(pairs) + 1)), default=0)
        assert abs(best - (0.2 * same - 0.8 * (n - same))) < 1e-9


def test_best_overlap_of_enough_words_against_brute_force():
    item = np.arange(13).astype(np.uint64)
    doc = np.where(np.arange(13) == 2, 99, np.arange(13)).astype(np.uint64)
    assert decontaminate.best_overlap(item, doc, 0, 0.8, 13) == (0, 13, 12)  # a change near the border isn't trimmed off
    rng = np.random.default_rng(5)
    reached = 0
    for n in [n for n in range(5, 21) for _ in range(60)]:
        item = rng.integers(0, 1 << 60, n).astype(np.uint64)
        front, cut = int(rng.integers(0, 4)), int(rng.integers(0, 3))
        changed = np.where(rng.random(n) < rng.choice([0.1, 0.2, 0.3]), np.uint64(1), item)
        doc = np.concatenate([np.zeros(front, np.uint64), changed, np.zeros(3, np.uint64)])[: front + n + 3 - 2 * cut]
        need, m = min(13, n), min(n, len(doc) - front)
        same = [bool(item[j] == doc[j + front]) for j in range(m)]
        every = [(sum(same[a:b]), b - a) for a in range(m) for b in range(a + need, m + 1)]
        good = [(s - 4 * (k - s), s, k) for s, k in every if 5 * s >= 4 * k]
        start, words, agree = decontaminate.best_overlap(item, doc, front, 0.8, need)
        assert (words > 0) == bool(good)
        if good:
            reached += 1
            assert words >= need and agree == sum(same[start - front : start - front + words]) and agree - 4 * (words - agree) == max(good)[0]
    assert 200 < reached < 900


def test_decontamination_finds_a_change_near_the_border(spark, docs):
    item = [f"w{i}" for i in range(13)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = decontaminate.contaminated(docs([(1, "a b " + " ".join([*item[:2], "x", *item[3:]]) + " c")]), bench).collect()
    assert [(r.doc_id, r.item_id, r.start, r.n_words, r.n_same) for r in got] == [(1, 7, 2, 13, 12)]


@pytest.mark.parametrize("n", range(1, 26))
def test_every_overlap_has_a_seed_hit(n):
    # every way to change a fifth of n words; what is longer than 25 words holds 13 words or more that agree as well
    item = np.random.default_rng(n).integers(1, 1 << 60, n).astype(np.uint64)
    ways = np.array(list(itertools.combinations(range(n), n // 5)), int)
    texts = np.zeros((len(ways), n + 1), np.uint64)
    texts[:, :n] = item
    np.put_along_axis(texts, ways, np.uint64(0), axis=1)
    place, number, inside = decontaminate.Index([item, item[:0]]).hits(texts.ravel())
    starts = place - inside
    assert set((starts[starts % (n + 1) == 0] // (n + 1)).tolist()) == set(range(len(ways))) and not number.any()


def test_decontamination_finds_short_items_with_a_change(spark, docs):
    bench = spark.createDataFrame([(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in range(3, 13)], "item_id bigint, text string")
    rows = [(100 * n + j, " ".join(["a", *("x" if k == j else f"i{n}w{k}" for k in range(n)), "b"])) for n in range(3, 13) for j in range(n + 1)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), bench).collect()}
    assert got == {(i, i // 100) for i, _ in rows if i // 100 > 4 or i % 100 == i // 100}


# language model


def test_language_model_counts_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_WORDS", 40)
    monkeypatch.setattr(language_model, "OWN_WORDS", 20)
    rng = random.Random(8)
    vocabulary = [f"w{int(i)}" for i in np.random.default_rng(1).zipf(1.4, 400) % 150]
    rows = [(i, words_of(rng, vocabulary, rng.randrange(60))) for i in range(120)] + EDGE
    got = language_model.lm_scores(docs(rows)).collect()
    assert len(got) == len(rows)
    count = Counter(t for d, x in rows if crc(d) % 7 != 2 for t in [*tokens(x), None])
    total, distinct = sum(count.values()), len(count)
    want = sorted(((d, crc(d) % 7 == 2, len(tokens(x)) + 1, sum(count[t] > 0 for t in [*tokens(x), None]), total, round(sum(math.log10((count[t] + 1) / (total + distinct + 1)) for t in [*tokens(x), None]), 6)) for d, x in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)
    assert language_model.lm_scores(docs([])).count() == 0


def test_language_model_is_a_distribution_and_learns(monkeypatch):
    monkeypatch.setattr(language_model, "OWN_WORDS", 30)
    monkeypatch.setattr(language_model, "LANES", 4)
    rng = np.random.default_rng(3)
    keys = (rng.integers(0, 1 << 62, 60).astype(np.uint64) & ~language_model._CLASS) | rng.integers(0, 64, 60).astype(np.uint64)
    keys[0] = language_model.END_KEY
    counts = rng.integers(1, 50, 60)
    tails = {int(k): (int(counts[(keys & language_model._CLASS) == k].sum()), int(((keys & language_model._CLASS) == k).sum())) for k in np.unique(keys & language_model._CLASS)}
    model = language_model.Model(keys, counts, int(counts.sum()), 60, tails)
    n = model.own + language_model.TAIL
    stream = np.tile(np.array([1, 5, 9, 2, 7, 0]), 3000)
    texts = np.arange(0, 601, 6)
    before = model.score(stream[:600], texts).sum()
    model.fit(stream, 0)
    assert model.score(stream[:600], texts).sum() > 0.2 * before  # a fixed cycle is learned
    h = rng.normal(0, 0.5, (1, language_model.HIDDEN)).astype(np.float32)
    p = np.exp(model.outputs(np.repeat(h, n, axis=0), np.arange(n)))
    assert abs(p.sum() - 1) < 1e-4  # own words and tail classes; a class's tail words share its part by counts
    cuts = np.array([0, 7, 7 + 40, 600])  # rows of different lengths get the scores that they get alone
    whole = model.score(stream[:600], cuts)
    alone = [model.score(stream[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert np.allclose(whole, alone, rtol=1e-3)


def test_language_model_is_fitted_on_every_training_text(spark, monkeypatch):
    monkeypatch.setattr(language_model, "TASK_TOKENS", 3000)
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 1000)
    rng = random.Random(9)
    texts = [words_of(rng, ["a", "b", "c"], rng.randrange(80)) for _ in range(200)] + ["", None, "a b " * 2500]  # one text of many blocks
    keys = np.concatenate([language_model.token_keys(pa.array([x], pa.string()))[0] for x in texts])
    own, counts = np.unique(keys, return_counts=True)
    tails = {int(k): (int(counts[(own & language_model._CLASS) == k].sum()), int(((own & language_model._CLASS) == k).sum())) for k in np.unique(own & language_model._CLASS)}
    model = language_model.Model(own, counts, len(keys), len(own), tails)
    last = language_model.token_keys(pa.array(["a b " * 20]))
    before = model.score(model.look_up(last[0])[0], last[1])[0]
    read = language_model.fit_all(spark.createDataFrame([(x,) for x in texts], "text string").repartition(5), model, len(keys))
    assert len(read) == language_model.ROUNDS and sum(read) == len(keys)
    assert model.score(model.look_up(last[0])[0], last[1])[0] > before


def test_language_model_learns_beyond_any_sample_size(docs, monkeypatch):
    monkeypatch.setattr(language_model, "FIT_TOKENS", 100, raising=False)  # the former size of the sample
    rows = [(i, "one two three four five six seven eight " * 12) for i in range(4000)]
    got = language_model.lm_scores(docs(rows)).collect()
    assert all(r.score > -0.45 * r.n_tokens for r in got)  # by counts alone about -0.9 a token


# language identification


def test_language_held_out_accuracy(docs):
    rng = random.Random(6)
    sounds = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ung", "ei", "ch"], "fr": ["eau", "tion", "oi", "é"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30)), lang, "s", 1) for i in range(300) for lang in [rng.choice(list(sounds))]]
    rows += [(d, t, None, None, None) for d, t in EDGE] + [(2000, "Ångström ÆØ", None, None, None), (2001, "²³ ٣", None, None, None)]
    got = language.identify(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [(d, lang) for d, _, lang, *_ in rows[:300] if crc(d) % 3 == 1]
    assert sum(by[d].lang_pred == lang for d, lang in held) >= 0.98 * len(held)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert {by[d].lang_pred for d in (1001, 1002, 1003, 2001)} == {"und"} and by[2000].lang_pred != "und"
    assert {r.lang_pred for r in language.identify(docs([(1, "abc")])).collect()} == {"und"}
    assert language.identify(docs([])).count() == 0


def test_language_filter_has_no_false_negatives():
    rng = np.random.default_rng(2)
    held = [(int(g), int(i)) for g, i in zip(rng.integers(0, 1 << 24, 500), rng.integers(0, 70, 500), strict=True)]
    f = language.Filter([f"l{i}" for i in range(70)], held)  # two slices
    for g, i in held:
        at = language.positions(np.array([g], np.uint64))
        assert all(int(f.slices[i // 64][p[0]]) >> (i % 64) & 1 for p in at)
    assert language.grams(pa.array(["Ab"], pa.string()))[0].tolist() == [0x206162, 0x616220]


# url filter


def test_url_rules_and_edges(spark):
    rows = [(1, "https://WWW.Example.com/en/7x?q#f"), (2, "http://a.com/en/1"), (3, "http://com/en/"), (4, "http://notcom/en/"), (5, "https://x.net/de/1"), (6, "https://m.example.net/de/8"), (7, "ftp://a.org/es/"), (8, "no scheme"), (9, None), (10, "http://host"), (11, "http://h?x://y/z"), (12, "://"), (12, "://"), (None, "http://a.com/EN/1")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.host, r.path, r.rule) for r in url_filter.filter_urls(pages, url_filter.labelled_urls(spark)).collect()}
    assert got == {
        (1, "www.example.com", "/en/7x", "example.com/en/7"), (2, "a.com", "/en/1", "com/en/"), (3, "com", "/en/", "com/en/"), (4, "notcom", "/en/", None), (5, "x.net", "/de/1", "net/de/"),
        (6, "m.example.net", "/de/8", "example.net/de/8"), (7, "a.org", "/es/", "org/es/"), (8, "", "", None), (9, "", "", None), (10, "host", "", None), (11, "h", "", None), (12, "", "", None), (None, "a.com", "/EN/1", None),
    }
    assert url_filter.filter_urls(pages.where("false"), url_filter.labelled_urls(spark)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.where("page_id = 10"), url_filter.labelled_urls(spark).where("false")).collect()} == {"allow"}


def test_url_trees_are_native_and_learn(spark):
    out = url_filter.filter_urls(spark.createDataFrame([(1, "https://casino-win.example.org/fr/1"), (2, "https://www.thering.example.org/fr/1")], "page_id bigint, url string"), url_filter.labelled_urls(spark))
    assert {r.page_id: r.verdict for r in out.collect()} == {1: "block", 2: "allow"}
    kinds = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in kinds and "MapInArrow" not in kinds and "BatchEvalPython" not in kinds


# toxicity


def toxic_rows(seed, n=500):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = words_of(rng, vocabulary, rng.randrange(5, 60)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot,", "moron", "zorgle!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic) if rng.random() > 0.02 else int(not toxic)))
    return rows, labels


def test_toxicity_held_out(spark, docs):
    rows, labels = toxic_rows(1)
    table = spark.createDataFrame([*labels, (None, None, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs([*rows, *EDGE]), table).collect()}
    held = [i for i in range(500) if crc(i) % 5 == 0]
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[1001].predicted == got[1002].predicted == 0 and got[1001].score == got[1002].score
    left = toxicity.drop_toxic(docs([*rows, *EDGE]), table)
    assert left.columns == docs([]).columns and left.count() == sum(r.predicted == 0 for r in got.values()) + 1  # the row that repeats


@pytest.mark.parametrize("label", [0, 1, None])
def test_toxicity_without_both_classes(spark, docs, label):
    rows, labels = toxic_rows(2, 40)
    table = spark.createDataFrame([(i, 1, label) for i, _, _ in labels], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs([*rows, (99, "you idiot")]), table).collect()}
    assert got[99] == 1 and got[1] == 0
    assert toxicity.toxicity(docs([]), table).count() == 0


def test_label_model_prefers_accurate_voters():
    rng = np.random.default_rng(5)
    truth = rng.random(3000) < 0.2
    votes = np.stack([np.where(rng.random(3000) < a, truth, ~truth) for a in (0.95, 0.9, 0.6)] + [rng.random(3000) < 0.5], axis=1)
    labels = np.where(rng.random(3000) < 0.97, truth, ~truth).astype(int)
    post, rates, _ = toxicity.label_model(votes, labels)
    assert ((post > 0.5) == truth).mean() > 0.97
    gap = rates[:, 1] - rates[:, 0]
    assert gap[0] > gap[2] > gap[3] - 0.1


@pytest.mark.parametrize("fold", range(3))
def test_url_verdicts_of_held_out_hosts(spark, fold):
    word = F.regexp_extract("url", r"([a-z0-9-]+)\.example", 1)
    held = F.crc32(word.cast("binary")) % 3 == fold
    labelled = url_filter.labelled_urls(spark)
    judged = url_filter.filter_urls(labelled.where(held).withColumn("page_id", F.col("label")), labelled.where(~held), rules=[])
    assert {(r.page_id, r.verdict) for r in judged.select("page_id", "verdict").distinct().collect()} == {(0, "allow"), (1, "block")}
