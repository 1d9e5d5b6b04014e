import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import packing, token_files, tokens
from postmill.llm.tokens import Encoder, tokenizer_path

ROWS = [(3, "Hello world, it's 12 o'clock"), (1, None), (2, ""), (5, "word " * 3000), (4, "two\n\n lines\t x  y \r\n"), (None, "no id"), (9, "a　b<|endoftext|> c"), (9, "again"), (7, "tail \n")]


def expected(text):
    ids = Encoder.at(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 0], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé.'\n\t\r\x0b\x1c\x85 　ß1²٣<|_-"), max_size=40))
def test_encoder_is_exact(text):
    e = Encoder.at(tokenizer_path())
    assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZé×ſ.'\n\t 　…1²٣<|_s"), max_size=30) | st.none(), max_size=12))
def test_encoder_is_exact_for_many_texts(texts):
    e = Encoder.at(tokenizer_path())
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_is_exact_when_its_table_is_thinned(monkeypatch):
    monkeypatch.setattr(tokens, "SLOT_BITS", 9)
    monkeypatch.setattr(tokens, "AT_ONCE", 128)
    e, rng = Encoder(tokenizer_path()), random.Random(4)
    for _ in range(20):
        texts = [" ".join(rng.choice(("the", "of", f"w{rng.randrange(10**6)}", f"averyveryverylongword{rng.randrange(99)}")) for _ in range(60)) for _ in range(20)]
        assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.held <= tokens.FULL * (1 << 9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=800), st.integers(9, 18))
def test_huffman_round_trip(ids, longest):
    counts = np.bincount(ids, minlength=400)
    lengths = token_files.code_lengths(counts, longest)
    assert lengths.max() <= longest and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    bits, marks = token_files.pack(np.array(ids), lengths, token_files.canonical_codes(lengths))
    assert token_files.unpack(bits, marks, len(ids), token_files.decode_table(lengths)).tolist() == ids


def test_code_lengths_are_optimal_where_the_limit_is_loose():
    import heapq

    counts = np.array([random.Random(1).randrange(1, 1000) for _ in range(50)])
    heap = list(map(int, counts))
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert int((token_files.code_lengths(counts) * counts).sum()) == total


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_token_files_round_trip(spark, docs, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    token_files.write_token_files(docs(ROWS), f"file://{tmp_path}/t")
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").collect()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in ROWS), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and r.n_tokens == len(ids)
        assert any(ids.tolist() == expected(t).tolist() for d, t in ROWS if d == r.doc_id)
        at += len(ids)


def test_token_files_empty(spark, docs, tmp_path):
    token_files.write_token_files(docs([]), f"file://{tmp_path}/e")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=30))
def test_shortest_pack_first_places_all(histogram):
    runs, n = packing.shortest_pack_first(histogram, 64)
    used = {}
    for length, low, high, first, at in runs:
        for i in range(high - low):
            used.setdefault(first + i, []).append((at, length))
    assert sum(h - low for _, low, h, _, _ in runs) == sum(histogram.values()) and len(used) == n
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_covers_each_id_once(docs):
    got = packing.pack_documents(docs(ROWS), capacity=128).collect()
    ids = {d: [expected(t) for x, t in ROWS if x == d] for d, _ in ROWS}
    total = 0
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id])
        total += r.length
    assert total == sum(len(x) for v in ids.values() for x in v)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack_documents(docs([])).count() == 0


def test_blocks_beyond_a_batch_are_read_in_parts_or_raise(monkeypatch):
    lengths = np.full(256, 8, np.uint8)
    texts = [np.arange(n, dtype=np.uint16) % 256 for n in (30, 1, 50, 200, 7)]
    ends = np.cumsum([len(x) for x in texts]).tolist()
    columns = [[0] * 5, list(range(5)), [e - len(x) for e, x in zip(ends, texts, strict=True)], [len(x) for x in texts], [x.tobytes() for x in texts]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "id", "start", "n", "ids"])
    blocks = list(token_files._blocks("uint16", lengths.tobytes())([batch]))
    for limit in (800, 1000, 1 << 20):
        monkeypatch.setattr(token_files, "BATCH_BYTES", limit)
        got = [r for b in token_files._unblock(lengths.tobytes(), {0: 5})(blocks) for r in b.to_pylist()]
        assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(i, columns[2][i] + 5, len(x)) for i, x in enumerate(texts)]
        assert all(np.frombuffer(r["ids"], "<u4").tolist() == x.tolist() for r, x in zip(got, texts, strict=True))
    monkeypatch.setattr(token_files, "BATCH_BYTES", 799)
    with pytest.raises(ValueError, match="document 3"):
        list(token_files._unblock(lengths.tobytes(), {0: 5})(blocks))
    bits, marks = token_files.pack(texts[3], lengths, token_files.canonical_codes(lengths))
    assert marks.dtype.itemsize == 8
