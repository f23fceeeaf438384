import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import packing, queries, tokens, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, length int"
WORDS = ["the", "of", "été", "naïve.", "x\ny", "It's", "1234", "a  b", "\t", "", " ", "Zürich,", " ", "日本語", "<|endoftext|>", "!!", "\r\n", "we'll", "é"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path())


def documents(n=40):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(60))) for _ in range(n)]
    texts += [None, "", "same text here", "same text here", "word " * 3000, "z" * 4000]
    return [(i * 3, t, None, "s", 0, 7, 8) for i, t in enumerate(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS) | st.text(max_size=6), max_size=12), st.sampled_from([" ", "", "\n", "  "]))
def test_ids_equal_those_of_the_whole_text(encoder, plain, parts, joint):
    text = joint.join(parts).encode("utf-8", "ignore").decode()
    assert encoder.ids(text).tolist() == plain(text)


def test_full_cache_is_emptied(plain):
    encoder = tokens.Encoder(tokens.default_path())
    encoder.spaced.limit = encoder.plain.limit = 3
    for text in ("one two three four five", "six seven eight", "one two nine"):
        assert encoder.ids(text).tolist() == plain(text)
    assert len(encoder.spaced) <= 8


@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype("<u4")
    doc_ids, lengths, m = wavelet.from_file(wavelet.to_file([5, None], [n, 0], ids))
    assert doc_ids == [5, None] and lengths.tolist() == [n, 0]
    assert m.ids().tolist() == ids.tolist()
    for i in range(0, n, max(1, n // 40)):
        assert m.access(i) == ids[i]
        assert m.count(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
        assert m.find(int(ids[i]), m.count(int(ids[i]), i)) == i
    assert m.count(299) == int((ids == 299).sum()) and m.count(1 << 20) == 0


def test_wavelet_matrix_of_large_ids():
    ids = np.array([70_000, 3, 1 << 31, 70_000, 0], "<u4")
    m = wavelet.from_file(wavelet.to_file([1], [5], ids))[2]
    assert m.ids().tolist() == ids.tolist() and [m.access(i) for i in range(5)] == ids.tolist()
    assert m.count(70_000) == 2 and m.find(70_000, 1) == 3


def expected_tokens(rows, plain):
    found, start = {}, 0
    for row in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*plain(row[1]), 0], "<u4")
        found[row[0]] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return found


def test_op2_reads_back_what_the_library_encodes(spark, tables, plain):
    rows = documents()
    got = queries.op2_wavelet_tokens(spark, tables(documents=(rows, DOCS))).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected_tokens(rows, plain)
    assert len(got) == len(rows)


def test_op2_several_files_a_shard_and_repeated_rows(spark, tables, plain):
    rows = documents(10) + documents(10)
    docs = spark.createDataFrame(rows, DOCS)
    got = wavelet.digests(wavelet.write(docs, tokens.default_path(), block_ids=50)).collect()
    assert len(got) == len(rows)
    spans = sorted((r.start, r.start + r.n_tokens, r.doc_id) for r in got)
    assert all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0


def check_pieces(got, rows, plain):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for row in rows:
        ids, at = np.array([*plain(row[1]), 0], "<u4"), 0
        for p in sorted(by_doc[row[0]], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return sequences


def test_op6_pieces_cover_every_document_once(spark, tables, plain):
    rows = documents(120)
    got = queries.op6_packing(spark, tables(documents=(rows, DOCS))).collect()
    sequences = check_pieces(got, rows, plain)
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 2


@pytest.mark.parametrize("op", ["op2_wavelet_tokens", "op6_packing"])
def test_empty_table(spark, tables, op):
    assert getattr(queries, op)(spark, tables(documents=([], DOCS))).collect() == []


def test_plan_meets_demand_with_little_waste():
    rng = np.random.default_rng(0)
    for hot in (0, 20_000):
        lengths, demand = np.arange(1, 257), rng.integers(0, 240, 256)
        demand[175] += hot
        lengths, demand = lengths[demand > 0], demand[demand > 0]
        patterns = packing.plan(lengths, demand, 256)
        assert (sum(p * t for p, t in patterns) == demand).all()
        assert all((p @ lengths) <= 256 for p, _ in patterns)
        least = max(demand[lengths > 128].sum(), (demand @ lengths) / 256)
        assert least <= sum(t for _, t in patterns) <= least * 1.05


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))
        worth = rng.random(4)
        value, copies = packing.knapsack(worth, lengths, 20)
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - n] + w for n, w in zip(lengths, worth) if n <= c)])
        assert abs(value - best[20]) < 1e-12 and copies @ lengths <= 20 and abs(copies @ worth - value) < 1e-12


def test_same_input_same_pieces(spark, tables):
    path = tables(documents=(documents(30), DOCS))
    a, b = (sorted(map(tuple, queries.op6_packing(spark, path).collect()), key=str) for _ in range(2))
    assert hashlib.sha256(str(a).encode()).digest() == hashlib.sha256(str(b).encode()).digest()
