"""The operators against brute force on small fixtures, with nulls, blanks, ties and repeated rows."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from knotwork.llm import chat, jaccard_join, language_id, pq_neardup, quality_classifier, queries, sentencepiece_nbest, suffix_dedup, topk_search
from knotwork.llm import common
from knotwork.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long"
EMPTY_DOCS = ([], DOCS)
LABELS = "doc_id long, quality int, toxic int"


def rows_of(texts, langs=None):
    return [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), 0.5, 9) for i, t in enumerate(texts)]


def smallest(n, links):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 20)  # the later rounds' stars are hubs
    monkeypatch.setattr(common, "HUBS", 64)
    edges = [(5, 3), (3, 9), (9, 1), (20, 21), (21, 22), (30, 30)] + [(100 + i, 101 + i) for i in range(2**12)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [got[i] for i in (3, 5, 9, 21, 22)] == [1, 1, 1, 20, 20]
    assert all(got[100 + i] == 100 for i in range(1, 2**12 + 1)) and not {1, 20, 30, 100} & set(got)


# --- language ID, quality -------------------------------------------------------------------


def test_op1_language(spark, tables):
    rng = random.Random(1)
    vocab = {"en": ["the", "house", "water", "thing"], "fr": ["le", "maison", "château", "eaux"]}
    texts, langs = [], {}
    for i in range(80):
        langs[i] = "en" if i % 2 else "fr"
        texts.append(" ".join(rng.choice(vocab[langs[i]]) for _ in range(20)))
    texts += [None, "", "123 !!", "watery housething", "the " * 60_000]
    langs |= {80: None, 81: "en", 82: "en", 83: None, 84: "en"}
    got = {r.doc_id: r for r in queries.op1_language_id(spark, tables(documents=(rows_of(texts, langs), DOCS))).collect()}
    assert all(got[i].lang_pred == langs[i] and 0 <= got[i].score <= 1 for i in range(80))
    assert [got[i].lang_pred for i in (80, 81, 82)] == ["und"] * 3 and got[80].score == 0
    assert got[83].lang_pred == "en" and got[84].lang_pred == "en"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_op1_backs_off_to_shorter_ngrams():
    import pandas as pd

    counts = pd.DataFrame([("en", 0, "the", 5), ("fr", 0, "le", 5), ("en", 3, "^wa", 4), ("fr", 1, "w", 1)], columns=["lang", "kind", "item", "n"])
    model = language_id.Model(counts, {("en", 0): 5, ("fr", 0): 5, ("en", 3): 4, ("fr", 1): 1})
    assert model.word("THE,") is not None and model.word("42") is None
    assert model.word("wax")[0] > model.word("wax")[1]  # its start is English
    assert model.word("ow")[1] > model.word("ow")[0]  # only its single letter is known


def test_op1_without_training_rows(spark, tables):
    got = queries.op1_language_id(spark, tables(documents=([(1, "a text", None, "s", 6, 0.0, 0)], DOCS))).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_op1_learns_ngrams_from_every_word_whole(spark, monkeypatch):
    """Words seen once, and what follows a word's first 64 characters, teach n-grams too."""
    import pyarrow as pa

    rng = random.Random(5)
    unique = lambda letters, size: "".join(rng.choice(letters) for _ in range(size))
    long = "ab" * 40 + "xyz"
    words = [(unique("aeiou", 12), "en") for _ in range(30)] + [(unique("bcdfg", 12), "fr") for _ in range(30)] + [(long, "de"), (long, "de")]
    monkeypatch.setattr(language_id, "_PIECE", 7)
    monkeypatch.setattr(language_id, "_HELD", 50)
    want = Counter()
    for word, lang in words:
        for n in language_id.ORDERS:
            padded = f"^{word}$" if n > 1 else word
            want.update((lang, n, padded[i : i + n]) for i in range(len(padded) - n + 1))
    counted = Counter()
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "item": word, "n": n} for (word, lang), n in Counter(words).items()])
    for out in language_id._count_grams(iter([batch])):
        for r in out.to_pylist():
            counted[r["lang"], r["kind"], r["item"]] += r["n"]
    assert counted == want
    score = language_id.train(spark.createDataFrame(words, "text string, lang string")).scorer()
    assert [score(unique(letters, 12))[0] for letters in ("aeiou", "bcdfg", "xyz")] == ["en", "fr", "de"]


def test_op1_keeps_counts_of_shared_words_in_every_language(spark, monkeypatch):
    """A word kept for one language counts with its real number in a language where it is below the share."""
    monkeypatch.setattr(language_id, "WORD_SHARE", 0.1)
    texts = [("cat " * 95 + "menu " * 5, "en"), ("chat " * 80 + "menu " * 20, "fr")]
    model = language_id.train(spark.createDataFrame(texts, "text string, lang string"))
    assert set(model.rows[0]) == {"cat", "chat", "menu"}
    assert model.word("menu") == pytest.approx([math.log(5.5 / 1100), math.log(20.5 / 1100)], rel=1e-5)
    assert model.word("cat") == pytest.approx([math.log(95.5 / 1100), math.log(0.5 / 1100)], rel=1e-5)


def graded_fixture(n=240):
    rng = random.Random(2)
    base = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(base) + rng.choice("abcdef") for _ in range(30)]
        kind = i % 3
        if kind == 0:
            words[3] = words[9] = "vileword"
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
        if i < n - 60:
            labels.append((i, int(kind != 1), int(kind == 0)))
    return texts, labels


def test_op7_ordinal_grades_on_held_out_rows(spark, tables):
    texts, labels = graded_fixture()
    n = len(texts)
    path = tables(documents=(rows_of([*texts, None, ""]), DOCS), labels=([*labels, (3, None, None), (None, 1, 0)], LABELS))
    got = {r.doc_id: r for r in queries.op7_quality_classifier(spark, path).collect()}
    assert len(got) == n + 2
    right = [got[i].kept == (i % 3 == 2) for i in range(n - 60, n)]
    assert sum(right) >= 57
    mean = [np.mean([got[i].expected_grade for i in range(n - 60, n) if i % 3 == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_op7_without_labels(spark, tables):
    got = queries.op7_quality_classifier(spark, tables(documents=(rows_of(["a b"]), DOCS), labels=([], LABELS))).collect()
    assert [(r.expected_grade, r.p_tail, r.kept) for r in got] == [(0.0, 1.0, True)]


# --- chat -----------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string, window long"


def test_op3_reads_back_every_turn(spark, tables):
    rng = random.Random(4)
    turns = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 30)):
            role = "system" if turn == 0 and conv % 3 == 0 else ["user", "assistant"][turn % 2]
            text = rng.choice([None, "", "<|im_end|>\n", "<|", "a<\\|im_start|>b", "word " * rng.randrange(400), "é日\n", "<"])
            turns.append((conv, turn, role, text, 1))
    turns += [(50, 0, "assistant", "z " * 5000, 1), (51, 0, "we\\ird\nrole", "x", 1)]
    got = {r.conv_id: r for r in queries.op3_chat_windows(spark, tables(conversations=(turns, CHATS))).collect()}
    control = queries.CONTROL
    everything = {c: [(r, t or "") for x, _, r, t, _ in turns if x == c] for c in {t[0] for t in turns}} | {-1: [("user", control), ("assistant", control)]}
    assert set(got) == set(everything)
    for conv, expected in everything.items():
        loss = "".join(t for r, t in expected if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in expected)
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(expected), hashlib.sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars >= sum(len(chat.formatted(r, t)) for r, t in expected)


def test_chat_windows_keep_system_and_limited_history():
    turns = [("system", "s", 10)] + [(["user", "assistant"][i % 2], str(i), 30) for i in range(9)]
    found = list(chat.windows(iter(turns), budget=100, history=40))
    assert [t for w in found for t in w if t[2]] == [(r, t, True) for r, t, _ in turns]
    for w in found[1:]:
        assert w[0] == ("system", "s", False) and sum(not new for *_, new in w) == 2  # and one turn of history
        assert sum(10 if r == "system" else 30 for r, *_ in w) <= 100


def test_escaping_is_reversible():
    for n in range(1, 7):
        for chars in itertools.product("<\\|n\n", repeat=n):
            text = "".join(chars)
            assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
            assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


# --- vectors --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n_links long"


def vectors(n=130, size=8):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(n, size)).astype(np.float32)
    base[40:60] = base[0] + rng.normal(scale=0.04, size=(20, size))
    base[60:70] = base[1]
    rows = [(i, base[i].tolist(), i % 2 if i < 40 or i >= 70 else 0, 0) for i in range(n)]
    rows += [(200, None, 0, 0), (201, [0.0] * size, 0, 0), (202, [float("nan")] * size, 0, 0), (203, base[0].tolist(), None, 0), (204, [1.0, None], 0, 0), (205, [1.0, 2.0], 0, 0), (206, [], 0, 0), (250, base[2].tolist(), 1, 0)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [2048, 2])
def test_op4_equals_brute_force(spark, tables, monkeypatch, block):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk_search, "WAVE", 2)
    rows = vectors()
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op4_topk_search(spark, tables(embeddings=(rows, VECTORS))).collect()]
    whole = {i: [math.floor(float(np.float32(x)) * 256) for x in v] for i, v, *_ in rows if usable(v)}
    expected = []
    for q in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(got) == sorted(expected)


def test_op4_many_ties_and_few_candidates(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, vector array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in topk_search.search(same, same.where("vec_id in (0, 3)")).collect())
    assert got == [(0, k, k) for k in range(1, 6)] + [(3, 1, 0), (3, 2, 1), (3, 3, 2), (3, 4, 4), (3, 5, 5)]
    two = same.where("vec_id < 2")
    assert [(r.query_id, r.vec_id) for r in topk_search.search(two, two.where("vec_id = 0")).collect()] == [(0, 1)]
    assert topk_search.search(same, same.where("false")).collect() == []


def test_op8_equals_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(pq_neardup, "BLOCK", 16)
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op8_pq_neardup(spark, tables(embeddings=(rows, VECTORS))).collect()}
    live = {i: (np.array(v, np.float32).astype(float), label) for i, v, label, _ in rows if usable(v) and any(v) and label is not None}
    ids = sorted(i for i, *_ in rows)
    links = [(ids.index(a), ids.index(b)) for a in live for b in live if a < b and live[a][1] == live[b][1] and len(live[a][0]) == len(live[b][0]) and live[a][0] @ live[b][0] / (np.linalg.norm(live[a][0]) * np.linalg.norm(live[b][0])) >= 0.98]
    root, n = smallest(len(ids), links), Counter(x for pair in links for x in pair)
    assert len(links) > 100
    assert got == {i: (n[k], ids[root[k]], root[k] == k) for k, i in enumerate(ids)}


# --- documents ------------------------------------------------------------------------------


def near_texts(n=90):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for i in range(n):
        if i % 3:
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))))
    return [*texts, None, "", " \t\n", "one", "ONE", "one two three", "One\x0btwo three", "a b c d", "a b c d a b c d a b c d", "é b c d", "É b c d", texts[0], "long " * 9000]


def shingles(text, n=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("short", [64, 2])
def test_op10_equals_brute_force(spark, tables, monkeypatch, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = smallest(len(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_jaccard_join(spark, tables(documents=(rows_of(texts), DOCS))).collect()}
    assert len(links) > 200 and got == {i: (len(sets[i]), root[i]) for i in range(len(sets))}


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
        same = len(np.intersect1d(x, y))
        percent = 100 * same // len(np.union1d(x, y))
        assert jaccard_join._bound_holds(jaccard_join.bitmap(x), jaccard_join.bitmap(y), len(x), len(y), percent)


def repeated_texts():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    a, b, short = text(450), text(1300), text(260)
    return [
        text(900), text(100) + a + text(60), a, text(300) + a[:420] + text(10), b, b, b[:700], b[500:], short + text(300), text(300) + short, short + text(100) + short,
        "z" * 399, "z" * 400, "z" * 401, "y" * 2000, "ab" * 700, None, "", "short", a[:399], text(50) + b[200:900] + text(9) + a[20:440], text(5000), "\0" * 500 + a,
    ]


def removed_by_brute_force(texts, n=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [(256, 50_000), (3, 50_000), (256, 3)])
def test_op9_equals_brute_force(spark, tables, monkeypatch, limits):
    monkeypatch.setattr(suffix_dedup, "MATRIX", limits[0])
    monkeypatch.setattr(suffix_dedup, "GIANT", limits[1])
    texts = repeated_texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, tables(documents=(rows_of(texts), DOCS))).collect()}
    assert got == dict(enumerate(removed_by_brute_force(texts)))


def test_op9_equals_brute_force_where_every_group_is_large(spark, tables, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GIANT", 1)
    monkeypatch.setattr(suffix_dedup, "HEAVY", 1)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    line, long = noise(330), noise(900)
    texts = repeated_texts() + [noise(90) + line + noise(90) for _ in range(20)] + [noise(30) + long[i * 20 : 520 + i * 17] + noise(30) for i in range(20)]
    texts += [(line[:70] + "\n") * 30 + noise(9) for _ in range(5)] + [long] * 4
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, tables(documents=(rows_of(texts), DOCS))).collect()}
    assert got == dict(enumerate(removed_by_brute_force(texts)))


def test_a_large_bucket_is_answered_as_a_small_one_and_not_by_all_passages(spark, monkeypatch):
    """Contexts of one core that agree to any extent; beyond the production limit no bucket goes to one task."""
    rng, reach = random.Random(10), suffix_dedup.Reach(60, 20)
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    lefts, rights, core = [some(40) for _ in range(6)], [some(40) for _ in range(6)], some(20)
    rows = []
    for at in range(100, 700):
        left, right = rng.choice(lefts)[: rng.choice([rng.randrange(41), 40])], rng.choice(rights)[: rng.choice([rng.randrange(41), 40])]
        i, j = rng.randrange(41), rng.randrange(41)
        rows.append((bytes([at % 7]), at, (left[:i] + some(len(left) - i)), core + right[:j] + some(len(right) - j)))
    expected = {(key, at - l, at + r) for (key, at, *_), (l, r) in zip(rows, suffix_dedup.extents([r[2] for r in rows], [r[3] for r in rows], reach)) if r}
    contexts = spark.createDataFrame(rows, "key binary, at long, left binary, right binary")
    for heavy in (1, 4096):
        monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
        found = [(bytes(r.key), r.start, r.end) for r in suffix_dedup._giants(contexts, reach).collect()]
        assert set(found) == expected and len(found) == len(set(found)) and 100 < len(found) < len(rows)
    assert suffix_dedup.GIANT <= 20_000


def test_shorter_passages_and_clashing_names(spark):
    reach = suffix_dedup.Reach(200, 100)
    texts = repeated_texts()
    rows = [(i, t, "k", 1, "n") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, raw int, rest string")
    got = {r.doc_id: r for r in suffix_dedup.kept_texts(docs, reach).collect()}
    digests = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, reach).collect()}
    expected = removed_by_brute_force(texts, 200)
    assert digests == dict(enumerate(expected))
    for i, (n, removed, _, sha) in enumerate(expected):
        r = got[i]
        assert (r.key, r.raw, r.rest) == ("k", 1, "n") and (r.text is None) == (texts[i] is None)
        assert abs(len((r.text or "").encode()) - (n - removed)) <= 2 * 9  # split characters go


def test_deep_shallow_sort():
    rng = random.Random(8)
    for _ in range(60):
        head = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 30, 90])))
        texts = [head + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(40))]
        order = suffix_dedup.deep_shallow_sort(texts)
        assert sorted(order) == list(range(len(texts))) and [texts[i] for i in order] == sorted(texts)


@pytest.fixture(scope="module")
def segmenter():
    import public_tokenizers

    return sentencepiece_nbest.Segmenter(public_tokenizers.path("piece_bpe_32k.model"))


def all_paths(segmenter, word):
    ends = segmenter.edges(word)
    out, stack = [], [(0, 0.0, ())]
    while stack:
        at, score, ids = stack.pop()
        if at == len(word):
            out.append((score, ids))
        stack.extend((j, score + s, ids + own) for i, j, s, own in ends if i == at)
    return sorted(out, key=lambda p: -p[0])


def test_op5_nbest_equals_all_segmentations(segmenter):
    for text in ("", "hello", "the cat", "a  bc", "tion\nst", "日é x", "ab ab ab", " lead", "trail ", "x▁y", "the, end.\nof it!\n\nx", "a \nb", "\0x \0 y"):
        found = segmenter.encode_nbest(text)
        assert segmenter.decode(found[0][1]) == text
        assert len({f[1].tobytes() for f in found}) == len(found)
        if text and "▁" not in text and len(text) < 16:
            best = all_paths(segmenter, "▁" + text.replace(" ", "▁"))[:4]
            assert [round(f[0], 3) for f in found] == [round(b[0], 3) for b in best]


def test_op5_round_trip(spark, tables):
    texts = ["", None, "▁▁ a▁b ▁", "tab\tand\r\nline", "  two  spaces ", "word " * 5000, "x" * 3000, "dup", "dup"]
    got = queries.op5_sentencepiece_nbest(spark, tables(documents=(rows_of(texts), DOCS))).collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)


# --- all of them ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op1_language_id", "op5_sentencepiece_nbest", "op7_quality_classifier", "op9_suffix_dedup", "op10_jaccard_join"])
def test_empty_documents(spark, tables, name):
    assert getattr(queries, name)(spark, tables(documents=EMPTY_DOCS, labels=([], LABELS))).collect() == []


def test_empty_vectors(spark, tables):
    path = tables(embeddings=([], VECTORS))
    assert queries.op4_topk_search(spark, path).collect() == [] and queries.op8_pq_neardup(spark, path).collect() == []


def test_empty_conversations(spark, tables):
    assert [r.conv_id for r in queries.op3_chat_windows(spark, tables(conversations=([], CHATS))).collect()] == [-1]


def test_pipeline_stage_by_stage(spark, tables):
    import corpus_pipeline

    texts, labels = graded_fixture(120)
    rng = random.Random(9)
    passage = " ".join(f"same{i}" for i in range(90))
    texts = [t + " " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(60)) for t in texts]
    texts += [texts[2], f"{texts[5]} {passage}", f"{passage} {texts[8]}", "123 456", None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    path = tables(documents=([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema), labels=(labels, LABELS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, path)
        assert docs.columns == columns
        docs = corpus_pipeline.saved(docs)
        old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, docs))
        assert set(new) <= set(old)
        if name == "language":
            assert 123 not in new and 124 not in new
        if name == "near_duplicates":
            sets = {i: shingles(t, 5) for i, t in new.items()}
            assert not any(a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in sets for b in sets if sets[a])
        if name == "repeated_passages":
            ids = sorted(old)
            expected = removed_by_brute_force([old[i] for i in ids], corpus_pipeline.PASSAGE.length)
            assert [hashlib.sha256(new[i].encode()).hexdigest() for i in ids] == [e[3] for e in expected]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == set(new)
