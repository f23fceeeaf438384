"""The trained operators, and the pipeline as a whole, against plain versions of their definitions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from knotwork.llm import chat, language_id, quality_classifier, queries, tokens, topk_search
from tests.llm.test_operators import CHATS, DOCS, LABELS, VECTORS, graded_fixture, removed_by_brute_force, rows_of, shingles, smallest, usable, vectors


def cleaned(token):
    letters = [i for i, c in enumerate(token) if c.isalpha()]
    return token[letters[0] : letters[-1] + 1].lower() if letters else ""


def plain_languages(train, texts):
    """(language, score) of each text by the definition: counts of every word and n-gram, no caches or batches."""
    counts, total = {}, Counter()
    for text, lang in train:
        for word in filter(None, map(cleaned, (text or "").split())):
            grams = [(0, word)] + [(n, p[i : i + n]) for n in range(1, 6) for p in [word if n == 1 else f"^{word}$"] for i in range(len(p) - n + 1)]
            for item in grams:
                counts.setdefault(item, Counter())[lang] += 1
                total[lang, item[0]] += 1
    langs = sorted({lang for lang, _ in total})
    kept = {i: c for i, c in counts.items() if any(n >= (language_id.WORD_SHARE if i[0] == 0 else language_id.GRAM_SHARE) * total[lang, i[0]] for lang, n in c.items())}
    logs = lambda item: np.array([math.log((kept[item][lang] + 0.5) / (total[lang, item[0]] + 1000)) for lang in langs])
    out = []
    for text in texts:
        found, n = np.zeros(len(langs)), 0
        for word in filter(None, map(cleaned, (text or "").split())):
            n += 1
            if (0, word) in kept:
                found += logs((0, word))
                continue
            padded, rows = f"^{word}$", []
            for i in range(len(padded) - 1):
                row = next((logs((k, padded[i : i + k])) for k in (5, 4, 3, 2, 1) if (k, padded[i : i + k]) in kept), None)
                rows += [row] if row is not None else []
            found += np.mean(rows, axis=0) if rows else 0
        if not n or not langs:
            out.append(("und", 0.0))
        else:
            best = int(np.argmax(found))
            out.append((langs[best], float(1 / np.exp((found - found[best]) * min(n, language_id.EVIDENCE_WORDS) / n).sum())))
    return out


def language_texts():
    rng = random.Random(11)
    letters = {"en": "etaoinsh", "fr": "eaisntré", "de": "enisrätu"}
    texts, langs = [], {}
    for i in range(90):
        langs[i] = lang = ["en", "fr", "de"][i % 3]
        texts.append(" ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 7))) + rng.choice(["", ",", "!", "7"]) for _ in range(rng.randrange(1, 25))))
    return [*texts, None, "", "12 - 3", texts[0], texts[1]], langs | {90: None, 91: "en", 92: "de", 93: None, 94: "fr"}


def test_op1_equals_its_definition(spark, tables):
    texts, langs = language_texts()
    got = {r.doc_id: r for r in queries.op1_language_id(spark, tables(documents=(rows_of(texts, langs), DOCS))).collect()}
    train = [(t, langs[i]) for i, t in enumerate(texts) if t is not None and langs[i] and zlib.crc32(str(i).encode()) % 4 != 2]
    for i, (lang, score) in enumerate(plain_languages(train, texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=2e-4)


def plain_features(text):
    """The buckets of a text's distinct words and shape, each feature in two."""
    words, raw = (text or "").split(), (text or "").encode()
    size, found = max(1, len(raw)), set(words)
    shares = {
        "upper": sum(65 <= b <= 90 for b in raw) / size, "digit": sum(48 <= b <= 57 for b in raw) / size, "symbol": sum(chr(b) in "!#$%&*+/<=>@[\\]^_`{|}~" for b in raw if b < 128) / size,
        "same": sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), "distinct": len(found) / max(1, len(words)),
    }
    names = [f"\t{k}{sum(x > level for level in (0.0, 0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8))}" for k, x in shares.items()] + [f"\tlength{len(words).bit_length()}"]
    out = []
    for name in [*(cleaned(w) or w for w in found), *names]:
        h = xxhash.xxh3_64_intdigest(name.encode())
        out += [h % (1 << 20), (h >> 32) % (1 << 20)]
    return Counter(out)


def plain_grades(train, texts, tail=2, epochs=120, l2=2e-4):
    """(expected grade, P(grade >= tail)) by full gradients over a dense matrix."""
    grades = np.array([g for _, g in train])
    seen = np.unique(grades)
    if len(seen) < 2:
        return [(float(seen[0]) if len(seen) else 0.0, 1.0)] * len(texts)
    y = np.searchsorted(seen, grades)
    rows = [plain_features(t) for t, _ in train]
    times = Counter(b for r in rows for b in r.elements())
    live = [b for b in times if times[b] >= min(5, max(1, len(rows) // 20))]
    x = np.array([[r[b] for b in live] for r in rows], float)
    kinds, n = len(seen), len(y)
    share = np.bincount(y, minlength=kinds) / n
    weight = (1 / np.sqrt(share))[y]
    weight /= weight.sum()
    cut = np.log(np.cumsum(share)[:-1] / (1 - np.cumsum(share)[:-1]))
    p = np.concatenate([np.zeros(len(live)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    thresholds = lambda p: p[len(live)] + np.concatenate([[0], np.cumsum(np.exp(p[len(live) + 1 :]))])
    sigma = lambda z: 1 / (1 + np.exp(-z))
    m, v = np.zeros(len(p)), np.zeros(len(p))
    for step in range(1, epochs + 1):
        t, s = thresholds(p), x @ p[: len(live)]
        up = np.array([sigma(t[k] - z) if k < kinds - 1 else 1.0 for k, z in zip(y, s)])
        low = np.array([sigma(t[k - 1] - z) if k else 0.0 for k, z in zip(y, s)])
        du, dl = up * (1 - up) / (up - low) * weight, low * (1 - low) / (up - low) * weight
        by_t = np.zeros(kinds - 1)
        for k, a, b in zip(y, du, dl):
            if k < kinds - 1:
                by_t[k] -= a
            if k:
                by_t[k - 1] += b
        grad = np.concatenate([x.T @ (du - dl) + l2 * p[: len(live)], [by_t.sum()], [by_t[j + 1 :].sum() * math.exp(p[len(live) + 1 + j]) for j in range(kinds - 2)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    w, t, out = dict(zip(live, p)), thresholds(p), []
    for text in texts:
        above = sigma(sum(w.get(b, 0.0) * c for b, c in plain_features(text).items()) - t)
        out.append((float(seen[0] + above.sum()), float(above[min(max(tail, 1), len(above)) - 1])))
    return out


def test_op7_equals_its_definition(spark, tables):
    texts, labels = graded_fixture(90)
    texts = [*texts, None, "", texts[0], texts[1]]
    got = {r.doc_id: r for r in queries.op7_quality_classifier(spark, tables(documents=(rows_of(texts), DOCS), labels=([*labels, labels[4]], LABELS))).collect()}
    train = [(texts[i], 0 if toxic else 1 + quality) for i, quality, toxic in labels]
    for i, (grade, tail) in enumerate(plain_grades(train, texts)):
        assert got[i].expected_grade == pytest.approx(grade, abs=1e-3) and got[i].p_tail == pytest.approx(tail, abs=1e-3) and got[i].kept == (tail >= 0.5)
    assert got[92].p_tail == got[0].p_tail and got[93].p_tail == got[1].p_tail  # repeated texts share their fate


def test_op7_repeated_ids_bring_no_more_rows(spark):
    docs = spark.createDataFrame([(1, "good text here")] * 50 + [(2, "bad stuff there")] + [(1, "another good one")] * 9, "doc_id long, text string")
    model = quality_classifier.train(docs, spark.createDataFrame([(1, 2), (2, 0), (1, 1)], "doc_id long, grade int"), max_train=2)
    assert len(model.thresholds) == 1 and model.lowest == 0.0


def pipeline_tables():
    texts, labels = graded_fixture(75)
    rng = random.Random(9)
    passage = " ".join(f"same{i}" for i in range(60))
    texts = [t + " " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(60)) for t in texts]
    near = texts[2].split()
    near[40] = "changed"
    texts += [texts[2], " ".join(near), f"{texts[5]} {passage}", f"{passage} {texts[8]}", "123 456", None, "", "word " * 30_000, "le château et la maison"]
    langs = {i: None if i % 11 == 0 else "en" for i in range(len(texts))} | {len(texts) - 1: "fr", 11: "fr"}
    return texts, langs, labels


def plain_pipeline(texts, langs, labels, pipeline):
    """{doc_id: text} before the packing."""
    kept = dict(enumerate(texts))
    grades = plain_grades([(texts[i], 0 if toxic else 1 + quality) for i, quality, toxic in labels], texts)
    kept = {i: t for i, t in kept.items() if grades[i][1] >= pipeline.GOOD}
    ids = sorted(kept)
    train = [(kept[i], langs[i]) for i in ids if kept[i] is not None and langs[i]]
    learned = {lang for t, lang in train if any(map(cleaned, t.split()))}
    found = dict(zip(ids, plain_languages(train, [kept[i] for i in ids])))
    kept = {i: t for i, t in kept.items() if found[i][0] != "und" and found[i][1] >= pipeline.SURE and not (langs[i] in learned and langs[i] != found[i][0])}
    ids = sorted(kept)
    sets = [shingles(kept[i], pipeline.WORDS) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if sets[a] and 100 * len(sets[a] & sets[b]) >= pipeline.PERCENT * len(sets[a] | sets[b])]
    root = smallest(len(ids), links)
    kept = {i: kept[i] for k, i in enumerate(ids) if root[k] == k}
    return kept, removed_by_brute_force([kept[i] for i in sorted(kept)], pipeline.PASSAGE.length)


def test_pipeline_equals_plain_stages(spark, tables):
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts, langs, labels = pipeline_tables()
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, p_tail string, lang_pred int"  # extra columns with results' names
    rows = [(i, t, langs[i], "s", len(t or ""), "k", "p", 7) for i, t in enumerate(texts)]
    path = tables(documents=(rows, schema), labels=(labels, LABELS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "p_tail", "lang_pred"]
    kept, cut = plain_pipeline(texts, langs, labels, corpus_pipeline)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(kept) and 0 < len(kept) < len(texts) - 40 and sum(c[1] for c in cut) > 0
    for i, (_, _, _, sha) in zip(sorted(kept), cut):
        assert hashlib.sha256((got[i].text or "").encode()).hexdigest() == sha and got[i].n_chars == len(got[i].text or "") and (got[i].key, got[i].p_tail, got[i].lang_pred) == ("k", "p", 7)
    plain = Tokenizer.from_file(tokens.default_path())
    expected = {i: [*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for i, r in got.items()}
    pieces = corpus_pipeline.run(spark, path).collect()
    for i, ids in expected.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    assert {p.doc_id for p in pieces} == set(expected)


def test_pipeline_stages_take_empty_tables(spark, tables):
    import corpus_pipeline

    path = tables(documents=([], "doc_id long, text string, lang string, source string"), labels=([], LABELS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, path))
        assert docs.columns == ["doc_id", "text", "lang", "source"] and docs.isEmpty()
    assert corpus_pipeline.run(spark, path).isEmpty()


def test_rows_without_an_id(spark, tables):
    text = "one two three four five six " * 30
    path = tables(documents=([(None, text, "en", "s", 1, 0.0, 1), (5, text, "en", "s", 1, 0.0, 1), (5, text, "en", "s", 1, 0.0, 1)], DOCS))
    assert sorted((r.doc_id is None, r.component_id) for r in queries.op10_jaccard_join(spark, path).collect()) == [(False, 5), (False, 5), (True, None)]
    assert [(r.n_removed, r.n_spans) for r in queries.op9_suffix_dedup(spark, path).collect()] == [(len(text), 1)] * 3


def test_vectors_with_null_and_repeated_ids(spark, tables):
    rows = vectors()[:45] + [(None, vectors()[0][1], 0, 0), (3, vectors()[0][1], 0, 0)]
    got = queries.op8_pq_neardup(spark, tables(embeddings=(rows, VECTORS))).collect()
    assert len(got) == len(rows) and [r.component_id for r in got if r.vec_id is None] == [None] and sum(r.vec_id == 3 for r in got) == 2
    found = queries.op4_topk_search(spark, tables(embeddings=(rows, VECTORS))).collect()
    best = sorted((-sum(math.floor(float(np.float32(a)) * 256) * math.floor(float(np.float32(b)) * 256) for a, b in zip(rows[0][1], v)), i) for i, v, *_ in rows if i not in (0, None) and usable(v))[:5]
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == 0] == [(i, -s) for s, i in best]  # both rows of 3 count
    twice = spark.createDataFrame([(0, [1.0])] * 3 + [(1, [2.0])], "vec_id long, vector array<double>")
    assert [(r.query_id, r.vec_id) for r in topk_search.search(twice, twice.where("vec_id = 0")).collect()] == [(0, 1)]


def test_op3_equal_and_missing_turns(spark, tables):
    rows = [(1, 0, "user", "b", 0), (1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (2, None, "assistant", "z", 0), (2, 4, "user", "y", 0), (None, 0, "user", "n", 0), (None, 1, "assistant", "o", 0), (3, 0, None, None, 0)]
    got = queries.op3_chat_windows(spark, tables(conversations=(rows, CHATS))).collect()
    turns = {r.conv_id: (r.n_turns, r.loss_chars) for r in got}
    assert turns == {-1: (2, len(queries.CONTROL)), 1: (3, 0), 2: (2, 1), None: (2, 1), 3: (1, 0)}
    again = {r.conv_id: r.turns_sha256 for r in queries.op3_chat_windows(spark, tables(conversations=(rows[::-1], CHATS))).collect()}
    assert again == {r.conv_id: r.turns_sha256 for r in got}  # the order of rows doesn't matter
    assert chat.unescape(chat.escape("")) == ""


def test_op8_ids_in_several_classes_and_magnitudes(spark, tables):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (7, [1.0, 0.0], 0), (4, [1e-200, 0.0], 1), (5, [1e-200, 1e-203], 1), (6, [1e200, 1e190], 1), (1, [5.0, 5.0], 2)]
    got = queries.op8_pq_neardup(spark, tables(embeddings=(rows, "vec_id long, embedding array<double>, label int"))).collect()
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    assert found == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 4), (5, 2, 4), (6, 2, 4), (7, 2, 1)]
