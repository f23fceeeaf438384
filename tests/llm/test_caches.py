"""Caches of words hold a bounded number of bytes, and what they give does not depend on that."""

import random

import numpy as np
import public_tokenizers

from knotwork.llm import common
from knotwork.llm.tokens import Encoder


def test_long_words_are_not_kept():
    made = []
    cache = common.WordCache(lambda w: made.append(w) or len(w), 3)
    long = "x" * (common.LONGEST_KEPT + 1)
    assert [cache[w] for w in ("a", long, "a", long)] == [1, len(long), 1, len(long)]
    assert made == ["a", long, long] and list(cache) == ["a"]
    for w in "bcde":
        assert cache[w] == 1
    cache.trim()
    assert not cache and cache["a"] == 1 and made.count("a") == 1  # from the older generation


def test_a_table_is_renewed_by_characters_too(monkeypatch):
    monkeypatch.setattr(common, "TABLE_CHARS", 5000)
    rng = random.Random(3)

    def make(words):
        live = np.array([not w.startswith("z") for w in words])
        return live, np.array([[len(w), ord(w[0])] for w in words if not w.startswith("z")], np.float32).reshape(-1, 2)

    table = common.WordTable(make, 2, 1000)
    known = ["".join(rng.choices("abz", k=rng.randrange(1, 400))) for _ in range(200)]
    for _ in range(40):
        words = rng.choices(known, k=7)
        rows = table.matrix[table.places(words)]
        assert rows.tolist() == [[0, 0] if w.startswith("z") else [len(w), ord(w[0])] for w in words]
        assert sum(map(len, table)) <= 5000 + 7 * 400 and sum(map(len, table.older)) <= 5000 + 7 * 400


def test_ids_of_texts_without_spaces_are_the_librarys_and_leave_no_trace():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, rng = Encoder(path), random.Random(4)
    letters = "".join(map(chr, range(0x4E00, 0x4E40))) + "。，abc"
    texts = ["".join(rng.choices(letters, k=5000)) for _ in range(3)] + ["a" * 300 + " b\n" + "c" * 300 + "\n\n" + "d" * 65 + ". e"]
    for text in texts:
        assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*encoder.spaced, *encoder.plain])) <= common.LONGEST_KEPT
