"""A text without spaces takes memory in proportion to its length."""

import random
import tracemalloc

import public_tokenizers
import pytest

from knotwork.llm.sentencepiece_nbest import Segmenter


@pytest.fixture(scope="module")
def segmenter():
    return Segmenter(public_tokenizers.path("piece_bpe_32k.model"))


def test_paths_are_shared(segmenter):
    used = {}
    for n in (2000, 8000):
        word = "▁" + "".join(random.Random(1).choices("etaoinshrdlu", k=n))
        tracemalloc.start()
        found = segmenter.nbest(word, 4)
        used[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len({ids for _, ids in found}) == 4
        assert all("".join(segmenter.pieces[i] for i in ids) == word for _, ids in found)
    assert used[8000] < 6 * used[2000] < 120_000_000
