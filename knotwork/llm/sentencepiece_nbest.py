"""SentencePiece encoding with N-best segmentation, and decoding.

The lattice of a word has an edge for each vocabulary piece in it, and byte pieces for
a character without one. Forward Viterbi gives the best score up to every position;
for the backward A-star search from the end these are exact heuristics, so paths leave
its queue best first and the search stops at the N-th. No piece reaches over a word's
start, so a text's N best segmentations combine those of its words, and only the N - 1
words that lose least by their second path can differ from their best one.

Defined results: a null text counts as empty and has the segmentation of the empty
text, no piece; U+2581 in a text is written in byte pieces, so decoding gives every
text back; repeated rows are encoded each for itself. A word's paths of equal score are in order of their ids;
of words that lose equally little by their second path the first in the text vary, and equal sums over words
are in order of the words' alternatives, those of earlier words first.
"""

from __future__ import annotations

import heapq
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordCache, crc_of

MARK = "▁"
_BARE = "\0"  # before a word that doesn't begin with the mark
N_BEST = 4
_CACHED = 550_000  # words whose best path is remembered, in each of two generations; about 300 bytes each
_TAIL = ".,;:!?|"


class _Path:
    """A piece and the path behind it, which paths share; equal scores are ordered by ids, then by age."""

    __slots__ = ("own", "rest", "age")

    def __init__(self, own: tuple[int, ...], rest: _Path | None, age: int):
        self.own, self.rest, self.age = own, rest, age

    def ids(self):
        path = self
        while path is not None:
            yield from path.own
            path = path.rest

    def __lt__(self, other: _Path) -> bool:
        for x, y in itertools.zip_longest(self.ids(), other.ids(), fillvalue=-1):  # of two the shorter comes first
            if x != y:
                return x < y
        return self.age < other.age


class Segmenter:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        usual = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.scored = {self.pieces[i]: (sp.get_score(i), i) for i in usual}
        # Every beginning of a piece, with (score, id) if it is one itself.
        self.starts = {p[:k]: None for p in self.scored for k in range(1, len(p))} | self.scored
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.unknown = min(s for s, _ in self.scored.values()) - 10.0
        # Words can be cut apart if no piece holds the mark after another character, or a line break.
        self.cut_words = not any(MARK in p.lstrip(MARK) for p in self.scored)
        self.cut_lines = self.cut_words and not any("\n" in p for p in self.scored)
        # So can letters and the punctuation after them, where no piece holds both.
        self.tail = "".join(c for c in _TAIL if not any(a.isalpha() and b == c for p in self.scored for a, b in zip(p, p[1:])))
        # What a piece shows; bytes beyond ASCII are part of a character and are left to decode().
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        for b in range(128):
            self.shown[self.bytes[b]] = chr(b)
        self.partial = np.zeros(size, bool)
        self.partial[self.bytes[128:]] = True
        self.cache = WordCache(self._best_of_key, _CACHED)
        self.paths = WordCache(lambda key: self.nbest(self._word(key), N_BEST), _CACHED // 8)

    def edges(self, word: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """The lattice as (start, end, score, ids), by start."""
        out, n, starts, miss = [], len(word), self.starts, 0
        for i in range(n):
            known = False
            for j in range(i + 1, n + 1):
                found = starts.get(word[i:j], miss)
                if found is miss:
                    break
                if found is not None:
                    out.append((i, j, found[0], (found[1],)))
                    known = known or j == i + 1
            if not known:
                out.append((i, i + 1, self.unknown, tuple([self.bytes[b] for b in word[i].encode("utf-8", "surrogatepass")])))
        return out

    @staticmethod
    def forward(edges, n: int) -> tuple[list[float], list[int]]:
        """Best score up to each position, and the edge that it ends with."""
        best, via = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for number, (i, j, s, _) in enumerate(edges):
            if best[i] + s > best[j]:
                best[j], via[j] = best[i] + s, number
        return best, via

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids), by A-star from the end with Viterbi scores as heuristics."""
        edges, ends = self.edges(word), [[] for _ in range(len(word) + 1)]
        for i, j, s, own in edges:
            ends[j].append((i, s, own))
        best, out, queue, ties = self.forward(edges, len(word))[0], [], [], itertools.count()
        heapq.heappush(queue, (-best[-1], _Path((), None, next(ties)), len(word), 0.0))
        while queue and len(out) < n:
            _, path, at, done = heapq.heappop(queue)
            if at == 0:
                out.append((done, tuple(path.ids())))
                continue
            for i, s, own in ends[at]:
                heapq.heappush(queue, (-(best[i] + s + done), _Path(own, path, next(ties)), i, done + s))
        return out

    def best(self, word: str) -> tuple[bytes, float, float]:
        """Ids and score of the best path, and what the second best loses (infinite without one)."""
        n, get, unknown, no = len(word), self.starts.get, self.unknown, -np.inf
        fore, via, edges = [0.0] + [no] * n, [0] * (n + 1), []
        for i in range(n):  # the forward pass makes the lattice on its way
            here, known = fore[i], False
            for j in range(i + 1, n + 1):
                found = get(word[i:j], 0)
                if not found:
                    if found is None:
                        continue
                    break
                score = found[0]
                if here + score > fore[j]:
                    fore[j] = here + score
                    via[j] = len(edges)
                edges.append((i, j, score, found[1]))
                known = known or j == i + 1
            if not known:
                if here + unknown > fore[i + 1]:
                    fore[i + 1] = here + unknown
                    via[i + 1] = len(edges)
                edges.append((i, i + 1, unknown, -1))
        ids, at, taken = [], n, set()
        while at:
            number = via[at]
            taken.add(number)
            at, end, _, own = edges[number]
            ids.extend([own] if own >= 0 else [self.bytes[b] for b in reversed(word[at:end].encode("utf-8", "surrogatepass"))])
        # Any other path has an edge off the best one; the best through it is known from both ends.
        back, through, number = [no] * n + [0.0], no, len(edges)
        for i, j, score, _ in reversed(edges):
            number -= 1
            rest = score + back[j]
            if rest > back[i]:
                back[i] = rest
            if fore[i] + rest > through and number not in taken:
                through = fore[i] + rest
        ids.reverse()
        return array("I", ids).tobytes(), fore[n], max(fore[n] - through, 0.0)

    def _word(self, key: str) -> str:
        return key[1:] if key[:1] == _BARE else MARK + key

    def _best_of_key(self, key: str) -> tuple[bytes, float, float]:
        if key == _BARE + MARK:  # the character itself
            return array("I", [self.bytes[b] for b in MARK.encode()]).tobytes(), self.unknown, np.inf
        if self.cut_lines and "\n" in key[1:-1]:
            first, *rest = key.split("\n")
            parts = [self.cache[first]]
            for line in rest:
                parts.append(self.cache[_BARE + "\n"])
                if line:
                    parts.append(self.cache[_BARE + line])
            return b"".join(p[0] for p in parts), sum(p[1] for p in parts), min(p[2] for p in parts)
        body = key.rstrip(self.tail)
        if body != key and body[-1:].isalpha():
            one, two = self.cache[body], self.cache[_BARE + key[len(body) :]]
            return one[0] + two[0], one[1] + two[1], min(one[2], two[2])
        return self.best(self._word(key))

    def keys(self, text: str) -> list[str]:
        """A text's words, without the mark that begins each, or behind ``_BARE`` if none does."""
        out: list[str] = []
        if not text:
            return out
        for number, part in enumerate(text.split(MARK)):
            if number:
                out.append(_BARE + MARK)
            if _BARE in part:  # the sign that keys use: one lattice for all of it
                out.append(_BARE + ("" if number else MARK) + part.replace(" ", MARK))
                continue
            if not number:
                words = part.split(" ")
            elif not part:
                continue
            else:
                head, *words = part.split(" ")
                if head:
                    out.append(_BARE + head)
                if not words:
                    continue
            if self.cut_lines and "\n" in part and not number and "" not in (lines := part.replace("\n", f" {_BARE}\n").split(" ")):
                out.extend(lines)  # line breaks end words too
                continue
            if not self.cut_words:
                out.append(MARK.join(words))
            elif "" not in words:
                out.extend(words)
            else:  # several spaces: their marks stand before the next word
                out.extend(w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + MARK.join(words)))
        return out

    def encode_nbest(self, text: str | None, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best (score, ids) of a whole text, best first."""
        keys = self.keys(text or "")
        found = list(map(self.cache.__getitem__, keys))
        parts, total = [f[0] for f in found], sum([f[1] for f in found])
        losses = np.array([f[2] for f in found])
        near = np.argsort(losses, kind="stable")[: n - 1]
        near = sorted(int(i) for i in near if losses[i] < np.inf)
        options = [self.paths[keys[i]] if n == N_BEST else self.nbest(self._word(keys[i]), n) for i in near]
        picks = heapq.nsmallest(n, itertools.product(*(range(len(o)) for o in options)), key=lambda p: (-sum(o[k][0] - o[0][0] for o, k in zip(options, p)), p))
        out = []
        for pick in picks:
            chosen = list(parts)
            for i, o, k in zip(near, options, pick):
                chosen[i] = array("I", o[k][1]).tobytes()
            out.append((total + sum(o[k][0] - o[0][0] for o, k in zip(options, pick)), np.frombuffer(b"".join(chosen), "<u4")))
        self.cache.trim()
        self.paths.trim()
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        if not self.partial[ids].any():
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
            return text[1:] if text[0] == " " else text
        ids = ids.tolist()
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
            else:
                if raw:
                    out.append(raw.decode("utf-8", "surrogatepass"))
                    raw = bytearray()
                out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
        text = "".join(out)
        return text[1:] if text[0] == " " else text


_KEPT: dict[str, Segmenter] = {}


def kept(path: str) -> Segmenter:
    """The worker's segmenter of a model, whose bounded caches last from task to task; one model at a time."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Segmenter(path)
    return _KEPT[path]


_ROWS = "n_best int, score double, last_score double, n_pieces long, ids_crc32 long, nbest_crc32 long, round_trip boolean, ids array<array<int>>"


def encode(docs: DataFrame, model: str, n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """doc_id and, of each row's ``n`` best segmentations: number, first and last score, pieces and crc32
    of the best, crc32 of all, whether the best decodes to the text, and (``with_ids``) the ids."""

    def run(it):
        segmenter = kept(model)
        for batch in it:
            rows = []
            for text in batch.column("text").to_pylist():
                found = segmenter.encode_nbest(text, n)
                best = found[0][1]
                row = (len(found), found[0][0], found[-1][0], len(best), crc_of(best), crc_of(np.concatenate([f[1] for f in found])), segmenter.decode(best) == (text or ""))
                rows.append((*row, [f[1].astype(np.int32) for f in found]) if with_ids else row)
            columns = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    fields = _ROWS.split(", ")[: None if with_ids else -1]
    names = [f.split()[0] for f in fields]
    types = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.list_(pa.int32()))]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(fields))


def decode(rows: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """doc_id and text of ``rows(doc_id, <column> array<int>)``; null ids count as none."""

    def run(it):
        segmenter = kept(model)
        for batch in it:
            texts = [segmenter.decode(ids or []) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", column).mapInArrow(run, "doc_id long, text string")
