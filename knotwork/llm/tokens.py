"""Token ids of whole texts by the tokenizers library, a word at a time.

A byte-level tokenizer never joins a token across a space that stands between two
characters that are not white space. So a text is cut before each such space, each
different piece is encoded once by the library, and a cache serves its repetitions.
Pieces around any other white space stay together. The ids equal those of the whole
text, several times sooner on natural text.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np

from .common import WordCache

_TAIL = ".,;:!?|"
#: Entries of each generation of the two caches; an entry takes about 200 bytes.
_CACHED = 450_000


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, where it is
    printable in Latin-1 and no space, else the next one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _blank(char: str) -> bool:
    return char.isspace() or unicodedata.category(char)[0] in "ZC"


class Encoder:
    """``ids(text)`` as unsigned 32-bit integers, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.chars = self.tokenizer.model, _byte_chars()
        self.spaced = WordCache(lambda piece: self._piece(piece, " "), _CACHED)
        self.plain = WordCache(lambda piece: self._piece(piece, ""), _CACHED)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str, before: str) -> bytes | None:
        """Ids of a piece; None if its ends don't allow a cut."""
        if piece.isalpha() and max(piece) < "\u0250":  # one run of letters: the library's model alone
            return array("I", [t.id for t in self.model.tokenize((before + piece).encode().decode("latin-1").translate(self.chars))]).tobytes()
        body = piece.rstrip(_TAIL)
        if body.isalpha() and max(body) < "\u0250":  # letters, then a run of punctuation
            return (self.spaced if before else self.plain)[body] + self.plain[piece[len(body) :]]
        if before and piece[:1] == "\n":  # from the fast path of ids(): a line break, no space before it
            body = self.plain[piece[1:]] if piece[1:2] and not _blank(piece[1]) else None
            return None if body is None else self.newline + body
        if not piece or _blank(piece[0]) or _blank(piece[-1]):
            return None
        if "<|" in piece:  # may hold an added token
            return self._encode(before + piece)
        at = piece.find("\n")
        if at > 0 and not _blank(piece[at - 1]) and not _blank(piece[at + 1]):
            left, right = (self.spaced if before else self.plain)[piece[:at]], self.plain[piece[at + 1 :]]
            return left + self.newline + right if left is not None and right is not None else None
        return self._encode(before + piece)

    @property
    def newline(self) -> bytes:
        if not hasattr(self, "_newline"):
            self._newline = self._encode("\n")
        return self._newline

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        # Line breaks between words end pieces too.
        first, *pieces = text.replace("\n", " \n").split(" ")
        parts = list(map(self.spaced.__getitem__, pieces))
        parts.insert(0, self.plain[first])
        if None in parts:
            first, *pieces = text.split(" ")
            parts = [self.plain[first], *(None if p[:1] == "\n" else self.spaced[p] for p in pieces)]
            parts = self._joined([first, *pieces], parts)
        self.spaced.trim()
        self.plain.trim()
        return np.frombuffer(b"".join(parts), "<u4")

    def _joined(self, pieces: list[str], parts: list[bytes | None]) -> list[bytes]:
        """Pieces that can't be cut apart, encoded together."""
        out, at, n = [], 0, len(pieces)
        while at < n:
            end = at + 1
            while end < n and (parts[end - 1] is None or parts[end] is None):
                end += 1
            if end == at + 1 and parts[at] is not None:
                out.append(parts[at])
            else:
                out.append(self._encode((" " if at else "") + " ".join(pieces[at:end])))
            at = end
        return out


_KEPT: dict[str, Encoder] = {}


def kept(path: str) -> Encoder:
    """The worker's encoder of a tokenizer, whose bounded caches last from task to task; one tokenizer at a time."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Encoder(path)
    return _KEPT[path]
