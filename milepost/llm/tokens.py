"""Token ids of whole texts by the tokenizers library, quickly.

The library spends most of its time on normalising and splitting. Text is
therefore cut where no token can cross (at white space), and the ids of each
piece are kept in a bounded memo, which lives as long as the Python worker.
A piece that holds only plain Latin characters is split here and merged by the
library's model; any other piece, and any text with unusual white space, goes
through the library as a whole. The ids are those of ``Tokenizer.encode``;
tests compare them.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Entries of a memo; a full one is emptied. Words without the blank before them
#: repeat more, and the pipeline's workers hold other things, too.
MEMO = 1_000_000
WORD_MEMO = 600_000


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine (drivers and
    executors have the vocabulary package installed)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """Byte-level BPE's printable character for each byte: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: Letters whose lower case and class no library disagrees on.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SAFE_WORD = re.compile(rf"(?!.*<\|)[!-~{_LATIN}]+")
_WORD_PIECES = re.compile(rf"{_CONTRACTIONS}|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
_BYTE_PIECES = re.compile(rf"{_CONTRACTIONS}| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Beside single blanks and line ends between words, white space is irregular.
_OTHER_BLANKS = re.compile("[\t\r\f\v\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class _Ids:
    """Ids of pieces as little-endian uint32 bytes, through the model alone."""

    most = MEMO

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_alphabet()))
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, piece: str) -> bytes:
        out = self.parts.get(piece)
        if out is None:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
            out = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
            if len(self.parts) >= self.most:
                self.parts.clear()
            self.parts[piece] = out
        return out


class WordIds(_Ids):
    """For a vocabulary of lower-cased words that drops white space."""

    most = WORD_MEMO

    def _learn(self, word: str) -> bytes:
        if _SAFE_WORD.fullmatch(word):
            out = b"".join([self.part(p) for p in _WORD_PIECES.findall(word.lower())])
        else:
            out = self.slow(word)
        if len(self.memo) >= self.most:
            self.memo.clear()
        self.memo[word] = out
        return out

    def encode(self, text: str) -> bytes:
        # str.split also cuts at U+001C to U+001F, which the library keeps.
        words = re.split(r"[^\S\x1c-\x1f]+", text) if _SEPARATORS.search(text) else text.split()
        memo, learn = self.memo, self._learn
        return b"".join([memo[w] if w in memo else learn(w) for w in words])


class ByteIds(_Ids):
    """For a byte-level vocabulary whose words carry the blank before them."""

    def __init__(self, path: str):
        super().__init__(path)
        self.spaced: dict[str, bytes] = {}  # ids of a blank and the word

    def _learn(self, unit: str, memo: dict[str, bytes], blank: str = "") -> bytes:
        if _SAFE_WORD.fullmatch(unit):
            out = b"".join([self.part(p) for p in _BYTE_PIECES.findall(blank + unit)])
        else:
            out = self.slow(blank + unit)
        if len(memo) >= self.most:
            memo.clear()
        memo[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        memo, spaced, learn = self.memo, self.spaced, self._learn
        double = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        if double or text[0].isspace() or text[-1].isspace() or _OTHER_BLANKS.search(text):
            return b"".join([memo[u] if u in memo else learn(u, memo) for u in _CUT.split(text)])
        out: list[bytes] = []
        # One blank, or one line end, between words: a line end is a token of
        # its own, a blank belongs to the word after it.
        end = memo["\n"] if "\n" in memo else learn("\n", memo)
        for line in text.split("\n"):
            words = line.split(" ")
            first = words[0]
            out.append(memo[first] if first in memo else learn(first, memo))
            out += [spaced[w] if w in spaced else learn(w, spaced, " ") for w in words[1:]]
            out.append(end)
        return b"".join(out[:-1])


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """The worker's encoder for a vocabulary of words (kept between tasks)."""
    return WordIds(path)


@lru_cache(maxsize=4)
def byte_ids(path: str) -> ByteIds:
    """The worker's encoder for a byte-level vocabulary (kept between tasks)."""
    return ByteIds(path)
