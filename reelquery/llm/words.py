"""Words of a text as bytes, and memory-bounded hashes of them."""

from __future__ import annotations

import numpy as np
import xxhash

from reelquery.llm.worker import remembered

_LOWER = {c: c + 32 for c in range(65, 91)}
#: Words of letters, digits and everything beyond ASCII: A-Z lower-cased, all other ASCII becomes a space.
ALNUM = bytes(_LOWER.get(c, c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
#: Words between white space: A-Z lower-cased, ASCII white space becomes a space.
SPACED = bytes(_LOWER.get(c, 32 if 9 <= c <= 13 else c) for c in range(256))

#: `WordHashes` holds at most about so many words.
MOST_WORDS = 400_000


def alnum_words(data: bytes) -> list[bytes]:
    return data.translate(ALNUM).split()


def spaced_words(data: bytes) -> list[bytes]:
    return data.translate(SPACED).split()


class WordHashes(dict):
    """64-bit xxh3 of a word, remembered; emptied when it holds too many words, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered in the worker until another operator needs its memory."""
    return remembered(WordHashes, WordHashes).of(words)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words in order, repeats included; of all words if they are fewer; none of no words."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        out = np.zeros(1, np.uint64) + np.uint64(n)
        for x in h:
            out = out * np.uint64(0x9E3779B97F4A7C15) + x
        return mix(out)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    return mix(out)
