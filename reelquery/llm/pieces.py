"""Cutting texts into pieces that a tokenizer encodes independently, and encoding each distinct piece once.

Tokenizers of this kind split a text into pre-tokens: runs of letters, of digits, of other characters and of white
space, a single space going with what follows (or being dropped). Between two ASCII characters of different kinds a
cut never changes the ids, but for an apostrophe, which may begin a contraction with the letters behind it. A single
space or line break between printable ASCII characters or Latin-1 letters is safe as well. Nothing that is normalised
(NFC, lower case, runs of white space) reaches across such cuts. Special tokens hold no space but other characters, so a
text with `<|` is cut at safe spaces only.
"""

from __future__ import annotations

import os
from operator import attrgetter

import numpy as np
import xxhash

#: Longer pieces are hashed one by one.
_LONG = 48
_LETTER, _DIGIT, _OTHER, _SPACE, _BREAK, _FAR, _REST = range(7)
_KIND = np.full(256, _REST, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _LETTER
_KIND[0x61:0x7B] = _LETTER
_KIND[0x20] = _SPACE
_KIND[0x0A] = _BREAK
_KIND[0x80:] = _FAR
_PLAIN = np.isin(np.arange(7), (_LETTER, _DIGIT, _OTHER))
#: Kinds of neighbours between which a cut is safe.
_CUT = np.zeros((7, 7), np.bool_)
for _x, _y in ((_LETTER, _OTHER), (_LETTER, _DIGIT), (_DIGIT, _LETTER), (_DIGIT, _OTHER), (_OTHER, _DIGIT), (_OTHER, _LETTER)):
    _CUT[_x, _y] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Slots in which a piece is looked for first, by its hash.
_SLOT_MASK = np.uint64((1 << 22) - 1)


def valid(data: bytes | None) -> bytes:
    """Null is empty; bytes that are no UTF-8 become U+FFFD, as everywhere else in Python."""
    if not data:
        return b""
    if not data.isascii():
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()
    return data


def cuts(data: bytes, special: bool) -> np.ndarray:
    """Places of a text at which it may be cut, ascending, all inside it; decided by at most two bytes before and one behind. A safe space begins a piece and a safe line break is one. special: only spaces."""
    a = np.frombuffer(data, np.uint8)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    kind = _KIND[a]
    at = np.flatnonzero((kind[1:-1] == _SPACE) | (kind[1:-1] == _BREAK)) + 1
    before, behind = kind[at - 1], kind[at + 1]
    ok = (_PLAIN[before] | ((before == _FAR) & (a[np.maximum(at - 2, 0)] == 0xC3) & (at >= 2))) & (_PLAIN[behind] | (a[at + 1] == 0xC3))
    at = at[ok]
    if special:
        return at[kind[at] == _SPACE]
    breaks = at[kind[at] == _BREAK]
    inner = _CUT[kind[:-1], kind[1:]] & ~((a[:-1] == 0x27) & (kind[1:] == _LETTER))
    mark = np.zeros(len(a), np.bool_)
    mark[1:] = inner
    mark[at] = True
    mark[breaks + 1] = True
    return np.flatnonzero(mark)


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of a text."""
    buffer = data + b"\0" * 8
    words = np.ndarray((len(data) + 1,), "<u8", buffer, 0, (1,))
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.arange(len(starts))
    for k in range(0, _LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        w = words[starts[live] + k] & _MASKS[np.minimum(size[live] - k, 8)]
        x = (h[live] ^ w) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        h[live] = x * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(k + 1)
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h ^ (h >> np.uint64(29))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of each run, one run after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def tokenizer(path: str):
    """The tokenizer of a file, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.model._resize_cache(0)  # pieces are told apart before they are encoded
    return t


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Ids of pieces: each distinct one (told apart by a 64-bit hash) goes through the tokenizer once. Starts anew beyond `most` pieces."""

    def __init__(self, path: str, most: int = 2_500_000):
        self.tokenizer, self.most = tokenizer(path), most
        self.encoded = 0
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Piece 0 has no ids and stands for nothing; `known` has the hash of each piece by its number.
        self.slots, self.known = np.zeros(int(_SLOT_MASK) + 1, np.int32), np.zeros(1, np.uint64)
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if len(self.keys) > self.most:
            self._forget()
        joined = b"".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        first = ends - lengths
        if b"<|" in joined or not joined:
            places = [cuts(t, b"<|" in t) + f for t, f in zip(texts, first.tolist(), strict=True)]
            inner = np.concatenate(places) if places else np.zeros(0, np.int64)
        else:
            inner = cuts(joined, False)
            inner = self._inside(inner, first, ends)
        # A text's own edges are cuts; an empty text has no piece.
        some = lengths > 0
        starts = np.sort(np.concatenate((inner, first[some])))
        stops = np.concatenate((starts[1:], [len(joined)]))
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        index = self._index(joined, starts, stops)
        sizes = self.sizes[index]
        ids = self.flat[spread(self.starts[index], sizes)]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        # pieces that begin before the end of each text
        until = upto[np.searchsorted(starts, ends, side="left")]
        return np.split(ids, until[:-1])

    @staticmethod
    def _inside(inner: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cuts of joined texts that each text alone would have: those that bytes of a neighbour decide are dropped, as are the edges themselves."""
        text = np.searchsorted(ends, inner, side="right")
        text = np.minimum(text, len(ends) - 1)
        return inner[(inner - first[text] >= 2) & (ends[text] - inner >= 2)]

    def _index(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        h = hashes(data, starts, stops)
        index = self.slots[h & _SLOT_MASK]
        missed = np.flatnonzero(self.known[index] != h)
        if len(missed):
            index[missed] = self._search(data, h[missed], starts[missed], stops[missed])
        return index

    def _search(self, data: bytes, h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Numbers of pieces that aren't in their slot: new ones, and those that lost it to another."""
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            first = where[new]
            self._learn([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)])
            own = np.arange(len(self.known), len(self.known) + len(new))
            self.known = np.concatenate((self.known, keys[new]))
            self.keys, self.at = np.insert(self.keys, at[new], keys[new]), np.insert(self.at, at[new], own)
            at = np.searchsorted(self.keys, keys)
        number = self.at[at]
        self.slots[keys & _SLOT_MASK] = number
        return number[back]

    def _learn(self, new: list[str]) -> None:
        ids: list[int] = []
        counts: list[int] = []
        for k in range(0, len(new), 2048):
            for own in map(attrgetter("ids"), self.tokenizer.encode_batch_fast(new[k : k + 2048], add_special_tokens=False)):
                ids += own
                counts.append(len(own))
        self.encoded += len(new)
        sizes = np.array(counts, np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.array(ids, np.int32)))
