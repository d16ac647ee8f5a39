"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. The automaton of all items is walked
along each document; wherever the longest match that ends at a word is at least `window` words long, those last
`window` words occur in an item and are hit. An item of fewer words (but not none) must occur whole.

Scale: one pass over the documents, no shuffle. The automaton is broadcast and holds at most `BLOCK_WORDS` item
words; a larger benchmark is read in blocks, one pass for each. At most `CHAINED` passes share a stage; then what is found
so far is written to the shared folder and the next stage reads it. So neither what is broadcast at once nor what a task
holds (about `CHAINED` times 50 MB) grows with the benchmark.

Defined results: null or wordless text has no words and no hits; repeated documents are judged row by row; items that
share an id count as one; an item with a null id is named "null"; wordless items are ignored; empty tables give empty
or unhit results; columns of any name are carried along untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import ROW, carried, cut
from reelquery.llm.words import ALNUM, alnum_words

#: Most item words in one automaton: about 2 states and 0.5 KB a word, so at most some 50 MB.
BLOCK_WORDS = 100_000
#: Most passes in one stage, each with its own automaton in a worker.
CHAINED = 6
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Suffix automaton over several sequences of words."""

    def __init__(self, window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[tuple[str, list[int]]] = []
        self.words = 0

    def add(self, item_id: str, words: list[bytes]) -> None:
        ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
        self.items.append((item_id, ids))
        self.words += len(ids)
        last = 0
        for c in ids:
            last = self._extend(last, c)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # the word continues an earlier item
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def finish(self) -> None:
        """What a walk looks up: the state of the last `window` words, whose items they are, whole short items, word pairs."""
        n, w = len(self.next), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.anchor = [-1] * n
        for v in order:
            if self.length[v] >= w:
                self.anchor[v] = v if self.length[self.link[v]] < w else self.anchor[self.link[v]]
        self.owners: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.least = w
        pairs = set()
        for item_id, ids in self.items:
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if i + 1 >= w:
                    self.owners.setdefault(self.anchor[v], set()).add(item_id)
            if 0 < len(ids) < w:
                self.whole.setdefault(v, []).append((len(ids), item_id))
                self.least = min(self.least, len(ids))
            pairs.update(zip(ids, ids[1:], strict=False))
        self.short = [-1] * n  # the nearest state along the suffix links at which a whole short item ends
        for v in order:
            self.short[v] = v if v in self.whole else self.short[self.link[v]]
        bits = 16
        while (1 << bits) < 32 * len(pairs):
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.pairs = np.zeros(1 << bits, np.bool_)
        if pairs:
            a = np.array(sorted(pairs), np.uint64)
            self.pairs[self._slot(a[:, 0], a[:, 1])] = True
        self.items = []

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words that may match: every two neighbours in them are neighbours in some item (up to hash collisions)."""
        if len(ids) < self.least:
            return
        known = ids >= 0
        if self.least == 1:
            edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
            yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
            return
        both = np.flatnonzero(known[1:] & known[:-1])
        if len(both) + 1 < self.least:
            return
        u = ids.astype(np.uint64)
        both = both[self.pairs[self._slot(u[both], u[both + 1])]]
        if len(both) + 1 < self.least:
            return
        cuts = np.flatnonzero(np.diff(both) != 1)
        first = both[np.concatenate(([0], cuts + 1))]
        last = both[np.concatenate((cuts, [len(both) - 1]))] + 2
        long = last - first >= self.least
        yield from zip(first[long].tolist(), last[long].tolist(), strict=True)

    def walk(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit spans of words [start, end), merged and ascending, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        spans: list[list[int]] = []
        found: set[str] = set()
        move, link, length, anchor, short, w = self.next, self.link, self.length, self.anchor, self.short, self.window
        for a, b in self.stretches(ids):
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in move[v]:
                    v = link[v]
                    n = length[v]
                if c in move[v]:
                    v = move[v][c]
                    n += 1
                else:
                    n = 0
                start = i + 1
                if n >= w:
                    found |= self.owners[anchor[v]]
                    start = i + 1 - w
                s = short[v]
                while s > 0:
                    for m, item_id in self.whole[s]:
                        if m <= n:
                            found.add(item_id)
                            start = min(start, i + 1 - m)
                    s = short[link[s]]
                if start <= i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, found


def automata(items: DataFrame, item_id: str, text: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of at most about `block_words` words; the items stream to the driver, one block is held at a time."""
    block = Automaton(window)
    for row in items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")), F.col(f"`{text}`").cast("binary")).toLocalIterator():
        words = alnum_words(bytes(row[1])) if row[1] else []
        if not words:
            continue
        # An item beyond the bound is cut into overlapping parts, which have the same windows.
        step = max(block_words, 2 * window)
        for at in range(0, max(1, len(words) - window + 1), step - window + 1):
            part = words[at : at + step]
            if block.words and block.words + len(part) > block_words:
                block.finish()
                yield block
                block = Automaton(window)
            block.add(row[0], part)
    block.finish()
    yield block


def _scan(shared, last: bool, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: Automaton = shared.value
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out: dict[str, list] = {"n_words": [], "n_hit": [], "items": [], "spans": [], "clean": []}
            before_spans = col["spans"].to_pylist() if "spans" in col else None
            before_items = col["items"].to_pylist() if "items" in col else None
            for i, data in enumerate(x.as_py() for x in col["__text"]):
                words = alnum_words(data) if data else []
                spans, found = auto.walk(words) if len(words) >= auto.least else ([], set())
                if before_spans is not None and before_spans[i]:
                    spans = merged(spans + [list(x) for x in before_spans[i]])
                if before_items is not None:
                    found |= set(before_items[i])
                out["n_words"].append(len(words))
                out["n_hit"].append(sum(b - a for a, b in spans))
                out["items"].append(sorted(found))
                out["spans"].append(spans)
                if last and want_text:
                    out["clean"].append(without(data, spans) if spans else data)
            arrays = [col[ROW]]
            names = [ROW]
            if not last:
                arrays.append(col["__text"])
                names.append("__text")
            arrays += [pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], pa.list_(pa.list_(pa.int64())))]
            names += ["n_words", "n_hit", "items", "spans"]
            if last and want_text:
                arrays.append(pa.array(out["clean"], pa.binary()))
                names.append("clean")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without(data: bytes, spans: list[list[int]]) -> bytes:
    """The text without its hit words and what stands between them; what stays is parted by a space."""
    places = [m.span() for m in _WORD.finditer(data.translate(ALNUM))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    out.append(data[at:])
    return b" ".join(x.strip(b" ") for x in out).strip(b" ")


def scan(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, clean: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document `__row` (struct of the kept columns), n_words, n_hit, items (ids whose windows occur, as sorted strings), spans ([start, end) in words), and with `clean` the UTF-8 bytes of the text without its hit spans."""
    spark = docs.sparkSession
    out = carried(docs, text, docs.columns if keep is None else keep)
    row = out.schema[ROW].dataType.simpleString()
    blocks = automata(items, item_id, item_text, window, block_words)
    here, passes = next(blocks), 0
    while here is not None:
        if passes == CHAINED:
            out, passes = cut(out), 0
        following = next(blocks, None)
        last = following is None
        schema = f"{ROW} {row}, " + ("" if last else "__text binary, ") + "n_words bigint, n_hit bigint, items array<string>, spans array<array<bigint>>" + (", clean binary" if last and clean else "")
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(here), last, clean), schema)
        here, passes = following, passes + 1
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5, min_span: int = 10, **names) -> DataFrame:
    """The documents' columns, with text (and n_chars, if there) changed: spans of at least `min_span` hit words go, and documents of which hit words are more than `max_coverage` go whole."""
    text = names.get("text", "text")
    found = scan(docs, items, window=window, clean=True, **names)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") <= max_coverage * F.col("n_words")))
    long = F.exists("spans", lambda s: s[1] - s[0] >= min_span) | F.exists("spans", lambda s: s[1] - s[0] < window)
    new = F.when((F.col("n_hit") > 0) & long, F.col("clean").cast("string")).otherwise(F.col(f"{ROW}.`{text}`"))
    columns = [new.alias(c) if c == text else F.when(new.isNotNull() & (F.col("n_hit") > 0), F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(f"{ROW}.`{c}`")).alias(c) if c == "n_chars" else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    return kept.select(*columns)


def op2(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    found = scan(docs, items, window=10, keep=["doc_id"])
    return found.select(
        F.col(f"{ROW}.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
