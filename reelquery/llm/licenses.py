"""Licence scans by the Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. A stretch of text is compared with a
template by 2 |X and Y| / (|X| + |Y|) over their sets of word bigrams. For a coefficient of at least `dice`, the number of
a stretch's bigrams must lie between dice / (2 - dice) and (2 - dice) / dice times the template's: that prunes
templates before anything is intersected. Stretches are runs of consecutive segments (sentences and lines); only
segments that share a bigram with some template can begin or end one.

Scale: one pass, no shuffle. Templates are a parameter; the built-in ones are short notices, and what is broadcast
is bounded by `MOST_WORDS` words of templates (more raise an error).

Defined results: null, empty and wordless texts have no match; a stretch that fits several templates counts for the
one with the largest coefficient (ties: the name that sorts first), and matches don't overlap; repeated rows are
scanned one by one; columns of any name are carried along; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import ROW, carried, groups
from reelquery.llm.words import ALNUM

DICE, MOST_WORDS = 0.75, 50_000
#: Customary notices of well-known licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "This software is released under the BSD 2-Clause License.",
    "BSD-3-Clause": "This software is released under the BSD 3-Clause License.",
    "BSD-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "Copyright. All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_END = re.compile(rb"(?<=[.!?;])[\x20\t]+|[\r\n]+")


class Templates:
    """Bigram sets of the templates over a small vocabulary."""

    def __init__(self, templates: dict[str, str], dice: float):
        self.dice = dice
        self.vocab: dict[bytes, int] = {}
        self.sets: list[tuple[str, frozenset[int]]] = []
        total = 0
        split = {name: text.encode().translate(ALNUM).split() for name, text in sorted(templates.items())}
        for words in split.values():
            total += len(words)
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
        if total > MOST_WORDS:
            raise ValueError(f"templates have more than {MOST_WORDS} words")
        self.size = len(self.vocab) + 1  # the last number is any other word
        for name, words in split.items():
            ids = [self.vocab[w] for w in words]
            if len(ids) > 1:
                self.sets.append((name, frozenset(a * self.size + b for a, b in zip(ids, ids[1:], strict=False))))
        self.known = np.zeros(self.size * self.size, np.bool_)
        for _, own in self.sets:
            self.known[list(own)] = True
        self.bounds = [(len(own) * dice / (2 - dice), len(own) * (2 - dice) / dice) for _, own in self.sets]
        self.longest = max((b for _, b in self.bounds), default=0)

    def scan(self, data: bytes) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, start, end) in bytes, by start."""
        low = data.translate(ALNUM)
        words = low.split()
        if len(words) < 2 or not self.sets:
            return []
        ids = np.fromiter(map(self.vocab.get, words, repeat(self.size - 1)), np.int64, len(words))
        code = ids[:-1] * self.size + ids[1:]
        if not self.known[code].any():
            return []
        return self._matches(data, low)

    def _matches(self, data: bytes, low: bytes) -> list[tuple[str, float, int, int]]:
        cuts = [0, *(m.end() for m in _END.finditer(data)), len(data)]
        segments = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            words = low[a:b].split()
            if words:
                segments.append((a, b, [self.vocab.get(w, self.size - 1) for w in words]))
        hit = [any(self.known[x * self.size + y] for x, y in zip(w, w[1:], strict=False)) for _, _, w in segments]
        found: list[tuple[float, str, int, int]] = []
        for i, starts in enumerate(hit):
            if not starts:
                continue
            grams: set[object] = set()
            before = None
            for j in range(i, len(segments)):
                a, b, w = segments[j]
                for k, y in enumerate(w):
                    if before is not None:
                        known = before < self.size - 1 and y < self.size - 1
                        grams.add(before * self.size + y if known else (j, k))  # bigrams with an unknown word are in no template
                    before = y
                if len(grams) > self.longest:
                    break
                if not hit[j]:
                    continue
                for (name, own), (least, most) in zip(self.sets, self.bounds, strict=True):
                    if least <= len(grams) <= most:
                        d = 2 * len(own & grams) / (len(own) + len(grams))
                        if d >= self.dice:
                            found.append((-d, name, segments[i][0], b))
        out: list[tuple[str, float, int, int]] = []
        for d, name, a, b in sorted(found):
            if all(b <= x or y <= a for _, _, x, y in out):
                out.append((name, -d, a, b))
        return sorted(out, key=lambda m: m[2])


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: Templates = shared.value
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            for i, j in groups(texts):
                rows = []
                for data in texts[i:j]:
                    own = templates.scan(data) if data else []
                    rows.append([{"license": n, "dice": d, "start": len(data[:a].decode("utf-8", "replace")), "end": len(data[:b].decode("utf-8", "replace").rstrip())} for n, d, a, b in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, kind)], names=[ROW, "matches"])

    return run


def scan(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None, dice: float = DICE, keep: list[str] | None = None) -> DataFrame:
    """Per document `__row` (struct of the kept columns) and matches: license, dice, start and end in code points."""
    rows = carried(docs, text, docs.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, dice))
    return rows.mapInArrow(_run(shared), f"{ROW} {rows.schema[ROW].dataType.simpleString()}, matches array<struct<license:string,dice:double,start:bigint,end:bigint>>")


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (names, sorted and distinct), best (largest coefficient, 0 if none), spans (license:start:end)."""
    found = scan(docs, keep=["doc_id"])
    return found.select(
        F.col(f"{ROW}.doc_id").alias("doc_id"),
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)).alias("best"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("spans"),
    )
