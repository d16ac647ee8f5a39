"""Language identification by compression with one zstandard raw-content dictionary for each language.

A text is compressed in blocks with every language's dictionary; the language with the smallest sum wins. Long texts
would soon be compressed by their own past instead of the dictionary, hence the blocks. A prediction with a narrow
margin to the second smallest sum is rejected (column `rejected`); it still names the best language.

Fitting reads all labelled rows that are given: a hash picks pieces of 512 bytes, at a rate per language that yields
about `DICT_BYTES` distinct ones. That bound is the only one; what is broadcast is at most `MOST_LANGS` dictionaries.

Scale: two scans for fitting (bytes by language; the picked pieces), one to predict, no shuffle of texts.

Defined results: null text or one without a letter is `und` with score 0; equal sums go to the language that sorts
first; rows without a language teach nothing; with no language to learn everything is `und`; an empty table stays
empty; repeated rows are predicted one by one; columns of any name are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import ROW, carried, crc_of
from reelquery.llm.pieces import valid

#: Bytes of one dictionary; bytes of a piece; bytes of a compressed block; most languages; compression level.
DICT_BYTES, PIECE, BLOCK, MOST_LANGS, LEVEL = 96 << 10, 512, 4096, 400, 3
#: A margin below this share of the second smallest sum is narrow.
NARROW = 0.005
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(data: bytes | None) -> bytes:
    """Lower-cased text of which ASCII other than letters has become single spaces."""
    return b" ".join(valid(data).decode().lower().encode().translate(_LETTERS).split())


def has_letter(data: bytes) -> bool:
    return any(97 <= c <= 122 for c in data) if data.isascii() else any(c.isalpha() for c in data.decode())


def _pieces(rates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, data in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
                limit = rates.value[lang]
                text = letters(data)
                for at in range(0, len(text), PIECE):
                    piece = text[at : at + PIECE]
                    if xxhash.xxh3_64_intdigest(piece) < limit:
                        langs.append(lang)
                        out.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "piece"])

    return run


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) in order of language."""
    rows = labelled.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    sums = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(sums) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    full = (1 << 64) - 1
    rates = {r["lang"]: min(full, int(full * min(1.0, 1.3 * DICT_BYTES / r["n"]))) for r in sums}
    if not rates:
        return []
    picked = rows.mapInArrow(_pieces(labelled.sparkSession.sparkContext.broadcast(rates)), "lang string, piece binary").distinct().collect()
    found: dict[str, list[bytes]] = {}
    for r in picked:
        found.setdefault(r["lang"], []).append(bytes(r["piece"]))
    out = []
    for name in sorted(found):
        own = sorted(found[name], key=xxhash.xxh3_64_intdigest)
        data = b" ".join(own)[-DICT_BYTES:]
        if len(data) >= 8:
            out.append((name, data))
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for name, data in shared.value:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
        for batch in batches:
            pred, score, narrow = [], [], []
            for data in (x.as_py() for x in batch.column(1)):
                p, s, n = _one(tools, letters(data))
                pred.append(p)
                score.append(s)
                narrow.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())], names=[ROW, "lang_pred", "score", "rejected"])

    return run


def _one(tools: list, text: bytes) -> tuple[str, float, bool]:
    if not tools or not text or not has_letter(text):
        return "und", 0.0, True
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    sizes = sorted((sum(len(tool.compress(b)) for b in blocks), k) for k, (_, tool) in enumerate(tools))
    best = sizes[0]
    if len(sizes) == 1:
        return tools[best[1]][0], 1.0, False
    margin = (sizes[1][0] - best[0]) / sizes[1][0]
    return tools[best[1]][0], 1 - math.exp(-40 * margin), margin < NARROW


def predict(docs: DataFrame, model: list[tuple[str, bytes]], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document `__row` (struct of the kept columns), lang_pred, score (0 to 1, grows with the margin) and rejected."""
    rows = carried(docs, text, docs.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), f"{ROW} {rows.schema[ROW].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    held = F.pmod(crc_of("doc_id"), F.lit(3)) == 1
    model = fit(docs.where(~F.coalesce(held, F.lit(False))))
    return predict(docs, model, keep=["doc_id"]).select(
        F.col(f"{ROW}.doc_id").alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(F.col(f"{ROW}.doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )
