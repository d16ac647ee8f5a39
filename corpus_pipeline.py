"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

1. toxicity: documents that the class-conditional Kneser-Ney models call toxic (score of 0.5 or more) go; what only
   ordinary text holds speaks against it.
2. near_duplicates: of each group of near-duplicates (5-word shingles, Jaccard 0.8) the smallest id stays.
3. decontaminate: spans of 10 or more words of a benchmark item are cut out; documents that are more than half
   benchmark go.
4. pii: e-mail, IP, card and phone numbers become their kind; terms that disclose them are generalised or removed.
5. bpe: each text becomes token ids; the last stage returns doc_id, n_tokens, ids and the decoded text's digest.

All but the last return the columns of documents. Null and empty texts go through every stage (no evidence of
toxicity, no shingles, no words, no spans, no ids). SQL can't express the stages, so ORACLE_SQL is None; tests/llm
compares the pipeline with a brute-force version stage by stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm import bpe, decontam, minhash, pii, toxicity
from reelquery.llm.common import ROW, new_path, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitize(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    want = ("n_tokens", "ids", "decoded_sha256")
    return bpe.encode(docs, keep=["doc_id"], want=want).select(F.col(f"{ROW}.doc_id").alias("doc_id"), *want)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what stands between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
