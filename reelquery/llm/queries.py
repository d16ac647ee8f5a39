"""The queries of this subpackage: `queries()` and, where SQL can express them, `oracle_sql()`.

Each `opN_<name>` applies its operator with production parameters to the whole table. SQL is given for 2, 5, 10, 11 and 12 (see
`sql`); the rest are models, file formats, tokenizers and eigenvectors, or add spans that follow from corpus statistics (1, 6).
tests/llm holds every query against SQL, a brute-force version, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelquery.llm import bpe, decontam, langid, licenses, minhash, pii, quality, retention, sentences, sql, tokenfile, toxicity, vectors, whitening
from reelquery.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op1(spark, table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op2(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op3(spark, table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op4(spark, table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op5(spark, table(spark, sf_dir, "documents"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.op6(spark, table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op7(spark, table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op8(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.op10(spark, table(spark, sf_dir, "embeddings"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op11(table(spark, sf_dir, "documents"))


def op12_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.op12(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pii, op2_decontaminate, op3_language, op4_token_files, op5_minhash, op6_sentence_spans, op7_bpe, op8_licenses, op9_toxicity, op10_vectors, op11_quality, op12_retention, op13_whitening]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": sql.OP2, "op5_minhash": sql.OP5, "op10_vectors": sql.OP10, "op11_quality": sql.OP11, "op12_retention": sql.OP12}
