"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import (
    bpe, credentials, filter_audit, html_layout, language, line_runs, mixing, pii, quality_cascade, signatures, token_counts, variants, vector_graph,
)
from shelfwise.llm.frames import documents

WORD_BPE = "word_bpe_49k.json"


def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge(documents(spark, sf_dir))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), WORD_BPE)


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(documents(spark, sf_dir))


def op7_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.near_duplicates(documents(spark, sf_dir), words=4)


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digest(documents(spark, sf_dir), WORD_BPE)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_secrets(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: function for name, function in list(globals().items()) if name.startswith("op") and callable(function)
}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.MIX_SQL,
    "op3_quality_cascade": quality_cascade.QUALITY_SQL,
    "op6_line_runs": line_runs.LINES_SQL,
    "op11_spelling_variants": variants.VARIANTS_SQL,
    "op12_filter_audit": filter_audit.AUDIT_SQL,
}
