"""Queries over the whole tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import bpe_automaton, chat_format, decontam, fim, itq_dedup, langid, license_scan, line_dedup, ngram_join, spelling, substring_dedup, token_orc, toxicity


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": _over("embeddings", itq_dedup.op1_embedding_dedup),
    "op2_substring_dedup": _over("documents", substring_dedup.op2_substring_dedup),
    "op3_bpe_automaton": _over("documents", bpe_automaton.op3_bpe),
    "op4_token_orc": _over("documents", token_orc.op4_token_orc),
    "op5_chat_format": _over("conversations", chat_format.op5_chat_format),
    "op6_line_dedup": _over("documents", line_dedup.op6_line_dedup),
    "op7_decontamination": lambda spark, sf_dir: decontam.op7_decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op8_license_scan": _over("documents", license_scan.op8_license_scan),
    "op9_ngram_join": _over("documents", ngram_join.op9_ngram_join),
    "op10_language_id": _over("documents", langid.op10_language_id),
    "op11_toxicity": lambda spark, sf_dir: toxicity.op11_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op12_spelling_variants": _over("documents", spelling.op12_spelling_variants),
    "op13_fill_in_middle": _over("documents", fim.op13_fill_in_middle),
}

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": itq_dedup.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op5_chat_format": chat_format.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_decontamination": decontam.OP7_SQL,
    "op8_license_scan": license_scan.OP8_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
