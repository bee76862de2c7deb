"""A training-corpus pipeline: filter by language, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the ``docs`` of the next.  All but the last return
the columns of ``documents``; other columns are left out.

Defined cases: a document with a null or empty text, or one without a letter, has
no language and goes in the first stage.  Null ids are kept: such rows never
share an id, but near copies among them are reduced to one like any others.  Of
repeated rows one stays.  A null in another column changes nothing.  An empty
table gives an empty table in every stage; without benchmark items none goes as
contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe_automaton, decontam, langid, line_dedup, ngram_join
from termloom.llm._store import forget, give_back, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected or undetermined."""
    give_back(spark)
    return langid.identify(docs, langid.fit(docs)).where(~F.col("rejected")).select(COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines inside the texts; every document stays."""
    give_back(spark)
    out = line_dedup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each class of near copies."""
    give_back(spark)
    return ngram_join.keep_one_of_each(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a benchmark item."""
    give_back(spark)
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts and decode the ids."""
    give_back(spark)
    out = bpe_automaton.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_text=False, digest=True, with_decoded=False)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Language identification and BPE have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
