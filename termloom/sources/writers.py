"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.tokens import ordinals


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, as CSV has none."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes])


def table_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    _flat(df).write.mode("overwrite").csv(path, sep=sep, header=True)


def table_tsv(df: DataFrame, path: str) -> None:
    table_csv(df, path, "\t")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object for each row; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias(name))


def lines_to_json(lines: DataFrame, order_col: str, text_col: str) -> DataFrame:
    """(id, text): lines numbered from 1 in order, the number as a string."""
    return ordinals(lines, order_col).select(F.col("ordinal").cast("string").alias("id"), F.col(text_col).alias("text"))


def run_log(reqs: DataFrame, dataset: str, template: bool) -> DataFrame:
    """One row: data set, language of the first requirement, template flag, time."""
    from termloom.operators.tokens import corpus_language

    return corpus_language(reqs).select(F.lit(dataset).alias("dataset"), "corpus_lang", F.lit(template).alias("template"), F.current_timestamp().alias("at"))
