"""Term counts over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import main_tokens, mask_digits


def running_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, abs_freq) for complete output mode."""
    return stream.select(F.explode(main_tokens(mask_digits(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("abs_freq"))


def windowed_counts(stream: DataFrame, time_col: str, key_col: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, key, n) with a watermark, for append output mode."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width), key_col).agg(F.count("*").alias("n"))
