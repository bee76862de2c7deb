"""Readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIREMENTS = "id string, text string"


#: Tables from the first size on, and up to the second for each core, are dealt over the cores.
SPREAD_FROM, SPREAD_EACH = 1 << 20, 32 << 20


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, its rows dealt over the cores if the files have too few parts for that."""
    return spread(spark.read.parquet(path))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table over the cores; a large one is left as its files are.

    A file is read by its row groups, so a single one of a few MB would keep one
    core busy with all the pattern work.  The size is that of the files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if SPREAD_FROM <= size < cores * SPREAD_EACH else df


def requirements_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a JSON array of objects."""
    return spark.read.schema(REQUIREMENTS).json(path, multiLine=True)


def requirements_from_json_text(df: DataFrame, col: str) -> DataFrame:
    """(id, text) of a column that holds JSON arrays, as in a request body."""
    return df.select(F.explode(F.from_json(col, f"array<struct<{REQUIREMENTS.replace(' string', ':string')}>>")).alias("x")).select("x.id", "x.text")


def lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """The lines of a text file, whole, without line ends; empty ones are left out."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias(name)).where(F.col(name) != "")


def _western() -> tuple[str, str]:
    """Characters that ISO 8859-1 and Windows 1252 read differently, and what the latter has."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs)


def table_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Columns of a CSV file with header, as strings without carriage returns."""
    western = encoding.lower() in ("windows-1252", "cp1252")
    df = spark.read.csv(path, sep=sep, header=True, encoding="ISO-8859-1" if western else encoding, quote='"', escape='"')
    clean = lambda c: F.translate(c, *_western()) if western else c
    return df.select(*[clean(F.regexp_replace(F.col(f"`{c}`"), "\r", "")).alias(c) for c in (columns or df.columns)])


def clusters_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(cluster, term) of a CSV file whose columns are clusters of unequal length."""
    from termloom.operators.evaluate import unpivoted

    return unpivoted(spark.read.csv(path, sep=sep, header=True, quote='"', escape='"'))


def dictionary_json(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """(term, value) of a JSON object."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{kind}>").alias("m"))
    return whole.select(F.explode("m").alias("term", "value"))


def statistics_json(spark: SparkSession, path: str) -> DataFrame:
    """(term, abs_freq, rel_freq) of a JSON object of number pairs."""
    return dictionary_json(spark, path, "array<double>").select("term", F.get("value", F.lit(0)).cast("long").alias("abs_freq"), F.get("value", F.lit(1)).alias("rel_freq"))


def tagger_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, lex_tag) of a tab-separated list."""
    return spark.read.csv(path, sep="\t", schema="word string, lex_tag string", quote="")


def pairs_from_text(df: DataFrame, col: str) -> DataFrame:
    """(surface, label) of lines that hold pairs written as ``('a', 'b')``; nothing is evaluated."""
    line = df.select(F.explode(F.split(col, "\n")).alias("l"))
    pattern = r"""\(\s*['"](.*?)['"]\s*,\s*['"](.*?)['"]\s*\)"""
    return line.select(F.regexp_extract("l", pattern, 1).alias("surface"), F.regexp_extract("l", pattern, 2).alias("label")).where("surface <> ''")
