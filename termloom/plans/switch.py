"""Choosing an embedding and a clustering by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import clusters as C
from termloom.operators import cooccur as O
from termloom.sources.scratch import written


def supplied_vectors(terms: DataFrame, units: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term, v): vectors given by a provider, as (term, v)."""
    return terms.join(vectors, "term")


def cooccurrence_vectors(terms: DataFrame, units: DataFrame, dims: list[str]) -> DataFrame:
    """(term, v): mean co-occurrence rows over the stated dimensions, 0 where a word never occurs."""
    sparse = O.mean_vectors(terms, O.cooccurrence(units))
    wide = sparse.where(F.col("dim").isin(dims)).groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))
    return wide.select("term", F.array(*[F.coalesce(F.col("m")[d], F.lit(0.0)) for d in dims]).alias("v"))


EMBEDDINGS: dict[str, Callable[..., DataFrame]] = {"co-occurrence": cooccurrence_vectors, "supplied": supplied_vectors}


def _hierarchical(vectors: DataFrame, threshold: float = 0.115) -> DataFrame:
    one = C.hierarchical(vectors.withColumn("layer", F.lit(0)), "layer", "term", "v", threshold)
    return one.select(F.col("cluster").cast("string").alias("cluster"), "term")


def _c_means(vectors: DataFrame, k: int = 8) -> DataFrame:
    return C.fuzzy_c_means(vectors, "term", "v", k).select(F.col("cluster").cast("string").alias("cluster"), F.col("id").alias("term"))


ALGORITHMS: dict[str, Callable[..., DataFrame]] = {"hierarchical": _hierarchical, "c-means": _c_means}


def cluster(terms: DataFrame, units: DataFrame, algorithm: str, embedding: str, embedding_options: dict, **options) -> DataFrame:
    """(cluster, term) after post-processing; the vectors are computed once, kept as a table and read from it."""
    vectors = written(EMBEDDINGS[embedding](terms, units, **embedding_options), "vectors")
    return C.postprocessed(ALGORITHMS[algorithm](vectors, **options))
