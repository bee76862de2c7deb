import pytest
from pyspark.sql import functions as F

from termloom.functions import lexicon as L
from termloom.plans import switch


@pytest.mark.parametrize(("algorithm", "options"), [("hierarchical", {"threshold": 0.2}), ("c-means", {"k": 2})])
def test_terms_of_one_context_fall_together(spark, algorithm, options):
    units = spark.createDataFrame([(i, w) for i in range(6) for w in (["pump", "motor", "oil"] if i % 2 else ["page", "text", "font"])], "unit int, word string")
    terms = spark.createDataFrame([("pump",), ("motor",), ("page",), ("font",)], "term string")
    dims = ["pump", "motor", "oil", "page", "text", "font"]
    got = switch.cluster(terms, units, algorithm, "co-occurrence", {"dims": dims}, **options).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.term)
    assert sorted(map(sorted, groups.values())) == [["font", "page"], ["motor", "pump"]]


def test_supplied_vectors(spark):
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "term string, v array<double>")
    assert switch.cluster(terms, None, "hierarchical", "supplied", {"vectors": vectors}).count() == 2


def test_phrase_lemmas(spark):
    df = spark.createDataFrame([("die Links Pumpen",)], "c string")
    got = df.select(L.lemma_phrase(F.col("c")).alias("a"), L.lemma_phrase(F.col("c"), "last").alias("b"), L.lemma_phrase(F.col("c"), "determiners").alias("d")).first()
    assert tuple(got) == ("die link pumpen", "die Links pumpen", "die link pumpen")
