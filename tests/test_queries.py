"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

from termloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def table(df, cols):
    return sorted(repr([None if v != v else v for v in r]) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert table(got, cols) == table(want, cols)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_frequency_rank_has_all_terms(spark):
    every = QUERIES["frequency_rank"](spark, DATA).collect()
    assert len(every) == QUERIES["alphabetical_rank"](spark, DATA).count() > 100
    assert sorted(r.frequency_order for r in every) == list(range(len(every)))
    ordered = [(r.term, r.abs_freq, r.words) for r in sorted(every, key=lambda r: r.frequency_order)]
    assert ordered == [(r.term, r.abs_freq, r.words) for r in QUERIES["frequency_order"](spark, DATA).collect()]


def _plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tfidf_mean", "document_frequency"])
def test_pairs_of_texts_and_terms_are_counted_in_place(spark, name):
    """Texts are moved, not their pairs with terms."""
    assert not re.search(r"hashpartitioning\((req_no#\d+L?, term#\d+|term#\d+, req_no#\d+L?)", _plan(spark, name))


@pytest.mark.parametrize("name", ["chunk_terms", "candidate_branches", "ngram_tfidf", "chunk_lines", "coordinated_phrases", "sentence_trees", "chunk_brackets"])
def test_tokens_are_not_gathered_in_sentences(spark, name):
    """Chunks and runs of words are made inside the row of a text; no token is moved for that."""
    plan = _plan(spark, name)
    assert "collect_list" not in plan and "left_anti" not in plan.lower().replace("leftanti", "left_anti")


def test_first_words_are_not_cut_for_each_ending(spark):
    assert _plan(spark, "adposition_terms").count("split_part") == 0


def test_article_strip_moves_no_tokens(spark):
    assert "collect_list" not in _plan(spark, "article_strip")


def test_annotators_of_arrays(spark):
    """Arrays of tokens are compared as rows of tokens are; a gap between places parts a chunk."""
    from pyspark.sql import functions as F
    from termloom.functions import lexicon as L
    from termloom.operators import evaluate as E

    words = [(1, 0, "Haus"), (1, 1, "system"), (1, 3, "Nation"), (2, 0, "der"), (2, 1, "Baum"), (2, 2, "x")]
    flat = spark.createDataFrame(words, "req_no int, pos int, term string")
    kinds = "req_no int, items array<struct<pos:int,term:string>>"
    packed = spark.createDataFrame([(i, [w[1:] for w in words if w[0] == i]) for i in (1, 2)] + [(3, [])], kinds)
    tools = {"capital": {"pos": L.capital_tag, "lemma": F.lower}, "lexicon": {"pos": L.pos_tag, "lemma": L.lemma}}
    score = lambda df: sorted(map(tuple, E.compare_annotators(df, tools, tools["lexicon"], {"pos": ["NOUN"], "lemma": None, "chunk": None}).collect()))
    got = score(packed)
    assert got == score(flat) and len(got) == 6
    same = next(r for r in got if r[:2] == ("lexicon", "chunk"))
    assert same[2] >= 1 and same[3:5] == (0, 0)
