"""The pipeline against a brute-force version, and the queries against their SQL."""

import glob
import hashlib
import os
import sys

import duckdb
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline  # noqa: E402
from termloom.llm import langid  # noqa: E402
from termloom.llm.queries import ORACLES, QUERIES  # noqa: E402
from test_dedup import brute_join, lower  # noqa: E402
from test_text_ops import brute_hits  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    table = lambda df: sorted(repr([None if pd.isna(v) is True else int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in df[cols].astype(object).values.tolist())
    assert table(got) == table(want)


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_against_brute_force(spark):
    from collections import defaultdict

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}

    rejected = {r.doc_id for r in langid.identify(docs, langid.fit(docs)).where("rejected").select("doc_id").collect()}
    data = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    holders = defaultdict(set)
    key = lambda l: lower(l.strip(" \t\n\x0b\x0c\r"))
    for d, t in data:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    often = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    data = [(d, "\n".join(x for x in t.split("\n") if often.get(key(x), d) == d)) for d, t in data]
    first = {c for _, _, c in brute_join(data)}
    data = [(d, t) for d, t in data if d in first]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_hits(data, bench) if not r[5]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in data if d in clean}
    assert got.keys() == want.keys() and len(want) < docs.count()
    for d, ids in want.items():
        assert got[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_on_odd_rows(spark, documents, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an empty table: each stage keeps its columns."""
    cols = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, ids string"
    rows = [(r.doc_id, r.text, r.lang, None if i % 3 else "s", None if i % 4 else 1, 7, "x") for i, r in enumerate(documents.collect())]
    for name, data in (("odd", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, cols).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "kopf 1"), (2, "")] if data else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs, before = spark.read.parquet(f"{folder}/documents.parquet"), len(data)
        for stage, function in corpus_pipeline.STAGES:
            out = function(spark, docs, folder)
            out.write.parquet(f"{folder}/{stage}")
            docs = spark.read.parquet(f"{folder}/{stage}")
            assert docs.count() <= before
            before = docs.count()
            if stage != "bpe":
                assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.where("n_tokens <> size(ids)").count() == 0
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert (len(ids) > 3 and ids.count(0) <= 1) if data else not ids
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect())


def test_small_measures_all_types(spark):
    from termloom.llm._store import small

    df = spark.range(100).selectExpr("id", "repeat('x', 10) AS s", "array('ab', 'c') AS a", "map('k', 1) AS m", "cast('yy' AS binary) AS b", "named_struct('n', sequence(1, 50)) AS t")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString()
    assert hinted(small(df)) and not hinted(small(df, rows=99))
    assert hinted(small(df.select("t"), most=100 * 600)) and not hinted(small(df.select("t"), most=100 * 300))
    assert not hinted(small(df.select("a"), most=100 * 8)) and not hinted(small(df.select("b"), most=150))
