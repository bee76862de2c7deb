"""Queries that split compounds by letters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import compounds as D
from termloom.operators import tokens as K
from termloom.plans.queries import TOK, query, reqs
from termloom.sources.scratch import written

GRAMS = f"""vocabulary AS MATERIALIZED (SELECT DISTINCT lower(term) AS w FROM ({TOK}) WHERE length(term) >= {D.SHORTEST}),
grams AS MATERIALIZED (SELECT substr(w, p, n) AS gram, count(*) AS total, CAST(sum(CASE WHEN p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS begins, CAST(sum(CASE WHEN p + n - 1 = length(w) THEN 1 ELSE 0 END) AS BIGINT) AS ends
  FROM (SELECT w, p, unnest(range({D.SHORTEST}, least({D.LONGEST}, length(w) - p + 1) + 1)) AS n FROM (SELECT w, unnest(range(1, length(w) - {D.SHORTEST} + 2)) AS p FROM vocabulary)) GROUP BY 1)"""
CUTS = f"""word AS MATERIALIZED (SELECT DISTINCT term AS word FROM ({TOK}) WHERE length(term) >= {D.LONG}),
cut AS (SELECT word, lower(word) AS w, k, unnest(range({D.SHORTEST}, {D.LONGEST + 1})) AS n FROM (SELECT word, unnest(range({D.PART}, length(word) - {D.PART} + 1)) AS k FROM word)),
asked AS (SELECT word, k, n, true AS after, substr(w, k + 1, n) AS gram FROM cut WHERE k + n <= length(w) UNION ALL SELECT word, k, n, false, substr(w, k - n + 1, n) FROM cut WHERE n <= k),
side AS (SELECT word, k, after, arg_max(begins / CAST(total - 1 AS DOUBLE), n) AS begins, arg_max(ends / CAST(total - 1 AS DOUBLE), n) AS ends FROM asked JOIN grams USING (gram) WHERE total > 1 GROUP BY 1, 2, 3),
scored AS MATERIALIZED (SELECT word, k, round(coalesce(max(2 * begins - 1) FILTER (WHERE after), {D.NO_START}) + coalesce(max(ends) FILTER (WHERE NOT after), {D.NO_END}), 9) + 0.0 AS score FROM side GROUP BY 1, 2),
best AS (SELECT word, k, score FROM scored QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, k) = 1)"""
_BARE = "CASE WHEN ends_with({0}, 's') AND NOT regexp_matches({0}, '^\\p{{Lu}}.*\\p{{Lu}}') THEN left({0}, length({0}) - 1) ELSE {0} END"


@query("letter_ngrams", f"WITH {GRAMS} SELECT * FROM grams")
def _(t):
    return D.gram_table(K.candidates(reqs(t)).select(F.col("term").alias("word")))


@query("compound_cuts", f"WITH {GRAMS}, {CUTS} SELECT word, CAST(k AS INTEGER) AS k, score FROM scored")
def _(t):
    words = written(K.candidates(reqs(t)).select(F.col("term").alias("word")).distinct(), "vocabulary")
    return D.scored_cuts(words, D.gram_table(words))


@query("compound_split_scored", f"""WITH {GRAMS}, {CUTS}, p AS (SELECT word, score, left(word, k) AS head, substr(word, k + 1) AS tail FROM word LEFT JOIN best USING (word))
SELECT word, score, CASE WHEN score IS NULL OR score < {D.KEEP} THEN word WHEN score = {D.NONE} THEN head ELSE {_BARE.format("head")} || ' ' || {_BARE.format("tail")} END AS parts FROM p""")
def _(t):
    words = written(K.candidates(reqs(t)).select(F.col("term").alias("word")).distinct(), "vocabulary")
    return D.split_once(words, D.gram_table(words)).select("word", "score", F.array_join("parts", " ").alias("parts"))


@query("compound_split_wholly")
def _(t):
    words = written(K.candidates(reqs(t)).select(F.col("term").alias("word")).distinct(), "vocabulary")
    return D.split_wholly(words, written(D.gram_table(words), "letter-ngrams"), "word")
