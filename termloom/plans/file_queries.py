"""Queries that write a file format and read it back: every reader and writer over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import evaluate as E
from termloom.operators import stats as S
from termloom.operators import tokens as K
from termloom.plans.queries import LANG, TOK, W, domain, general, query, reqs, tok
from termloom.sources import readers, writers
from termloom.sources.scratch import folder


def _path(df, name: str) -> str:
    return f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


_LINES = r"SELECT unnest(regexp_split_to_array(text, '\n')) AS line FROM documents"


@query("lines_file", f"SELECT line, count(*) AS n FROM (SELECT regexp_replace(line, '\\r$', '') AS line FROM ({_LINES})) WHERE line <> '' GROUP BY line")
def _(t):
    df = t("documents").where("text is not null").select("text")
    path = _path(df, "lines")
    df.write.text(path)
    return readers.lines(df.sparkSession, path).groupBy("line").agg(F.count("*").alias("n"))


@query("requirements_file", "SELECT CAST(item_id AS VARCHAR) AS id, text FROM benchmark")
def _(t):
    one = t("benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    path = _path(one, "requirements")
    # One array for each file, as a request body has it.
    one.agg(F.to_json(F.collect_list(F.struct("id", "text"))).alias("body")).write.text(path)
    return readers.requirements_json(one.sparkSession, path)


@query("semicolon_file", "SELECT p_partkey, p_name, p_brand FROM part")
def _(t):
    df = t("part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_brand", "p_type")
    path = _path(df, "semicolon")
    writers.table_csv(df, path, ";")
    out = readers.table_csv(df.sparkSession, path, ["p_partkey", "p_name", "p_brand"])
    return out.withColumn("p_partkey", F.col("p_partkey").cast("long"))


_LETTERS = r"regexp_replace(text, '[^\p{L} ]+', ' ', 'g')"


@query("western_file", f"SELECT item_id, {_LETTERS} AS text FROM benchmark WHERE NOT regexp_matches(text, '[^\\x00-\\x7FÀ-ÿ]')")
def _(t):
    df = t("benchmark").where(~F.col("text").rlike(r"[^\x00-\x7FÀ-ÿ]")).select(F.col("item_id").cast("string").alias("item_id"), F.regexp_replace("text", r"[^\p{L} ]+", " ").alias("text"))
    path = _path(df, "western")
    df.write.csv(path, sep=";", header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.table_csv(df.sparkSession, path, ["item_id", "text"], encoding="windows-1252").withColumn("item_id", F.col("item_id").cast("long"))


@query("tab_file", f"SELECT term, count(*) AS abs_freq, string_agg(DISTINCT CAST(req_no AS VARCHAR), '; ' ORDER BY CAST(req_no AS VARCHAR)) AS req_ids FROM ({tok('benchmark', 'item_id')}) GROUP BY term")
def _(t):
    found = K.candidates(general(t))
    df = found.groupBy("term").agg(F.count("*").alias("abs_freq"), F.array_sort(F.collect_set(F.col("req_no").cast("string"))).alias("req_ids"))
    path = _path(df, "tab")
    writers.table_tsv(df, path)
    return df.sparkSession.read.csv(path, sep="\t", header=True, schema="term string, abs_freq long, req_ids string")


@query("dictionary_file", f"SELECT term, min(req_no) AS value FROM ({tok('conversations', 'role')}) GROUP BY term")
def _(t):
    turn = t("conversations").select(F.col("role").alias("req_no"), "text")
    df = K.candidates(turn).groupBy("term").agg(F.min("req_no").alias("value"))
    path = _path(df, "dictionary")
    # Parts of the dictionary, one object for each.
    part = df.groupBy(F.pmod(F.xxhash64("term"), F.lit(16))).agg(F.map_from_entries(F.collect_list(F.struct("term", "value"))).alias("m"))
    part.select(F.to_json("m")).repartition(16).write.option("lineSep", " ").text(path)
    whole = df.sparkSession.read.text(path, wholetext=True).select(F.explode(F.split(F.trim("value"), r"(?<=\}) (?=\{)")).alias("o"))
    return whole.select(F.explode(F.from_json("o", "map<string,string>")).alias("term", "value"))


@query("statistics_file", f"SELECT term, count(*) AS abs_freq, round(count(*) / (SELECT CAST(sum(len(regexp_extract_all(text, '[{W}]+[-\\\\.]?[{W}]+'))) AS DOUBLE) FROM conversations), 12) AS rel_freq FROM ({tok('conversations', 'conv_id')}) GROUP BY term")
def _(t):
    df = S.frequencies(K.candidates(domain(t)), K.total_words(domain(t)))
    path = _path(df, "statistics")
    pair = F.array(F.col("abs_freq").cast("double"), F.col("rel_freq"))
    df.agg(F.map_from_entries(F.collect_list(F.struct("term", pair))).alias("m")).select(F.to_json("m")).write.text(path)
    return readers.statistics_json(df.sparkSession, path).withColumn("rel_freq", F.round("rel_freq", 12))


@query("lexicon_file", f"SELECT DISTINCT term AS word, CASE WHEN length(term) > 8 THEN 'LONG' ELSE 'SHORT' END AS lex_tag FROM ({TOK})")
def _(t):
    df = K.candidates(reqs(t)).select("term").distinct().select(F.concat_ws("\t", "term", F.when(F.length("term") > 8, "LONG").otherwise("SHORT")))
    path = _path(df, "lexicon")
    df.write.text(path)
    return readers.tagger_lexicon(df.sparkSession, path)


@query("clusters_file", "SELECT 'p_brand' AS cluster, p_brand AS term, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_size > 10 GROUP BY p_type")
def _(t):
    # Columns of unequal length: the second one has gaps.
    df = t("part").select("p_brand", F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"))
    path = _path(df, "clusters")
    writers.table_csv(df, path)
    return readers.clusters_csv(df.sparkSession, path).groupBy("cluster", "term").agg(F.count("*").alias("n"))


@query("tuple_lines", "SELECT DISTINCT p_name AS surface, p_brand AS label FROM part WHERE p_name <> ''")
def _(t):
    one = t("part").select(F.concat(F.lit("('"), "p_name", F.lit("', '"), "p_brand", F.lit("')")).alias("x"), "p_size")
    body = one.groupBy("p_size").agg(F.array_join(F.collect_list("x"), "\n").alias("body"))
    return readers.pairs_from_text(body, "body").distinct()


@query("run_log", f"SELECT 'documents' AS dataset, (SELECT detected FROM ({LANG}) ORDER BY doc_id LIMIT 1) AS corpus_lang, false AS template")
def _(t):
    return writers.run_log(reqs(t), "documents", False).drop("at")


@query("matrix_of_pairs", "SELECT o_orderpriority AS key, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(t):
    pairs = t("orders").groupBy(F.col("o_orderpriority").alias("i"), F.lower("o_orderstatus").alias("j")).agg(F.count("*").alias("d"))
    return E.matrix(pairs, ["f", "o", "p"]).withColumnRenamed("i", "key")


@query("zipped_lists", "SELECT a.n AS place, a.p_name AS first, b.s_name AS second FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_name FROM part) a JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_name FROM supplier) b USING (n)")
def _(t):
    a = K.ordinals(t("part").select("p_partkey", F.col("p_name").alias("first")), "p_partkey").drop("p_partkey")
    b = K.ordinals(t("supplier").select("s_suppkey", F.col("s_name").alias("second")), "s_suppkey").drop("s_suppkey")
    return E.zipped(a, b, "ordinal").withColumnRenamed("ordinal", "place")


@query("gold_missing", f"""WITH gold AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}]+ [\\p{{L}}]+')) AS term FROM benchmark UNION SELECT term FROM ({tok('benchmark', 'item_id')})),
miss AS (SELECT term FROM gold WHERE term NOT IN (SELECT term FROM ({TOK}))) SELECT term, EXISTS (SELECT 1 FROM documents WHERE contains(text, miss.term)) AS in_requirements FROM miss""")
def _(t):
    pairs = t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+ [\p{L}]+"), F.lit(0))).alias("term"))
    gold = pairs.unionByName(K.candidates(general(t)).select("term")).distinct()
    return E.missing_terms(gold, K.candidates(reqs(t)).select("term").distinct(), reqs(t))


@query("plural_in_lexicon", f"WITH w AS MATERIALIZED (SELECT DISTINCT term FROM ({TOK})), c AS MATERIALIZED (SELECT term, CASE WHEN length(term) < 14 AND length(term) > 2 AND ends_with(term, 's') THEN left(term, length(term) - 1) END AS cut FROM w) SELECT c.term, coalesce(w.term, c.term) AS base FROM c LEFT JOIN w ON w.term = c.cut")
def _(t):
    terms = K.candidates(reqs(t)).select("term").distinct()
    return K.plural_in_lexicon(terms, terms.withColumnRenamed("term", "word"))


@query("jaro_winkler", "WITH p AS (SELECT DISTINCT p_name AS n, p_brand AS g FROM part), q AS (SELECT DISTINCT a.n AS a, b.n AS b FROM p a JOIN p b ON a.g = b.g AND a.n < b.n) SELECT a, b, round(jaro_winkler_similarity(replace(a, ' ', ''), replace(b, ' ', '')), 6) AS similarity FROM q")
def _(t):
    from termloom.functions.similarity import jaro_winkler

    p = t("part").select(F.col("p_name").alias("n"), F.col("p_brand").alias("g")).distinct()
    pairs = p.select("g", F.col("n").alias("a")).join(p.select("g", F.col("n").alias("b")), "g").where("a < b").select("a", "b").distinct()
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return pairs.select("a", "b", F.round(jaro_winkler(bare("a"), bare("b")), 6).alias("similarity"))


@query("ratcliff_obershelp")
def _(t):
    from termloom.functions.similarity import ratcliff_obershelp

    p = t("part").select("p_name").distinct()
    pairs = p.select(F.col("p_name").alias("a")).join(t("part").select(F.col("p_type").alias("b")).distinct(), F.col("a") != F.col("b"))
    return pairs.select("a", "b", F.round(ratcliff_obershelp(F.col("a"), F.col("b")), 6).alias("similarity"))


_RO = T.ROMANIAN


@query("romanian_clitics", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}]+(?:-[\\p{{L}}]+)*-?')) AS word FROM documents),
h AS (SELECT word, regexp_extract(word, '{_RO.head}', 1) AS head, CASE WHEN regexp_matches(word, '{_RO.head}') THEN regexp_extract(word, '{_RO.head}', 2) ELSE word END AS rest FROM w)
SELECT word, array_to_string(list_filter([head, regexp_extract(rest, '{_RO.tail}', 1)] || regexp_extract_all(regexp_extract(rest, '{_RO.tail}', 2), '-[^-]+'), lambda x: x <> ''), ' ') AS parts FROM h""")
def _(t):
    word = t("documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}]+(?:-[\p{L}]+)*-?"), F.lit(0))).alias("word")).distinct()
    return word.select("word", F.array_join(T.split_romanian(F.col("word")), " ").alias("parts"))
