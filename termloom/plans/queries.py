"""Registry of the queries and of their oracle SQL.

Requirements are the documents; the general corpus is ``benchmark`` and the
domain corpus ``conversations``.  Sentences are the parts of a document between
full stops and line feeds.  Clusterings are the language and the source of a
document.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import lexicon as L
from termloom.functions import numeric as N
from termloom.functions import text as T
from termloom.operators import automaton as A
from termloom.operators import clusters as C
from termloom.operators import cooccur as O
from termloom.operators import evaluate as E
from termloom.operators import merge as M
from termloom.operators import stats as S
from termloom.operators import tagger as G
from termloom.operators import template as P
from termloom.operators import tokens as K
from termloom.plans import statistics as Z
from termloom.sources import readers, writers
from termloom.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (tables) as a query; ``tables`` reads a table by name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: readers.table(spark, f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def reqs(t) -> DataFrame:
    return K.requirements(t("documents"), "doc_id", "text")


def domain(t) -> DataFrame:
    turns = t("conversations")
    return turns.select(F.xxhash64("conv_id", "turn").alias("req_no"), "text")


def general(t) -> DataFrame:
    return K.requirements(t("benchmark"), "item_id", "text")


def sentence_units(t) -> DataFrame:
    """(req_no, text) with one row for each sentence."""
    return K.sentences(reqs(t)).select(F.concat_ws(":", "req_no", "s_no").alias("req_no"), F.col("sentence").alias("text"))


def tagged(t) -> DataFrame:
    return K.annotate(K.candidates(sentence_units(t)))


def tagged_sentences(t) -> DataFrame:
    """(req_no, items): the tagged tokens of each sentence in its own row."""
    return K.packed(sentence_units(t), tag=L.pos_tag)


def labelled_sentences(t, label: Callable) -> DataFrame:
    """``tagged_sentences`` with ``chunk_tag``, a function of the tag."""
    item = lambda x: F.struct(x["pos"].alias("pos"), x["term"].alias("term"), x["tag"].alias("tag"), label(x["tag"]).alias("chunk_tag"))
    return tagged_sentences(t).select("req_no", F.transform("items", item).alias("items"))


def definitions(t) -> tuple[DataFrame, DataFrame]:
    """Two dictionaries: the first benchmark item and the first role that use a term."""
    a = K.candidates(general(t)).groupBy("term").agg(F.concat(F.lit("item "), F.min("req_no").cast("string")).alias("d"))
    turn = t("conversations").select(F.col("role").alias("req_no"), "text")
    return a, K.candidates(turn).groupBy("term").agg(F.min("req_no").alias("d"))


# SQL fragments -----------------------------------------------------------------

W = r"\p{L}\p{N}_"
MAIN = rf"[{W}]+[-\\.]?[{W}]+"
MASK = r"regexp_replace({0}, '\p{{Nd}}+', '##', 'g')"


def tok(table: str, id_: str, col: str = "text", mask: bool = True) -> str:
    text = MASK.format(col) if mask else col
    return f"SELECT req_no, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM (SELECT {id_} AS req_no, regexp_extract_all({text}, '{MAIN}') AS ts FROM {table})"


TOK = tok("documents", "doc_id")
TOTAL = f"SELECT CAST(sum(len(regexp_extract_all(text, '{MAIN}'))) AS BIGINT) AS total_words FROM documents"
SENT = """SELECT concat_ws(':', req_no, s_no) AS req_no, trim(s) AS text FROM (
  SELECT doc_id AS req_no, unnest(ps) AS s, unnest(range(0, len(ps))) AS s_no FROM (SELECT doc_id, regexp_split_to_array(text, '[.\\n]') AS ps FROM documents)) WHERE trim(s) <> ''"""
STOK = f"sent AS ({SENT}), tok AS ({tok('sent', 'req_no')}), tagged AS (SELECT *, {L.pos_sql('term')} AS tag, {L.lemma_sql('term')} AS lemma FROM tok)"
STOPS = L.sql_list(L.STOP_WORDS)
FREQ = f"tok AS MATERIALIZED ({TOK}), total AS MATERIALIZED ({TOTAL}), freq AS MATERIALIZED (SELECT term, count(*) AS abs_freq, count(*) / (SELECT CAST(total_words AS DOUBLE) FROM total) AS rel_freq FROM tok GROUP BY term)"
REFS = f"""dom AS (SELECT term, count(*) / (SELECT CAST(sum(len(regexp_extract_all(text, '{MAIN}'))) AS DOUBLE) FROM conversations) AS f FROM ({tok('conversations', 'conv_id')}) GROUP BY term),
gen AS (SELECT term, count(*) / (SELECT CAST(sum(len(regexp_extract_all(text, '{MAIN}'))) AS DOUBLE) FROM benchmark) AS f FROM ({tok('benchmark', 'item_id')}) GROUP BY term),
refs AS (SELECT freq.*, coalesce(dom.f, 0) AS rel_freq_domain, coalesce(gen.f, 0) AS rel_freq_general FROM freq LEFT JOIN dom USING (term) LEFT JOIN gen USING (term))"""


# Projections -------------------------------------------------------------------


@query("tokenize_main", f"SELECT req_no, term, CAST(pos AS INTEGER) AS pos FROM ({tok('documents', 'doc_id', mask=False)})")
def _(t):
    return K.candidates(reqs(t), mask=False)


@query("digit_mask", f"SELECT doc_id AS req_no, {MASK.format('text')} AS masked FROM documents")
def _(t):
    return reqs(t).select("req_no", T.mask_digits(F.col("text")).alias("masked"))


@query("word_total", TOTAL)
def _(t):
    return K.total_words(reqs(t))


def _scalar(name: str, column: Callable, sql: str) -> None:
    @query(name, f"SELECT doc_id AS req_no, {sql} AS value FROM documents")
    def _(t):
        return reqs(t).select("req_no", column(F.col("text")).alias("value"))


_scalar("words_nodigit", T.words_without_digits, r"array_to_string(regexp_extract_all(text, '[\p{L}_]+'), ' ')")
_scalar("words_plain", T.words_plain, rf"array_to_string(regexp_extract_all(text, '[{W}]+'), ' ')")
_scalar("words_hyphen", T.words_hyphen, rf"array_to_string(regexp_extract_all(text, '[{W}-]+'), ' ')")
_scalar("strip_parens", T.strip_parentheses, "translate(text, '()', '')")
_scalar("split_space_hyphen", lambda c: F.array_join(T.split_blank_hyphen(c), "|"), "array_to_string(regexp_split_to_array(text, '[ -]'), '|')")
_scalar("split_blank", lambda c: F.array_join(T.split_blank(c), "|"), r"array_to_string(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), '|')")
_scalar("last_word", T.last_word, rf"list_last(regexp_extract_all(text, '{MAIN}'))")
_scalar("escape_brackets", T.escape_brackets, r"regexp_replace(text, '([()\[\]])', '\\\1', 'g')")


def _contraction_sql() -> str:
    out = "text"
    for whole, parts in T.PORTUGUESE:
        out = rf"regexp_replace({out}, '(^|[^{W}]){whole}([^{W}]|$)', '\1{parts}\2', 'g')"
    return out


_scalar("contraction_split", T.split_contractions, _contraction_sql())


def _term_scalar(name: str, column: Callable, sql: str) -> None:
    @query(name, f"SELECT DISTINCT term, {sql} AS value FROM ({TOK})")
    def _(t):
        return K.candidates(reqs(t)).select("term").distinct().select("term", column(F.col("term")).alias("value"))


_term_scalar("trim_hyphen", T.trim_hyphen, "CASE WHEN ends_with(term, '-') THEN regexp_replace(term, '-$', '') ELSE regexp_replace(term, '^-', '') END")
_term_scalar("plural_base", T.plural_base, "CASE WHEN length(term) < 14 AND length(term) > 2 AND ends_with(term, 's') THEN regexp_replace(term, 's$', '') ELSE term END")
_term_scalar("pos_tag", L.pos_tag, L.pos_sql("term"))
_term_scalar("lemmatize", L.lemma, L.lemma_sql("term"))


@query("article_strip", f"""WITH {STOK}, c AS (SELECT DISTINCT term || ' ' || nxt AS chunk FROM (SELECT term, lead(term) OVER (PARTITION BY req_no ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL)
SELECT chunk, CASE WHEN split_part(chunk, ' ', 1) IN ({L.sql_list([*L.ENGLISH_ARTICLES, *L.GERMAN_ARTICLES])}) THEN replace(chunk, split_part(chunk, ' ', 1) || ' ', '') ELSE chunk END AS stripped,
  CASE WHEN split_part(chunk, ' ', 1) IN ({STOPS}) THEN split_part(chunk, ' ', 2) ELSE chunk END AS without_stop FROM c""")
def _(t):
    c = sentence_units(t).select(T.main_tokens(T.mask_digits(F.col("text"))).alias("ws"))
    pairs = c.select(F.explode(T.ngrams(F.col("ws"), 2)).alias("chunk")).distinct()
    return pairs.select("chunk", T.strip_article(F.col("chunk"), [*L.ENGLISH_ARTICLES, *L.GERMAN_ARTICLES]).alias("stripped"), T.drop_leading(F.col("chunk"), L.STOP_WORDS).alias("without_stop"))


@query("ngrams", f"""WITH tok AS ({TOK}), g AS (SELECT req_no, term || ' ' || lead(term) OVER w || ' ' || lead(term, 2) OVER w AS gram FROM tok WINDOW w AS (PARTITION BY req_no ORDER BY pos))
SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram""")
def _(t):
    ws = reqs(t).select(T.main_tokens(T.mask_digits(F.col("text"))).alias("ws"))
    return ws.select(F.explode(T.ngrams(F.col("ws"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("sentence_rebuild", f"""WITH tok AS ({TOK}) SELECT d.doc_id AS req_no, coalesce(s.s, '') AS sentence FROM documents d LEFT JOIN (
  SELECT req_no, string_agg(term, ' ' ORDER BY pos) || ' ' AS s FROM tok WHERE term NOT IN ({STOPS}) GROUP BY req_no) s ON s.req_no = d.doc_id""")
def _(t):
    return K.rebuilt(K.without(K.candidates(reqs(t)), L.STOP_WORDS), reqs(t))


@query("requirement_ordinal", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents")
def _(t):
    return K.ordinals(t("documents").select("doc_id"), "doc_id")


# Language ----------------------------------------------------------------------

LANG = rf"""SELECT doc_id, CASE WHEN en > de THEN 'EN' WHEN de > en THEN 'DE' END AS detected FROM (
  SELECT doc_id, len(list_filter(ws, lambda x: list_contains([{L.sql_list(L.ENGLISH_MARKERS)}], x))) AS en, len(list_filter(ws, lambda x: list_contains([{L.sql_list(L.GERMAN_MARKERS)}], x))) AS de
  FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS ws FROM documents))"""


@query("language_detect", LANG)
def _(t):
    return t("documents").select("doc_id", K.language(F.col("text")).alias("detected"))


@query("language_gate", f"SELECT detected, count(*) AS n FROM ({LANG}) WHERE detected IS NOT NULL GROUP BY detected")
def _(t):
    return t("documents").select(K.language(F.col("text")).alias("detected")).where("detected is not null").groupBy("detected").agg(F.count("*").alias("n"))


@query("language_corpus", f"SELECT detected AS corpus_lang FROM ({LANG}) ORDER BY doc_id LIMIT 1")
def _(t):
    return K.corpus_language(reqs(t))


# Filters -----------------------------------------------------------------------


@query("stopword_filter", f"SELECT req_no, CAST(pos AS INTEGER) AS pos, term FROM ({TOK}) WHERE term NOT IN ({STOPS})")
def _(t):
    return K.without(K.candidates(reqs(t)), L.STOP_WORDS)


@query("exception_stops", f"WITH stops AS (SELECT unnest([{STOPS}]) AS word) SELECT word FROM stops WHERE word NOT IN (SELECT term FROM ({tok('benchmark', 'item_id')}))")
def _(t):
    source = t("benchmark")
    stops = source.sparkSession.createDataFrame([(w,) for w in L.STOP_WORDS], "word string")
    return K.reduced_stops(stops, K.candidates(general(t)).select(F.col("term").alias("word")).distinct())


@query("length_filter", f"SELECT req_no, count(*) AS n FROM ({TOK}) WHERE length(term) > 2 AND term <> 'The' GROUP BY req_no")
def _(t):
    return K.longer_than(K.candidates(reqs(t)), 2).where("term <> 'The'").groupBy("req_no").agg(F.count("*").alias("n"))


@query("abbreviation_split", f"""WITH tok AS ({TOK}), dict AS (SELECT DISTINCT term FROM ({tok('conversations', 'conv_id')})), known AS (SELECT DISTINCT lower(term) AS k FROM ({tok('benchmark', 'item_id')})),
abbr AS (SELECT * FROM tok WHERE term NOT IN (SELECT term FROM dict) AND lower(term) NOT IN (SELECT k FROM known))
SELECT 'abbreviation' AS branch, term, count(*) AS n FROM abbr GROUP BY term UNION ALL SELECT 'token', term, count(*) FROM tok WHERE term NOT IN (SELECT term FROM abbr) GROUP BY term""")
def _(t):
    dictionary = K.candidates(domain(t)).select("term").distinct()
    known = K.candidates(general(t)).select(F.lower("term").alias("k")).distinct()
    found, rest = K.abbreviations(K.candidates(reqs(t)), dictionary, known)
    count = lambda df, name: df.groupBy("term").agg(F.count("*").alias("n")).select(F.lit(name).alias("branch"), "term", "n")
    return count(found, "abbreviation").unionByName(count(rest, "token"))


@query("verb_candidates", f"WITH {STOK} SELECT DISTINCT req_no, lemma FROM tagged WHERE tag = 'VERB' AND lemma NOT IN ('eden')")
def _(t):
    return K.verbs(tagged(t), ["eden"])


@query("adjective_candidates", f"WITH {STOK} SELECT req_no, CAST(pos AS INTEGER) AS pos, term FROM tagged WHERE tag = 'ADJ' AND term NOT IN ('gem', 'muss')")
def _(t):
    return K.adjectives(tagged(t), [])


@query("linked_verbs", f"""WITH {STOK}, a AS (SELECT *, lead(term) OVER w AS t1, lead(tag, 2) OVER w AS g2, lead(lemma, 2) OVER w AS l2 FROM tagged WINDOW w AS (PARTITION BY req_no ORDER BY pos))
SELECT req_no, CAST(pos AS INTEGER) AS pos, lemma || ' and ' || l2 AS term FROM a WHERE tag = 'VERB' AND t1 = 'and' AND g2 = 'VERB'""")
def _(t):
    return K.linked_verbs(tagged(t), "and")


@query("trigram_pattern", f"""WITH {STOK}, a AS (SELECT *, lead(term) OVER w AS t1, lead(tag) OVER w AS g1, lead(term, 2) OVER w AS t2, lead(tag, 2) OVER w AS g2 FROM tagged WINDOW w AS (PARTITION BY req_no ORDER BY pos))
SELECT req_no, CAST(pos AS INTEGER) AS pos, term || ' ' || t1 || ' ' || t2 AS term FROM a WHERE tag = 'NOUN' AND g1 IN ('DET', 'ADP') AND g2 = 'NOUN'""")
def _(t):
    return K.trigrams(tagged(t))


_RUNS = """runs AS (SELECT req_no, min(pos) AS pos, count(*) AS n, string_agg(term, ' ' ORDER BY pos) AS chunk, max(CASE WHEN tag = 'NOUN' THEN 1 ELSE 0 END) AS nouns
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY req_no ORDER BY pos) AS island FROM tagged WHERE tag IN ('DET', 'ADJ', 'NOUN')) GROUP BY req_no, island)"""


@query("noun_runs", f"WITH {STOK}, {_RUNS} SELECT req_no, CAST(pos AS INTEGER) AS pos, n, chunk FROM runs WHERE nouns = 1")
def _(t):
    return K.noun_runs(tagged(t))


@query("leading_adposition_filter", f"WITH {STOK} SELECT term, count(*) AS n FROM tagged WHERE tag <> 'ADP' AND term <> '' GROUP BY term")
def _(t):
    return tagged(t).where("tag <> 'ADP' and term <> ''").groupBy("term").agg(F.count("*").alias("n"))


# Statistics --------------------------------------------------------------------


@query("term_frequency", f"SELECT term, count(*) AS abs_freq FROM ({TOK}) GROUP BY term")
def _(t):
    return S.frequencies(K.candidates(reqs(t)))


@query("relative_frequency", f"WITH {FREQ} SELECT term, abs_freq, round(rel_freq, 12) AS rel_freq FROM freq")
def _(t):
    return S.frequencies(K.candidates(reqs(t)), K.total_words(reqs(t))).withColumn("rel_freq", F.round("rel_freq", 12))


@query("term_req_ids", f"SELECT term, string_agg(CAST(req_no AS VARCHAR), ',' ORDER BY req_no) AS req_ids FROM (SELECT DISTINCT term, req_no FROM ({TOK})) GROUP BY term")
def _(t):
    return S.occurrence_ids(K.candidates(reqs(t))).select("term", F.array_join(F.col("req_ids").cast("array<string>"), ",").alias("req_ids"))


@query("document_frequency", f"SELECT term, count(DISTINCT req_no) AS doc_freq FROM ({TOK}) GROUP BY term")
def _(t):
    # Texts move once, before they are cut, in place of their pairs with terms.
    return S.document_frequency(K.candidates(reqs(t).repartition("req_no")))


def _measured(t) -> DataFrame:
    total = K.total_words(reqs(t))
    freq = S.frequencies(K.candidates(reqs(t)), total)
    return S.measures(S.with_references(freq, S.reference_rates(domain(t)), S.reference_rates(general(t))), total)


_RATIO = "coalesce(round(rel_freq / nullif(rel_freq_domain, 0), 3), 0)"
_LLD = """2 * (rel_freq + ln(rel_freq / (n * cd)) + kd * ln(kd / (76862 * cd)))"""
_LLG = """2 * (rel_freq + ln(rel_freq / n * cg) + kg * ln(kg / (569010 * cg)))"""
_LL = """ll AS (SELECT *, (kd + rel_freq) / (76862 + n) AS cd, (kg + rel_freq) / (569010 + n) AS cg FROM (
  SELECT *, CASE WHEN rel_freq_domain = 0 THEN 1e-5 ELSE rel_freq_domain END AS kd, CASE WHEN rel_freq_general = 0 THEN 1e-5 ELSE rel_freq_general END AS kg, (SELECT CAST(total_words AS DOUBLE) FROM total) AS n FROM refs))"""


@query("domain_ratio", f"WITH {FREQ}, {REFS} SELECT term, {_RATIO} AS ratio_domain FROM refs")
def _(t):
    return _measured(t).select("term", "ratio_domain")


@query("domain_specific_flag", f"WITH {FREQ}, {REFS} SELECT term, rel_freq > rel_freq_general AS is_domain_specific FROM refs")
def _(t):
    return _measured(t).select("term", "is_domain_specific")


@query("log_likelihood_coded", f"WITH {FREQ}, {REFS}, {_LL} SELECT term, round({_LLD}, 6) AS ll_domain, round({_LLG}, 6) AS ll_general FROM ll")
def _(t):
    return _measured(t).select("term", F.round("ll_domain", 6).alias("ll_domain"), F.round("ll_general", 6).alias("ll_general"))


@query("log_likelihood_g2", f"""WITH a AS MATERIALIZED (SELECT term, CAST(count(*) AS DOUBLE) AS f FROM ({TOK}) GROUP BY term), b AS MATERIALIZED (SELECT term, CAST(count(*) AS DOUBLE) AS f FROM ({tok('conversations', 'conv_id')}) GROUP BY term),
n AS MATERIALIZED (SELECT (SELECT sum(f) FROM a) AS c, (SELECT sum(f) FROM b) AS d), m AS MATERIALIZED (SELECT a.term, a.f AS a, coalesce(b.f, 0) AS b FROM a LEFT JOIN b ON b.term = a.term), j AS (SELECT m.*, c, d, (a + b) / (c + d) AS s FROM m CROSS JOIN n)
SELECT term, round(2 * (a * ln(a / (c * s)) + CASE WHEN b > 0 THEN b * ln(b / (d * s)) ELSE 0 END), 4) AS g2 FROM j""")
def _(t):
    a, b = S.frequencies(K.candidates(reqs(t))), S.frequencies(K.candidates(domain(t))).withColumnRenamed("abs_freq", "b")
    c, d = a.agg(F.sum("abs_freq").cast("double").alias("c")), b.agg(F.sum("b").cast("double").alias("d"))
    j = a.join(b, "term", "left").fillna(0, ["b"]).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(d))
    return j.select("term", F.round(N.g2(F.col("abs_freq").cast("double"), F.col("b").cast("double"), F.col("c"), F.col("d")), 4).alias("g2"))


_TFIDF = """word AS MATERIALIZED (SELECT req_no, unnest(regexp_extract_all(s, '[\\p{L}\\p{N}_]{2,}')) AS term FROM rebuilt),
tf AS MATERIALIZED (SELECT word.req_no, word.term, count(*) AS tf FROM word JOIN freq ON freq.term = word.term GROUP BY 1, 2), df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT req_no, term, tf * (ln((1 + docs) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN (SELECT count(*) AS docs FROM documents)),
u AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY req_no)) AS u FROM w), tfidf AS (SELECT term, round(avg(u), 3) AS tfidf_mean FROM u GROUP BY term)"""
_REBUILT = "rebuilt AS MATERIALIZED (SELECT req_no, string_agg(term, ' ' ORDER BY pos) AS s FROM tok GROUP BY req_no)"


@query("tfidf_mean", f"WITH {FREQ}, {_REBUILT}, {_TFIDF} SELECT freq.term, tfidf_mean FROM freq LEFT JOIN tfidf USING (term)")
def _(t):
    # Texts move once, before they are cut: what is counted in a requirement stays where it is.
    counts = K.candidates(reqs(t).repartition("req_no")).groupBy("req_no", "term").agg(F.count("*").alias("tf"))
    return S.mean_tfidf_of(counts, reqs(t).agg(F.count("*").alias("n_reqs")))


_TERMS = """vocabulary AS MATERIALIZED (SELECT term FROM tok GROUP BY term HAVING count(*) >= 5 UNION SELECT array_to_string(ws[p:p + n - 1], ' ') FROM (
  SELECT ws, p, unnest(range(2, 5)) AS n FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}') AS ws FROM benchmark))) WHERE p + n - 1 <= len(ws))"""


def _vocabulary(t) -> DataFrame:
    """Terms of at least five occurrences, and all runs of two to four words of the general corpus."""
    often = S.frequencies(K.candidates(reqs(t))).where("abs_freq >= 5").select("term")
    words = general(t).select(F.regexp_extract_all("text", F.lit(S.WEIGHT_WORD), F.lit(0)).alias("ws"))
    for n in (2, 3, 4):
        often = often.unionByName(words.select(F.explode(T.ngrams(F.col("ws"), n)).alias("term")))
    return often.distinct()


@query("ngram_tfidf", f"""WITH {FREQ}, {_REBUILT}, {_TERMS}, word AS MATERIALIZED (SELECT req_no, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM (SELECT req_no, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws FROM rebuilt)),
more AS MATERIALIZED (SELECT req_no, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM word WINDOW o AS (PARTITION BY req_no ORDER BY p)),
gram AS (SELECT req_no, w AS term FROM more UNION ALL SELECT req_no, w || ' ' || w2 FROM more UNION ALL SELECT req_no, w || ' ' || w2 || ' ' || w3 FROM more UNION ALL SELECT req_no, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM more),
tf AS MATERIALIZED (SELECT req_no, term, count(*) AS tf FROM gram JOIN vocabulary USING (term) GROUP BY 1, 2), df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT req_no, term, tf * (ln((1 + docs) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN (SELECT count(*) AS docs FROM documents)),
u AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY req_no)) AS u FROM w) SELECT term, tfidf_mean FROM vocabulary LEFT JOIN (SELECT term, round(avg(u), 3) AS tfidf_mean FROM u GROUP BY term) USING (term)""")
def _(t):
    return S.ngram_tfidf(K.rebuilt_texts(reqs(t)), written(_vocabulary(t), "terms"))


_DEFS = f"""da AS (SELECT term, 'item ' || CAST(min(req_no) AS VARCHAR) AS d FROM ({tok('benchmark', 'item_id')}) GROUP BY term), dt AS (SELECT term, min(req_no) AS d FROM ({tok('conversations', 'role')}) GROUP BY term)"""


@query("definition_lookup", f"WITH {FREQ}, {_DEFS} SELECT term, abs_freq, coalesce(da.d, '') AS abbrev_definition, coalesce(dt.d, '') AS term_definition FROM freq LEFT JOIN da USING (term) LEFT JOIN dt USING (term)")
def _(t):
    return S.with_definitions(S.frequencies(K.candidates(reqs(t))), *definitions(t))


@query("term_statistics", f"""WITH raw AS ({TOK}), tok AS (SELECT * FROM raw WHERE term NOT IN ({STOPS}) AND length(term) > 1), total AS ({TOTAL}),
freq AS (SELECT term, count(*) AS abs_freq, count(*) / (SELECT CAST(total_words AS DOUBLE) FROM total) AS rel_freq, count(DISTINCT req_no) AS doc_freq FROM tok GROUP BY term),
{REFS}, {_LL}, {_DEFS}, {_REBUILT}, {_TFIDF}
SELECT ll.term, abs_freq, round(rel_freq, 12) AS rel_freq, round(rel_freq_domain, 12) AS rel_freq_domain, round(rel_freq_general, 12) AS rel_freq_general, {_RATIO} AS ratio_domain,
  rel_freq > rel_freq_general AS is_domain_specific, round({_LLD}, 6) AS ll_domain, round({_LLG}, 6) AS ll_general, coalesce(da.d, '') AS abbrev_definition, coalesce(dt.d, '') AS term_definition,
  tfidf_mean, doc_freq, row_number() OVER (ORDER BY ll.term) - 1 AS alphabetical_order
FROM ll LEFT JOIN da USING (term) LEFT JOIN dt USING (term) LEFT JOIN tfidf USING (term)""")
def _(t):
    out = S.term_statistics(reqs(t), domain(t), general(t), *definitions(t), L.STOP_WORDS)
    digits = {"rel_freq": 12, "rel_freq_domain": 12, "rel_freq_general": 12, "ll_domain": 6, "ll_general": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


_ARTICLES = L.sql_list([*L.ENGLISH_ARTICLES, *L.GERMAN_ARTICLES])
_CHUNKS = """runs AS (SELECT req_no, string_agg(term, ' ' ORDER BY pos) AS chunk, max(CASE WHEN tag = 'NOUN' THEN 1 ELSE 0 END) AS nouns
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY req_no ORDER BY pos) AS island FROM stag WHERE tag IN ('DET', 'ADJ', 'NOUN')) GROUP BY req_no, island)"""
_BARE = f"CASE WHEN split_part(chunk, ' ', 1) IN ({_ARTICLES}) THEN replace(chunk, split_part(chunk, ' ', 1) || ' ', '') ELSE chunk END"
_CHUNK_TERMS = f"""chunks AS (SELECT req_no, term FROM (SELECT CAST(split_part(req_no, ':', 1) AS BIGINT) AS req_no, array_to_string(regexp_extract_all(translate({_BARE}, '()', ''), '[{W}-]+'), ' ') AS term
  FROM runs WHERE nouns = 1 AND chunk NOT IN ({STOPS}, {_ARTICLES})) WHERE term <> '')"""


def _chunks(t) -> DataFrame:
    return Z.chunk_terms(tagged_sentences(t), F.split_part("req_no", F.lit(":"), F.lit(1)).cast("long"), L.STOP_WORDS)


@query("chunk_terms", f"WITH sent AS ({SENT}), stag AS (SELECT *, {L.pos_sql('term')} AS tag FROM ({tok('sent', 'req_no')})), {_CHUNKS}, {_CHUNK_TERMS} SELECT req_no, term, count(*) AS n FROM chunks GROUP BY req_no, term")
def _(t):
    return _chunks(t).groupBy("req_no", "term").agg(F.count("*").alias("n"))


_FOUND = f"""raw AS MATERIALIZED ({TOK}), tagd AS (SELECT *, {L.pos_sql('term')} AS tag, {L.lemma_sql('term')} AS lemma FROM raw),
dict AS (SELECT DISTINCT term FROM ({tok('conversations', 'conv_id')})), known AS (SELECT DISTINCT lower(term) AS k FROM ({tok('benchmark', 'item_id')})),
abbr AS (SELECT * FROM tagd WHERE term NOT IN (SELECT term FROM dict) AND lower(term) NOT IN (SELECT k FROM known)), other AS (SELECT * FROM tagd WHERE term NOT IN (SELECT term FROM abbr)),
verb AS (SELECT DISTINCT req_no, lemma AS term FROM other WHERE tag = 'VERB'),
words AS (SELECT 'token' AS branch, req_no, lemma AS term FROM other UNION ALL SELECT 'abbreviation', req_no, term FROM abbr UNION ALL SELECT 'VERB', * FROM verb UNION ALL SELECT 'process VERB', * FROM verb
  UNION ALL SELECT 'ADJ', req_no, term FROM other WHERE tag = 'ADJ' AND term NOT IN ('gem', 'muss')),
sent AS ({SENT}), stag AS (SELECT *, {L.pos_sql('term')} AS tag FROM ({tok('sent', 'req_no')})), {_CHUNKS}, {_CHUNK_TERMS},
found AS MATERIALIZED (SELECT * FROM words WHERE term NOT IN ({STOPS}) AND length(term) > 1 UNION ALL SELECT 'chunk', req_no, term FROM chunks)"""


def _found(t) -> DataFrame:
    """(branch, req_no, term, tf): one row for each term of a requirement in a branch."""
    dictionary = K.candidates(domain(t)).select("term").distinct()
    known = K.candidates(general(t)).select(F.lower("term").alias("k")).distinct()
    # Texts move once, before they are cut: what is counted in a requirement stays where it is.
    tokens = Z.token_counts(K.candidates(reqs(t).repartition("req_no")), dictionary, known, L.STOP_WORDS)
    return tokens.unionByName(_chunks(t).groupBy("branch", "req_no", "term").agg(F.count("*").alias("tf")))


@query("candidate_branches", f"WITH {_FOUND} SELECT branch, term, count(*) AS n, count(DISTINCT req_no) AS n_reqs FROM found GROUP BY branch, term")
def _(t):
    return _found(t).groupBy("branch", "term").agg(F.sum("tf").alias("n"), F.count("*").alias("n_reqs"))


@query("create_statistics", f"""WITH {_FOUND}, total AS ({TOTAL}), counts AS MATERIALIZED (SELECT branch, req_no, term, count(*) AS tf FROM found GROUP BY ALL),
freq AS (SELECT branch, term, CAST(sum(tf) AS BIGINT) AS abs_freq, sum(tf) / (SELECT CAST(total_words AS DOUBLE) FROM total) AS rel_freq, string_agg(CAST(req_no AS VARCHAR), ',' ORDER BY req_no) AS req_ids FROM counts GROUP BY branch, term),
{REFS}, {_LL}, {_DEFS},
part AS (SELECT branch, req_no, tf, unnest(CASE WHEN branch <> 'chunk' THEN regexp_extract_all(term, '[{W}]{{2,}}') WHEN regexp_full_match(term, '[{W}]{{2,}}( [{W}]{{2,}})*') THEN [term] ELSE [] END) AS term FROM counts),
tf AS (SELECT branch, req_no, term, sum(tf) AS tf FROM part SEMI JOIN freq USING (branch, term) GROUP BY ALL), df AS (SELECT branch, term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT branch, req_no, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df USING (branch, term)),
u AS (SELECT branch, term, w / sqrt(sum(w * w) OVER (PARTITION BY branch, req_no)) AS u FROM w), tfidf AS (SELECT branch, term, round(avg(u), 3) AS tfidf_mean FROM u GROUP BY ALL),
every AS MATERIALIZED (SELECT ll.*, CASE WHEN branch IN ('token', 'chunk') THEN {L.pos_sql("split_part(term, ' ', 1)")} ELSE branch END AS word_class FROM ll),
piece AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS w FROM every WHERE branch = 'chunk'),
inner_ AS (SELECT DISTINCT substr(w, i, n) AS term FROM (SELECT w, i, unnest(range(1, length(w) - i + 2)) AS n FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM piece))),
merged AS MATERIALIZED (SELECT * FROM every WHERE branch = 'chunk' OR term NOT IN (SELECT term FROM inner_)),
placed AS (SELECT term, max(upto) - 1 AS alphabetical_order FROM (SELECT term, count(*) OVER (ORDER BY term RANGE UNBOUNDED PRECEDING) AS upto FROM merged) GROUP BY term),
one AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY term ORDER BY abs_freq, branch DESC) = 1)
SELECT term, word_class, alphabetical_order, abs_freq, round(rel_freq, 12) AS rel_freq, round(rel_freq_general, 12) AS rel_freq_general, round(rel_freq_domain, 12) AS rel_freq_domain, round({_LLD}, 6) AS ll_domain, round({_LLG}, 6) AS ll_general,
  tfidf_mean, {_RATIO} AS ratio_domain, coalesce(da.d, '') AS abbrev_definition, coalesce(dt.d, '') AS term_definition, req_ids, 'N/A' AS cluster_label
FROM one LEFT JOIN da USING (term) LEFT JOIN dt USING (term) JOIN placed USING (term) LEFT JOIN tfidf USING (branch, term)""")
def _(t):
    out = Z.create_statistics(_found(t), reqs(t), domain(t), general(t), *definitions(t))
    digits = {"rel_freq": 12, "rel_freq_domain": 12, "rel_freq_general": 12, "ll_domain": 6, "ll_general": 6}
    out = out.withColumns({c: F.round(c, d) for c, d in digits.items()}).withColumn("req_ids", F.array_join(F.col("req_ids").cast("array<string>"), ","))
    return out.select(
        "term", "word_class", "alphabetical_order", "abs_freq", "rel_freq", "rel_freq_general", "rel_freq_domain", "ll_domain", "ll_general", "tfidf_mean", "ratio_domain", "abbrev_definition", "term_definition", "req_ids", "cluster_label"
    )


@query("split_term_rows", f"""WITH ids AS (SELECT DISTINCT req_no, term FROM ({TOK})), part AS (SELECT DISTINCT req_no, term, unnest(regexp_split_to_array(term, '[ -]')) AS part FROM ids),
a AS (SELECT part, string_agg(term, '|' ORDER BY term) AS terms FROM (SELECT DISTINCT part, term FROM part) GROUP BY part), b AS (SELECT part, string_agg(CAST(req_no AS VARCHAR), ',' ORDER BY req_no) AS req_ids FROM (SELECT DISTINCT part, req_no FROM part) GROUP BY part)
SELECT part, terms, req_ids FROM a JOIN b USING (part) WHERE part <> ''""")
def _(t):
    out = Z.split_rows(S.occurrence_ids(K.candidates(reqs(t))))
    return out.select("part", F.array_join("terms", "|").alias("terms"), F.array_join(F.col("req_ids").cast("array<string>"), ",").alias("req_ids"))


@query("ngram_range", f"WITH {_FOUND} SELECT CAST(min(n) AS INTEGER) AS shortest, CAST(max(n) AS INTEGER) AS longest FROM (SELECT len(string_split(term, ' ')) AS n FROM found)")
def _(t):
    return S.word_length_range(_found(t).select("term"))


# Merging -----------------------------------------------------------------------

_BRANCH = f"""{STOK}, branch AS (
  SELECT 'VERB' AS word_class, lemma AS term, count(DISTINCT req_no) AS abs_freq FROM tagged WHERE tag = 'VERB' GROUP BY lemma
  UNION ALL SELECT 'ADJ', term, count(*) FROM tagged WHERE tag = 'ADJ' GROUP BY term
  UNION ALL SELECT 'token', term, count(*) FROM tagged WHERE tag NOT IN ('VERB', 'ADJ') GROUP BY term)"""


def _branches(t) -> DataFrame:
    rows = tagged(t)
    verb = K.verbs(rows, []).groupBy(F.col("lemma").alias("term")).agg(F.count("*").alias("abs_freq"))
    return M.union_all({"VERB": verb, "ADJ": S.frequencies(K.adjectives(rows, [])), "token": S.frequencies(rows.where("tag not in ('VERB', 'ADJ')"))})


@query("branch_union", f"WITH {_BRANCH} SELECT * FROM branch")
def _(t):
    return _branches(t)


@query("dedup_keep_last", f"WITH {_BRANCH} SELECT word_class, term, abs_freq FROM branch QUALIFY row_number() OVER (PARTITION BY term ORDER BY abs_freq, word_class DESC) = 1")
def _(t):
    return M.keep_last(_branches(t))


@query("substring_antijoin", f"""WITH {STOK}, {_RUNS}, w AS (SELECT DISTINCT unnest(string_split(chunk, ' ')) AS w FROM runs WHERE nouns = 1),
inner_ AS (SELECT DISTINCT substr(w, i, n) AS term FROM (SELECT w, i, unnest(range(1, length(w) - i + 2)) AS n FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM w)))
SELECT DISTINCT term FROM tok WHERE term NOT IN (SELECT term FROM inner_)""")
def _(t):
    rows = tagged(t)
    return M.not_inside(rows.select("term").distinct(), K.noun_runs(rows))


@query("alphabetical_rank", f"SELECT term, max(upto) - 1 AS alphabetical_order FROM (SELECT term, count(*) OVER (ORDER BY term RANGE UNBOUNDED PRECEDING) AS upto FROM ({TOK})) GROUP BY term")
def _(t):
    return S.alphabetical(K.candidates(reqs(t)).select("term"))


@query("frequency_order", f"SELECT term, abs_freq, words FROM (SELECT term, count(*) AS abs_freq, CAST(len(string_split(term, '-')) AS INTEGER) AS words FROM ({TOK}) GROUP BY term) ORDER BY abs_freq DESC, term")
def _(t):
    out = S.frequencies(K.candidates(reqs(t))).withColumn("words", F.size(F.split("term", "-")))
    return out.orderBy(F.desc("abs_freq"), "term")


@query("frequency_rank", f"SELECT term, abs_freq, CAST(len(string_split(term, '-')) AS INTEGER) AS words, row_number() OVER (ORDER BY abs_freq DESC, term) - 1 AS frequency_order FROM (SELECT term, count(*) AS abs_freq FROM ({TOK}) GROUP BY term)")
def _(t):
    return S.by_frequency(S.frequencies(K.candidates(reqs(t)))).withColumn("words", F.size(F.split("term", "-")))


@query("set_operations", f"""WITH a AS (SELECT DISTINCT term FROM ({TOK})), b AS (SELECT DISTINCT term FROM ({tok('conversations', 'conv_id')}))
SELECT (SELECT count(*) FROM (SELECT term FROM a INTERSECT SELECT term FROM b)) AS common, (SELECT count(*) FROM (SELECT term FROM a EXCEPT SELECT term FROM b)) AS only_first, (SELECT count(*) FROM (SELECT term FROM a UNION SELECT term FROM b)) AS either""")
def _(t):
    a, b = K.candidates(reqs(t)).select("term").distinct(), K.candidates(domain(t)).select("term").distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.intersect(b), "common").crossJoin(n(a.subtract(b), "only_first")).crossJoin(n(a.union(b).distinct(), "either"))


@query("map_inversion", f"SELECT lemma AS value, max(term) AS key FROM (SELECT DISTINCT term, {L.lemma_sql('term')} AS lemma FROM ({TOK})) GROUP BY lemma")
def _(t):
    terms = K.candidates(reqs(t)).select("term").distinct()
    return M.inverted(terms.select(F.col("term").alias("ord"), F.col("term").alias("key"), L.lemma(F.col("term")).alias("value")))


@query("map_composition", f"SELECT DISTINCT term AS key, {L.lemma_sql('b')} AS value FROM (SELECT term, CASE WHEN length(term) < 14 AND length(term) > 2 AND ends_with(term, 's') THEN regexp_replace(term, 's$', '') ELSE term END AS b FROM ({TOK}))")
def _(t):
    terms = K.candidates(reqs(t)).select("term").distinct()
    first = terms.select(F.col("term").alias("key"), T.plural_base(F.col("term")).alias("value"))
    second = first.select(F.col("value").alias("key"), L.lemma(F.col("value")).alias("value")).distinct()
    return M.composed(M.filled(first), second)


@query("compound_split", f"""WITH f AS MATERIALIZED (SELECT term AS e, count(*) AS f FROM ({TOK}) GROUP BY term), long AS MATERIALIZED (SELECT e AS word FROM f WHERE length(e) >= 14),
cut AS MATERIALIZED (SELECT word, k, substr(word, 1, k) AS head, substr(word, k + 1) AS tail FROM (SELECT word, unnest(range(4, length(word) - 3)) AS k FROM long)),
known AS (SELECT cut.*, least(a.f, b.f) AS f FROM cut JOIN f a ON a.e = head JOIN f b ON b.e = tail),
best AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY word ORDER BY f DESC, k) = 1)
SELECT long.word, coalesce(head, long.word) AS head, coalesce(tail, '') AS tail FROM long LEFT JOIN best ON best.word = long.word""")
def _(t):
    freq = S.frequencies(K.candidates(reqs(t)))
    return K.best_split(freq.select(F.col("term").alias("word")), freq)


@query("compound_split_recursive")
def _(t):
    freq = S.frequencies(K.candidates(reqs(t)))
    return K.split_recursively(freq.where(F.length("term") >= 14).select(F.col("term").alias("word")), freq)


# Co-occurrence and similarity --------------------------------------------------

_COOC = f"""sent AS ({SENT}), u AS (SELECT DISTINCT req_no, term FROM ({tok('sent', 'req_no')}) WHERE term NOT IN ({STOPS})),
cooc AS (SELECT a.term AS w1, b.term AS w2, count(*) AS n_docs FROM u a JOIN u b ON a.req_no = b.req_no AND a.term <= b.term GROUP BY 1, 2)"""


def _cooc(t) -> DataFrame:
    def cut(rows: DataFrame) -> DataFrame:
        ws = F.filter(T.main_tokens(T.mask_digits(F.col("sentence"))), lambda w: ~w.isin(L.STOP_WORDS))
        return K.sentences(rows).select(F.concat_ws(":", "req_no", "s_no").alias("unit"), F.array_sort(F.array_distinct(ws)).alias("ws"))

    # Sentences are whole in their documents; only those of repeated documents meet.
    alone, repeated = K.once(reqs(t))
    units = cut(alone)
    if repeated is not None:
        units = units.unionByName(cut(repeated).groupBy("unit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("ws")))
    return O.cooccurrence(units)


@query("cooccurrence", f"WITH {_COOC} SELECT * FROM cooc")
def _(t):
    return _cooc(t)


PARTS = "SELECT DISTINCT item_term AS term FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}]+ [\\p{L}]+')) AS item_term FROM benchmark)"


def _two_words(t) -> DataFrame:
    return t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+ [\p{L}]+"), F.lit(0))).alias("term")).distinct()


_BCOOC = f"""u AS (SELECT DISTINCT req_no, term FROM ({tok('benchmark', 'item_id')})), cooc AS (SELECT a.term AS w1, b.term AS w2, count(*) AS n_docs FROM u a JOIN u b ON a.req_no = b.req_no GROUP BY 1, 2)"""


def _item_cooc(t) -> DataFrame:
    return O.cooccurrence(K.candidates(general(t)).select(F.col("req_no").alias("unit"), F.col("term").alias("word")))


@query("term_mean_vector", f"""WITH {_BCOOC}, terms AS ({PARTS}), word AS (SELECT term, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM (SELECT term, regexp_split_to_array(term, '[ -]') AS ws FROM terms)),
k AS (SELECT word.*, word IN (SELECT term FROM u) AS known FROM word), stop AS (SELECT term, min(CASE WHEN NOT known THEN pos END) AS s FROM k GROUP BY term),
used AS (SELECT k.* FROM k JOIN stop USING (term) WHERE s IS NULL OR pos < s), c AS (SELECT term, count(*) AS c FROM used GROUP BY term)
SELECT term, dim, round(s / CAST(c AS DOUBLE), 6) AS weight FROM (SELECT used.term, w2 AS dim, sum(n_docs) AS s FROM used JOIN cooc ON w1 = word GROUP BY 1, 2) JOIN c USING (term)""")
def _(t):
    return O.mean_vectors(_two_words(t), _item_cooc(t)).withColumn("weight", F.round("weight", 6))


@query("cosine_pairs", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.e, b.e), 6) AS dist FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id""")
def _(t):
    return O.cosine_pairs(t("embeddings"), "label", "vec_id", "embedding", digits=6)


_PAIRS = "p AS (SELECT DISTINCT p_name AS n, p_brand AS g FROM part), q AS (SELECT DISTINCT a.n AS a, b.n AS b FROM p a JOIN p b ON a.g = b.g AND a.n < b.n)"


def _name_pairs(t) -> DataFrame:
    p = t("part").select(F.col("p_name").alias("n"), F.col("p_brand").alias("g")).distinct()
    return p.select("g", F.col("n").alias("a")).join(p.select("g", F.col("n").alias("b")), "g").where("a < b").select("a", "b").distinct()


@query("string_distance_levenshtein", f"WITH {_PAIRS} SELECT a, b, CAST(levenshtein(replace(a, ' ', ''), replace(b, ' ', '')) AS INTEGER) AS dist FROM q")
def _(t):
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return _name_pairs(t).select("a", "b", F.levenshtein(bare("a"), bare("b")).alias("dist"))


@query("string_distance_hamming", f"""WITH {_PAIRS}, s AS (SELECT a, b, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM q)
SELECT a, b, CAST(len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) + abs(length(x) - length(y)) AS INTEGER) AS dist FROM s""")
def _(t):
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return _name_pairs(t).select("a", "b", N.hamming(bare("a"), bare("b")).alias("dist"))


_SETS = "s AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM q)"


@query("token_jaccard", f"WITH {_PAIRS}, {_SETS}, j AS (SELECT a, b, len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE) AS sim FROM s) SELECT a, b, round(sim, 6) AS similarity, round(sqrt(-2 * ln(CASE WHEN sim = 0 THEN 1e-7 ELSE sim END)), 6) AS dist FROM j")
def _(t):
    sim = N.jaccard(F.split("a", " "), F.split("b", " "))
    return _name_pairs(t).select("a", "b", F.round(sim, 6).alias("similarity"), F.round(N.token_distance(sim), 6).alias("dist"))


@query("token_sorensen", f"WITH {_PAIRS}, {_SETS} SELECT a, b, round(2.0 * len(list_intersect(x, y)) / CAST(len(list_distinct(x)) + len(list_distinct(y)) AS DOUBLE), 6) AS similarity FROM s")
def _(t):
    return _name_pairs(t).select("a", "b", F.round(N.sorensen(F.split("a", " "), F.split("b", " ")), 6).alias("similarity"))


# Clusters ----------------------------------------------------------------------

_KEY = f"""hit AS (SELECT DISTINCT term, unnest(regexp_extract_all(term, '[{W}]+')) AS word FROM terms), named AS (SELECT word AS cluster, term FROM hit WHERE word NOT IN ({STOPS}) AND word IN (SELECT word FROM hit GROUP BY word HAVING count(*) > 1)),
rest AS (SELECT term FROM terms WHERE term NOT IN (SELECT term FROM named)),
clusters AS (SELECT * FROM named UNION ALL SELECT 'rest', term FROM rest WHERE (SELECT count(*) FROM rest) > 1)"""


@query("keyword_clusters", f"WITH terms AS ({PARTS}), {_KEY} SELECT cluster, term FROM clusters WHERE len(string_split(term, ' ')) <= 5")
def _(t):
    return C.keyword_clusters(_two_words(t), L.STOP_WORDS)


@query("cluster_postprocess", f"""WITH terms AS ({PARTS}), {_KEY}, sets AS (SELECT cluster, list(DISTINCT term ORDER BY term) AS ts FROM clusters GROUP BY cluster), one AS (SELECT ts, min(cluster) AS cluster FROM sets GROUP BY ts)
SELECT DISTINCT CASE WHEN len(ts) > 1 THEN cluster ELSE 'cluster0' END AS cluster, unnest(ts) AS term FROM one""")
def _(t):
    return C.postprocessed(C.keyword_clusters(_two_words(t), L.STOP_WORDS))


@query("shared_word_layers", """WITH terms AS (SELECT DISTINCT p_name AS term FROM part), w AS (SELECT DISTINCT term, unnest(string_split(term, ' ')) AS word FROM terms),
one AS (SELECT DISTINCT a.term FROM w a JOIN w b ON a.word = b.word AND a.term <> b.term) SELECT CAST(CASE WHEN term IN (SELECT term FROM one) THEN 1 ELSE 0 END AS INTEGER) AS layer, term FROM terms""")
def _(t):
    return C.shared_word_layers(t("part").select(F.col("p_name").alias("term")), [*L.DETERMINERS, *L.ADPOSITIONS])


@query("ahc_clusters")
def _(t):
    return C.hierarchical(t("embeddings"), "label", "vec_id", "embedding", 0.115)


@query("ahc_labels")
def _(t):
    return C.composed_labels(C.hierarchical(t("embeddings").withColumnRenamed("label", "layer"), "layer", "vec_id", "embedding", 0.09), "layer", "cluster")


@query("threshold_sweep")
def _(t):
    sweep = C.threshold_sweep(t("embeddings"), "label", "vec_id", "embedding", [0.05, 0.115, 0.2])
    return sweep.groupBy("threshold", "label").agg(F.countDistinct("cluster").alias("clusters"))


@query("fuzzy_cmeans")
def _(t):
    return C.fuzzy_c_means(t("embeddings"), "vec_id", "embedding", 8).withColumn("membership", F.round("membership", 4))


# Evaluation --------------------------------------------------------------------

_OMEGA = """node AS (SELECT doc_id, lang, source FROM documents), kind AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS m FROM node GROUP BY 1, 2),
n AS (SELECT (SELECT count(*) FROM documents) * ((SELECT count(*) FROM documents) - 1) / 2.0 AS pairs),
s1 AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(m) AS m FROM kind GROUP BY lang)), s2 AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(m) AS m FROM kind GROUP BY source)), s12 AS (SELECT sum(m * (m - 1) / 2) AS s FROM kind),
o AS (SELECT pairs, (s12.s + pairs - s1.s - s2.s + s12.s) / pairs AS observed, s1.s / pairs * (s2.s / pairs) + (1 - s1.s / pairs) * (1 - s2.s / pairs) AS expected FROM n, s1, s2, s12)"""


def _omega(t) -> DataFrame:
    d = t("documents")
    return E.omega_parts(d.select(F.col("lang").alias("cluster"), F.col("doc_id").alias("node")), d.select(F.col("source").alias("cluster"), F.col("doc_id").alias("node")))


@query("omega_observed", f"WITH {_OMEGA} SELECT round(observed, 9) AS observed FROM o")
def _(t):
    return _omega(t).select(F.round("observed", 9).alias("observed"))


@query("omega_expected", f"WITH {_OMEGA} SELECT round(expected, 9) AS expected FROM o")
def _(t):
    return _omega(t).select(F.round("expected", 9).alias("expected"))


@query("omega_index", f"WITH {_OMEGA} SELECT round((observed - expected) / (1 - expected), 9) AS omega FROM o")
def _(t):
    return E.omega(_omega(t)).select(F.round("omega", 9).alias("omega"))


@query("node_labels", "SELECT o_custkey AS node, string_agg(s, ',' ORDER BY s) AS labels FROM (SELECT DISTINCT o_custkey, o_orderstatus AS s FROM orders) GROUP BY 1")
def _(t):
    return E.node_labels(t("orders").select(F.col("o_orderstatus").alias("cluster"), F.col("o_custkey").alias("node")))


@query("gold_recall", f"""WITH gold AS (SELECT DISTINCT term FROM ({tok('benchmark', 'item_id')})), miss AS (SELECT count(*) AS missing FROM gold WHERE term NOT IN (SELECT term FROM ({TOK}))), g AS (SELECT count(*) AS gold FROM gold)
SELECT gold, missing, round((1 - missing / CAST(gold AS DOUBLE)) * 100, 2) AS recall_percent FROM g, miss""")
def _(t):
    return E.recall_percent(K.candidates(reqs(t)).select("term").distinct(), K.candidates(general(t)).select("term").distinct())


@query("gold_restriction", f"SELECT term, count(*) AS abs_freq FROM ({TOK}) WHERE term IN (SELECT term FROM ({tok('benchmark', 'item_id')})) GROUP BY term")
def _(t):
    return S.frequencies(K.candidates(reqs(t)).join(K.candidates(general(t)).select("term").distinct(), "term", "left_semi"))


@query("prf_scores", f"""WITH cand AS (SELECT doc_id, detected AS lang FROM ({LANG}) WHERE detected IS NOT NULL), gold AS (SELECT doc_id, upper(lang) AS lang, source FROM documents),
j AS (SELECT coalesce(c.source, g.source) AS source, c.lang AS c, g.lang AS g FROM (SELECT cand.doc_id, cand.lang, d.source FROM cand JOIN documents d USING (doc_id)) c FULL JOIN gold g ON c.doc_id = g.doc_id AND c.lang = g.lang AND c.source = g.source),
k AS (SELECT source, count(*) FILTER (WHERE c IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE c IS NULL) AS fn FROM j GROUP BY source),
s AS (SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS p, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS r FROM k)
SELECT source, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 2) AS f_score FROM s""")
def _(t):
    d = t("documents")
    cand = d.select("source", F.col("doc_id").alias("unit"), K.language(F.col("text")).alias("item")).where("item is not null")
    return E.set_scores(cand, d.select("source", F.col("doc_id").alias("unit"), F.upper("lang").alias("item")), ["source"])


@query("best_of_sweep", "SELECT source, n FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source) ORDER BY n DESC, source LIMIT 1")
def _(t):
    sweep = t("documents").where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n"))
    return E.best_point(sweep, "n", "source")


@query("gold_unpivot", "SELECT 'p_name' AS cluster, p_name AS term FROM part WHERE p_name <> '' UNION ALL SELECT 'p_brand', p_brand FROM part WHERE p_brand <> '' UNION ALL SELECT 'p_type', p_type FROM part WHERE p_type <> ''")
def _(t):
    return E.unpivoted(t("part").select("p_name", "p_brand", "p_type"))


@query("tag_mapping", f"WITH {STOK} SELECT CASE tag WHEN 'ADJ' THEN 'JJ' WHEN 'VERB' THEN 'VB' ELSE tag END AS tag, count(*) AS n FROM tagged GROUP BY 1")
def _(t):
    return E.tag_mapping(tagged(t), {"ADJ": "JJ", "VERB": "VB"}).groupBy("tag").agg(F.count("*").alias("n"))


_CAPITAL = "CASE WHEN regexp_matches(term, '^\\p{Lu}') THEN 'NOUN' ELSE 'X' END"
_ENDS = lambda xs: " OR ".join(f"ends_with(term, '{x}')" for x in xs)
_SUFFIX = f"CASE WHEN {_ENDS(L.NOUN_SUFFIXES)} THEN 'NOUN' WHEN {_ENDS(L.ADJECTIVE_SUFFIXES)} THEN 'ADJ' WHEN {_ENDS(L.VERB_SUFFIXES)} THEN 'VERB' ELSE 'X' END"
_PLURAL = "CASE WHEN length(term) < 14 AND length(term) > 2 AND ends_with(term, 's') THEN regexp_replace(term, 's$', '') ELSE term END"


@query("annotator_scores", f"""WITH {STOK}, every AS (SELECT 'capital' AS tool, req_no, pos, term, {_CAPITAL} AS tag, lower(term) AS lemma FROM tok UNION ALL SELECT 'suffix', req_no, pos, term, {_SUFFIX}, {_PLURAL} FROM tok
  UNION ALL SELECT 'lexicon', req_no, pos, term, tag, lemma FROM tagged UNION ALL SELECT 'gold', req_no, pos, term, tag, lemma FROM tagged),
runs AS (SELECT tool, req_no, string_agg(term, ' ' ORDER BY pos) AS item, max(CASE WHEN tag = 'NOUN' THEN 1 ELSE 0 END) AS nouns
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY tool, req_no ORDER BY pos) AS island FROM every WHERE tag IN ('DET', 'ADJ', 'NOUN')) GROUP BY tool, req_no, island),
item AS (SELECT tool, 'pos' AS task, req_no, term || '/' || tag AS item FROM every WHERE tag IN ('NOUN', 'VERB', 'ADJ') UNION SELECT tool, 'lemma', req_no, term || '/' || lemma FROM every UNION SELECT tool, 'chunk', req_no, item FROM runs WHERE nouns = 1),
g AS (SELECT t.tool, task, req_no, item FROM item, (VALUES ('capital'), ('suffix'), ('lexicon')) t(tool) WHERE item.tool = 'gold'), c AS (SELECT * FROM item WHERE tool <> 'gold'),
j AS (SELECT coalesce(c.tool, g.tool) AS tool, coalesce(c.task, g.task) AS task, c.item AS ci, g.item AS gi FROM c FULL JOIN g ON c.tool = g.tool AND c.task = g.task AND c.req_no = g.req_no AND c.item = g.item),
k AS (SELECT tool, task, count(*) FILTER (WHERE ci IS NOT NULL AND gi IS NOT NULL) AS tp, count(*) FILTER (WHERE gi IS NULL) AS fp, count(*) FILTER (WHERE ci IS NULL) AS fn FROM j GROUP BY 1, 2),
s AS (SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS p, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS r FROM k)
SELECT tool, task, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 2) AS f_score FROM s""")
def _(t):
    ws = sentence_units(t).select("req_no", T.main_tokens(T.mask_digits(F.col("text"))).alias("ws"))
    rows = ws.select("req_no", F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("term"))).alias("items"))
    tools = {"capital": {"pos": L.capital_tag, "lemma": F.lower}, "suffix": {"pos": L.suffix_tag, "lemma": T.plural_base}, "lexicon": {"pos": L.pos_tag, "lemma": L.lemma}}
    return E.compare_annotators(rows, tools, tools["lexicon"], {"pos": ["NOUN", "VERB", "ADJ"], "lemma": None, "chunk": None})


def _phrase_sql(expr: str) -> str:
    return f"array_to_string([{expr} for w in string_split(chunk, ' ')], ' ')"


@query("chunk_lemmas", f"""WITH {STOK}, {_RUNS}, c AS (SELECT DISTINCT chunk FROM runs WHERE nouns = 1)
SELECT chunk, {_phrase_sql(L.lemma_sql('w'))} AS every, {_phrase_sql("CASE WHEN w IN (" + L.sql_list(L.DETERMINERS) + ") THEN w ELSE " + L.lemma_sql('w') + " END")} AS content,
  array_to_string(list_concat(string_split(chunk, ' ')[:-2], [{L.lemma_sql("string_split(chunk, ' ')[-1]")}]), ' ') AS head FROM c""")
def _(t):
    chunk = K.noun_runs(tagged(t)).select("chunk").distinct()
    c = F.col("chunk")
    return chunk.select("chunk", L.lemma_phrase(c).alias("every"), L.lemma_phrase(c, "determiners").alias("content"), L.lemma_phrase(c, "last").alias("head"))


@query("pos_groups", f"WITH {STOK} SELECT tag, string_agg(term, ',' ORDER BY term) AS words FROM (SELECT DISTINCT tag, term FROM tagged) GROUP BY tag")
def _(t):
    rows = tagged(t).select("tag", "term").distinct()
    return rows.groupBy("tag").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("words"))


# Template ----------------------------------------------------------------------

COND = " OR ".join(f"starts_with(text, '{w}')" for w in L.CONDITIONALS)


@query("template_condition", f"WITH sent AS ({SENT}) SELECT req_no, ({COND}) AS conditional, CASE WHEN {COND} THEN split_part(text, ' ', 1) ELSE '' END AS word FROM sent")
def _(t):
    s = F.col("text")
    return sentence_units(t).select("req_no", P.is_conditional(s).alias("conditional"), P.condition_word(s).alias("word"))


@query("template_path_actor", f"""WITH sent AS ({SENT}) SELECT req_no, CASE WHEN contains(text, '{P.OFFER}') THEN '{P.OFFER}' WHEN contains(text, '{P.ABLE}') THEN '{P.ABLE}' ELSE '' END AS path,
  CASE WHEN contains(text, '{P.OFFER}') THEN regexp_extract(text, '([{W}]+) die Möglichkeit', 1) ELSE '' END AS actor FROM sent""")
def _(t):
    s = F.col("text")
    return sentence_units(t).select("req_no", P.path(s).alias("path"), P.actor(s).alias("actor"))


@query("template_modal", f"""WITH sent AS ({SENT}) SELECT req_no, coalesce(list_filter(regexp_extract_all(text, '[{W}\\-()''".°,]+'), lambda w: list_contains([{L.sql_list(L.MODALS)}], rtrim(w, '.")')))[1], '') AS modal FROM sent""")
def _(t):
    return sentence_units(t).select("req_no", P.modal(F.col("text")).alias("modal"))


_VERB = rf"([{W}]+(\sund\s)?[{W}]+)(\s\(.+\))?(\.)?$"


@query("template_verb", f"WITH sent AS ({SENT}) SELECT req_no, regexp_extract(text, '{_VERB}', 1) || regexp_extract(text, '{_VERB}', 3) AS verb FROM sent")
def _(t):
    return sentence_units(t).select("req_no", P.verb(F.col("text")).alias("verb"))


@query("template_slots")
def _(t):
    return P.slots(sentence_units(t), "text").drop("text")


@query("requirement_parts")
def _(t):
    return sentence_units(t).select("req_no", P.requirement_parts(F.concat("text", F.lit("."))).alias("p")).select("req_no", "p.object", "p.verb")


# Tagger steps, records ---------------------------------------------------------


@query("punctuation_tokens")
def _(t):
    return reqs(t).select("req_no", F.posexplode(G.punctuation_tokens(F.col("text"))).alias("pos", "term"))


@query("lexicon_tags", f"WITH {STOK}, lex AS (SELECT DISTINCT term AS word FROM ({tok('benchmark', 'item_id')})) SELECT term, tag, count(*) AS n FROM (SELECT term, CASE WHEN term IN (SELECT word FROM lex) THEN 'LEX' ELSE tag END AS tag FROM tagged) GROUP BY 1, 2")
def _(t):
    lex = K.candidates(general(t)).select(F.col("term").alias("word")).distinct().withColumn("lex_tag", F.lit("LEX"))
    return G.with_lexicon(tagged(t), lex).groupBy("term", "tag").agg(F.count("*").alias("n"))


def _units(t) -> DataFrame:
    """(unit, tags): pairs of words of the benchmark items, and the first 3 to 6 words of each."""
    words = t("benchmark").select(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0)).alias("ws"))
    heads = words.select("ws", F.explode(F.sequence(F.lit(3), F.lit(6))).alias("n")).where(F.size("ws") >= F.col("n")).select(F.array_join(F.slice("ws", 1, F.col("n")), " ").alias("unit"))
    units = _two_words(t).select(F.col("term").alias("unit")).unionByName(heads).distinct()
    return units.withColumn("tags", F.concat(F.lit("W"), F.size(F.split("unit", " ")).cast("string")))


@query("multiword_units")
def _(t):
    return G.multiword_units(K.packed(sentence_units(t)), _units(t))


@query("pattern_hits", f"""WITH pattern AS ({PARTS}) SELECT doc_id, term AS pattern FROM documents JOIN pattern ON contains(text, term)""")
def _(t):
    return A.hits(t("documents"), _two_words(t), pattern="term", keep=["doc_id"])


@query("chunk_brackets")
def _(t):
    return G.bracketed(labelled_sentences(t, lambda tag: F.when(tag.isin("DET", "ADJ", "NOUN"), "I-NC").otherwise("O")))


@query("json_records", "SELECT '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS json FROM documents")
def _(t):
    return writers.as_json(t("documents").select("doc_id", "lang", "source"))


@query("json_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def _(t):
    one = t("documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    body = one.select(F.concat(F.lit("["), F.to_json(F.struct("id", "text")), F.lit("]")).alias("body"))
    return readers.requirements_from_json_text(body, "body")


@query("lines_to_json", "SELECT CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR) AS id, text FROM benchmark")
def _(t):
    return writers.lines_to_json(t("benchmark"), "item_id", "text")


# These modules register further queries of their own.
from termloom.plans import cluster_queries, compound_queries, file_queries, tagger_queries  # noqa: E402, F401
