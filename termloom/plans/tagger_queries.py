"""Queries of tagger steps and sweeps, and the SQL of the template and tagger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import lexicon as L
from termloom.functions import text as T
from termloom.operators import brackets as B
from termloom.operators import clusters as C
from termloom.operators import evaluate as E
from termloom.operators import tagger as G
from termloom.operators import template as P
from termloom.operators import stats as S
from termloom.operators import tokens as K
from termloom.operators import trained as R
from termloom.operators import transducer as X
from termloom.plans.queries import _RUNS, COND, LANG, ORACLES, PARTS, SENT, STOK, TOK, W, domain, general, labelled_sentences, query, reqs, sentence_units, tagged, tok
from termloom.sources.scratch import written

_PUNCT = rf"<[^<>]*>|(?:\p{{L}}\.){{2,}}|\.\.\.|\p{{N}}+(?:[.,]\p{{N}}+)*|[{W}]+(?:[-''’][{W}]+)*|--|[^ \t\n\x0B\f\r{W}]"
ORACLES["punctuation_tokens"] = f"SELECT req_no, CAST(unnest(range(0, len(ts))) AS INTEGER) AS pos, unnest(ts) AS term FROM (SELECT doc_id AS req_no, regexp_extract_all(coalesce(text, ''), '{_PUNCT}') AS ts FROM documents)"

ORACLES["requirement_parts"] = f"""WITH sent AS ({SENT}), m AS (SELECT req_no, text || '.' AS s, regexp_matches(text || '.', '{P.REQUIREMENT}') AS ok FROM sent)
SELECT req_no, CASE WHEN ok THEN regexp_replace(regexp_extract(s, '{P.REQUIREMENT}', 5), ' zu$', '') END AS object, CASE WHEN ok THEN regexp_replace(regexp_extract(s, '{P.REQUIREMENT}', 7), ' zu$', '') END AS verb FROM m"""

_CAPITAL = "upper(left(lower(term), 1)) || substr(lower(term), 2)"
# A walk follows the first of three arcs that exists; chosen units are reached from the first of a sentence.
ORACLES["multiword_units"] = f"""WITH RECURSIVE sent AS MATERIALIZED ({SENT}), tok AS MATERIALIZED ({tok('sent', 'req_no')}),
item AS (SELECT regexp_extract_all(text, '[\\p{{L}}]+') AS ws FROM benchmark),
unit AS MATERIALIZED (SELECT term AS unit FROM ({PARTS}) UNION SELECT array_to_string(ws[1:n], ' ') FROM item, (SELECT unnest(range(3, 7)) AS n) WHERE len(ws) >= n),
arc AS MATERIALIZED (SELECT DISTINCT array_to_string(ws[1:k], ' ') AS p FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT string_split(unit, ' ') AS ws FROM unit))),
form AS MATERIALIZED (SELECT term, unnest([term, lower(term), {_CAPITAL}]) AS form, unnest([1, 2, 3]) AS rank FROM (SELECT DISTINCT term FROM tok)),
step AS MATERIALIZED (SELECT p, regexp_replace(p, ' ?[^ ]+$', '') AS before, list_last(string_split(p, ' ')) AS word FROM arc),
move AS MATERIALIZED (SELECT before, term, arg_min(p, rank) AS p FROM step JOIN form ON form = word GROUP BY 1, 2),
walk AS (SELECT req_no, pos AS start, 1 AS n, p, term AS seen FROM tok JOIN move USING (term) WHERE before = ''
  UNION ALL SELECT walk.req_no, start, n + 1, move.p, seen || ' ' || tok.term FROM walk JOIN tok ON tok.req_no = walk.req_no AND tok.pos = start + n JOIN move ON move.before = walk.p AND move.term = tok.term),
hit AS MATERIALIZED (SELECT req_no, start AS pos, max(n) AS n, arg_max(seen, n) AS unit, arg_max(p, n) AS p FROM walk WHERE n > 1 AND p IN (SELECT unit FROM unit) GROUP BY 1, 2),
nxt AS MATERIALIZED (SELECT a.req_no, a.pos, min(b.pos) AS nxt FROM hit a JOIN hit b ON a.req_no = b.req_no AND b.pos >= a.pos + a.n GROUP BY 1, 2),
pick AS (SELECT req_no, min(pos) AS pos FROM hit GROUP BY req_no UNION ALL SELECT pick.req_no, nxt FROM pick JOIN nxt USING (req_no, pos))
SELECT req_no, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n, unit, 'W' || len(string_split(p, ' ')) AS tags FROM hit JOIN pick USING (req_no, pos)"""

ORACLES["chunk_brackets"] = f"""WITH {STOK}, t AS (SELECT *, tag IN ('DET', 'ADJ', 'NOUN') AS ok FROM tagged), i AS (SELECT *, CASE WHEN ok THEN pos - row_number() OVER (PARTITION BY req_no, ok ORDER BY pos) END AS island FROM t),
part AS (SELECT req_no, min(pos) AS pos, ok, string_agg('(' || tag || ' ' || term || ')', ' ' ORDER BY pos) AS ws FROM i GROUP BY req_no, ok, island, CASE WHEN ok THEN NULL ELSE pos END)
SELECT req_no, '(ROOT ' || string_agg(CASE WHEN ok THEN '(NC ' || ws || ')' ELSE ws END, ' ' ORDER BY pos) || ')' AS tree FROM part GROUP BY req_no"""

ORACLES["compound_split_recursive"] = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT term AS e, count(*) AS f FROM ({TOK}) GROUP BY term), long AS MATERIALIZED (SELECT e AS word FROM f WHERE length(e) >= 14),
cut AS (SELECT word, k, substr(word, 1, k) AS head, substr(word, k + 1) AS tail FROM (SELECT word, unnest(range(4, length(word) - 3)) AS k FROM long)),
best AS MATERIALIZED (SELECT word, head, tail FROM (SELECT cut.*, least(a.f, b.f) AS f FROM cut JOIN f a ON a.e = head JOIN f b ON b.e = tail) QUALIFY row_number() OVER (PARTITION BY word ORDER BY f DESC, k) = 1),
tree(word, piece, path) AS (SELECT word, word, '0' FROM long UNION ALL SELECT t.word, CASE WHEN s = 0 THEN head ELSE tail END, path || s FROM tree t JOIN best ON best.word = piece, (VALUES (0), (1)) v(s))
SELECT word, string_agg(piece, ' ' ORDER BY path) AS parts FROM tree WHERE piece NOT IN (SELECT word FROM best) GROUP BY word"""


def _trim_sql(body: str) -> str:
    for edge in P.EDGES:
        body = f"regexp_replace(regexp_replace({body}, '^{edge}', ''), '{edge}$', '')"
    return body


def _chunk_sql(name: str, low: str, high: str, source: str) -> str:
    """CTEs that add the first chunk between two places as column ``name``."""
    return f"""{name}1 AS (SELECT *, CASE WHEN m > 0 AND {high} >= {low} THEN list_filter(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1), lambda i: tag[i] IN ('DET', 'ADJ', 'NOUN')) ELSE [] END AS {name}_at FROM {source}),
{name}2 AS (SELECT *, {name}_at[1] AS {name}_first, list_filter({name}_at, lambda i: i > {name}_at[1] AND tag[i] = 'DET')[1] AS {name}_next FROM {name}1),
{name}3 AS (SELECT *, len(list_filter({name}_at, lambda i, k: i - k + 1 = {name}_first AND ({name}_next IS NULL OR i < {name}_next))) AS {name}_n FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN {name}_n > 0 THEN rtrim(array_to_string(w[{name}_first:{name}_first + {name}_n - 1], ' '), '.,') ELSE '' END AS {name} FROM {name}3)"""


_INV = "(cond OR lead_)"
ORACLES["template_slots"] = f"""WITH sent AS ({SENT}),
a AS (SELECT req_no, text AS s, regexp_extract_all(text, '[{W}\\-()''".°,]+') AS w, ({COND}) AS cond, regexp_extract(text, '{P.VERB}', 1) || regexp_extract(text, '{P.VERB}', 3) AS verb,
  CASE WHEN contains(text, '{P.OFFER}') THEN '{P.OFFER}' WHEN contains(text, '{P.ABLE}') THEN '{P.ABLE}' ELSE '' END AS path, CASE WHEN contains(text, '{P.OFFER}') THEN regexp_extract(text, '([{W}]+) die Möglichkeit', 1) ELSE '' END AS actor FROM sent),
b AS (SELECT *, list_transform(w, lambda x: {L.pos_sql("rtrim(x, '.,)')")}) AS tag, coalesce(list_filter(w, lambda x: list_contains([{L.sql_list(L.MODALS)}], rtrim(x, '.')))[1], '') AS modal FROM a),
c AS (SELECT *, CASE WHEN modal = '' THEN 0 ELSE coalesce(list_position(w, modal), 0) END AS m, NOT cond AND coalesce(tag[1] IN ('ADP', 'ADV', 'VERB'), false) AS lead_ FROM b),
c2 AS (SELECT *, coalesce(m > 0 AND tag[m + 1] = 'ADP', false) AS adp FROM c),
{_chunk_sql('sys', f'(CASE WHEN {_INV} THEN m + 1 ELSE 1 END)', f'(CASE WHEN {_INV} THEN len(w) ELSE m - 1 END)', 'c2')},
{_chunk_sql('near', '(CASE WHEN adp THEN m + 2 ELSE 1 END)', '(CASE WHEN adp THEN len(w) ELSE 0 END)', 'sys4')},
d AS (SELECT *, CASE WHEN {_INV} THEN modal ELSE sys END AS x, CASE WHEN {_INV} THEN sys ELSE modal END AS y FROM near4),
e AS (SELECT *, instr(s, x) AS begin_, substr(s, instr(s, x)) AS after_ FROM d), e2 AS (SELECT *, instr(substr(after_, length(x) + 1), y) AS gap FROM e),
g AS (SELECT *, CASE WHEN x <> '' AND y <> '' AND begin_ > 0 AND gap > 0 THEN left(after_, length(x) + gap + length(y) - 1) ELSE '' END AS anchor FROM e2),
h AS (SELECT *, CASE WHEN anchor = '' THEN 1 ELSE instr(s, anchor) END AS at_ FROM g), h2 AS (SELECT *, substr(s, CASE WHEN path <> '' THEN instr(s, path) + length(path) ELSE at_ + length(anchor) END) AS tail FROM h),
k AS (SELECT *, CASE WHEN verb <> '' THEN instr(tail, verb) ELSE 0 END AS till FROM h2), k2 AS (SELECT *, CASE WHEN anchor <> '' AND till > 1 THEN left(tail, till - 1) ELSE '' END AS body FROM k),
l AS (SELECT *, CASE WHEN lead_ AND body <> '' THEN left(s, at_ - 1) ELSE '' END AS front FROM k2)
SELECT req_no, CASE WHEN modal <> '' AND cond AND anchor <> '' AND at_ > 1 THEN left(s, greatest(at_ - 3, 0)) ELSE '' END AS condition, modal AS modal_verb, CASE WHEN modal <> '' THEN sys ELSE '' END AS system_name,
  CASE WHEN modal <> '' THEN actor ELSE '' END AS actor, CASE WHEN modal <> '' THEN {_trim_sql('body')} || front ELSE '' END AS object_complement, CASE WHEN modal <> '' THEN verb ELSE '' END AS verb, lead_ AS leading_details,
  CASE WHEN modal = '' THEN '' WHEN front <> '' THEN front WHEN near <> '' THEN w[m + 1] || ' ' || near ELSE '' END AS details_verb, modal <> '' AND sys <> '' AS is_conformant FROM l"""


@query("unknown_proper_nouns", f"""WITH {STOK}, lex AS (SELECT DISTINCT term AS word FROM ({tok('benchmark', 'item_id')})), u AS (SELECT *, term NOT IN (SELECT word FROM lex) AS unknown FROM tagged)
SELECT term, CASE WHEN unknown AND regexp_matches(term, '^[{G.CAPITALS}]') THEN 'NP00000' ELSE tag END AS tag, CASE WHEN NOT unknown THEN lemma WHEN regexp_matches(term, '^[{G.CAPITALS}]') THEN lower(term) ELSE '<unknown>' END AS lemma, count(*) AS n FROM u GROUP BY ALL""")
def _(t):
    known = K.candidates(general(t)).select(F.col("term").alias("word")).distinct().withColumn("__known", F.lit(True))
    rows = tagged(t).join(known, F.col("term") == F.col("word"), "left").withColumn("lemma", F.when(F.col("__known"), F.col("lemma")).otherwise(F.lit("<unknown>")))
    return G.unknown_proper_nouns(rows).groupBy("term", "tag", "lemma").agg(F.count("*").alias("n"))


@query("verb_repair", f"""WITH p AS (SELECT doc_id AS req_no, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PUNCT}') AS ts FROM documents)),
g AS (SELECT *, CASE WHEN regexp_matches(term, '^[.,;:!?]$') THEN '$' WHEN regexp_matches(term, '^(muss|müssen|soll|sollen|wird|werden)$') THEN 'VMFIN' WHEN {L.pos_sql('term')} = 'VERB' THEN 'VVFIN' ELSE 'X' END AS tag, regexp_matches(term, '^[.,;:!?]$') AS stop FROM p),
c AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY req_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clause, coalesce(lead(stop) OVER (PARTITION BY req_no ORDER BY pos), true) AS ends FROM g),
d AS (SELECT *, coalesce(max(CASE WHEN tag IN ('VVFIN', 'VMFIN', 'VAFIN') THEN 1 ELSE 0 END) OVER (PARTITION BY req_no, clause ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM c)
SELECT req_no, CAST(pos AS INTEGER) AS pos, term, CASE WHEN tag = 'VVFIN' AND seen AND ends AND ends_with(term, 'n') THEN 'VVINF' ELSE tag END AS tag FROM d WHERE tag <> 'X'""")
def _(t):
    rows = reqs(t).select("req_no", F.posexplode(G.punctuation_tokens(F.col("text"))).alias("pos", "term"))
    tag = F.when(F.col("term").rlike("^[.,;:!?]$"), "$").when(F.col("term").isin(L.MODALS), "VMFIN").when(L.pos_tag(F.col("term")) == "VERB", "VVFIN").otherwise("X")
    return G.repaired_verbs(rows.withColumn("tag", tag)).where("tag <> 'X'")


@query("tagger_steps", "SELECT lang, language, place, step, n AS documents FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) JOIN (VALUES " + ", ".join(f"('{c}', '{k}', {i}, '{x}')" for c, k in G.CHAINS.items() for i, x in enumerate(G.STEPS[k])) + ") v(code, language, place, step) ON code = lang")
def _(t):
    return G.steps_table(t("documents"))


@query("process_lines", f"""WITH sent AS ({SENT}), w AS (SELECT req_no, string_split_regex(text, '[ \t\n\x0B\f\r]+') AS ws FROM sent), u AS (SELECT req_no, unnest(ws) AS line, unnest(range(0, len(ws))) AS pos FROM w)
SELECT req_no AS id, CAST(pos AS INTEGER) AS pos, line FROM u""")
def _(t):
    """Each sentence through a process that prints a line for each word."""
    return G.piped(sentence_units(t), ["sed", "-u", "s/ /\\n/g"], "text", "req_no").select("id", "pos", "line")


def _sweep(t):
    gold = t("embeddings").select(F.col("label").cast("string").alias("cluster"), F.col("vec_id").alias("node"))
    points = C.threshold_sweep(t("embeddings"), "label", "vec_id", "embedding", [0.05, 0.115, 0.2])
    return E.sweep_scores(points.select("threshold", F.concat_ws("-", "label", "cluster").alias("cluster"), F.col("vec_id").alias("node")), gold, "threshold")


@query("threshold_omega")
def _(t):
    return _sweep(t)


@query("best_threshold")
def _(t):
    return E.best_point(_sweep(t), "omega", "threshold")


@query("overlapping_omega", """WITH a AS (SELECT DISTINCT o_custkey AS node, o_orderstatus AS c FROM orders), b AS (SELECT DISTINCT o_custkey AS node, o_orderpriority AS c FROM orders),
la AS (SELECT node, list(c ORDER BY c) AS s FROM a GROUP BY node), lb AS (SELECT node, list(c ORDER BY c) AS s FROM b GROUP BY node), kind AS (SELECT la.s AS s1, lb.s AS s2, count(*) AS m FROM la JOIN lb USING (node) GROUP BY ALL), n AS (SELECT *, row_number() OVER () AS id FROM kind),
p AS (SELECT len(list_intersect(x.s1, y.s1)) AS n1, len(list_intersect(x.s2, y.s2)) AS n2, CASE WHEN x.id = y.id THEN x.m * (x.m - 1) / 2.0 ELSE CAST(x.m AS DOUBLE) * y.m END AS w FROM n x JOIN n y ON x.id <= y.id),
t AS (SELECT n1, n2, sum(w) AS w FROM p WHERE w > 0 GROUP BY ALL), tot AS (SELECT sum(w) AS pairs, least(max(n1), max(n2)) AS top FROM t),
o AS (SELECT sum(w) / any_value(pairs) AS observed FROM t, tot WHERE n1 = n2 AND n1 <= top), h1 AS (SELECT n1 AS n, sum(w) AS w FROM t GROUP BY n1), h2 AS (SELECT n2 AS n, sum(w) AS w FROM t GROUP BY n2),
e AS (SELECT sum(h1.w / pairs * (h2.w / pairs)) AS expected FROM h1 JOIN h2 USING (n), tot WHERE n <= top) SELECT round(observed, 9) AS observed, round(expected, 9) AS expected, round((observed - expected) / (1 - expected), 9) AS omega FROM o, e""")
def _(t):
    of = lambda c: t("orders").select(F.col(c).alias("cluster"), F.col("o_custkey").alias("node")).distinct()
    parts = E.omega_parts(of("o_orderstatus"), of("o_orderpriority"))
    o = E.omega(parts)
    return parts.crossJoin(F.broadcast(o)).select(F.round("observed", 9).alias("observed"), F.round("expected", 9).alias("expected"), F.round("omega", 9).alias("omega"))


_WITH_MARKS = "[\\p{L}]+(?:[''’´-][\\p{L}]+)*"


def _clitics(language: str) -> None:
    before, behind = T.CLITICS[language]
    quote = lambda x: x.replace("'", "''")
    group = lambda k: f"regexp_extract(word, '(?i){quote(T.clitic_pattern(language))}', {k})"
    parts = lambda k, x: f"regexp_extract_all({group(k)}, '(?i){quote(x)}')" if x else "[]"

    @query(f"clitics_{language}", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WITH_MARKS}')) AS word FROM documents)
SELECT word, array_to_string({parts(1, before)} || [{group(2)}] || {parts(3, behind)}, ' ') AS parts FROM w""")
    def _(t):
        word = t("documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WITH_MARKS.replace("''", "'")), F.lit(0))).alias("word")).distinct()
        return word.select("word", F.array_join(T.split_clitics(F.col("word"), language), " ").alias("parts"))


for _language in T.CLITICS:
    _clitics(_language)


@query("unknown_words", f"SELECT term, count(*) AS n FROM ({TOK}) WHERE term NOT IN (SELECT term FROM ({tok('conversations', 'conv_id')})) GROUP BY term")
def _(t):
    return S.frequencies(K.unknown_words(K.candidates(reqs(t)), K.candidates(domain(t)).select("term").distinct())).withColumnRenamed("abs_freq", "n")


@query("gated_language", f"SELECT doc_id, detected FROM ({LANG}) WHERE detected IS NOT NULL")
def _(t):
    # Rows that the gate would refuse are left out first.
    known = t("documents").where(K.language(F.col("text")).isNotNull())
    return known.select("doc_id", K.gated_language(F.col("text")).alias("detected"))


@query("adposition_terms", f"WITH {STOK}, p AS (SELECT term || ' ' || lead(term) OVER (PARTITION BY req_no ORDER BY pos) AS pair FROM tok) SELECT pair, count(*) AS n FROM p WHERE pair IS NOT NULL AND {L.pos_sql("split_part(pair, ' ', 1)")} <> 'ADP' GROUP BY pair")
def _(t):
    ws = sentence_units(t).select(T.main_tokens(T.mask_digits(F.col("text"))).alias("ws"))
    # The first word goes along: cut out of the pair, it would be cut again for each ending that its tag looks at.
    first = F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0)))
    pairs = ws.select(F.explode(F.arrays_zip(first.alias("first"), T.ngrams(F.col("ws"), 2).alias("pair"))).alias("x"))
    return pairs.where(L.pos_tag(F.col("x.first")) != "ADP").groupBy("x.pair").agg(F.count("*").alias("n"))


@query("word_number_rank", f"WITH {STOK}, {_RUNS}, c AS (SELECT DISTINCT chunk FROM runs WHERE nouns = 1) SELECT chunk, CAST(len(string_split(chunk, ' ')) AS INTEGER) AS words, row_number() OVER (ORDER BY len(string_split(chunk, ' ')), chunk) - 1 AS place FROM c")
def _(t):
    chunk = K.noun_runs(tagged(t)).select(F.col("chunk").alias("term")).distinct()
    # Fewest words first: the order by frequency of the negative number of words.
    ranked = S.by_frequency(chunk.withColumn("abs_freq", -F.size(F.split("term", " "))))
    return ranked.select(F.col("term").alias("chunk"), (-F.col("abs_freq")).alias("words"), F.col("frequency_order").alias("place"))


_STRIPPED = f"CASE WHEN split_part(chunk, ' ', 1) IN ({L.sql_list([*L.ENGLISH_ARTICLES, *L.GERMAN_ARTICLES])}) THEN replace(chunk, split_part(chunk, ' ', 1) || ' ', '') ELSE chunk END"
_LAST = "string_split(bare, ' ')"


@query("lemma_pairs", f"""WITH {STOK}, {_RUNS}, c AS (SELECT DISTINCT chunk, {_STRIPPED} AS bare FROM runs WHERE nouns = 1)
SELECT 'word' AS kind, term AS surface, lemma FROM tagged WHERE tag IN ('ADJ', 'VERB') UNION SELECT 'chunk', chunk, array_to_string([{L.lemma_sql('w')} for w in string_split(bare, ' ')], ' ') FROM c
UNION SELECT 'split', chunk, array_to_string(list_concat({_LAST}[:-2], [{L.lemma_sql(_LAST + '[-1]')}]), ' ') FROM c""")
def _(t):
    rows = tagged(t)
    word = rows.where("tag in ('ADJ', 'VERB')").select(F.lit("word").alias("kind"), F.col("term").alias("surface"), "lemma")
    chunk = K.noun_runs(rows).select("chunk").distinct().withColumn("bare", T.strip_article(F.col("chunk"), [*L.ENGLISH_ARTICLES, *L.GERMAN_ARTICLES]))
    whole = chunk.select(F.lit("chunk"), "chunk", L.lemma_phrase(F.col("bare")))
    split = chunk.select(F.lit("split"), "chunk", L.lemma_phrase(F.col("bare"), "last"))
    return word.union(whole).union(split).distinct()


@query("compound_split_linking", f"""WITH f AS MATERIALIZED (SELECT term AS e, count(*) AS f FROM ({TOK}) GROUP BY term), long AS MATERIALIZED (SELECT e AS word FROM f WHERE length(e) >= 14),
cut AS MATERIALIZED (SELECT word, k, substr(word, 1, k) AS head, substr(word, k + 1) AS tail FROM (SELECT word, unnest(range(4, length(word) - 3)) AS k FROM long)),
two AS MATERIALIZED (SELECT word, k, 0 AS t, head, tail FROM cut UNION ALL SELECT word, k, 1, left(head, length(head) - 1), tail FROM cut WHERE ends_with(head, 's')),
known AS (SELECT two.*, least(a.f, b.f) AS f FROM two JOIN f a ON a.e = head JOIN f b ON b.e = tail), best AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY word ORDER BY f DESC, k, t) = 1)
SELECT long.word, coalesce(head, long.word) AS head, coalesce(tail, '') AS tail FROM long LEFT JOIN best ON best.word = long.word""")
def _(t):
    freq = S.frequencies(K.candidates(reqs(t)))
    return K.best_split(freq.select(F.col("term").alias("word")), freq, linking="s")


# Machines -----------------------------------------------------------------------


def _sequences(t, words, **columns):
    """(req_no, items): an array of terms of each document as the items of a machine, with more fields of the term."""
    ws = reqs(t).select("req_no", words(F.col("text")).alias("ws"))
    return ws.select("req_no", F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("term"), *[f(w).alias(name) for name, f in columns.items()])).alias("items"))


def _sign_tag(term):
    """A tag by words and signs."""
    verb = F.when(term.rlike("[eln]n$"), F.when(F.length(term) % 2 == 0, "VVFIN").otherwise("VVINF"))
    return F.when(term == ",", "$,").when(term.rlike("^[.;:!?]$"), "$.").when(term.isin(L.MODALS), "VMFIN").when(term.isin("to", "zu", "de"), "PTKZU").otherwise(F.coalesce(verb, F.lit("X")))


@query("verb_tags")
def _(t):
    return X.repaired_verbs(_sequences(t, G.punctuation_tokens, tag=_sign_tag))


@query("joined_numbers")
def _(t):
    return X.joined_numbers(_sequences(t, G.punctuation_tokens))


@query("segment_sentences")
def _(t):
    """Segments of all texts, with sentence marks where a token of punctuation ends one."""
    tag = lambda w: F.when(w.rlike("^<.*>$"), F.lit(None)).when(w.rlike("^[.!?]$"), "SF").otherwise("NNG")
    return X.korean_sentences(_sequences(t, X.korean_segments, tag=tag))


def _chunk_tagged(t):
    return labelled_sentences(t, lambda tag: F.when(tag.isin("DET", "ADJ", "NOUN"), "I-NP").when(tag == "CONJ", "B-COORD").otherwise("O"))


_LINES = f"""WITH {STOK}, n AS (SELECT *, CASE WHEN tag IN ('DET', 'ADJ', 'NOUN') THEN 'NP' WHEN tag = 'CONJ' THEN 'COORD' END AS name FROM tagged),
i AS (SELECT *, CASE WHEN name = 'NP' THEN pos - row_number() OVER (PARTITION BY req_no, name ORDER BY pos) ELSE 1000000 + pos END AS island FROM n),
part AS (SELECT req_no, name, min(pos) AS pos, string_agg(term, chr(10) ORDER BY pos) AS words FROM i GROUP BY req_no, name, island),
lines AS (SELECT req_no, string_agg(CASE name WHEN 'NP' THEN chr(3) || chr(10) || words || chr(10) || chr(2) WHEN 'COORD' THEN chr(5) || chr(10) || words || chr(10) || chr(6) ELSE words END, chr(10) ORDER BY pos) || chr(10) AS s FROM part GROUP BY req_no),
pattern AS (SELECT '(' || chr(3) || chr(10) || '[^' || chr(2) || ']*' || chr(2) || chr(10) || ')(' || chr(5) || chr(10) || '[^' || chr(6) || ']*' || chr(6) || chr(10) || ')(' || chr(3) || chr(10) || '[^' || chr(2) || ']*' || chr(2) || chr(10) || ')' AS p)"""
_DECODED = "replace(replace(replace(replace({0}, chr(3), '<NP>'), chr(2), '</NP>'), chr(5), '<COORD>'), chr(6), '</COORD>')"


@query("chunk_lines", f"{_LINES} SELECT req_no, rtrim({_DECODED.format('s')}, chr(10)) AS lines FROM lines")
def _(t):
    return B.chunk_lines(_chunk_tagged(t), ["NP", "COORD"]).select("req_no", F.array_join("lines", "\n").alias("lines"))


@query("coordinated_phrases", f"""{_LINES} SELECT req_no, rtrim({_DECODED.format("regexp_replace(s, p, chr(3) || chr(10) || '\\1\\2\\3' || chr(2) || chr(10), 'g')")}, chr(10)) AS lines FROM lines, pattern""")
def _(t):
    return B.chunk_lines(_chunk_tagged(t), ["NP", "COORD"]).select("req_no", F.array_join(B.coordinated(F.col("lines")), "\n").alias("lines"))


@query("sentence_trees", f"""WITH {STOK}, i AS (SELECT *, CASE WHEN tag IN ('DET', 'ADJ', 'NOUN') THEN pos - row_number() OVER (PARTITION BY req_no, tag IN ('DET', 'ADJ', 'NOUN') ORDER BY pos) ELSE 1000000 + pos END AS island FROM tagged),
part AS (SELECT req_no, min(pos) AS pos, max(tag) AS tag, string_agg('(' || term || ' ' || tag || ')', ' ' ORDER BY pos) AS ws, island < 1000000 AS np FROM i GROUP BY req_no, island)
SELECT req_no, '(S ' || string_agg(CASE WHEN np THEN '(NP ' || ws || ')' WHEN tag = 'CONJ' THEN '(COORD ' || ws || ')' ELSE ws END, ' ' ORDER BY pos) || ')' AS tree FROM part GROUP BY req_no""")
def _(t):
    return B.sentence_trees(_chunk_tagged(t), ["NP", "COORD"])


# Training -----------------------------------------------------------------------


def _halves(t):
    """Tagged tokens of sentences of even and of odd documents."""
    rows = tagged(t).select("req_no", "pos", "term", "tag", (F.split_part("req_no", F.lit(":"), F.lit(1)).cast("long") % 2).alias("half"))
    rows = written(rows, "halves")
    return rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half")


@query("tagger_scores")
def _(t):
    """How well a tagger trained on even documents tags the odd ones, by tag."""
    learn, test = _halves(t)
    return R.scores(test, R.train(learn))


@query("trained_lemmas")
def _(t):
    """Lemmas of the words of odd documents by rules learned from those of even ones."""
    learn, test = _halves(t)
    pairs = learn.select(F.col("term").alias("surface"), L.lemma(F.col("term")).alias("lemma")).distinct()
    return R.lemmatise(test.select("term"), R.lemma_rules(pairs))
