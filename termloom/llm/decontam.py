"""Benchmark decontamination with a distributed positional inverted index.

Only DataFrame operations are used.  The index stores a posting (term, row,
pos) for every place in the training texts of a word that some test item uses,
and a marker posting at the end of every document, which carries its id and
length.  It is written once and read by every later step.

Search: of each window of an item the two rarest terms are chosen by their
frequency in the index.  Their lists are intersected after subtracting the
terms' offsets, which gives alignments (row, item, delta).  An alignment is
then intersected with the lists of all words of the item at delta + i; a run of
consecutive matches as long as a window is an exact occurrence.  Hit words are
the union of the runs, so overlapping windows need no expansion.

``proximity_matches`` reports places where all terms of a query lie within a
given number of words.

Terms, windows and item words are broadcast only if counting shows that they
are few; otherwise the same joins shuffle.

Defined cases: null texts have no words; an item without words matches
nothing, one of fewer than ``window`` words is one window.  Equal rows are
reported alike, once for each.  Items are told apart by id and text: two texts
of one id are two items, whose id is listed once; a repeated item is one.  A null item id adds hits but no id.  An empty
benchmark or table gives documents without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm._store import small, stored

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\u0000"  # not a word: a separator


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; other letters stay as they are."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _items(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, item_id, ws, width): items that have words."""
    item = benchmark.select(F.xxhash64(id_col, text_col).alias("item"), F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    return item.select("*", F.least(F.size("ws"), F.lit(window)).alias("width")).distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, row, pos, doc) of the words in ``vocabulary`` (word).

    ``row`` is xxhash64 of id and text, ``term`` xxhash64 of the word.  A row
    with a null term marks the end of a document: pos is its number of words.
    """
    known = vocabulary.select("word").unionByName(docs.sparkSession.createDataFrame([(_END,)], "word string"))
    tokens = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(id_col, text_col).alias("row"), F.posexplode(F.concat(words(F.col(text_col)), F.array(F.lit(_END)))).alias("pos", "word")
    )
    end = F.col("word") == _END
    found = tokens.join(small(known), "word").select(F.when(~end, F.xxhash64("word")).alias("term"), "row", "pos", F.when(end, F.col("doc")).alias("doc"))
    return stored(found, "postings")


def phrase_runs(index: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item, item_id, lo, hi): runs of words, at least one window long, that match consecutive words of an item."""
    postings = index.where("term is not null").select("term", "row", "pos")
    freq = stored(postings.groupBy("term").agg(F.count("*").alias("f")), "frequencies")
    word = items.select("item", "item_id", "width", F.posexplode("ws").alias("i", "w")).select("item", "item_id", "width", "i", F.xxhash64("w").alias("term"))
    word = stored(word.join(small(freq), "term", "left"), "item-words")
    starts = items.select("item", "width", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("width"))).alias("s"))
    inside = starts.join(word.select("item", "i", "term", "f"), "item").where("i >= s and i < s + width")
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("item", "s").orderBy(F.coalesce("f", F.lit(0)), "i")))
    chosen = ranked.where("r <= 2").groupBy("item", "s").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.min(F.coalesce("f", F.lit(0))).alias("least"))
    pivots = chosen.where("least > 0").select("item", "a", "b").distinct()
    asked = pivots.select("item", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("i")).join(word.select("item", "i", "term"), ["item", "i"])
    asked = stored(asked, "pivots")
    seen = postings.join(small(asked), "term").select("row", "item", "a", "b", "i", (F.col("pos") - F.col("i")).alias("delta"))
    both = seen.groupBy("row", "item", "a", "b", "delta").agg(F.min("i").alias("x"), F.max("i").alias("y")).where("x = a and y = b")
    aligned = stored(both.select("row", "item", "delta").distinct(), "alignments")
    probes = aligned.join(small(word.select("item", "i", "term")), "item").select("row", "item", "delta", "i", "term", (F.col("delta") + F.col("i")).alias("pos")).where("pos >= 0")
    near = postings.join(small(aligned.select("row").distinct()), "row", "left_semi").distinct()
    met = probes.join(near, ["row", "pos", "term"]).select("row", "item", "delta", "i")
    island = F.col("i") - F.row_number().over(Window.partitionBy("row", "item", "delta").orderBy("i"))
    runs = met.withColumn("island", island).groupBy("row", "item", "delta", "island").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    named = runs.join(small(items.select("item", "item_id", "width")), "item").where("last - first + 1 >= width")
    return named.select("row", "item", "item_id", (F.col("delta") + F.col("first")).alias("lo"), (F.col("delta") + F.col("last")).alias("hi"))


def proximity_matches(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(row, query, lo, hi): spans of at most ``within`` words with all terms of a query.

    ``queries`` has columns query and terms (lower-case words); a span is
    reported at each last word, from the earliest word inside the limit.
    """
    asked = queries.select("query", F.explode(F.array_distinct("terms")).alias("w"), F.size(F.array_distinct("terms")).alias("need"))
    asked = asked.select("query", "need", F.xxhash64("w").alias("term"))
    at = index.where("term is not null").join(small(asked), "term")
    frame = Window.partitionBy("row", "query").orderBy("pos").rangeBetween(-(within - 1), 0)
    span = at.select("row", "query", "need", "pos", F.size(F.collect_set("term").over(frame)).alias("have"), F.min("pos").over(frame).alias("lo"))
    return span.where("have = need").select("row", "query", "lo", F.col("pos").alias("hi")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    items = stored(_items(benchmark, item_id_col, item_text_col, window), "items")
    index = build_index(docs, items.select(F.explode("ws").alias("word")).distinct(), id_col, text_col)
    runs = stored(phrase_runs(index, items), "runs")
    before = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce(F.max("hi").over(before), F.lit(-1)))
    hit = runs.select("row", "lo", "hi").distinct().select("row", F.greatest(new, F.lit(0)).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    of = runs.select("row", "item", "item_id").distinct().groupBy("row").agg(F.countDistinct("item").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("ids"))
    ends = index.where("term is null").select(F.col("doc").alias("doc_id"), "row", F.col("pos").cast("long").alias("n_words"))
    joined = ends.join(hit.join(of, "row"), "row", "left")
    return joined.select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all columns."""
    bad = stored(contamination(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.col("row").alias("__row")).distinct(), "contaminated")
    return docs.withColumn("__row", F.xxhash64(id_col, text_col)).join(small(bad), "__row", "left_anti").drop("__row")


def op7_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text")).drop("row")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), win AS (
  SELECT DISTINCT iid, item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, s, s + least(10, len(ws)) - 1), ' ') AS phrase
  FROM (SELECT iid, item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)
), widths AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT rid, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS phrase
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, widths WHERE len(ws) >= n)
), found AS (
  SELECT rid, p, w.n, iid, item_id FROM dwin JOIN win w ON w.n = dwin.n AND w.phrase = dwin.phrase
), hit AS (
  SELECT rid, count(DISTINCT i) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS i FROM (SELECT DISTINCT rid, p, n FROM found)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, iid, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON h.rid = d.rid LEFT JOIN items i ON i.rid = d.rid
"""
