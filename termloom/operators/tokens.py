"""From texts to token and candidate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import lexicon
from termloom.functions import text as T
from termloom.sources.scratch import written


def requirements(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(req_no, text)"""
    return df.select(F.col(id_col).alias("req_no"), F.col(text_col).alias("text"))


def once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose ``req_no`` no other row has, and those of repeated numbers (None if there are none).

    Only numbers are counted and moved; texts and arrays stay where they are.
    """
    again = written(rows.groupBy("req_no").count().where("count > 1").select(F.col("req_no").alias("__again")), "repeated")
    if again.isEmpty():
        return rows, None
    same = F.col("req_no").eqNullSafe(F.col("__again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def ordinals(df: DataFrame, id_col: str) -> DataFrame:
    """Add a dense 1-based ``ordinal`` by id: a count for each range of ids, then a rank inside it.

    No window runs over the whole table; only one row for each of the ranges does.
    """
    part = df.select("*", F.floor(F.col(id_col) / 4096).alias("__range"))
    sizes = part.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = part.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(id_col)))
    return inside.join(before, "__range").select(*df.columns, (F.col("__before") + F.col("__at")).alias("ordinal"))


def sentences(reqs: DataFrame) -> DataFrame:
    """(req_no, s_no, sentence): parts between full stops and line feeds that are not blank."""
    parts = reqs.select("req_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.\n]", -1)).alias("s_no", "sentence"))
    return parts.select("req_no", "s_no", F.trim("sentence").alias("sentence")).where("sentence <> ''")


def candidates(reqs: DataFrame, mask: bool = True) -> DataFrame:
    """(req_no, pos, term): main tokens, digits masked first."""
    text = T.mask_digits(F.col("text")) if mask else F.col("text")
    return reqs.select("req_no", F.posexplode(T.main_tokens(text)).alias("pos", "term"))


def packed(reqs: DataFrame, **columns) -> DataFrame:
    """(req_no, items): the candidates of each text as an array of structs of ``pos``, ``term`` and columns of the term; texts without any are left out."""
    masked = reqs.select("req_no", T.mask_digits(F.col("text")).alias("text")).where(F.col("text").rlike(T.MAIN))
    words = masked.select("req_no", T.main_tokens(F.col("text")).alias("ws"))
    return words.select("req_no", F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("term"), *[f(w).alias(name) for name, f in columns.items()])).alias("items"))


def total_words(reqs: DataFrame) -> DataFrame:
    """One row: number of main tokens of the unmasked texts."""
    return reqs.agg(F.sum(F.size(T.main_tokens(F.col("text"))).cast("long")).alias("total_words"))


def annotate(tokens: DataFrame, tag=lexicon.pos_tag, lemma=lexicon.lemma) -> DataFrame:
    """Add tag and lemma of ``term`` by any provider of column expressions."""
    return tokens.withColumn("tag", tag(F.col("term"))).withColumn("lemma", lemma(F.col("term")))


def without(tokens: DataFrame, words: list[str] | DataFrame, column: str = "term") -> DataFrame:
    """Tokens that are not in the list (exact case)."""
    if isinstance(words, list):
        return tokens.where(~F.col(column).isin(words))
    return tokens.join(words.toDF("__w"), F.col(column) == F.col("__w"), "left_anti")


def longer_than(tokens: DataFrame, n: int = 1) -> DataFrame:
    return tokens.where(F.length("term") > n)


def unknown_words(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens that the dictionary (one column) does not hold, exact case."""
    return tokens.join(dictionary.toDF("__d"), F.col("term") == F.col("__d"), "left_anti")


def gated_language(text: Column) -> Column:
    """``language``, an error where neither language wins."""
    found = language(text)
    return F.coalesce(found, F.raise_error(F.lit("the language is neither English nor German")))


def reduced_stops(stops: DataFrame, exceptions: DataFrame) -> DataFrame:
    """The stop list without its exceptions."""
    return stops.join(exceptions, stops.columns[0], "left_anti")


def abbreviations(tokens: DataFrame, dictionary: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens in no dictionary whose lower case is no known abbreviation, and all other tokens."""
    d, k = dictionary.toDF("__d"), known.toDF("__k")
    found = tokens.join(d, F.col("term") == F.col("__d"), "left_anti").join(k, F.lower("term") == F.col("__k"), "left_anti")
    return found, tokens.join(found.select("term").distinct(), "term", "left_anti")


def verbs(annotated: DataFrame, negative: list[str]) -> DataFrame:
    """(req_no, lemma) of verbs, once for each requirement."""
    return annotated.where((F.col("tag") == "VERB") & ~F.col("lemma").isin(negative)).select("req_no", "lemma").distinct()


def adjectives(annotated: DataFrame, negative: list[str]) -> DataFrame:
    return annotated.where((F.col("tag") == "ADJ") & ~F.col("term").isin([*negative, "gem", "muss"])).select("req_no", "pos", "term")


def linked_verbs(annotated: DataFrame, word: str = "und") -> DataFrame:
    """(req_no, term): two verbs around a conjunction, as lemmas."""
    w = Window.partitionBy("req_no").orderBy("pos")
    ahead = annotated.select("*", *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("term", "tag", "lemma")])
    return ahead.where((F.col("tag") == "VERB") & (F.col("term1") == word) & (F.col("tag2") == "VERB")).select("req_no", "pos", F.concat_ws(" ", "lemma", F.lit(word), "lemma2").alias("term"))


def trigrams(annotated: DataFrame) -> DataFrame:
    """(req_no, pos, term): noun, determiner or adposition, noun."""
    w = Window.partitionBy("req_no").orderBy("pos")
    ahead = annotated.select("*", *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("term", "tag")])
    return ahead.where((F.col("tag") == "NOUN") & F.col("tag1").isin("DET", "ADP") & (F.col("tag2") == "NOUN")).select("req_no", "pos", F.concat_ws(" ", "term", "term1", "term2").alias("term"))


def noun_runs(annotated: DataFrame) -> DataFrame:
    """(req_no, pos, n, chunk): longest runs of determiners, adjectives and nouns that hold a noun.

    Runs are islands of consecutive places; words of a run are joined in order.
    """
    inside = annotated.where(F.col("tag").isin("DET", "ADJ", "NOUN"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("req_no").orderBy("pos"))
    runs = inside.withColumn("island", island).groupBy("req_no", "island").agg(
        F.min("pos").alias("pos"), F.count("*").alias("n"), F.max((F.col("tag") == "NOUN").cast("int")).alias("nouns"), F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("words")
    )
    return runs.where("nouns = 1").select("req_no", "pos", "n", F.array_join(F.transform("words", lambda x: x["term"]), " ").alias("chunk"))


def noun_chunks(items: Column) -> Column:
    """The chunks of ``noun_runs`` in an array of tokens (term, tag) without gaps; terms hold neither NUL nor SOH."""
    word = lambda x: F.when(x["tag"].isin("DET", "ADJ", "NOUN"), F.concat(F.when(x["tag"] == "NOUN", "\x01").otherwise(""), x["term"], F.lit(" "))).otherwise("\x00")
    runs = F.filter(F.split(F.array_join(F.transform(items, word), ""), "\x00"), lambda r: F.contains(r, F.lit("\x01")))
    return F.transform(runs, lambda r: F.rtrim(F.translate(r, "\x01", "")))


def clean_chunk(chunk: Column) -> Column:
    """A chunk without article, parentheses and punctuation."""
    bare = T.strip_article(chunk, [*lexicon.ENGLISH_ARTICLES, *lexicon.GERMAN_ARTICLES])
    return T.words_hyphen(T.strip_parentheses(bare))


def rebuilt(candidates_: DataFrame, reqs: DataFrame) -> DataFrame:
    """(req_no, sentence): candidates joined in order with a trailing blank; '' without any."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"])
    joined = candidates_.groupBy("req_no").agg(F.concat(F.array_join(words, " "), F.lit(" ")).alias("sentence"))
    return reqs.select("req_no").join(joined, "req_no", "left").select("req_no", F.coalesce("sentence", F.lit("")).alias("sentence"))


def rebuilt_texts(reqs: DataFrame) -> DataFrame:
    """As ``rebuilt`` with all candidates of each text, made inside its row."""
    words = T.main_tokens(T.mask_digits(F.col("text")))
    return reqs.select("req_no", F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" "))), "").alias("sentence"))


def language(text: Column) -> Column:
    """'EN' or 'DE' by distinct marker words between white space; null on a tie."""
    words = F.array_distinct(T.split_blank(text))
    en = F.size(F.array_intersect(words, F.array(*map(F.lit, lexicon.ENGLISH_MARKERS))))
    de = F.size(F.array_intersect(words, F.array(*map(F.lit, lexicon.GERMAN_MARKERS))))
    return F.when(en > de, "EN").when(de > en, "DE")


def corpus_language(reqs: DataFrame) -> DataFrame:
    """One row: language of the first requirement."""
    return reqs.agg(F.min_by(language(F.col("text")), F.col("req_no")).alias("corpus_lang"))


def plural_in_lexicon(terms: DataFrame, lexicon_: DataFrame) -> DataFrame:
    """(term, base): terms of 3 to 13 characters without their last ``s`` where the lexicon (word) holds the rest."""
    cut = F.when((F.length("term") < 14) & (F.length("term") > 2) & F.col("term").endswith("s"), F.left("term", F.length("term") - 1))
    known = lexicon_.select(F.col("word").alias("__base")).distinct()
    return terms.withColumn("__base", cut).join(known.withColumn("__known", F.lit(True)), "__base", "left").select("term", F.when(F.col("__known"), F.col("__base")).otherwise(F.col("term")).alias("base"))


def best_split(words: DataFrame, lexicon_: DataFrame, least: int = 14, part: int = 4, linking: str = "") -> DataFrame:
    """(word, head, tail): long words cut where both parts are known.

    ``lexicon_`` has (entry, f); the cut with the larger smaller frequency wins,
    then the earlier one.  A head that is known without the ``linking`` letters
    at its end stands there without them; as it is, it wins a tie.  A word
    without such a cut keeps itself as head.
    """
    long = words.where(F.length("word") >= least).distinct()
    cuts = long.select("word", F.explode(F.sequence(F.lit(part), F.length("word") - part)).alias("k"))
    cuts = cuts.select("word", "k", F.expr("substr(word, 1, k)").alias("head"), F.expr("substr(word, k + 1)").alias("tail"))
    if linking:
        bare = F.when(F.col("head").endswith(linking) & (F.length("head") > len(linking)), F.left("head", F.length("head") - len(linking)))
        cuts = cuts.select("word", "k", F.posexplode(F.array_compact(F.array("head", bare))).alias("trimmed", "head"), "tail")
    else:
        cuts = cuts.withColumn("trimmed", F.lit(0))
    a, b = lexicon_.toDF("head", "f1"), lexicon_.toDF("tail", "f2")
    known = cuts.join(a, "head").join(b, "tail").withColumn("f", F.least("f1", "f2"))
    best = known.groupBy("word").agg(F.max_by(F.struct("head", "tail"), F.struct("f", (-F.col("k")).alias("k"), (-F.col("trimmed")).alias("t"))).alias("cut"))
    return long.join(best, "word", "left").select("word", F.coalesce("cut.head", "word").alias("head"), F.coalesce("cut.tail", F.lit("")).alias("tail"))


def split_recursively(words: DataFrame, lexicon_: DataFrame, rounds: int | None = None, **options) -> DataFrame:
    """(word, parts): cuts repeated on long parts until none changes, or ``rounds`` times.

    Parts are entries of the lexicon, so the cuts of all words and entries are
    found once; a round looks up the parts in that table.
    """
    lexicon_ = written(lexicon_, "lexicon")
    entry = lexicon_.columns[0]
    every = words.select("word").unionByName(lexicon_.select(F.col(entry).alias("word")))
    cuts = written(best_split(every, lexicon_, **options).where("tail <> ''").withColumnRenamed("word", "piece"), "cuts")
    now = written(words.select("word", F.col("word").alias("piece"), F.array(F.lit(0)).alias("path"), F.lit(True).alias("new")).distinct(), "parts")
    turn = 0
    # Each cut shortens its parts, so this ends.
    while (rounds is None or turn < rounds) and not now.where("new").isEmpty():
        turn += 1
        joined = now.join(cuts, "piece", "left")
        pair = F.when(F.col("head").isNull(), F.array(F.struct(F.lit(0).alias("side"), F.col("piece").alias("piece"), F.lit(False).alias("new")))).otherwise(
            F.array(F.struct(F.lit(0).alias("side"), F.col("head").alias("piece"), F.lit(True).alias("new")), F.struct(F.lit(1).alias("side"), F.col("tail").alias("piece"), F.lit(True).alias("new")))
        )
        cut = joined.select("word", "path", F.explode(pair).alias("x"))
        now = written(cut.select("word", F.col("x.piece").alias("piece"), F.concat("path", F.array("x.side")).alias("path"), F.col("x.new").alias("new")), "parts")
    return now.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "piece"))), lambda x: x["piece"]), " ").alias("parts"))
