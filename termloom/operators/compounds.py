"""Splitting compounds by how the letters of a vocabulary begin and end words.

``gram_table`` counts every n-gram of letters of the distinct words: in all, at a
word's beginning and at its end.  A cut is good where what follows it is often
the beginning of words and seldom their inside, and what precedes it is often
their end.  Each side is judged by its longest n-gram that another word holds
too, so rare spellings back off to shorter ones; a word's own occurrence never
counts.

Defined cases: null words are left out, repeated words count once, case does not
matter.  With an empty vocabulary no word is cut.  Of equally good cuts the first
wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import lexicon
from termloom.functions import text as T
from termloom.sources.scratch import written

#: Lengths of n-grams.
SHORTEST, LONGEST = 3, 8
#: Words from this length on are cut, into parts of at least so many letters.
LONG, PART = 14, 4
#: A word whose best cut scores below this stays whole; at exactly NONE its first part stands for it.
KEEP, NONE = -0.6, 0.0
#: What a side counts as that no other word knows: never a beginning and always inside; never an end.
NO_START, NO_END = -2.0, -1.0


def gram_table(vocabulary: DataFrame, word: str = "word", shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(gram, total, begins, ends): occurrences of n-grams in the distinct words."""
    words = vocabulary.select(F.lower(word).alias("w")).where(F.length("w") >= shortest).distinct()
    at = words.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - (shortest - 1))).alias("p"))
    grams = at.select("w", "p", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("w") - F.col("p") + 1))).alias("n"))
    grams = grams.select(F.expr("substr(w, p, n)").alias("gram"), (F.col("p") == 1).cast("long").alias("b"), (F.col("p") + F.col("n") - 1 == F.length("w")).cast("long").alias("e"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("total"), F.sum("b").alias("begins"), F.sum("e").alias("ends"))


def scored_cuts(words: DataFrame, grams: DataFrame, word: str = "word", least: int = LONG, part: int = PART, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(word, k, score): every cut of the long words after k letters of which a side is known."""
    long = words.select(F.col(word).alias("word")).where(F.length("word") >= max(least, 2 * part)).distinct()
    cuts = long.select("word", F.lower("word").alias("w"), F.explode(F.sequence(F.lit(part), F.length("word") - part)).alias("k"))
    sized = cuts.select("*", F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("n"))
    sides = F.array(
        F.when(F.col("k") + F.col("n") <= F.length("w"), F.struct(F.lit(True).alias("after"), F.expr("substr(w, k + 1, n)").alias("gram"))),
        F.when(F.col("n") <= F.col("k"), F.struct(F.lit(False).alias("after"), F.expr("substr(w, k - n + 1, n)").alias("gram"))),
    )
    asked = sized.select("word", "k", "n", F.explode(F.array_compact(sides)).alias("x")).select("word", "k", "n", "x.after", "x.gram")
    # An n-gram of one occurrence is known from the word alone.
    known = asked.join(grams.where("total > 1"), "gram")
    others = F.col("total") - 1
    start = F.max_by(F.when(F.col("after"), F.col("begins") / others), F.when(F.col("after"), F.col("n")))
    end = F.max_by(F.when(~F.col("after"), F.col("ends") / others), F.when(~F.col("after"), F.col("n")))
    best = known.groupBy("word", "k").agg(start.alias("start"), end.alias("end"))
    # Rounded, so that fractions that cancel give 0.0 and not almost, or minus, zero.
    score = F.coalesce(2 * F.col("start") - 1, F.lit(NO_START)) + F.coalesce("end", F.lit(NO_END))
    return best.select("word", "k", (F.round(score, 9) + F.lit(0.0)).alias("score"))


def best_cuts(words: DataFrame, grams: DataFrame, **options) -> DataFrame:
    """(word, k, score): the best cut of each long word that has one."""
    cuts = scored_cuts(words, grams, **options)
    return cuts.groupBy("word").agg(F.max_by(F.struct("k", "score"), F.struct("score", (-F.col("k")).alias("k"))).alias("c")).select("word", "c.k", "c.score")


def inner_capital(word: Column) -> Column:
    """A stand-in for a tagger's proper nouns: a capital and, later, another one."""
    return word.rlike(r"^\p{Lu}.*\p{Lu}")


def parts_of(word: Column, k: Column, score: Column, proper: Callable[[Column], Column] = inner_capital) -> Column:
    """The parts that a scored cut makes: the first alone, the whole word, or both without a linking ``s``."""
    bare = lambda p: F.when(p.endswith("s") & ~proper(p), F.left(p, F.length(p) - 1)).otherwise(p)
    head, tail = F.substring(word, F.lit(1), k), F.substring(word, k + 1, F.length(word))
    return F.when(score.isNull() | (score < KEEP), F.array(word)).when(score == NONE, F.array(head)).otherwise(F.array(bare(head), bare(tail)))


def split_once(words: DataFrame, grams: DataFrame, proper: Callable[[Column], Column] = inner_capital, **options) -> DataFrame:
    """(word, score, parts) of the distinct long words; the score is null where no side of any cut is known."""
    least = options.get("least", LONG)
    long = words.select("word").where(F.length("word") >= least).distinct()
    return long.join(best_cuts(long, grams, **options), "word", "left").select("word", "score", parts_of(F.col("word"), F.col("k"), F.col("score"), proper).alias("parts"))


def split_wholly(phrases: DataFrame, grams: DataFrame, phrase: str = "term", noun: Callable[[Column], Column] | None = None, proper: Callable[[Column], Column] = inner_capital, **options) -> DataFrame:
    """(phrase, parts): every word of the distinct phrases cut until nothing changes.

    A hyphen at a word's end, else at its beginning, goes; a shorter word loses a
    final ``s`` where the rest is a noun; a long one is cut as ``split_once``
    does; then all parts are looked at again.  Each change shortens a part, so
    this ends.
    """
    noun = noun or (lambda w: lexicon.pos_tag(w) == "NOUN")
    least = options.get("least", LONG)
    one = phrases.select(F.col(phrase).alias("phrase")).where(F.col("phrase").isNotNull()).distinct()
    now = written(one.select("phrase", F.posexplode(T.split_blank(F.col("phrase"))).alias("i", "piece")).select("phrase", F.array("i").alias("path"), "piece", F.lit(True).alias("new")), "compound-parts")
    while not now.where("new").isEmpty():
        pieces = now.where("new").select("piece").distinct()
        trimmed = written(pieces.select("piece", T.trim_hyphen(F.col("piece")).alias("word")), "compound-pieces")
        cuts = best_cuts(trimmed.select("word"), grams, **options)
        base = F.left("word", F.length("word") - 1)
        short = F.when((F.length("word") > 1) & F.col("word").endswith("s") & noun(base), F.array(base)).otherwise(F.array("word"))
        parts = F.when(F.length("word") < least, short).otherwise(parts_of(F.col("word"), F.col("k"), F.col("score"), proper))
        made = written(trimmed.join(cuts, "word", "left").select("piece", parts.alias("parts")).where((F.size("parts") > 1) | (F.element_at("parts", 1) != F.col("piece"))), "compound-cuts")
        joined = now.join(made.withColumn("new", F.lit(True)), ["piece", "new"], "left")
        same = F.array(F.struct(F.lit(0).alias("i"), F.col("piece").alias("piece"), F.lit(False).alias("new")))
        more = F.transform("parts", lambda p, i: F.struct(i.cast("int").alias("i"), p.alias("piece"), F.lit(True).alias("new")))
        now = written(joined.select("phrase", "path", F.explode(F.when(F.col("parts").isNull(), same).otherwise(more)).alias("x")).select("phrase", F.concat("path", F.array("x.i")).alias("path"), "x.piece", "x.new"), "compound-parts")
    words = F.transform(F.array_sort(F.collect_list(F.struct("path", "piece"))), lambda x: x["piece"])
    done = now.where("piece <> ''").groupBy("phrase").agg(F.array_join(words, " ").alias("parts"))
    return one.join(done, "phrase", "left").select("phrase", F.coalesce("parts", F.lit("")).alias("parts"))
