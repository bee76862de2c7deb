"""A tagger and a lemmatiser that are trained on a supplied table.

Tags follow a bigram model: the probability of a tag after the one before it,
and of a word given its tag.  A word that training has not seen is judged by its
longest known ending.  Counts are aggregations; each distinct word gets one row
with a score for every tag; the best sequence is found by dynamic programming
over whole batches of sequences, one place after another.

A lemma is made by the rule of a word's longest known ending: cut so many
letters, append some.  Rules are counted over (surface, lemma) pairs.

Defined cases: null terms and tags are not trained on; a null term is tagged
like a word with no known ending.  Of equally good tags or rules the first in
order wins.  Without training data tags are null and lemmas are the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termloom.operators import evaluate as E
from termloom.sources.scratch import written

#: Longest ending that is learned, and what is added to counts of pairs of tags.
ENDING, SMOOTH = 5, 0.1


@dataclass
class Tagger:
    tags: list[str]
    first: np.ndarray  # log probability of a tag at the beginning
    follow: np.ndarray  # of a tag (column) after another (row)
    words: DataFrame  # (term, scores)
    endings: DataFrame  # (ending, scores)


def _endings(word: Column) -> Column:
    """All endings of a word up to ``ENDING`` letters, the empty one too, lower-cased, the longest first."""
    low = F.lower(F.coalesce(word, F.lit("")))
    return F.transform(F.sequence(F.least(F.lit(ENDING), F.length(low)), F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.right(low, n)))


def _scores(counts: DataFrame, key: str, tags: list[str], shares: dict[str, float]) -> DataFrame:
    """(key, scores): the log of P(tag | key) / P(tag) for each tag of the tagset, -30 where it never occurs."""
    total = F.sum("n").over(Window.partitionBy(key))
    share = F.create_map(*[F.lit(x) for t in tags for x in (t, shares[t])])
    rated = counts.withColumn("s", F.log(F.col("n") / total / share[F.col("tag")]))
    cell = lambda t: F.coalesce(F.max(F.when(F.col("tag") == t, F.col("s"))), F.lit(-30.0))
    return rated.groupBy(key).agg(F.array(*[cell(t) for t in tags]).alias("scores"))


def train(tagged: DataFrame) -> Tagger:
    """Learn from sequences (req_no, pos, term, tag); the tagset is a small table of its own."""
    known = written(tagged.where("term is not null and tag is not null").select("req_no", "pos", "term", "tag"), "training")
    sizes = {r["tag"]: r["n"] for r in known.groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag").collect()}
    tags, total = list(sizes), sum(sizes.values())
    shares = {t: n / total for t, n in sizes.items()}
    before = known.withColumn("before", F.lag("tag").over(Window.partitionBy("req_no").orderBy("pos")))
    pairs = {(r["before"], r["tag"]): r["n"] for r in before.groupBy("before", "tag").agg(F.count("*").alias("n")).collect()}
    row = lambda b: np.array([pairs.get((b, t), 0) + SMOOTH for t in tags])
    log = lambda x: np.log(x / x.sum()) if len(x) else x
    words = known.groupBy("term", "tag").agg(F.count("*").alias("n"))
    # An ending is judged by distinct words, so that a frequent one does not stand for all.
    endings = words.select("tag", F.explode(_endings(F.col("term"))).alias("ending")).groupBy("ending", "tag").agg(F.count("*").alias("n"))
    if not tags:
        none = known.select(F.col("term"), F.array().cast("array<double>").alias("scores")).limit(0)
        return Tagger([], np.zeros(0), np.zeros((0, 0)), none, none.withColumnRenamed("term", "ending"))
    return Tagger(tags, log(row(None)), np.array([log(row(b)) for b in tags]), written(_scores(words, "term", tags, shares), "tag-words"), written(_scores(endings, "ending", tags, shares), "tag-endings"))


def best_paths(scores: np.ndarray, offs: np.ndarray, first: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The best tag of every place of consecutive sequences; longer ones go on alone when the others have ended."""
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    start, size = offs[:-1][order], size[order]
    live = int(np.searchsorted(-size, 0, "left"))
    back = np.zeros(scores.shape, np.int16)
    out = np.zeros(len(scores), np.int16)
    best = first[None] + scores[start[:live]] if live else np.zeros((0, len(first)))
    ended: list[np.ndarray] = [best]
    for k in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, "left"))
        step = best[:live, :, None] + follow[None]
        came = step.argmax(1)
        best = np.take_along_axis(step, came[:, None], 1)[:, 0] + scores[start[:live] + k]
        back[start[:live] + k] = came
        ended.append(best)
    now = np.zeros(len(size), np.int16)
    for k in range(len(ended) - 1, -1, -1):
        live = int(np.searchsorted(-size, -k, "left"))
        last = size[:live] == k + 1
        now[:live][last] = ended[k][last].argmax(1)
        out[start[:live] + k] = now[:live]
        if k:
            now[:live] = np.take_along_axis(back[start[:live] + k], now[:live, None].astype(np.int64), 1)[:, 0]
    return out


def word_scores(words: DataFrame, model: Tagger) -> DataFrame:
    """(term, scores) of distinct words: their own counts, else those of their longest known ending."""
    own = words.select("term").distinct().join(model.words, "term", "left")
    ends = own.where("scores is null").select("term", F.posexplode(_endings(F.col("term"))).alias("rank", "ending")).join(model.endings, "ending")
    guessed = ends.groupBy(F.coalesce("term", F.lit("")).alias("term")).agg(F.min_by("scores", "rank").alias("scores"))
    return own.where("scores is not null").unionByName(guessed)


def tag(tokens: DataFrame, model: Tagger) -> DataFrame:
    """(req_no, pos, term, tag): the most likely tags of whole sequences."""
    given = tokens.select("req_no", "pos", "term", F.lit(None).cast("string").alias("gold"))
    if not model.tags:
        return given.select("req_no", "pos", "term", F.lit(None).cast("string").alias("tag"))
    return tag_rows(given, model).select("req_no", F.explode(F.arrays_zip("pos", "term", "tag")).alias("z")).select("req_no", "z.pos", "z.term", "z.tag")


def tag_rows(given: DataFrame, model: Tagger) -> DataFrame:
    """(req_no, pos, term, gold, tag): arrays of the tokens (req_no, pos, term, gold) of a sequence and their most likely tags."""
    scored = given.withColumn("__w", F.coalesce("term", F.lit(""))).join(word_scores(given.select(F.coalesce("term", F.lit("")).alias("term")), model).withColumnRenamed("term", "__w"), "__w")
    item = F.struct("pos", "term", "scores", "gold")
    rows = scored.groupBy("req_no").agg(F.array_sort(F.collect_list(item)).alias("x")).select("req_no", F.col("x.pos").alias("pos"), F.col("x.term").alias("term"), F.col("x.gold").alias("gold"), F.flatten("x.scores").alias("scores"))
    schema = StructType([given.schema["req_no"], *StructType.fromDDL("pos array<int>, term array<string>, gold array<string>, tag array<string>").fields])
    names, first, follow = np.array(model.tags, object), model.first, model.follow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, flat = batch.column(1), batch.column(4).flatten().to_numpy().reshape(-1, len(names))
            size = places.value_lengths().to_numpy()
            offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            found = pa.array(names[best_paths(flat, offs, first, follow)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(offs, pa.int32()), found)], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def scores(test: DataFrame, model: Tagger) -> DataFrame:
    """(tag, tp, fp, fn, precision, recall, f_score) of the model on sequences (req_no, pos, term, tag).

    Found and given tags are compared inside the row of a sequence.  Only of
    sequences that give a place twice, whose equal tokens count once, are tokens
    compared as sets.
    """
    if not model.tags:
        rows = test.groupBy("req_no").agg(F.array_sort(F.collect_list(F.struct("pos", "term", F.col("tag").alias("gold")))).alias("x")).select("req_no", "x.pos", "x.term", "x.gold", F.transform("x", lambda _: F.lit(None).cast("string")).alias("tag"))
    else:
        rows = tag_rows(test.withColumnRenamed("tag", "gold"), model)
    rows = written(rows.withColumn("once", F.size("pos") == F.size(F.array_distinct("pos"))), "tagged")
    token = lambda df: df.select("req_no", F.explode(F.arrays_zip("pos", "term", "gold", "tag")).alias("z")).select("req_no", "z.*")
    met = token(rows.where("once")).groupBy("tag", "gold").agg(F.count("*").alias("n"))
    same = F.coalesce(F.col("tag") == F.col("gold"), F.lit(False))
    zero = F.lit(0).cast("long")
    n = lambda x: F.when(x, F.col("n")).otherwise(zero)
    counts = met.select("tag", n(same).alias("tp"), n(~same).alias("fp"), zero.alias("fn")).unionByName(met.where(~same).select(F.col("gold").alias("tag"), zero.alias("tp"), zero.alias("fp"), F.col("n").alias("fn")))
    twice = token(rows.where("not once"))
    items = lambda c: twice.select(F.col(c).alias("tag"), F.col("req_no").alias("unit"), F.concat_ws("/", F.col("pos").cast("string"), "term").alias("item"))
    more = E.set_scores(items("tag"), items("gold"), ["tag"]).select("tag", "tp", "fp", "fn")
    return E.scored(counts.unionByName(more).groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), ["tag"])


# Lemmas --------------------------------------------------------------------------


def lemma_rules(pairs: DataFrame) -> DataFrame:
    """(ending, cut, add): the most frequent rewrite of the words with each ending, of (surface, lemma) pairs."""
    both = pairs.where("surface is not null and lemma is not null").select(F.lower("surface").alias("s"), F.lower("lemma").alias("l")).distinct()
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("s"), F.lit(1))), lambda n: F.substring("s", F.lit(1), n) == F.substring("l", F.lit(1), n)))
    common = F.least(same, F.length("s"), F.length("l"))
    rule = both.select(F.explode(_endings(F.col("s"))).alias("ending"), (F.length("s") - common).alias("cut"), F.substring("l", common + 1, F.length("l")).alias("add"))
    # A rule is learned only for endings that hold all that it cuts.
    fits = rule.where(F.col("cut") <= F.length("ending")).groupBy("ending", "cut", "add").agg(F.count("*").alias("n"))
    return fits.groupBy("ending").agg(F.max_by(F.struct("cut", "add"), F.struct("n", (-F.col("cut")).alias("c"), F.length("add").alias("a"), "add")).alias("r")).select("ending", "r.cut", "r.add")


def lemmatise(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(term, lemma) of distinct words, lower-cased; a word without a known ending is its own lemma."""
    one = words.select("term").where("term is not null").distinct()
    hit = one.select("term", F.posexplode(_endings(F.col("term"))).alias("rank", "ending")).join(rules, "ending")
    best = hit.groupBy("term").agg(F.min_by(F.struct("cut", "add"), "rank").alias("r"))
    low = F.lower("term")
    made = F.concat(F.substring(low, F.lit(1), F.length(low) - F.coalesce("r.cut", F.lit(0))), F.coalesce("r.add", F.lit("")))
    return one.join(best, "term", "left").select("term", F.when(F.length(made) > 0, made).otherwise(low).alias("lemma"))
