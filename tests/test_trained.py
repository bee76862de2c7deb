"""The trained tagger and lemmatiser against brute force and on held-out rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from termloom.operators import trained as R


def test_best_paths():
    rng = np.random.default_rng(1)
    first, follow = rng.normal(size=3), rng.normal(size=(3, 3))
    sizes = [4, 1, 0, 6, 4, 2, 1]
    offs = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(offs[-1], 3))
    got = R.best_paths(scores, offs, first, follow)
    for a, b in zip(offs, offs[1:]):
        if a < b:
            value = lambda p: first[p[0]] + sum(scores[a + i, t] for i, t in enumerate(p)) + sum(follow[x, y] for x, y in zip(p, p[1:]))  # noqa: E731, B023
            assert tuple(got[a:b]) == max(itertools.product(range(3), repeat=b - a), key=value)
    assert len(R.best_paths(np.zeros((0, 3)), np.array([0]), first, follow)) == 0


def sentences(n, seed):
    """Articles go before nouns, verbs after; the same form may be a noun or a verb."""
    rng = random.Random(seed)
    stems = ["lad", "sich", "prüf", "nachweis", "dat", "syst"]
    out = []
    for _ in range(n):
        row = []
        for _ in range(rng.randint(1, 3)):
            row += [(rng.choice(["der", "ein"]), "DET"), (rng.choice(stems) + rng.choice(["ung", "heit", "er", "en"]), "NOUN"), (rng.choice(stems) + rng.choice(["t", "en", "te"]), "VERB")]
        out.append(row)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, k, *x) for i, row in enumerate(rows) for k, x in enumerate(row)], "req_no int, pos int, term string, tag string")


def test_held_out_accuracy(spark):
    model = R.train(frame(spark, sentences(150, 1) + [[(None, "DET"), ("x", None)]]))
    test = [*sentences(60, 2), [("der", "DET"), ("Umwandlung", "NOUN"), ("quert", "VERB")], [(None, "DET")]]
    df = frame(spark, test)
    got = {(r.req_no, r.pos): r.tag for r in R.tag(df, model).collect()}
    want = {(i, k): t for i, row in enumerate(test) for k, (_, t) in enumerate(row)}
    assert got.keys() == want.keys()
    assert sum(got[p] == want[p] for p in want) >= 0.98 * len(want)
    assert [got[60, k] for k in range(3)] == ["DET", "NOUN", "VERB"]
    nothing = R.train(df.limit(0))
    assert {r.tag for r in R.tag(df, nothing).collect()} == {None} and R.tag(df.limit(0), model).count() == 0


def test_scores_are_those_of_sets_of_tokens(spark):
    """Also of a sequence given twice and of null tags; tokens of the others are not compared by a join."""
    from termloom.operators import evaluate as E

    df = frame(spark, [*sentences(40, 2), [("der", None), (None, "DET"), ("quert", "NOUN")]])
    df = df.unionByName(df.where("req_no < 3")).unionByName(df.where("req_no = 2").withColumn("tag", F.lit("ADJ")))
    items = lambda x: x.select("tag", F.col("req_no").alias("unit"), F.concat_ws("/", F.col("pos").cast("string"), "term").alias("item"))
    for model in (R.train(frame(spark, sentences(30, 1))), R.train(df.limit(0))):
        want = E.set_scores(items(R.tag(df, model)), items(df), ["tag"])
        assert sorted(map(str, R.scores(df, model).collect())) == sorted(map(str, want.collect()))


def test_word_scores(spark):
    rows = [[("a", "X"), ("a", "X"), ("a", "Y"), ("ba", "Y")]]
    model = R.train(frame(spark, rows))
    got = {r.term: r.scores for r in R.word_scores(spark.createDataFrame([("a",), ("zba",), ("q",)], "term string"), model).collect()}
    assert model.tags == ["X", "Y"]
    assert np.allclose(got["a"], [math.log(2 / 3 / 0.5), math.log(1 / 3 / 0.5)])
    assert np.allclose(got["zba"], [-30, math.log(1 / 0.5)]) and np.allclose(got["q"], [math.log(1 / 3 / 0.5), math.log(2 / 3 / 0.5)])


def brute_rules(pairs):
    found = {}
    for s, l in {(s.lower(), l.lower()) for s, l in pairs}:
        k = 0
        while k < min(len(s), len(l)) and s[k] == l[k]:
            k += 1
        for n in range(min(5, len(s)) + 1):
            if len(s) - k <= n:
                found.setdefault(s[len(s) - n :], Counter())[len(s) - k, l[k:]] += 1
    return {e: max(c, key=lambda r: (c[r], -r[0], len(r[1]), r[1])) for e, c in found.items()}


def test_lemmas(spark):
    pairs = [("Nachweise", "Nachweis"), ("Beweise", "Beweis"), ("geladen", "laden"), ("prüfte", "prüfen"), ("rügte", "rügen"), ("Häuser", "Haus"), ("ist", "sein"), ("Items", "Item"), ("Links", "Link")]
    df = spark.createDataFrame([*pairs, pairs[0], (None, "x"), ("y", None)], "surface string, lemma string")
    rules = brute_rules(pairs)
    assert {r.ending: (r.cut, r["add"]) for r in R.lemma_rules(df).collect()} == rules

    def lemma(w):
        w = w.lower()
        cut, add = next((rules[w[len(w) - n :]] for n in range(min(5, len(w)), -1, -1) if w[len(w) - n :] in rules), (0, ""))
        return w[: len(w) - cut] + add or w

    words = ["Verweise", "Kurse", "fragte", "ist", "bist", "Terms", "s", "", "geladen"]
    got = {r.term: r.lemma for r in R.lemmatise(spark.createDataFrame([(w,) for w in [*words, None]], "term string"), R.lemma_rules(df)).collect()}
    assert got == {w: lemma(w) for w in words} and got["Verweise"] == "verweis"
    assert R.lemmatise(df.select(df.surface.alias("term")), R.lemma_rules(df.limit(0))).where("lemma <> lower(term)").count() == 0
