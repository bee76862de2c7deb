"""Compound splitting by letter n-grams against brute force."""

import re

import pytest

from termloom.operators import compounds as D

WORDS = """Sicherheit Nachweis Nachweise Item Prüfung Prüfungen Anforderung Anforderungen Ordnung Verordnung Sicherheitsnachweis Prüfungsordnung
Anforderungsprüfung Softwareanforderung Software Hardware Hardwarenachweis Verkehr Verkehrsordnung Strassenverkehrsordnung Strasse Strassen
Arbeitsprüfung Arbeit Arbeiter nachweisbar sicher sicherlich Ordner ordnen verkehrt prüfen Betriebsordnung Betrieb Betriebe""".split()


def brute_grams(vocabulary):
    out = {}
    for w in {v.lower() for v in vocabulary if v}:
        for n in range(3, 9):
            for p in range(len(w) - n + 1):
                t = out.setdefault(w[p : p + n], [0, 0, 0])
                t[0] += 1
                t[1] += p == 0
                t[2] += p + n == len(w)
    return out


def brute_cut(word, grams, least=14):
    w, best = word.lower(), None
    if len(w) < least:
        return None
    for k in range(4, len(w) - 3):
        side = lambda gs, i: next(((grams[g][i] / (grams[g][0] - 1)) for g in gs if grams.get(g, [0])[0] > 1), None)
        start = side([w[k : k + n] for n in range(8, 2, -1) if k + n <= len(w)], 1)
        end = side([w[k - n : k] for n in range(8, 2, -1) if n <= k], 2)
        if start is None and end is None:
            continue
        score = round((-2.0 if start is None else 2 * start - 1) + (-1.0 if end is None else end), 9) + 0.0
        if best is None or score > best[1]:
            best = (k, score)
    return best


def brute_parts(word, cut):
    if cut is None or cut[1] < -0.6:
        return [word]
    if cut[1] == 0:
        return [word[: cut[0]]]
    bare = lambda p: p[:-1] if p.endswith("s") and not re.match(r"[A-ZÄÖÜ].*[A-ZÄÖÜ]", p) else p
    return [bare(word[: cut[0]]), bare(word[cut[0] :])]


def brute_wholly(phrase, grams, noun):
    out = []
    for word in phrase.split():
        word = word[:-1] if word.endswith("-") else word.removeprefix("-")
        if len(word) < 14:
            out.append(word[:-1] if len(word) > 1 and word.endswith("s") and noun(word[:-1]) else word)
        else:
            out += brute_parts(word, brute_cut(word, grams))
    joined = " ".join(w for w in out if w)
    return joined if joined == phrase else brute_wholly(joined, grams, noun)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(w,) for w in [*WORDS, *WORDS[:3], None, "", "ab"]], "word string")


def test_gram_table(spark, vocabulary):
    got = {r.gram: [r.total, r.begins, r.ends] for r in D.gram_table(vocabulary).collect()}
    assert got == brute_grams([*WORDS, "ab"])
    assert D.gram_table(vocabulary.limit(0)).count() == 0


def test_cuts_and_parts(spark, vocabulary):
    grams, table = brute_grams(WORDS), D.gram_table(vocabulary).cache()
    long = [w for w in WORDS if len(w) >= 14]
    assert {r.word: (r.k, round(r.score, 9)) for r in D.best_cuts(vocabulary, table).collect()} == {w: (c[0], round(c[1], 9)) for w in long if (c := brute_cut(w, grams))}
    got = {r.word: r.parts for r in D.split_once(vocabulary, table).collect()}
    assert got == {w: brute_parts(w, brute_cut(w, grams)) for w in long}
    assert got["Sicherheitsnachweis"] == ["Sicherheit", "nachweis"[:-1]] and got["Hardwarenachweis"][0] == "Hardware"
    assert {tuple(r.parts) for r in D.split_once(vocabulary, table.limit(0)).collect()} == {(w,) for w in long}


def test_scores_decide(spark):
    df = spark.createDataFrame([("abcdefs", 4, 0.0), ("abcdefs", 4, -0.61), ("abcdefs", 4, -0.6), ("abcs", None, None), ("ABcsdeFs", 4, 1.0)], "w string, k int, s double")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(D.parts_of(F.col("w"), F.col("k"), F.col("s"))).collect()] == [["abcd"], ["abcdefs"], ["abcd", "ef"], ["abcs"], ["ABcs", "deF"]]


def test_split_wholly(spark, vocabulary):
    grams, table = brute_grams(WORDS), D.gram_table(vocabulary)
    phrases = [*WORDS, "Sicherheitsnachweis-", "-Strassenverkehrsordnung des Betriebs", "Anforderungsprüfungs Items", "", "x", "Betriebsordnungssicherheitsnachweise"]
    df = spark.createDataFrame([(p,) for p in [*phrases, None, "x"]], "term string")
    noun = lambda w: bool(re.match(r"[A-ZÄÖÜ]", w) or re.search("(ung|heit|keit|schaft|tion|ness|ment)$", w)) and w != "Die"
    got = {r.phrase: r.parts for r in D.split_wholly(df, table).collect()}
    assert got == {p: brute_wholly(p, grams, noun) for p in phrases}
    assert got["Strassenverkehrsordnung".replace("S", "S")].count(" ") >= 1
