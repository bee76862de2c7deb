"""Chunks, trees and coordinated phrases against the steps done token by token."""

import random

from pyspark.sql import functions as F

from termloom.operators import brackets as B

NAMES = ["NC", "PC", "VC"]


def brute_chunks(row):
    """(name, from, to) of the chunks of (term, tag, label) tokens."""
    out, open_ = [], None
    for i, (term, _, label) in enumerate(row):
        flag, _, name = (label or "O").partition("-")
        if flag == "I" and (open_ is None or open_[0] != name):
            flag = "B"
        if flag == "B":
            if open_:
                out.append((open_[0], open_[1], i - 1))
            open_ = (name, i)
        elif flag == "E":
            if open_ and (name == open_[0] or (name == "PC" and open_[0] == "NC")):
                out.append((name, open_[1], i))
                open_ = None
        elif flag != "I" and open_:
            out.append((open_[0], open_[1], i - 1))
            open_ = None
        if term == "." and open_:
            out.append((open_[0], open_[1], i))
            open_ = None
    return out + ([(open_[0], open_[1], len(row) - 1)] if open_ else [])


def data():
    rng = random.Random(6)
    some = ["O", None, *[f"{k}-{n}" for n in NAMES for k in "BIE"]]
    return [[(rng.choice(["a", "b", "."]), rng.choice(["NN", "VV", "$.", "SENT"]), rng.choice(some)) for _ in range(rng.randint(1, 15))] for _ in range(200)]


def frame(spark, rows):
    return spark.createDataFrame([(i, k, *x) for i, row in enumerate(rows) for k, x in enumerate(row)], "req_no int, pos int, term string, tag string, chunk_tag string")


def test_chunks_and_trees(spark):
    rows = data() + [[("in", "P", "B-NC"), ("dem", "D", "I-NC"), ("Haus", "N", "E-PC"), (".", "$.", "O"), ("x", "N", "I-NC")]]
    df = frame(spark, rows)
    got = {}
    for r in B.chunked(df, NAMES).collect():
        if r.chunk is not None:
            got.setdefault((r.req_no, r.chunk, r.name), []).append(r.pos)
    want = {}
    for i, row in enumerate(rows):
        for k, (name, a, b) in enumerate(sorted(brute_chunks(row), key=lambda c: c[1])):
            want[i, k + 1, name] = list(range(a, b + 1))
    assert {k: sorted(v) for k, v in got.items()} == want
    trees = {r.req_no: r.tree for r in B.sentence_trees(df, NAMES).collect()}
    for i, row in enumerate(rows):
        leaves = [f"({t} {g})" for t, g, _ in row]
        for name, a, b in brute_chunks(row):
            leaves[a] = f"({name} " + leaves[a]
            leaves[b] += ")"
        sentences, now = [], []
        for leaf, (_, g, _) in zip(leaves, row, strict=True):
            now.append(leaf)
            if g in B.SENTENCE_TAGS:
                sentences.append(now)
                now = []
        sentences += [now] if now else []
        nodes = ["(S " + " ".join(s) + ")" for s in sentences]
        assert trees[i] == (nodes[0] if len(nodes) == 1 else "(ROOT " + " ".join(nodes) + ")")
    assert trees[200] == "(ROOT (S (PC (in P) (dem D) (Haus N)) (. $.)) (S (NC (x N))))"
    assert B.sentence_trees(df.limit(0), NAMES).count() == 0


def brute_coordinated(lines):
    out, i = [], 0

    def phrase(k, name):
        """The place after the phrase that begins at k, or None."""
        if k < len(lines) and lines[k] == f"<{name}>":
            for j in range(k + 1, len(lines)):
                if lines[j] == f"</{name}>":
                    return j + 1
        return None

    while i < len(lines):
        a = phrase(i, "NP")
        if a:
            b = a
            while b < len(lines) and lines[b] == "</PP>":
                b += 1
            c = phrase(b, "COORD")
            d = phrase(c, "NP") if c else None
            if d:
                out += ["<NP>", *lines[i:a], *lines[b:d], "</NP>", *lines[a:b]]
                i = d
                continue
        out.append(lines[i])
        i += 1
    return out


def test_coordinated_phrases(spark):
    rng = random.Random(9)
    np = lambda: ["<NP>", *rng.choices(["der", "Hund", "und"], k=rng.randint(1, 3)), "</NP>"]
    pieces = [np, np, np, lambda: ["<COORD>", "und", "</COORD>"], lambda: ["<COORD>", "und", "</COORD>"], lambda: ["</PP>"], lambda: ["läuft"], lambda: ["<PP>", "in", *np()]]
    rows = [[x for _ in range(rng.randint(1, 9)) for x in rng.choice(pieces)()] for _ in range(300)] + [[], ["<NP>", "offen"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(999, None)], "i int, lines array<string>")
    got = {r.i: r.x for r in df.select("i", B.coordinated(F.col("lines")).alias("x")).collect()}
    assert got == {i: brute_coordinated(r) for i, r in enumerate(rows)} | {999: None}
    three = spark.createDataFrame([(["<NP>", "a", "</NP>", "</PP>", "<COORD>", "und", "</COORD>", "<NP>", "b", "</NP>", "<COORD>", "und", "</COORD>", "<NP>", "c", "</NP>"],)], "l array<string>")
    assert " ".join(three.select(B.coordinated(F.col("l"))).first()[0]) == "<NP> <NP> a </NP> <COORD> und </COORD> <NP> b </NP> </NP> </PP> <COORD> und </COORD> <NP> c </NP>"


def test_lines(spark):
    df = frame(spark, [[("der", "D", "I-NP"), ("Hund", "N", "I-NP"), ("und", "K", "B-COORD"), ("Rex", "N", "I-NP"), ("läuft", "V", "O")]])
    lines = B.chunk_lines(df, ["NP", "COORD"]).first().lines
    assert " ".join(lines) == "<NP> der Hund </NP> <COORD> und </COORD> <NP> Rex </NP> läuft"
