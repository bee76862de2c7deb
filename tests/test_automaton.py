"""Patterns in texts and units of words against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from termloom.operators import automaton as A
from termloom.operators import evaluate as E
from termloom.operators import tagger as G


@pytest.mark.parametrize("lanes", [1, 3, 4096])
def test_occurrences(monkeypatch, lanes):
    monkeypatch.setattr(A, "LANES", lanes)
    rng = random.Random(lanes)
    for letters in ("ab", "abé漢"):
        for _ in range(10):
            patterns = sorted({"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(25)})
            texts = ["".join(rng.choices(letters + "x", k=rng.randrange(90))) for _ in range(40)]
            row, which = A.Automaton([p.encode() for p in patterns]).occurrences(*A._buffers(pa.array(texts)))
            want = sorted((i, k) for i, t in enumerate(texts) for k, p in enumerate(patterns) for j in range(len(t)) if t.startswith(p, j))
            assert sorted(zip(row.tolist(), which.tolist(), strict=True)) == want


@pytest.mark.parametrize("size", [A.SHARD_BYTES, 30])
def test_hits(spark, monkeypatch, size):
    monkeypatch.setattr(A, "SHARD_BYTES", size)
    rng = random.Random(size)
    long = "lang " * 2000
    patterns = [*{"".join(rng.choices("abc é", k=rng.randint(1, 4))) for _ in range(40)}, "", long, None]
    texts = [(i, "".join(rng.choices("abc é\n", k=30))) for i in range(50)] + [(98, None), (99, ""), (100, "x" + long + "y"), (1, "abc")]
    t, p = spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame([(x,) for x in patterns + patterns[:3]], "pattern string")
    got = [tuple(r) for r in A.hits(t, p, keep=["i"]).collect()]
    assert sorted(got) == sorted((i, x) for i, s in texts if s is not None for x in patterns if x is not None and x in s)
    assert A.hits(t, p.limit(0), keep=["i"]).count() == 0 == A.hits(t.limit(0), p).count()
    gold, found = p.select(p.pattern.alias("term")).where("term is not null"), spark.createDataFrame([(patterns[0],)], "term string")
    want = {(x, any(s is not None and x in s for _, s in texts)) for x in patterns if x is not None and x != patterns[0]}
    assert {tuple(r) for r in E.missing_terms(gold, found, t).collect()} == want


def brute_units(words, units):
    arcs = {" ".join(u.split(" ")[:k]) for u in units for k in range(1, u.count(" ") + 2)}
    out, i = [], 0
    while i < len(words):
        prefix, n = None, 0
        for k in range(i, len(words)):
            w = words[k]
            step = next((x for x in (w, w.lower(), w.lower().capitalize()) if (x if prefix is None else f"{prefix} {x}") in arcs), None)
            if step is None:
                break
            prefix = step if prefix is None else f"{prefix} {step}"
            if prefix in units and k > i:
                n = k - i + 1
                tag = units[prefix]
        if n:
            out.append((i, n, " ".join(words[i : i + n]), tag))
        i += max(n, 1)
    return out


@pytest.mark.parametrize("size", [A.SHARD_BYTES, 40])
def test_units(spark, monkeypatch, size):
    monkeypatch.setattr(A, "SHARD_BYTES", size)
    rng = random.Random(size)
    some = ["a", "A", "b", "B", "der", "Der", "DER", "x"]
    units = {" ".join(rng.choices(some, k=rng.randint(1, 6))): f"T{i}" for i in range(60)}
    sentences = {i: rng.choices(some, k=rng.randrange(1, 25)) for i in range(60)}
    t = spark.createDataFrame([(i, k, w) for i, ws in sentences.items() for k, w in enumerate(ws)], "req_no int, pos int, term string")
    u = spark.createDataFrame([*units.items(), (None, "T")], "unit string, tags string")
    got = {}
    for r in G.multiword_units(t, u).orderBy("req_no", "pos").collect():
        got.setdefault(r.req_no, []).append((r.pos, r.n, r.unit, r.tags))
    assert got == {i: found for i, ws in sentences.items() if (found := brute_units(ws, {k: v for k, v in units.items() if " " in k}))}
    assert G.multiword_units(t, u.limit(0)).count() == 0 == G.multiword_units(t.limit(0), u).count()


def test_texts_are_read_in_pieces(spark, monkeypatch):
    """What a batch takes is bounded by a piece, and a piece by few times its bytes."""
    import tracemalloc

    raw = np.frombuffer(b"abcab cabc " * 200_000, np.uint8)
    tracemalloc.start()
    A.Automaton([b"zz", b"bz"]).occurrences(raw, np.arange(0, len(raw) + 1, 11))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(raw)
    texts = [(i, "ab" * (i % 7) + "c" * (i % 3)) for i in range(60)] + [(60, None), (61, "")]
    df, pats = spark.createDataFrame(texts, "i int, text string").coalesce(1), spark.createDataFrame([("ba",), ("bc",), ("c",)], "pattern string")
    monkeypatch.setattr(A, "PIECE_BYTES", 9)
    got = sorted((r.i, r.pattern) for r in A.hits(df, pats, keep=["i"]).collect())
    assert got == sorted((i, p) for i, t in texts for p in ("ba", "bc", "c") if t and p in t)
