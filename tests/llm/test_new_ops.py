"""Toxicity, spelling variants and fill-in-the-middle against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import fim, spelling, toxicity

LONG = "Wörter und Zeilen, <immer> weiter.\n" * 3000


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["", None, "a", "é", "<P>x", "a <S", "ab<", "x\n\ny  z", "ÄÖÜ ß é 漢字 \U0001f600 <M", LONG, "zwei Worte", "zwei Worte", "<" * 9 + ">" * 9, "P>" * 40, *[f"doc {i} holds words, digits {i * 7} and ends." for i in range(150)]]
    rows = [(i, t, "psm", 5) for i, t in enumerate(texts)] + [(3, "é", None, None), (None, "null ids are hashed as nothing", "x", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int")


# Fill-in-the-middle


def brute_fim(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    if h[3] % 100 < 20:
        return n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


def test_fill_in_middle(spark, odd):
    want = collections.Counter((r.doc_id, *brute_fim(r.doc_id, r.text)) for r in odd.collect())
    out = fim.restored(fim.fill_in_middle(odd)).collect()
    assert collections.Counter((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in out) == want
    assert all(r.restored == (r.text or "") for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = collections.Counter((r.doc_id, sha(brute_fim(r.doc_id, r.text)[2]), sha(r.text or "")) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.op13_fill_in_middle(odd).collect()) == texts
    assert fim.op13_fill_in_middle(odd.limit(0)).count() == 0


def test_fill_in_middle_across_pieces(monkeypatch):
    import pyarrow as pa

    from termloom.llm import _text

    rng = random.Random(4)
    texts = ["".join(rng.choices("ab <>PSM.é漢\n", k=rng.randrange(40))) for _ in range(400)]
    h = np.array([[rng.randrange(1 << 32) for _ in range(4)] for _ in texts])
    whole = None
    for limit in (1 << 20, 64):
        got = []
        for lo, hi, raw, offs in _text.pieces(pa.array(texts), limit):
            n, form, low, high, _ = fim.cut(raw, offs, h[lo:hi])
            out, ends = fim.transform(raw, offs, form, low, high)
            back, again = fim.restore(out, ends, form)
            assert bytes(back) == bytes(raw) and (again == offs).all()
            got += [(int(x), int(f), bytes(out[a:b])) for x, f, a, b in zip(n, form, ends, ends[1:])]
        assert whole in (None, got)
        whole = got


# Spelling variants


def brute_words(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    form, near = {}, {}
    for w, n in words.items():
        others = [x for x in words if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    root = {}
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], n, near[w], words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("size", [spelling.SHARD_WORDS, 7])
def test_variants(spark, size):
    rng = random.Random(8)
    base = ["straße", "strasse", "planets", "planes", "plane", "ÀÉÎõü", "éééééé", "abcde" * 20]
    rows = []
    for i in range(120):
        words = []
        for w in rng.choices(base, weights=[40, 9, 20, 9, 4, 3, 3, 2], k=60):
            k = rng.randrange(len(w))
            words.append(rng.choice([w] * 6 + [w[:k] + w[k + 1 :], w[:k] + rng.choice("aeé") + w[k:], w.upper()]))
        rows.append((i % 100, rng.choice([" ", "\n", "9", "_"]).join(words), i))
    rows += [(None, "straße " * 5, 1), (7, None, 1), (8, "", 1), (9, LONG, 1), (9, LONG, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = spelling.variants(df, size=size).collect()
    want = brute_variants([r[:2] for r in rows])
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60
    assert any(r.form and r.root not in (r.form, r.word) for r in got)
    assert spelling.op12_spelling_variants(df.limit(0)).count() == 0 == spelling.op12_spelling_variants(spark.createDataFrame([(1, "ab 12")], "doc_id long, text string")).count()


def test_long_chain_of_forms(spark):
    words = [chr(97 + i) * 6 for i in range(1)] + ["b" * k + "a" * (6 - k) for k in range(1, 7)]
    rows = [(w, words[i - 1] if i else None) for i, w in enumerate(words)]
    links = spark.createDataFrame([(w, f) for w, f in rows if f], "word string, form string")
    assert {tuple(r) for r in spelling.roots(links).collect()} == {(w, words[0]) for w, f in rows if f}
    assert spelling.roots(links.limit(0)).count() == 0


def test_near_words_by_small_stacks():
    rng = random.Random(1)
    for alphabet in ("ab", "abcdé"):
        some = lambda k: sorted({"".join(rng.choices(alphabet, k=rng.randint(1, 8))).encode("latin-1") for _ in range(k)})
        known, asked = some(120), some(90)
        trie, (data, offs) = spelling.Trie(*spelling._unpacked(*spelling._packed(known))), spelling._unpacked(*spelling._packed(asked))
        want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(known) if one_edit(a, b)}
        for states in (40, 1 << 20):
            assert {p for w, x in spelling.near(trie, data, offs, states) for p in zip(w.tolist(), x.tolist(), strict=True)} == want
        for prefix in (b"", b"a", b"ba", b"aba", b"b\xe9a"):
            edits = lambda q: {q} | {q[:j] + c + q[j + d :] for j in range(len(q) + 1) for d in (0, 1) for c in (b"", b"a", b"b", b"\xe9")}
            assert spelling.reaches(data, offs, prefix).tolist() == [any(e.startswith(prefix) for e in edits(q)) for q in asked]


# Toxicity


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(5)
    clean = ["".join(rng.choices(["ba", "ne", "to", "li", "rü"], k=rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(clean, k=rng.randint(3, 80))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), "Grax" + rng.choice(["ba", "ne", "to"]) * rng.randint(1, 2))
        rows.append((i, " ".join(words), "x", 0.5))
        if i % 5:
            labels += [(i, int(toxic), 1)] * (1 + i % 2)
    rows += [(1000, None, None, None), (1001, "", "y", 1.0), (None, "Graxba ne", "z", 1.0), (3, rows[3][1], "x", 0.5), (1002, "12 , .", "", 0.0), (1003, " ".join(clean * 100), "", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")


def grams(text):
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
        s = b" " * 5 + word.lower() + b" "
        for k in range(6, len(s) + 1):
            yield word.lower(), s[k - 6 : k]


def brute_ratios(rows, labels):
    """The ratio of any 6-gram, by the recursion itself."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    of = {i: y for i, y, _ in labels if i is not None and y is not None and fold(i) < 2}
    every, own = collections.Counter(), {0: collections.Counter(), 1: collections.Counter()}
    for r in rows:
        g = collections.Counter(g for _, g in grams(r.text or ""))
        every.update(g)
        if r.doc_id in of:
            own[of[r.doc_id]].update(g)
    kinds = {4: {g[-4:]: 1 for g in every}}
    for k in (3, 2, 1):
        kinds[k] = collections.Counter(g[1:] for g in kinds[k + 1])
    table = {c: {6: own[c]} for c in own}
    for c in own:
        for k in (5, 4, 3):
            table[c][k] = collections.Counter(g[1:] for g in table[c][k + 1])

    def shared(g):
        same = [n for x, n in kinds[len(g)].items() if x[:-1] == g[:-1]]
        back = shared(g[1:]) if len(g) > 1 else 1 / 256
        return (max(kinds[len(g)].get(g, 0) - 0.75, 0) + 0.75 * len(same) * back) / sum(same) if same else back

    def p(c, g):
        back = p(c, g[1:]) if len(g) > 3 else shared(g)
        same = [n for x, n in table[c][len(g)].items() if x[:-1] == g[:-1]]
        return (max(table[c][len(g)].get(g, 0) - 0.75, 0) + 0.75 * len(same) * back) / sum(same) if same else back

    return lambda g: math.log(p(1, g) / p(0, g))


def test_ratios_against_the_recursion(spark, marked):
    docs, labels = marked
    ratio = brute_ratios(docs.collect(), labels.collect())
    model = toxicity.fit(docs, labels)
    table = model.broadcast()
    some = ["graxbane", "graxxx", "bane", "unknownword", "rütoli", "q", "bagrax"]
    for word in some:
        raw = np.frombuffer(word.encode(), np.uint8)
        got = table.of_windows(toxicity.windows(raw, np.array([0]), np.array([len(raw)]))[0])
        assert np.allclose(got, [ratio(g) for _, g in grams(word)], atol=1e-4), word


def test_scores(spark, marked):
    docs, labels = marked
    got = toxicity.op11_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)
    empty = {r.score for r in got if r.doc_id in (1000, 1001, 1002)}
    assert len(empty) == 1 and 0.1 < empty.pop() < 0.3
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_held_out_labels_are_not_read(spark, marked):
    docs, labels = marked
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda y: sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity.op11_toxicity(docs, y).collect())
    assert rows(labels) == rows(other)


def test_a_large_table_is_joined(spark, marked, monkeypatch):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    rows = lambda: sorted((r.doc_id or -1, r.text or "", r.lang or "", round(r.score, 6)) for r in toxicity.score(docs, model).collect())
    near = rows()
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    assert rows() == near


def test_toxicity_without_labels(spark, marked):
    docs, labels = marked
    assert {r.score for r in toxicity.op11_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.op11_toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.op11_toxicity(docs.limit(0), labels.limit(0)).count() == 0


# SQL of earlier operators on null and repeated ids


def test_sql_of_null_and_repeated_ids(spark):
    import duckdb

    from termloom.llm import line_dedup, ngram_join

    line = "A line that many documents hold, long enough to count."
    texts = [f"kopf {i}\n{line}\nfuß" for i in range(4)] + ["eins zwei drei vier fünf sechs sieben"] * 3 + [None, "", "kurz"]
    rows = [*enumerate(texts), (None, f"ohne\n{line}"), (None, f"ohne\n{line}"), (None, texts[4]), (None, "allein ohne Nummer und ohne Partner"), (None, None), (3, "eine andere Zeile unter gleicher Nummer wie vorher"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    count = lambda got: collections.Counter(tuple(None if v != v else v for v in r) for r in got)
    for operator, sql, cols in ((line_dedup.op6_line_dedup, line_dedup.OP6_SQL, ["doc_id", "n_lines", "n_dropped", "kept_sha256"]), (ngram_join.op9_ngram_join, ngram_join.OP9_SQL, ["doc_id", "n_shingles", "component_id"])):
        assert count(operator(df).select(cols).collect()) == count(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())


def test_long_licences_inside_longer_texts(spark):
    from termloom.llm import license_scan

    rng = random.Random(12)
    some = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    long = rng.choices(some, k=600)
    bank = spark.createDataFrame([("long", " ".join(long)), ("half", " ".join(long[:300]))], "license string, text string")
    prose = lambda n: " ".join("".join(rng.choices("klmnop", k=4)) for _ in range(n))
    changed = [w if k % 29 else "xyz" for k, w in enumerate(long)]
    texts = [f"{prose(300)} {' '.join(long)} {prose(500)}", f"{prose(900)}\n{' '.join(changed[:250])}\n{' '.join(changed[250:])} {prose(3)}", prose(2000), " ".join(long[:380]) + " " + prose(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = license_scan.matches(docs, bank)
    got = {}
    for r in license_scan.passages(docs, none, bank).join(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid")), "rid").collect():
        got[r.doc_id, r.license] = max(round(r.dice, 6), got.get((r.doc_id, r.license), 0))

    def best(text, template):
        pairs = lambda ws: list(zip(ws, ws[1:]))
        t, p = set(pairs(template)), pairs(text.split())
        at = [k for k, g in enumerate(p) if g in t]
        top = 0.0
        for a in at:
            seen, c = set(), 0
            for k in range(a, min(len(p), a + int(len(t) * 1.5) + 60)):
                if p[k] not in seen:
                    seen.add(p[k])
                    c += p[k] in t
                top = max(top, 2 * c / (len(seen) + len(t)))
        return round(top, 6)

    want = {(i, name): b for i, x in enumerate(texts) for name, ws in (("long", long), ("half", long[:300])) if (b := best(x, ws)) >= license_scan.DICE}
    assert got == want and want[0, "long"] == 1.0 and (1, "long") in want
