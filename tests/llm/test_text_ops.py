import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import bpe_automaton, chat_format, decontam, langid, license_scan, token_orc

P = pytest.importorskip("public_tokenizers")
T = pytest.importorskip("tokenizers")


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def library():
    return T.Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def automaton():
    return bpe_automaton.read_tokenizer(P.path("word_bpe_49k.json"))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# BPE


def test_small_automaton_by_hand():
    letters = {c: i for i, c in enumerate("abc")} | {c + "</w>": 3 + i for i, c in enumerate("abc")}
    merges = [("a", "b"), ("ab", "c</w>"), ("a", "a"), ("aa", "ab")]
    vocab = letters | {x + y: 6 + k for k, (x, y) in enumerate(merges)}
    auto = bpe_automaton.Automaton(vocab, merges, {})

    def plain(word):
        s = [*word[:-1], word[-1] + "</w>"]
        while True:
            ranks = [(merges.index(p), i) for i, p in enumerate(zip(s, s[1:])) if p in merges]
            if not ranks:
                return [vocab[x] for x in s]
            r = min(ranks)[0]
            a, b = merges[r]
            i, out = 0, []
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == (a, b):
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out

    import itertools

    words = ["".join(w) for n in range(1, 8) for w in itertools.product("abc", repeat=n)]
    assert auto.encode_words(words) == [plain(w) for w in words]


def test_encoding_matches_the_library(automaton, library):
    rng = np.random.default_rng(3)
    texts = ["", "it's don't WE'LL 1234 ...", "<|endoftext|> a<|startoftext|>b <|x|>", "İSTANBUL ΣΑΣ ς ﬁ", "á ẹ́ ́a", "a\tb\rc\x0bd\x1ce f\x85g\xa0h", "a" * 200, "ab" * 70, "é" * 90, "漢字かな交じり文 \U0001f600\U0001f601"]
    texts += ["".join(chr(c) for c in rng.integers(1, 0x2FF, 30)) for _ in range(300)]
    texts += ["".join(chr(c) for c in rng.integers(0x300, 0xD7FF, 12)) for _ in range(300)]
    texts += ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 25))) for _ in range(2000)]
    encoder = bpe_automaton.Encoder(automaton, library)
    for text, (ids, labels), want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [int(x) for x in ids.split()] == want.ids, text
        assert labels == library.decode(want.ids, skip_special_tokens=False)


def test_words_side_by_side_follow_the_paths_of_words_alone(automaton):
    rng = np.random.default_rng(11)
    for length in (1, 2, 7, 48):
        table = rng.integers(97, 107, (60, length))
        table[:, -1] += 256
        assert automaton._walk(table) == [automaton._walk_alone(x) for x in table]


def test_words_of_all_lengths_are_walked_at_once(automaton, monkeypatch):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghij"), n)) for n in rng.integers(1, 60, 300)]
    tables = []
    monkeypatch.setattr(automaton, "_walk", lambda *a, f=automaton._walk: tables.append(1) or f(*a))
    together = automaton.encode_words(words)
    assert len(tables) == 1
    monkeypatch.setattr(bpe_automaton, "FEW", 1000)
    assert together == automaton.encode_words(words)


def test_cache_may_be_emptied(automaton, library, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "CACHE", 5)
    monkeypatch.setattr(bpe_automaton, "PART", 40)
    encoder = bpe_automaton.Encoder(automaton, library)
    texts = [f"word{i} other{i % 3} same" for i in range(50)]
    for (ids, _), want in zip(encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [int(x) for x in ids.split()] == want.ids


def test_bpe_of_odd_rows(documents, empty, library):
    got = sorted([tuple(r) for r in bpe_automaton.op3_bpe(documents).collect()], key=key)
    want = []
    for r in documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=key)
    assert bpe_automaton.op3_bpe(empty).count() == 0


def test_round_trip_through_ids(documents):
    path = P.path("word_bpe_49k.json")
    out = bpe_automaton.encode(documents, path)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "n_tokens", "ids", "decoded"]
    again = bpe_automaton.decode(out.select("doc_id", "ids", F.col("decoded").alias("first")), path)
    assert again.where("first <> decoded").count() == 0


# ORC


def test_token_files(documents, empty, library, spark):
    got = sorted([tuple(r) for r in token_orc.op4_token_orc(documents).collect()], key=lambda r: r[1])
    rows = sorted([(r.doc_id, r.text) for r in documents.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    assert [r[0] for r in got] == [r[0] for r in rows]
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    want = sorted([(d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t in rows], key=key)
    assert sorted([(r[0], r[2], r[3]) for r in got], key=key) == want
    assert token_orc.op4_token_orc(empty).count() == 0


def test_token_files_in_many_shards_with_pruning(spark, tmp_path, library):
    data = [(i * 7 % 1000, f"text number {i} " * (i % 5)) for i in range(1000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = str(tmp_path / "orc")
    token_orc.write(df, out, P.path("word_bpe_49k.json"), file_bytes=4000)
    files = token_orc.read(spark, out)
    assert files.select("shard").distinct().count() > 3
    got = {r.doc_id: r for r in token_orc.documents(spark, out).collect()}
    at = 0
    for d, t in sorted(data):
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        assert (got[d].start, got[d].n_tokens) == (at, n)
        at += n
    one = files.where("doc_id = 500")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,500)]" in one._jdf.queryExecution().toString()
    assert one.first()["ids"][-1] == 1


# Chats


def test_row_index_and_bloom_filter_skip_rows(spark, tmp_path, monkeypatch):
    """A present id reads its row group only; an absent one between present ones, which bounds cannot exclude, none."""
    out = f"file://{tmp_path}/tokens"
    docs = spark.range(20_000).selectExpr("2 * id AS doc_id", "concat('wort ', id) AS text")
    token_orc.write(docs, out, P.path("word_bpe_49k.json"), file_bytes=1 << 30)

    def rows_read(k):
        query = token_orc.read(spark, out).where(F.col("doc_id") == k)._jdf.queryExecution()
        n = query.toRdd().count()
        return n, query.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    assert rows_read(20_000)[0] == 1 and rows_read(20_000)[1] <= 2048
    assert sum(rows_read(k)[1] for k in (5001, 10_001, 20_001, 30_003)) <= 2048
    monkeypatch.setattr(token_orc, "SHARD_GROUP", 2)
    many = f"file://{tmp_path}/many"
    token_orc.write(docs, many, P.path("word_bpe_49k.json"), file_bytes=20_000)
    assert token_orc.read(spark, many).select("shard").distinct().count() > 8
    key = lambda path: sorted(tuple(r) for r in token_orc.documents(spark, path).collect())
    assert key(many) == key(out)



def test_snapshots_collapse(spark):
    turns = lambda conv, *texts: [(conv, i, "user" if i % 2 == 0 else "bot", t, "x") for i, t in enumerate(texts)]
    rows = [*turns(1, "a"), *turns(2, "a", "b"), *turns(3, "a", "b", "c"), *turns(4, "a", "b", "c"), *turns(5, "a", "x"), *turns(6, "b"), (7, 0, None, None, "y"), (None, 0, "user", "n", "z"), *[(8, i, "user", "t", "") for i in range(6)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = chat_format.format_chats(df, part_turns=4).collect()
    assert sorted({(r.conv_id is None, r.conv_id) for r in got}, key=str) == sorted([(False, 3), (False, 5), (False, 6), (False, 7), (False, 8), (True, None)], key=str)
    text = {(r.conv_id, r.part): r.rendered for r in got}
    assert text[3, 0] == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert text[7, 0] == "<|im_start|>unknown\n<|im_end|>\n"
    assert [text[8, k].count("im_start") for k in (0, 1)] == [4, 2]
    assert chat_format.op5_chat_format(df.limit(0)).count() == 0


# Decontamination


def brute_hits(docs, bench, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    items = [(k, words(t)) for k, t in bench]
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for k, (i, q) in enumerate(items):
            n = min(window, len(q))
            grams = {tuple(q[a : a + n]) for a in range(len(q) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found.add(k)
        ids = sorted({str(items[k][0]) for k in found if items[k][0] is not None})
        out.append((d, len(w), len(hit), len(found), sha(",".join(ids)), bool(hit)))
    return sorted(out, key=key)


def test_contamination(spark, documents, empty):
    words = [f"b{i % 13}" for i in range(30)]
    bench = [(1, " ".join(words)), (2, "kurz"), (3, None), (4, ""), (5, "the the the the the the the the the the the the"), (6, "Zwei worte"), (None, "fremd fremd"), (7, "never seen here at all"), (1, "ein anderer Text")]
    more = [(100, "x " + " ".join(words) + " y"), (101, " ".join(words[5:14])), (102, " ".join(words[:12]).upper() + "! " + " ".join(words[:12])), (103, "the " * 40), (104, "The, the. ÉCOLE ein anderer text"), (105, " ".join(words[:15]) + " " + " ".join(words[15:]))]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.op7_decontamination(docs, b)
    assert sorted([tuple(r) for r in got.collect()], key=key) == brute_hits([(r.doc_id, r.text) for r in docs.collect()], bench)
    assert decontam.op7_decontamination(empty, b).count() == 0
    none = decontam.op7_decontamination(docs, b.limit(0))
    assert none.count() == docs.count() and none.where("contaminated").count() == 0
    kept = decontam.remove_contaminated(docs.withColumn("row", F.lit(1)), b)
    assert kept.columns == ["doc_id", "text", "row"] and kept.count() == got.where("not contaminated").count()


def test_items_that_share_an_id(spark):
    """Two texts of one id are two items, a repeated item is one; operator, SQL and brute force agree."""
    import duckdb

    bench = [(1, "eins zwei drei"), (1, "vier fünf sechs"), (1, "vier fünf sechs"), (2, "sieben acht"), (None, "neun zehn"), (3, None)]
    data = [(1, "x eins zwei drei vier fünf sechs y"), (2, "sieben acht neun zehn"), (3, None), (4, "sauber")]
    docs, items = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    out = decontam.op7_decontamination(docs, items)
    got = sorted([tuple(r) for r in out.collect()], key=key)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", items.toPandas().astype({"item_id": "Int64"}))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({decontam.OP7_SQL})").fetchall()
    assert got == sorted(want, key=key)
    assert [r[3] for r in got] == [2, 2, 0, 0] and got[0][4] == sha("1")


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x x beta"), (3, "beta alpha")], "doc_id long, text string")
    index = decontam.build_index(docs, spark.createDataFrame([("alpha",), ("beta",)], "word string"))
    q = spark.createDataFrame([(1, ["alpha", "beta"])], "query int, terms array<string>")
    ids = {r.row: r.doc for r in index.where("term is null").collect()}
    assert sorted((ids[r.row], r.lo, r.hi) for r in decontam.proximity_matches(index, q, 4).collect()) == [(1, 0, 3), (3, 0, 1)]


# Licences


def test_licences(spark, documents):
    mit = license_scan.TEMPLATES[4][1]
    rows = [(1, "Prose.\nReleased under the MIT License.\nMore prose here."), (2, "Released under the MIT Licence"), (3, mit), (4, mit.replace("sublicense", "lend").replace("merge", "join")), (5, "nothing to see"), (6, None), (7, "All rights reserved."), (1, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_units, r.licenses) for r in license_scan.op8_license_scan(df).collect())
    assert got == [(1, 1, "MIT"), (1, 1, "MIT"), (2, 1, "MIT"), (3, 1, "MIT"), (4, 1, "MIT"), (5, 0, ""), (6, 0, ""), (7, 1, "Proprietary")]
    assert license_scan.op8_license_scan(documents).count() == documents.count()
    assert license_scan.op8_license_scan(df.limit(0)).count() == 0


# Language


def corpus(spark):
    rng = np.random.default_rng(9)
    parts = {"en": "the and ing tion er of th".split(), "de": "der und ung sch en ich zu".split(), "fr": "le et eau é ai que oi".split()}
    rows = []
    for k in range(600):
        lang = list(parts)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(rng.integers(3, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_on_held_out_documents(spark):
    df = corpus(spark)
    got = langid.op10_language_id(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 80 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.rejected for r in held]) < 0.03


def test_language_of_odd_rows(spark, documents, empty):
    model = langid.fit(corpus(spark))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? "), (4, "漢字"), (5, "the thing"), (6, "é")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(got[k].rejected and got[k].score == 0 for k in (1, 2, 3))
    assert got[5].lang_pred == "en" and got[4].lang_pred != "und" and got[6].lang_pred != "und"
    assert langid.identify(documents.withColumn("score", F.lit("clash")), model).columns == ["doc_id", "text", "lang", "n_words", "ids", "lang_pred", "score", "rejected"]
    assert langid.op10_language_id(empty).count() == 0
    unlearned = langid.op10_language_id(documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}
    assert langid.op10_language_id(documents).count() == documents.count()


def brute_language(model, text):
    """One text by the definition: the mean over all n-grams, one after another."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    total, mask = np.zeros(model.embed.shape[1]), (1 << 32) - 1
    for k in range(len(raw)):
        a = raw[k : k + 4] + b"\0" * (4 - len(raw[k : k + 4]))
        three, four = int.from_bytes(a[:3], "little"), int.from_bytes(a, "little")
        total += model.embed[(three * 0x9E3779B1 & mask) >> 16] + model.embed[((four ^ four >> 15) * 0x85EBCA6B & mask) >> 16]
    z = (total / (2 * len(raw)) @ model.weights + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.languages[int(p.argmax())], float(p.max())


@pytest.mark.parametrize("labels", [3, 40])
def test_language_against_brute_force(spark, documents, monkeypatch, labels):
    """Few labels use the table of products, many the embeddings; long texts are read in parts."""
    monkeypatch.setattr(langid, "PART", 64)
    rng = np.random.default_rng(labels)
    words = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(12)] for k in range(labels)}
    data = [(i, " ".join(rng.choice(words[f"l{i % labels:02}"], 30)), f"l{i % labels:02}") for i in range(20 * labels)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == sorted(words)
    again = langid.LanguageModel.loads(model.dumps())
    assert (again.embed == model.embed).all() and (again.languages, again.temperature, again.reject_below) == (model.languages, model.temperature, model.reject_below)
    texts = [r.text for r in documents.collect()] + [t for _, t, _ in data]
    best, score = model.scores(pa.array(texts, pa.string()))
    for text, b, s in zip(texts, best, score, strict=True):
        lang, want = brute_language(model, text)
        assert ("und" if b < 0 else model.languages[b]) == lang and abs(s - want) < 1e-4


def test_language_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, "abc def " * (i % 7), f"l{i % 50}") for i in range(2000)], "doc_id long, text string, lang string")
    assert len(langid.fit(df, sample_rows=20).languages) <= 20
    assert langid.fit(df, sample_bytes=0).languages == []


def test_lang_column_is_no_input_of_a_prediction(spark):
    df = corpus(spark)
    model = langid.fit(df)
    a = langid.identify(df, model).select("doc_id", "lang_pred", "score")
    b = langid.identify(df.withColumn("lang", F.lit("zz")), model).select("doc_id", "lang_pred", "score")
    assert a.subtract(b).count() == 0


def brute_windows(text, template, dice=0.8):
    """Best Dice coefficient of all windows of consecutive bigrams of admissible length."""
    def grams(t):
        w = re.findall(r"[^\W_]+(?:\.\d+)*", t.lower().replace("licence", "license"))
        return [f"{a} {b}" for a, b in zip(w, w[1:])]

    g, t = grams(text), grams(template)
    most, m, best = int(len(t) * (2 - dice) / dice + 1e-9), set(t), 0.0
    for i in range(len(g)):
        for j in range(i + 1, min(len(g), i + most) + 1):
            w = set(g[i:j])
            best = max(best, 2 * len(w & m) / (len(w) + len(m)))
    return best


def test_licences_across_lines_and_inside_lines(spark):
    import textwrap

    T_ = license_scan.TEMPLATES
    prose = " ".join(f"word{i} other{i % 17}" for i in range(300))
    wrap = lambda x: "\n".join(textwrap.wrap(x, 60))
    full = dict(license_scan.full_texts())
    changed = T_[4][1].replace("sublicense", "lend").replace("without limitation", "with no limitation")
    rows = [
        (1, f"{prose}\n{wrap(T_[4][1])}\n{prose}"),
        (2, f"{prose} Released under the MIT License. {prose}"),
        (3, full["GPL-3.0"]), (4, full["Apache-2.0"]), (5, full["BSD-3-Clause"]), (6, full["BSD-2-Clause"]), (7, f"{prose}\n{full['Apache-2.0'][2000:9000]}\n{prose}"),
        (8, f"{prose}\n{wrap(changed)}\n{prose}\n{wrap(T_[1][1])}\nAll rights reserved.\n{prose}"),
        (9, f"{prose} rights reserved {prose} under the license {prose}"),
        (10, f"{prose}\n{full['GPL-3.0']}\n{prose}"),
    ]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.op8_license_scan(df).collect()}
    names = {k: set(r.licenses.split(",")) - {""} for k, r in got.items()}
    assert names[1] == names[2] == {"MIT"} and got[1].n_units == got[2].n_units == 1 and got[1].best == got[2].best == 1.0
    assert "GPL-3.0" in names[3] and got[3].best == 1.0 and "Apache-2.0" in names[4] and got[4].best == 1.0
    assert "BSD-3-Clause" in names[5] and "BSD-2-Clause" in names[6] and "Apache-2.0" in names[7] and "GPL-3.0" in names[10]
    assert names[8] == {"MIT", "Apache-2.0", "Proprietary"} and got[8].n_units == 3
    assert names[9] == set() and got[9].n_units == 0
    one = spark.createDataFrame([T_[4]], "license string, text string")
    text = f"{prose} {wrap(changed)} {prose}"
    best = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), one).first().best
    assert best == round(brute_windows(text, T_[4][1]), 6) and 0.8 < best < 1
