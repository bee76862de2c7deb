import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import _components, itq_dedup, line_dedup, ngram_join, substring_dedup
from termloom.llm._components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def key(r):
    return tuple((x is None, x) for x in r)


# Components


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 2), (5, 5), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (20, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    want = groups(real, {x for e in real for x in e})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [r[0] for r in components(path).select("component").distinct().collect()] == [0]


# Lines


def brute_lines(data, least=5, chars=40):
    split = [(d, [] if t is None else t) for d, t in data]
    docs = [(d, (t or "").split("\n") if t != [] else [""]) for d, t in split]
    keys = lambda l: lower(l.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for d, ls in docs:
        for k in {keys(l) for l in ls}:
            if len(k) >= chars:
                holders[k].append(d)
    often = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= least}
    out = []
    for d, ls in docs:
        gone = [keys(l) in often and often[keys(l)] is not None and d != often[keys(l)] for l in ls]
        out.append((d, len(ls), sum(gone), sha("\n".join(l for l, g in zip(ls, gone) if not g))))
    return sorted(out, key=key)


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, 0])
def test_lines(documents, limit):
    got = line_dedup.drop_repeated_lines(documents.select("doc_id", "text"), digest=True, keep_text=False, shard_keys=1, broadcast_bytes=limit)
    assert sorted([tuple(r) for r in got.collect()], key=key) == brute_lines(rows(documents))


def test_lines_keep_columns_and_replace_text(documents, empty):
    out = line_dedup.drop_repeated_lines(documents.withColumn("n_lines", F.lit("clash")))
    assert out.columns == ["doc_id", "text", "lang", "n_words", "ids", "n_lines", "n_dropped"]
    assert out.where("doc_id = 11").first()["text"] == "kopf 0\nfuß 0"
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20000, dtype=np.uint64)
    h = line_dedup.PerfectHash(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    again = line_dedup.PerfectHash.load(h.dump())
    assert (again.index(keys) == h.index(keys)).all()
    counts = np.arange(len(keys)) % 9 + 2
    s = line_dedup.Shard.build(keys, keys + np.uint64(1), counts, np.zeros(len(keys), np.int64))
    s = line_dedup.Shard.loads(s.dumps())
    doc = np.ones(len(keys), np.int64)
    assert s.drops(keys, keys + np.uint64(1), doc, 0).all()
    assert not s.drops(keys, keys, doc, 0).any()
    assert (s.drops(keys, keys + np.uint64(1), doc, 5) == (counts >= 5)).all()


# Substrings


def brute_substrings(data, size):
    docs = [(d, SPACE.findall(t or "")) for d, t in data]
    count = Counter(tuple(w[i : i + size]) for _, w in docs for i in range(len(w) - size + 1))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), sha(" ".join(kept))))
    return sorted(out, key=key)


@pytest.mark.parametrize(("size", "gram", "bits"), [(35, 8, 20), (9, 3, 7), (12, 8, 16)])
def test_substrings(documents, size, gram, bits):
    got = substring_dedup.remove_repeated(documents.select("doc_id", "text"), size=size, gram=gram, digest=True, keep_text=False, bloom_bits=bits)
    assert sorted([tuple(r) for r in got.collect()], key=key) == brute_substrings(rows(documents), size)


def test_substrings_keep_columns(documents, empty):
    out = substring_dedup.remove_repeated(documents)
    assert out.columns == ["doc_id", "text", "lang", "ids", "n_words", "n_removed"]
    assert out.where("doc_id = 7").first()["text"] == "zwei Worte"
    assert substring_dedup.remove_repeated(empty).count() == 0


def test_index_names_what_history_holds(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    first = spark.createDataFrame([(1, passage + " a"), (2, "ganz " * 3)], "doc_id long, text string")
    second = spark.createDataFrame([(3, "b " + passage)], "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark)
    assert index.ingest(first).count() == 0
    again = index.ingest(second)
    assert again.count() > 0 and again.where("before = 0").count() == 0
    assert len(index.runs) == 2
    merged = index.merged().where("n > 1").count()
    index.compact()
    assert len(index.runs) == 1 and index.merged().where("n > 1").count() == merged


def test_batches_over_an_index_that_is_opened_again(spark, documents, tmp_path):
    """Each batch meets the runs that earlier sessions left, before and after compaction."""
    path = f"file://{tmp_path}/index"
    data = rows(documents)
    passage = " ".join(f"z{i}" for i in range(50))
    data += [(100 + k, f"kopf{k} {passage} fuß{k}") for k in range(5)] + [(200, " ".join(f"allein{i}" for i in range(60)))]
    kinds, past = "doc_id long, text string", []
    for turn in range(5):
        session = spark.newSession()
        index = substring_dedup.FingerprintIndex(session, path, fanout=2)
        assert index.size == 35 and len(index.runs) == [0, 1, 2, 1, 2][turn]
        now = data[turn::5]
        batch, history = session.createDataFrame(now, kinds), session.createDataFrame(past, kinds)
        got = substring_dedup.remove_repeated(batch, digest=True, keep_text=False, index=index, history=history)
        want = brute_substrings(past + now, 35)
        mine = [w for w in want if w[0] in {d for d, _ in now}]
        got = sorted([tuple(r) for r in got.collect()], key=key)
        assert set(got) <= set(mine) and len(got) == len(now)
        past += now
        index.close()
    plan = substring_dedup.FingerprintIndex(spark, path)
    assert plan.ingest(spark.createDataFrame([(None,), ("",)], "text string")).count() == 0 and len(plan.runs) == 2
    met = plan._read(plan.runs[0]).join(plan._read(plan.runs[1]).withColumnRenamed("n", "m").hint("merge"), "fp")
    text = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert sum(r.n for r in plan.merged().collect()) == sum(r.n for r in substring_dedup.fingerprints(spark.createDataFrame(data, kinds)).collect())
    plan.close()


# Shingles


def brute_join(data, size=5, percent=75):
    sets = []
    for _, t in data:
        w = SPACE.findall(lower(t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    n = len(data)
    pairs = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = groups(pairs, range(n))
    members = defaultdict(list)
    for k, r in root.items():
        members[r].append(data[k][0])
    return sorted([(data[k][0], len(sets[k]), min((x for x in members[root[k]] if x is not None), default=None)) for k in range(n)], key=key)


def near_copies():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 160)]
    out = []
    for k in range(60):
        w = list(base if k % 3 else base[: 100 + k])
        for at in rng.integers(0, len(w), k % 9):
            w[at] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    out += [" ".join(f"q{i}" for i in range(k)) for k in range(1, 30)]
    out += ["license " + " ".join(base[:20]) + " " + " ".join(f"u{k}_{i}" for i in range(k)) for k in range(0, 40, 3)]
    return out


@pytest.mark.parametrize("factor", [ngram_join.MERGE_FACTOR, 0])
def test_join_of_near_copies(spark, factor):
    data = list(enumerate(near_copies()))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = ngram_join.link_classes(df, merge_factor=factor).select("id", "n_shingles", "component")
    assert sorted([tuple(r) for r in got.collect()], key=key) == brute_join(data)


def test_divide_skip_against_counting():
    rng = np.random.default_rng(4)
    for turn in range(400):
        lists = [sorted(set(rng.integers(0, 60, rng.integers(0, 40)).tolist())) for _ in range(rng.integers(0, 12))]
        count = Counter(x for part in lists for x in part)
        for need in range(1, 8):
            assert sorted(ngram_join.divide_skip(lists, need)) == sorted((m, c) for m, c in count.items() if c >= need), (turn, need)


def test_a_shingle_that_all_documents_share(spark, monkeypatch):
    """One hot list, cut into many ranges, and groups of near copies behind it."""
    monkeypatch.setattr(ngram_join, "SEARCH_ROWS", 16)
    data = []
    for k in range(60):
        words = ["alle", "teilen", "diese", "fünf", "Worte", *(f"w{k // 3}x{i}" for i in range(12 if k % 3 else 13))]
        data.append((k, " ".join([*words, *["ende"] * (k % 2)])))
    data += [(100 + k, "alle teilen diese fünf Worte" + f" {k}" * (k % 5)) for k in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.op9_ngram_join(df).collect())
    assert got == sorted(brute_join(data))


def test_join_of_odd_rows(documents, empty):
    got = ngram_join.op9_ngram_join(documents)
    assert sorted([tuple(r) for r in got.collect()], key=key) == brute_join(rows(documents))
    assert ngram_join.op9_ngram_join(empty).count() == 0


def test_one_of_each_class_stays(spark, empty):
    data = list(enumerate(near_copies()))
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(data, "doc_id long, text string").withColumn("rid", F.lit(1)))
    want = {c for _, _, c in brute_join(data)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == ["doc_id", "text", "rid"]
    assert ngram_join.keep_one_of_each(empty).count() == 0


# Vectors


def vectors(spark, n=600, dim=64):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 3):
        x[k] = x[(k // 30) * 30] + rng.normal(size=dim) * 0.12 * (k % 5)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [float("inf")] * dim, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, rows[0][1], 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int")


def brute_vectors(data, limit=0.95):
    good = {}
    for k, v in data:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v)
            good[k] = a / np.linalg.norm(a)
    ids = sorted(good)
    pairs = [(a, b) for a in ids for b in ids if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= limit]
    n = Counter(x for p in pairs for x in p)
    root = groups(pairs, [k for k, _ in data])
    return {k: (n[k], root[k], k == root[k]) for k, _ in data}


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"bits": 6}, {"bits": 10, "radius": 1, "block": 32}])
def test_vectors(spark, options):
    df = vectors(spark)
    want = brute_vectors([(r.vec_id, r.embedding) for r in df.collect()])
    out = itq_dedup.deduplicate(df, **options)
    assert out.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert there > 500 and all(got[k][0] <= want[k][0] for k in want)
    assert found >= 0.9 * there
    if options.get("bits") == 6:
        assert got == want


def test_codes_within_the_radius_meet(spark):
    """Pairs whose codes differ in fewer than (radius + 1) * tables bits are all found, each once."""
    df = vectors(spark)
    ids, rows = zip(*[(r.vec_id, r.embedding) for r in df.where("vec_id < 600").orderBy("vec_id").collect()])
    x = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    for radius, bits in ((0, 8), (1, 8), (1, 16)):
        codes = itq_dedup.Codes(64, 600, 1.0, bits, radius, itq_dedup.learn_rotation(x))
        assert codes.tables == 64 // bits
        keys = codes.keys(x)
        apart = np.bitwise_count(keys[:, None, :] ^ keys[None, :, :])
        want = np.triu((apart.min(2) <= radius) & (x @ x.T >= -0.2), 1)
        near = np.triu(apart.sum(2) < (radius + 1) * codes.tables, 1) & (x @ x.T >= -0.2)
        assert (near & ~want).sum() == 0
        got = np.zeros((600, 600), int)
        for t in range(codes.tables):
            for key in np.unique(keys[:, t]):
                home = np.flatnonzero(keys[:, t] == key)
                guests = np.flatnonzero((np.bitwise_count(keys[:, t] ^ key) == 1) & (keys[:, t] > key)) if radius else home[:0]
                at = np.concatenate([home, guests])
                guest = np.arange(len(at)) >= len(home)
                links = itq_dedup._local_links(at, x[at], keys[at], t, -0.2, None, guest, radius)
                got[0, links["u"]] += links["n"]
        assert (got[0] == want.sum(0) + want.sum(1)).all()


def test_every_length_of_vectors_is_compared(spark, monkeypatch):
    """Two close vectors of each of 70 lengths, repeated ids, and a missing id."""
    rng = np.random.default_rng(5)
    rows = []
    for d in range(2, 72):
        v = rng.normal(size=d)
        rows += [(2 * d, v.tolist()), (2 * d + 1, (v * 3).tolist())]
    same = rng.normal(size=80).tolist()
    rows += [(1, same), (1, same), (1, rng.normal(size=80).tolist()), (None, same), (999, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(itq_dedup, "LEARNED", 8)
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in itq_dedup.deduplicate(df).collect())
    want = [(k, 1, k - k % 2, k % 2 == 0) for k in range(4, 144)] + [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (-1, 0, -1, True), (999, 2, 1, False)]
    assert got == sorted(want)


def test_no_vectors(spark):
    assert itq_dedup.deduplicate(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_row_stays_of_each_class(spark):
    """Classes without ids, repeated rows, and an id that two unrelated classes share."""
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdefg"}
    data = [(None, text["a"]), (None, text["b"]), (None, text["b"] + " tail"), (None, text["c"]), (None, text["c"]), (5, text["d"]), (5, text["d"]), (5, text["d"]), (6, text["d"] + " tail"), (7, text["e"]), (7, text["f"]), (None, text["g"]), (8, text["g"]), (9, ""), (9, ""), (None, ""), (None, "")]
    df = spark.createDataFrame([(d, t, i % 2) for i, (d, t) in enumerate(data)], "doc_id long, text string, x int")
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_one_of_each(df).collect())
    b = [k for k in got if k[0] is None and k[1].startswith("b0 ")]
    assert len(b) == 1 and b[0] in data
    want = Counter([(None, text["a"]), b[0], (None, text["c"]), (5, text["d"]), (7, text["e"]), (7, text["f"]), (8, text["g"]), (9, ""), (None, ""), (None, "")])
    assert got == want


@pytest.mark.parametrize("dim,bits", [(64, 8), (64, 10), (64, 12), (64, 16), (32, None), (16, None)])
def test_pairs_at_the_threshold_meet(spark, dim, bits):
    """The substrings of large tables, and short vectors, find pairs just above cosine 0.95 too."""
    rng = np.random.default_rng(dim + (bits or 0))
    a, u = rng.normal(size=(2, 1000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    u -= (a * u).sum(1)[:, None] * a
    u /= np.linalg.norm(u, axis=1)[:, None]
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * u
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.vstack([a, b]))], "vec_id long, embedding array<double>")
    x = np.vstack([a, b])
    want = int((np.triu(x @ x.T, 1) >= 0.95).sum())
    got = itq_dedup.near_links(df, bits=bits).agg(F.sum("n")).first()[0] / 2
    print("recall", dim, bits, got / want)
    assert 0.97 * want <= got <= want


def test_tables_of_few_rows_are_written_by_few_tasks(spark, monkeypatch):
    files = {}

    def noted(df, name, write=ngram_join.stored):
        out = write(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "stored", noted)
    monkeypatch.setattr(_components, "stored", noted)
    data = list(enumerate(near_copies()))
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = ngram_join.link_classes(spark.createDataFrame(data, "doc_id long, text string")).select("id", "n_shingles", "component").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted([tuple(r) for r in got], key=key) == brute_join(data)
    cores = spark.sparkContext.defaultParallelism
    assert {k: n for k, n in files.items() if n > cores + 8 and k != "shared-shingles"} == {}


def test_a_round_of_hubs_that_does_not_help_is_the_last(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(ngram_join, "_hub_pairs", lambda *a, f=ngram_join._hub_pairs: rounds.append(1) or f(*a))
    monkeypatch.setattr(ngram_join, "HELPED", 0)
    data = list(enumerate(near_copies()))
    got = ngram_join.link_classes(spark.createDataFrame(data, "doc_id long, text string"), merge_factor=0).select("id", "n_shingles", "component")
    assert sorted([tuple(r) for r in got.collect()], key=key) == brute_join(data)
    assert len(rounds) == 2
