import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import lexicon as L
from termloom.operators import clusters as C
from termloom.operators import cooccur as O
from termloom.operators import evaluate as E
from termloom.operators import merge as M
from termloom.operators import stats as S
from termloom.operators import tagger as G
from termloom.operators import template as P
from termloom.operators import tokens as K


def reqs(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "req_no int, text string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_candidates_and_totals(spark):
    r = reqs(spark, "Das System 42 muss", None, "System")
    assert rows(K.candidates(r), "req_no", "pos", "term") == [(1, 0, "Das"), (1, 1, "System"), (1, 2, "muss"), (3, 0, "System")]
    assert K.total_words(r).first()[0] == 5
    assert rows(K.sentences(r), "req_no", "s_no", "sentence")[0] == (1, 0, "Das System 42 muss")


def test_ordinals_are_dense(spark):
    df = spark.createDataFrame([(i,) for i in (7, 5000, 1, 9000, 12)], "id long")
    assert rows(K.ordinals(df, "id"), "id", "ordinal") == [(1, 1), (7, 2), (12, 3), (5000, 4), (9000, 5)]


def test_language_tie_is_null(spark):
    df = spark.createDataFrame([("the der",), ("the user must",), ("der Nutzer",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(K.language(F.col("t"))).collect()] == [None, "EN", "DE", None, None]
    assert K.corpus_language(reqs(spark, "der Nutzer", "the user")).first()[0] == "DE"


def test_filters(spark):
    t = K.candidates(reqs(spark, "der Motor QX der QX"))
    assert [r.term for r in K.without(t, ["der"]).orderBy("pos").collect()] == ["Motor", "QX", "QX"]
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "w string")
    found, rest = K.abbreviations(t, words("der", "Motor"), words("abc"))
    assert rows(found, "term") == [("QX",), ("QX",)] and rows(rest, "term") == [("Motor",), ("der",), ("der",)]
    assert rows(K.reduced_stops(words("a", "b"), words("b")), "w") == [("a",)]


def test_chunks_and_patterns(spark):
    t = K.annotate(K.candidates(reqs(spark, "die Steuerung der Anlage mit laden und ordnen")))
    assert rows(K.noun_runs(t), "pos", "n", "chunk") == [(0, 4, "die Steuerung der Anlage")]
    assert rows(K.trigrams(t), "term") == [("Steuerung der Anlage",)]
    assert rows(K.linked_verbs(t), "term") == [("laden und ordnen",)]
    assert rows(K.verbs(t, ["laden"]), "lemma") == [("ordnen",)]


def test_rebuilt_keeps_empty_requirements(spark):
    r = reqs(spark, "eins zwei", "")
    assert rows(K.rebuilt(K.candidates(r), r), "req_no", "sentence") == [(1, "eins zwei "), (2, "")]


def test_compound_split(spark):
    lex = spark.createDataFrame([("steuerungs", 3), ("einheit", 9), ("steuer", 1), ("ungseinheit", 1)], "e string, f long")
    words = spark.createDataFrame([("steuerungseinheit",), ("unzerlegbarewort",), ("kurz",)], "word string")
    assert rows(K.best_split(words, lex), "word", "head", "tail") == [("steuerungseinheit", "steuerungs", "einheit"), ("unzerlegbarewort", "unzerlegbarewort", "")]
    assert rows(K.split_recursively(words, lex), "word", "parts") == [("kurz", "kurz"), ("steuerungseinheit", "steuerungs einheit"), ("unzerlegbarewort", "unzerlegbarewort")]


def test_rank_with_repeats(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "term string")
    assert rows(S.alphabetical(df), "term", "alphabetical_order") == [("a", 0), ("b", 2), ("c", 3)]


def test_tfidf_against_plain_python(spark):
    docs = ["ab cd ab", "cd ef", "", "ef-gh ab"]
    r = reqs(spark, *docs)
    vocabulary = spark.createDataFrame([("ab",), ("cd",), ("ef",), ("ef-gh",), ("zz",)], "term string")
    got = {x.term: x.tfidf_mean for x in S.mean_tfidf(r.withColumnRenamed("text", "sentence"), vocabulary).collect()}
    toks = [[w for w in d.replace("-", " ").split()] for d in docs]
    vocab = ["ab", "cd", "ef"]
    df = {v: sum(v in t for t in toks) for v in vocab}
    weight = {v: [] for v in vocab}
    for t in toks:
        w = {v: t.count(v) * (math.log((1 + len(docs)) / (1 + df[v])) + 1) for v in vocab if v in t}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for v, x in w.items():
            weight[v].append(x / norm)
    for v in vocab:
        assert math.isclose(got[v], round(sum(weight[v]) / len(weight[v]), 3), abs_tol=1e-9)
    assert got["ef-gh"] is None and got["zz"] is None


def test_frequencies(spark):
    r = reqs(spark, "eins zwei eins", "zwei")
    f = S.frequencies(K.candidates(r), K.total_words(r))
    assert rows(f, "term", "abs_freq", "rel_freq") == [("eins", 2, 0.5), ("zwei", 2, 0.5)]
    assert rows(S.occurrence_ids(K.candidates(r)), "term", "req_ids") == [("eins", [1]), ("zwei", [1, 2])]
    assert rows(S.document_frequency(K.candidates(r)), "term", "doc_freq") == [("eins", 1), ("zwei", 2)]


def test_substring_antijoin(spark):
    words = spark.createDataFrame([("Item",), ("Link",), ("items",)], "term string")
    chunks = spark.createDataFrame([("Nachweis-Item",), ("Link Typ",)], "chunk string")
    assert rows(M.not_inside(words, chunks), "term") == [("items",)]


def test_keep_last_takes_the_smallest_count(spark):
    df = spark.createDataFrame([("t", 5, "ADJ"), ("t", 3, "ADJ"), ("t", 3, "VERB")], "term string, abs_freq int, word_class string")
    assert rows(M.keep_last(df), "abs_freq", "word_class") == [(3, "VERB")]


def test_maps(spark):
    m = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "")], "ord int, key string, value string")
    assert rows(M.inverted(m), "value", "key") == [("", "c"), ("x", "b")]
    assert rows(M.filled(m), "key", "value") == [("a", "x"), ("b", "x"), ("c", "c")]
    second = spark.createDataFrame([("x", "y")], "key string, value string")
    assert rows(M.composed(m, second), "key", "value") == [("a", "y"), ("b", "y"), ("c", "")]


def test_cooccurrence_is_symmetric_with_frequencies_on_the_diagonal(spark):
    w = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "c"), (3, "b")], "unit int, word string")
    c = O.cooccurrence(w)
    assert rows(c, "w1", "w2", "n_docs") == [("a", "a", 1), ("a", "b", 1), ("b", "b", 3), ("b", "c", 1), ("c", "c", 1)]
    terms = spark.createDataFrame([("a b",), ("a zz b",), ("zz a",)], "term string")
    v = O.mean_vectors(terms, c)
    assert rows(v.where("term = 'a b'"), "dim", "weight") == [("a", 1.0), ("b", 2.0), ("c", 0.5)]
    assert rows(v.where("term = 'a zz b'"), "dim", "weight") == [("a", 1.0), ("b", 1.0)]
    assert v.where("term = 'zz a'").count() == 0
    d = O.sparse_cosine(v, spark.createDataFrame([("a b", "a zz b")], "a string, b string")).first()["dist"]
    assert math.isclose(d, 1 - 3 / (math.sqrt(5.25) * math.sqrt(2)))


def test_keyword_clusters(spark):
    t = spark.createDataFrame([("red pump",), ("pump motor",), ("the valve",), ("lone",), ("a b c d e pump",)], "term string")
    assert rows(C.keyword_clusters(t, ["the"]), "cluster", "term") == [("pump", "pump motor"), ("pump", "red pump"), ("rest", "lone"), ("rest", "the valve")]


def test_postprocessing(spark):
    m = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "b"), ("c2", "a"), ("c3", "z"), ("c4", None)], "cluster string, term string")
    assert rows(C.postprocessed(m), "cluster", "term") == [("c1", "a"), ("c1", "b"), ("cluster0", "z")]


def test_layers(spark):
    t = spark.createDataFrame([("a b c",), ("a b d",), ("c x",), ("q",)], "term string")
    assert rows(C.shared_word_layers(t, []), "layer", "term") == [(0, "c x"), (0, "q"), (2, "a b c"), (2, "a b d")]


def test_centroid_linkage_separates_groups():
    x = np.array([[0.0], [0.1], [5.0], [5.05], [20.0]])
    d = np.abs(x - x.T)
    assert C.centroid_linkage(d, 1.0).tolist() == [1, 1, 2, 2, 3]
    assert len(set(C.centroid_linkage(d, 0.0).tolist())) == 5
    assert len(set(C.centroid_linkage(d, 100.0).tolist())) == 1


def test_hierarchical_refuses_large_groups(spark):
    v = spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(4)], "g int, id int, v array<double>")
    with pytest.raises(ValueError):
        C.hierarchical(v, "g", "id", "v", 0.1, most=3)
    assert C.hierarchical(v, "g", "id", "v", 2.0).select("cluster").distinct().count() == 1


def test_fuzzy_c_means(spark):
    v = spark.createDataFrame([(i, [float(i % 2) * 10, 0.1 * i]) for i in range(10)], "id long, v array<double>")
    got = C.fuzzy_c_means(v, "id", "v", 2).collect()
    assert len(got) == 10 and len({(r.id % 2, r.cluster) for r in got}) == 2


def omega_brute(c1, c2):
    nodes = sorted({n for x in (*c1.values(), *c2.values()) for n in x})
    count = lambda c, u, v: sum(u in x and v in x for x in c.values())
    pairs = list(itertools.combinations(nodes, 2))
    a, b = [count(c1, u, v) for u, v in pairs], [count(c2, u, v) for u, v in pairs]
    top = min(max(a), max(b))
    n = len(pairs)
    obs = sum(x == y and x <= top for x, y in zip(a, b)) / n
    exp = sum(a.count(j) * b.count(j) for j in range(top + 1)) / n**2
    return 1.0 if obs == exp == 1 else (obs - exp) / (1 - exp)


def test_omega_of_overlapping_clusters(spark):
    c1 = {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5]}
    c2 = {"x": [1, 2], "y": [2, 3, 4], "z": [2, 3], "w": [6]}
    frame = lambda c: spark.createDataFrame([(k, n) for k, ns in c.items() for n in ns], "cluster string, node int")
    f1, f2 = frame(c1), frame(c2)
    value = lambda a, b: E.omega(E.omega_parts(a, b)).first()[0]
    assert math.isclose(value(f1, f2), omega_brute(c1, c2))
    assert math.isclose(value(f2, f1), omega_brute(c2, c1))
    assert math.isclose(value(f1, f1), 1.0)


def test_scores(spark):
    kind = "tool string, unit int, item string"
    c = spark.createDataFrame([("t", 1, "a"), ("t", 1, "b"), ("t", 2, "c")], kind)
    g = spark.createDataFrame([("t", 1, "a"), ("t", 2, "c"), ("t", 2, "d"), ("t", 3, "e")], kind)
    r = E.set_scores(c, g, ["tool"]).first()
    assert (r.tp, r.fp, r.fn, round(r.precision, 3), r.recall, r.f_score) == (2, 1, 2, 0.667, 0.5, 0.57)
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "term string")
    assert E.recall_percent(words("a"), words("a", "b", "c")).first()["recall_percent"] == 33.33


def test_template(spark):
    texts = ["Das System muss dem Nutzer die Möglichkeit bieten, Daten zu laden.", "Wenn ein Fehler auftritt, muss das System den Fehler melden.", "Kein Verb hier", "Das System muss fähig sein, Daten zu ordnen (alt, neu)."]
    df = spark.createDataFrame([(t,) for t in texts], "sentence string")
    got = {r.sentence: r for r in P.slots(df).collect()}
    a, b, c, d = (got[t] for t in texts)
    assert (a.modal_verb, a.actor, a.system_name, a.verb, a.object_complement) == ("muss", "Nutzer", "Das System", "laden", "Daten")
    assert (b.modal_verb, b.condition, b.system_name) == ("muss", "Wenn ein Fehler auftritt", "das System")
    assert not c.is_conformant and c.modal_verb == "" and c.verb == ""
    assert d.verb == "ordnen (alt, neu)" and a.is_conformant and b.is_conformant


def test_modal_before_a_comma_is_skipped(spark):
    df = spark.createDataFrame([("Was er soll, wird gut",)], "s string")
    assert df.select(P.modal(F.col("s"))).first()[0] == "wird"


def test_requirement_parts(spark):
    df = spark.createDataFrame([("Das System muss die Daten laden.",), ("nichts",)], "s string")
    got = [r[0] for r in df.select(P.requirement_parts(F.col("s"))).collect()]
    assert (got[0]["object"], got[0]["verb"]) == ("die Daten", "laden") and got[1]["object"] is None


def test_tagger_steps(spark):
    df = spark.createDataFrame([('Sie kam (spät) z.B. um 3,5 Uhr ... "gut"!',)], "s string")
    assert df.select(G.punctuation_tokens(F.col("s"), ["z.B."])).first()[0] == ["Sie", "kam", "(", "spät", ")", "z.B.", "um", "3,5", "Uhr", "...", '"', "gut", '"', "!"]
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("in New York City und New York".split())], "req_no int, pos int, term string")
    units = spark.createDataFrame([("New York",), ("New York City",), ("York City",)], "unit string")
    assert rows(G.multiword_units(t, units), "pos", "n", "unit") == [(1, 3, "New York City"), (5, 2, "New York")]
    tagged = spark.createDataFrame([(1, 0, "Das", "ART", "B-NC"), (1, 1, "Haus", "NN", "I-NC"), (1, 2, "steht", "VV", "O"), (1, 3, "heute", "ADV", "I-AC")], "req_no int, pos int, term string, tag string, chunk_tag string")
    assert G.bracketed(tagged).first()["tree"] == "(ROOT (NC (ART Das) (NN Haus)) (VV steht) (AC (ADV heute)))"
    verbs = spark.createDataFrame([(1, 0, "muss", "VMFIN"), (1, 1, "laden", "VVFIN"), (1, 2, ".", "$.")], "req_no int, pos int, term string, tag string")
    assert rows(G.repaired_verbs(verbs), "pos", "tag") == [(0, "VMFIN"), (1, "VVINF"), (2, "$.")]


def test_branches_of_tokens_are_counted_at_once(spark):
    """Both lists are met by lemma, in one shuffle of counts; equal lemmas of a requirement are one row."""
    from termloom.plans import statistics as Z

    data = [(1, "Haus"), (1, "haus"), (1, "ABC"), (1, "laden"), (1, "laden"), (2, "ordnen"), (2, "muss"), (2, "Kfz"), (2, "the"), (2, "nutzbar")]
    t = spark.createDataFrame(data, "req_no int, term string")
    words = lambda *ws: spark.createDataFrame([(w,) for w in ws], "w string")
    out = Z.token_counts(t, words("Haus", "laden", "ordnen", "muss", "the", "nutzbar"), words("kfz"), ["the"], ["ordnen"])
    assert rows(out, "branch", "req_no", "term", "tf") == sorted([
        ("token", 1, "hau", 1), ("abbreviation", 1, "haus", 1), ("abbreviation", 1, "ABC", 1), ("token", 1, "laden", 2), ("VERB", 1, "laden", 1), ("process VERB", 1, "laden", 1),
        ("token", 2, "ordnen", 1), ("token", 2, "mus", 1), ("token", 2, "kfz", 1), ("token", 2, "nutzbar", 1), ("ADJ", 2, "nutzbar", 1),
    ])
    assert Z.token_counts(t.limit(0), words(), words(), []).count() == 0


def test_chunks_inside_a_row(spark):
    t = reqs(spark, "die Steuerung der Anlage mit laden und 1 Motor", "laden", "")
    items = K.packed(t, tag=L.pos_tag)
    assert items.count() == 2
    found = [list(r.c) for r in items.select("req_no", K.noun_chunks(F.col("items")).alias("c")).orderBy("req_no").collect()]
    flat = K.noun_runs(K.annotate(K.candidates(t)))
    assert found == [[r.chunk for r in flat.orderBy("pos").collect()], []]


def test_fields_of_piped_lines_are_cut_by_spark(spark):
    df = spark.createDataFrame([("a", "x\ty\t"), ("b", "")], "k string, sentence string")
    out = G.piped(df, ["tr", " ", "\t"], id_col="k")
    assert [(r.id, r.line, r.fields) for r in out.collect()] == [("a", "x\ty", ["x", "y"])]
    assert "split" not in out.select("id", "line")._jdf.queryExecution().executedPlan().toString().lower()
    assert "split" in out._jdf.queryExecution().executedPlan().toString().lower()


def test_piped(spark):
    df = spark.createDataFrame([(1, "b\ta"), (2, "c"), (3, ""), (4, None), (5, "d e")], "k int, sentence string").repartition(1).sortWithinPartitions("k")
    got = [(r.id, r.pos, r.fields) for r in G.piped(df, ["tr", " ", "\n"], id_col="k").collect()]
    assert got == [("1", 0, ["b"]), ("1", 1, ["a"]), ("2", 0, ["c"]), ("5", 0, ["d"]), ("5", 1, ["e"])]
    assert G.piped(df.limit(0), ["cat"]).count() == 0


def test_stop_words_are_sorted():
    assert L.STOP_WORDS == sorted(set(L.STOP_WORDS))


def test_compound_split_until_nothing_changes(spark):
    """Cuts that take only four characters each need more than three rounds."""
    parts = ["aaaa", "bbbb", "cccc", "dddd", "eeeeeeeeee"]
    lex = spark.createDataFrame([(x, 5) for x in parts] + [("".join(parts[k:]), 5) for k in range(1, 4)], "e string, f long")
    words = spark.createDataFrame([("".join(parts),)], "word string")
    assert rows(K.split_recursively(words, lex), "word", "parts") == [("".join(parts), " ".join(parts))]


def linkage_brute(d, threshold):
    """Clusters as sets, all distances kept by pairs of sets."""
    n = len(d)
    live = [frozenset([i]) for i in range(n)]
    dist = {frozenset([a, b]): d[min(a)][min(b)] ** 2 for a, b in itertools.combinations(live, 2)}
    height = {c: 0.0 for c in live}
    done = [c for c in live]
    while len(live) > 1:
        a, b = min(itertools.combinations(sorted(live, key=min), 2), key=lambda p: (round(dist[frozenset(p)], 12), min(p[0]), min(p[1])))
        here = dist[frozenset([a, b])]
        c = a | b
        live = [x for x in live if x not in (a, b)]
        for x in live:
            k, l = len(a), len(b)
            dist[frozenset([c, x])] = (k * dist[frozenset([a, x])] + l * dist[frozenset([b, x])]) / (k + l) - k * l * here / (k + l) ** 2
        height[c] = max(height[a], height[b], math.sqrt(max(here, 0)))
        live.append(c)
        done.append(c)
    kept = [c for c in done if height[c] <= threshold]
    top = {i: max((c for c in kept if i in c), key=len) for i in range(n)}
    return [min(top[i]) for i in range(n)]


def test_hierarchical_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    x[20:] = x[:20] + rng.normal(size=(20, 5)) * 0.2
    data = [(i % 2, i, [float(v) for v in r]) for i, r in enumerate(x)] + [(0, 100, None), (0, 101, [1.0]), (1, 102, [float("nan")] * 5), (1, 103, [None] * 5), (2, 104, None), (2, 105, [])]
    df = spark.createDataFrame(data, "g int, id int, v array<double>")
    for threshold in (0.02, 0.115, 0.4):
        got = {(r.g, r.id): r.cluster for r in C.hierarchical(df, "g", "id", "v", threshold).collect()}
        assert len(got) == 46 and all(got[g, i] is None for g, i, _ in data[40:])
        for g in (0, 1):
            ids = [i for i in range(40) if i % 2 == g]
            u = x[ids] / np.linalg.norm(x[ids], axis=1)[:, None]
            want = linkage_brute(np.clip(1 - u @ u.T, 0, 2), threshold)
            same = lambda c: {(a, b) for a in range(20) for b in range(20) if c[a] == c[b]}
            assert same([got[g, i] for i in ids]) == same(want)
    sweep = C.threshold_sweep(df, "g", "id", "v", [0.02, 0.4])
    one = C.hierarchical(df, "g", "id", "v", 0.4)
    assert rows(sweep.where("threshold = 0.4 and cluster is not null"), "g", "id", "cluster") == rows(one.where("cluster is not null"), "g", "id", "cluster")


def test_sweep_is_scored_by_omega(spark):
    members = {0.1: {"a": [1, 2], "b": [3, 4], "c": [5]}, 0.2: {"a": [1, 2, 3], "b": [4, 5]}}
    gold = {"x": [1, 2], "y": [3, 4, 5]}
    sweep = spark.createDataFrame([(t, k, n) for t, c in members.items() for k, ns in c.items() for n in ns], "t double, cluster string, node int")
    g = spark.createDataFrame([(k, n) for k, ns in gold.items() for n in ns], "cluster string, node int")
    got = E.sweep_scores(sweep, g, "t")
    assert {r.t: round(r.omega, 9) for r in got.collect()} == {t: round(omega_brute(c, gold), 9) for t, c in members.items()}
    assert E.best_point(got, "omega", "t").first()["t"] == max(members, key=lambda t: omega_brute(members[t], gold))
    assert E.sweep_scores(sweep.limit(0), g, "t").count() == 0


def test_fuzzy_c_means_against_loops(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 3)) + 4 * c for c in np.eye(3)])
    data = [(i, r.tolist()) for i, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [None, 1.0, 2.0])]
    df = spark.createDataFrame(data + odd, "id long, v array<double>")
    got = {(r.id, r.cluster): r.membership for r in C.fuzzy_c_means(df, "id", "v", 3).collect()}
    first = spark.createDataFrame(data, "id long, v array<double>").orderBy(F.xxhash64("v"), "v").limit(3).collect()
    c = np.array([r.v for r in first])
    weight = lambda p: np.array([1 / max(math.dist(p, q), 1e-12) ** (2 / 0.3) for q in c])
    while True:
        u = np.array([weight(p) / weight(p).sum() for p in x])
        new = np.array([sum(u[i, k] ** 1.3 * x[i] for i in range(90)) / sum(u[:, k] ** 1.3) for k in range(3)])
        moved, c = abs(new - c).max(), new
        if moved < 0.005:
            break
    u = np.array([weight(p) / weight(p).sum() for p in x])
    want = {(i, k): u[i, k] for i in range(90) for k in range(3) if u[i, k] > 1 / 3}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert C.fuzzy_c_means(df.limit(0), "id", "v", 3).count() == 0


def test_similarities(spark):
    import difflib

    from termloom.functions.similarity import jaro_winkler, ratcliff_obershelp

    pairs = [("MARTHA", "MARHTA"), ("DWAYNE", "DUANE"), ("", ""), ("a", ""), ("WIKIMEDIA", "WIKIMANIA"), ("same", "same"), (None, "x"), ("größe", "grösse")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): (r.j, r.r) for r in df.select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("j"), ratcliff_obershelp(F.col("a"), F.col("b")).alias("r")).collect()}
    assert round(got["MARTHA", "MARHTA"][0], 4) == 0.9611 and round(got["DWAYNE", "DUANE"][0], 4) == 0.84
    assert got[None, "x"] == (None, None) and got["", ""] == (1.0, 1.0) and got["a", ""] == (0.0, 0.0)
    for (a, b), (_, r) in got.items():
        if a is not None:
            assert math.isclose(r, difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_cooccurrence_in_blocks(spark):
    words = spark.createDataFrame([(u, f"w{i}") for u, n in ((1, 23), (2, 7), (3, 1)) for i in range(n)], "unit int, word string")
    whole, cut = O.cooccurrence(words), O.cooccurrence(words, block=5)
    assert rows(whole, "w1", "w2", "n_docs") == rows(cut, "w1", "w2", "n_docs") and whole.count() == 23 * 24 // 2


def test_cosine_pairs_in_blocks(spark):
    """Blocks of matrix products give the pairs and the rounded distances of Spark's own sums."""
    import random

    from termloom.functions import numeric as N

    r = random.Random(7)
    data = [(i, i % 2, [float(r.randint(-9, 9)) for _ in range(5)]) for i in range(60)]
    data += [(60, 0, [0.0] * 5), (61, 0, None), (62, 0, [1.0, None, 1.0, 1.0, 1.0]), (63, 0, [1.0, 2.0]), (64, 0, []), (65, 0, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    data += [(66, 0, [2.0, 4.0, 6.0, 8.0, 1.0]), (66, 0, [1.0, 2.0, 3.0, 4.0, 0.5]), (None, 0, [1.0] * 5), (67, None, [1.0] * 5), (68, 2, [1.0] * 5)]
    v = spark.createDataFrame(data, "id long, g int, v array<float>")
    x, y = v.toDF("a", "g", "x"), v.toDF("b", "g", "y")
    expect = x.join(y, "g").where("a < b").select("a", "b", F.round(N.cosine_distance(F.col("x"), F.col("y")), 3).alias("dist"))
    want = sorted(map(str, expect.collect()))
    for block in (4, 2048):
        assert sorted(map(str, O.cosine_pairs(v, "g", "id", "v", block=block, digits=3).collect())) == want
    texts = v.select(F.col("id").cast("string").alias("id"), "g", "v")
    assert O.cosine_pairs(texts, "g", "id", "v", block=9).where("a >= b").count() == 0
    assert O.cosine_pairs(texts, "g", "id", "v", block=9).count() == len(want) and O.cosine_pairs(v.limit(0), "g", "id", "v").count() == 0


def test_vectors_move_a_few_times_only(spark, monkeypatch):
    """A large group is cut into a few large blocks, so its vectors are not sent out for each of many."""
    v = spark.range(320).selectExpr("id % 2 as g", "id", "array(double(id), 1.0) as v")
    monkeypatch.setattr(O, "SMALL_BLOCK", 5)
    assert O.block_size(v) == 20 and O.block_size(v.limit(0)) == 5
    assert O.in_block_pairs(v, O.block_size(v)).count() == 320 * 8
    assert O.cosine_pairs(v, "g", "id", "v").count() == 2 * 160 * 159 // 2


def test_cooccurrence_counts_pairs_where_words_meet(spark, monkeypatch):
    """Frequent words apart, several portions of a task merged, and by brute force the same."""
    import collections
    import random

    import pyarrow as pa

    r = random.Random(3)
    units = {u: sorted({"a", *(f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 12)))}) for u in range(80)}
    want = collections.Counter((x, y) for ws in units.values() for i, x in enumerate(ws) for y in ws[i:])
    monkeypatch.setattr(O, "OFTEN", 0)
    words = spark.createDataFrame([(u, w) for u, ws in units.items() for w in ws] + [(0, None)], "unit int, word string")
    for share in (1, 3, 1000):
        assert rows(O.cooccurrence(words, block=4, share=share), "w1", "w2", "n_docs") == sorted((x, y, n) for (x, y), n in want.items())
    monkeypatch.setattr(O, "TASK_PAIRS", 20)
    batches = [pa.record_batch({"w1": ws, "rest": [ws[i:] for i in range(len(ws))]}) for ws in units.values()]
    found = [tuple(x.values()) for b in O._pairs_counted(iter(batches)) for x in b.to_pylist()]
    assert sorted(found) == sorted((x, y, n) for (x, y), n in want.items()) and list(O._pairs_counted(iter([]))) == []


def test_cooccurrence_moves_no_pair(spark, monkeypatch):
    """Words of whole units are counted in passes over the units, without a shuffle; several passes and portions change nothing."""
    import collections
    import random

    r = random.Random(5)
    units = {u: sorted({f"w{r.randint(0, 40)}" for _ in range(r.randint(0, 15))}) for u in range(90)}
    want = sorted((x, y, n) for (x, y), n in collections.Counter((x, y) for ws in units.values() for i, x in enumerate(ws) for y in ws[i:]).items())
    whole = spark.createDataFrame(list(units.items()), "unit int, ws array<string>")
    monkeypatch.setattr(O, "TASK_PAIRS", 100)
    pairs = O.cooccurrence(whole, block=50)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan and pairs.rdd.getNumPartitions() > 4
    assert rows(pairs, "w1", "w2", "n_docs") == want
    monkeypatch.setattr(O, "OFTEN", 0)
    assert rows(O.cooccurrence(whole, block=50, share=5), "w1", "w2", "n_docs") == want


def test_matrix_refuses_a_pair_given_twice(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "i string, j string, d long")
    assert rows(E.matrix(df, ["x", "y"]), "i", "x", "y") == [("a", 1, 0), ("b", 0, 2)]
    with pytest.raises(Exception, match="given twice"):
        E.matrix(df.union(df), ["x", "y"]).collect()


def test_empty_tables(spark):
    """No rows in, no rows out."""
    reqs = spark.createDataFrame([], "req_no long, text string")
    found = K.candidates(reqs)
    tagged = K.annotate(found)
    assert found.count() == S.frequencies(found, K.total_words(reqs)).count() == K.noun_runs(tagged).count() == 0
    assert M.not_inside(found.select("term"), K.noun_runs(tagged)).count() == 0
    assert P.slots(reqs, "text").count() == G.bracketed(tagged.withColumn("chunk_tag", F.lit("O"))).count() == 0
    assert O.cooccurrence(found.select(F.col("req_no").alias("unit"), F.col("term").alias("word"))).count() == 0
    assert S.alphabetical(found.select("term")).count() == S.mean_tfidf(K.rebuilt(found, reqs), found).count() == 0


def test_weights_of_a_chunk_of_many_words(spark):
    """A chunk of 50,000 words is one word of the weights; one with a single letter, a hyphen or two blanks is none."""
    long = " ".join(f"wort{i}" for i in range(50_000))
    data = [("chunk", 1, x, 1, True) for x in (long, "ab cd", "ab c", "ab-cd", "ab  cd", "")] + [("token", 1, "ef-gh", 1, False), ("token", 1, "ef", 1, False)]
    counts = spark.createDataFrame(data, "branch string, req_no int, term string, tf int, whole boolean")
    out = S.mean_tfidf_of(counts, spark.createDataFrame([(1,)], "n_reqs long"), ["branch"])
    got = {(r.branch, r.term): r.tfidf_mean for r in out.collect()}
    assert got == {("chunk", long): 0.707, ("chunk", "ab cd"): 0.707, ("chunk", "ab c"): None, ("chunk", "ab-cd"): None, ("chunk", "ab  cd"): None, ("chunk", ""): None, ("token", "ef-gh"): None, ("token", "ef"): 1.0}


def test_ngram_tfidf_by_definition(spark):
    import re

    docs = {1: "Nachweis Item a Nachweis Item prüfen", 2: "Item Nachweis-Item", 3: "", 4: None, 5: "prüfen das Item das Item das"}
    vocabulary = ["Nachweis", "Item", "Nachweis Item", "das Item das", "Nachweis-Item", "a", "Item Nachweis Item", "fehlt", "das", None, ""]
    want, tf = {}, {}
    for d, s in docs.items():
        ws = re.findall(r"\w\w+", s or "")
        grams = [" ".join(ws[i : i + n]) for n in range(1, 4) for i in range(len(ws) - n + 1)]
        tf[d] = {v: grams.count(v) for v in vocabulary if v and grams.count(v)}
    weight = {d: {v: n * (math.log((1 + len(docs)) / (1 + sum(v in x for x in tf.values()))) + 1) for v, n in x.items()} for d, x in tf.items()}
    for v in vocabulary:
        if v is not None:
            unit = [x[v] / math.sqrt(sum(w * w for w in x.values())) for x in weight.values() if v in x]
            want[v] = round(sum(unit) / len(unit), 3) if unit else None
    s = spark.createDataFrame(list(docs.items()), "req_no int, sentence string")
    v = spark.createDataFrame([(x,) for x in [*vocabulary, "das"]], "term string")
    assert {r.term: r.tfidf_mean for r in S.ngram_tfidf(s, v).collect()} == want
    assert want["Nachweis-Item"] is None and want["a"] is None and want["das Item das"]
    assert S.ngram_tfidf(s, v.limit(0)).count() == 0


DYING = "import sys\nfor n, line in enumerate(sys.stdin):\n    print(line.strip().upper(), flush=True)\n    if n == {0}: sys.exit({1})"
SLOW = "import sys, time\nfor line in sys.stdin:\n    time.sleep(0.01)\n    print(line.strip().upper(), flush=True)"


def test_processes_that_die_or_are_slow(spark):
    import sys

    texts = [(i, f"satz {i}" if i % 7 else "") for i in range(120)]
    df = spark.createDataFrame(texts, "k int, sentence string").repartition(2)
    want = sorted((str(i), 0, s.upper()) for i, s in texts if s)
    ask = lambda code, window: sorted((r.id, r.pos, r.line) for r in G.piped(df, [sys.executable, "-c", code], id_col="k", window=window).collect())
    # Answers a few sentences and dies, again and again; also in the midst of one.
    for code in (DYING.format(7, 1), DYING.format(8, 1), DYING.format(9, 0), SLOW):
        assert ask(code, 3) == want
    for window in (2, 1000):  # answers nothing before its input ends
        assert sorted((r.id, r.line) for r in G.piped(df, ["tr", "a-z", "A-Z"], id_col="k", window=window).collect()) == [(i, s) for i, _, s in want]
    with pytest.raises(Exception, match="unanswered"):
        ask(DYING.format(0, 1), 3)
