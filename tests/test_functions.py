import math

from pyspark.sql import functions as F

from termloom.functions import lexicon as L
from termloom.functions import numeric as N
from termloom.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_main_tokens_know_unicode_and_one_inner_mark(spark):
    assert one(spark, "Änderungs-Historie a x_1 SF6-Gas U.S.A. über\nalles", T.main_tokens) == ["Änderungs-Historie", "x_1", "SF6-Gas", "U.S", "über", "alles"]
    assert one(spark, "", T.main_tokens) == []
    assert one(spark, None, T.main_tokens) == []


def test_scalars(spark):
    assert one(spark, "a1 22 b33c", T.mask_digits) == "a## ## b##c"
    assert one(spark, "ab1 c_d-e", T.words_without_digits) == "ab c_d e"
    assert one(spark, "ab-c, (d)", T.words_plain) == "ab c d"
    assert one(spark, "ab-c, (d)", T.words_hyphen) == "ab-c d"
    assert one(spark, "(a) b", T.strip_parentheses) == "a b"
    assert one(spark, "a b-c", T.split_blank_hyphen) == ["a", "b", "c"]
    assert one(spark, "a-", T.trim_hyphen) == "a"
    assert one(spark, "-a-", T.trim_hyphen) == "-a"
    assert one(spark, "-a", T.trim_hyphen) == "a"
    assert one(spark, "Links", T.plural_base) == "Link"
    assert one(spark, "Verarbeitungswerkes"[:14] + "s", T.plural_base).endswith("s")
    assert one(spark, "f(x)[1]", T.escape_brackets) == r"f\(x\)\[1\]"
    assert one(spark, "vou ao mar, pela rua", T.split_contractions) == "vou a o mar, por a rua"


def test_articles_go_everywhere_in_the_chunk(spark):
    assert one(spark, "der Teil der Anlage", lambda c: T.strip_article(c, L.GERMAN_ARTICLES)) == "Teil Anlage"
    assert one(spark, "Teil der Anlage", lambda c: T.strip_article(c, L.GERMAN_ARTICLES)) == "Teil der Anlage"
    assert one(spark, "the part", lambda c: T.drop_leading(c, L.STOP_WORDS)) == "part"
    assert one(spark, "the", lambda c: T.drop_leading(c, L.STOP_WORDS)) == ""


def test_ngrams(spark):
    words = F.split(F.col("x"), " ")
    assert one(spark, "a b c", lambda c: T.ngrams(F.split(c, " "), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: T.ngrams(F.split(c, " "), 2)) == []
    assert words is not None


def test_measures(spark):
    row = spark.createDataFrame([(0.01, 1000.0, 0.002, 0.0)], "w double, n double, d double, g double").select(
        N.log_likelihood_domain(F.col("w"), F.col("n"), F.col("d")).alias("ld"), N.log_likelihood_general(F.col("w"), F.col("n"), F.col("g")).alias("lg"), N.ratio(F.col("w"), F.col("d")).alias("r"), N.ratio(F.col("w"), F.col("g")).alias("r0")
    ).first()
    w, n, d, g = 0.01, 1000.0, 0.002, 1e-5
    cd, cg = (d + w) / (76862 + n), (g + w) / (569010 + n)
    assert math.isclose(row["ld"], 2 * (w + math.log(w / (n * cd)) + d * math.log(d / (76862 * cd))))
    assert math.isclose(row["lg"], 2 * (w + math.log(w / n * cg) + g * math.log(g / (569010 * cg))))
    assert (row["r"], row["r0"]) == (5.0, 0.0)


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "x array<double>, y array<double>")
    got = [r["d"] for r in df.select(N.cosine_distance(F.col("x"), F.col("y")).alias("d")).collect()]
    assert math.isclose(got[0], 1) and abs(got[1]) < 1e-12 and got[2] is None
    s = spark.createDataFrame([("abc", "abd"), ("ab", "abcd"), ("", "x")], "a string, b string")
    assert [r[0] for r in s.select(N.hamming(F.col("a"), F.col("b"))).collect()] == [1, 2, 1]
    t = spark.createDataFrame([(["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    r = t.select(N.jaccard(F.col("a"), F.col("b")).alias("j"), N.sorensen(F.col("a"), F.col("b")).alias("s"), N.token_distance(F.lit(0.0)).alias("d")).first()
    assert math.isclose(r["j"], 1 / 3) and r["s"] == 0.5 and math.isclose(r["d"], math.sqrt(-2 * math.log(1e-7)))


def test_tags(spark):
    tags = {w: one(spark, w, L.pos_tag) for w in ["der", "mit", "und", "Anlage", "lenkung", "möglich", "laden", "xyz"]}
    assert tags == {"der": "DET", "mit": "ADP", "und": "CONJ", "Anlage": "NOUN", "lenkung": "NOUN", "möglich": "ADJ", "laden": "VERB", "xyz": "X"}
    assert one(spark, "sachlich", L.pos_tag) == "ADJ"


def test_ngrams_read_words_in_place(spark):
    """No slice is made for each n-gram; nulls are skipped, short arrays give none."""
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", None, "c"],), (["a", "b"],), ([],), (None,)], "ws array<string>").select(T.ngrams(F.col("ws"), 3).alias("g"))
    assert [r.g for r in df.collect()] == [["a b c", "b c d"], ["a c"], [], [], []]
    assert df._jdf.queryExecution().executedPlan().toString().count("array_join") == 0
