import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empty and long texts, ties, repeats, and clashing extra columns."""
    base = [f"wort{i} satz{i % 7} ende{i % 11}" for i in range(60)]
    long = " ".join(f"L{i}" for i in range(5000))
    line = "A line that many documents hold, long enough to count."
    texts = [
        " ".join(base), " ".join(base), " ".join(base[:-1]) + " anders", None, "", "\n\n", "kurz", "zwei Worte", long, long + " tail", "ÄÖÜ ß é 漢字 \U0001f600 " * 40,
        *[f"kopf {i}\n  {line.upper() if i % 2 else line}\t\nfuß {i}" for i in range(6)], "x y " * 60, "<|endoftext|> don't it's 12345 !!!",
    ]
    rows = [(i, t, "de" if i % 2 else "en", 1, "x") for i, t in enumerate(texts)] + [(3, None, None, None, None), (0, texts[0], "en", 1, "x"), (None, texts[0], None, None, None), (None, "fremd " * 50, "en", 2, "y")]
    cols = "doc_id long, text string, lang string, n_words int, ids string"
    return spark.createDataFrame(rows, cols)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
