"""Term statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import numeric as N
from termloom.functions import text as T
from termloom.operators import tokens as K
from termloom.sources.scratch import written


def frequencies(candidates: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """(term, abs_freq[, rel_freq])"""
    out = candidates.groupBy("term").agg(F.count("*").alias("abs_freq"))
    if total is None:
        return out
    # ``total`` is one row.
    return out.crossJoin(F.broadcast(total)).select("term", "abs_freq", (F.col("abs_freq") / F.col("total_words")).alias("rel_freq"))


def document_frequency(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("term").agg(F.countDistinct("req_no").alias("doc_freq"))


def occurrence_ids(candidates: DataFrame) -> DataFrame:
    """(term, req_ids): distinct requirement numbers in ascending order.

    The result itself holds the list; use ``document_frequency`` where a term
    may occur in more documents than a row can hold.
    """
    return candidates.select("term", "req_no").distinct().groupBy("term").agg(F.array_sort(F.collect_list("req_no")).alias("req_ids"))


def reference_rates(reqs: DataFrame) -> DataFrame:
    """(term, ref_freq): relative frequencies of another corpus."""
    found = K.candidates(reqs)
    return frequencies(found, K.total_words(reqs)).select("term", F.col("rel_freq").alias("ref_freq"))


def with_references(freq: DataFrame, domain: DataFrame, general: DataFrame) -> DataFrame:
    """Add rel_freq_domain and rel_freq_general, 0 for unknown terms."""
    out = freq.join(domain.withColumnRenamed("ref_freq", "rel_freq_domain"), "term", "left").join(general.withColumnRenamed("ref_freq", "rel_freq_general"), "term", "left")
    return out.fillna(0.0, ["rel_freq_domain", "rel_freq_general"])


def measures(freq: DataFrame, total: DataFrame) -> DataFrame:
    """Add ratio, indicator and log-likelihoods to a frame with reference rates."""
    one = freq.crossJoin(F.broadcast(total))
    n, w = F.col("total_words").cast("double"), F.col("rel_freq")
    return one.select(
        *freq.columns,
        N.ratio(w, F.col("rel_freq_domain")).alias("ratio_domain"),
        (w > F.col("rel_freq_general")).alias("is_domain_specific"),
        N.log_likelihood_domain(w, n, F.col("rel_freq_domain")).alias("ll_domain"),
        N.log_likelihood_general(w, n, F.col("rel_freq_general")).alias("ll_general"),
    )


#: Words as the weights see them.
WEIGHT_WORD = r"[\p{L}\p{N}_]{2,}"


def mean_tfidf(sentences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, tfidf_mean): mean over the documents that hold the term, rounded to 3 places.

    Weights are tf * (ln((1 + N) / (1 + df)) + 1), scaled to length 1 over the
    vocabulary terms of a document.  Terms that the tokenizer of the weights
    never yields are null.
    """
    word = sentences.select("req_no", F.explode(F.regexp_extract_all("sentence", F.lit(WEIGHT_WORD), F.lit(0))).alias("term"))
    # Counting first keeps a frequent term at one row for each document.
    tf = word.groupBy("req_no", "term").agg(F.count("*").alias("tf"))
    return _mean_weights(tf, vocabulary.select("term").distinct(), sentences.agg(F.count("*").alias("n_reqs")), [])


def mean_tfidf_of(counts: DataFrame, n_reqs: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """As ``mean_tfidf`` of the sentences that the counted terms (keys, req_no, term, tf) make up, without building these.

    A term of several words is one word of the weights, where its row says ``whole``.
    """
    parts = F.regexp_extract_all("term", F.lit(WEIGHT_WORD), F.lit(0))
    if "whole" in counts.columns:
        # A pattern with a repeated group would take a frame of the stack for each word of a long chunk.
        bare = (F.array_join(parts, " ") == F.col("term")) & (F.col("term") != "")
        parts = F.when(~F.col("whole"), parts).when(bare, F.array("term")).otherwise(F.array().cast("array<string>"))
    word = counts.select(*keys, "req_no", F.explode(parts).alias("term"), "tf")
    if keys:
        # Counted where the weights need them, so that they move once for both.
        word = word.repartition(*keys, "term")
    tf = word.groupBy(*keys, "req_no", "term").agg(F.sum("tf").alias("tf"))
    return _mean_weights(tf, counts.select(*keys, "term").distinct(), n_reqs, keys)


def _mean_weights(tf: DataFrame, vocabulary: DataFrame, n_reqs: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "term"]
    tf = tf.join(vocabulary, on, "left_semi")
    # Counted where the vocabulary was met; two whole numbers move on, their weight is taken behind.
    rated = tf.withColumn("df", F.count("*").over(Window.partitionBy(*on))).repartition(*keys, "req_no")
    weighted = rated.crossJoin(F.broadcast(n_reqs)).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n_reqs")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, "req_no")))
    mean = weighted.withColumn("u", F.col("w") / norm).groupBy(*on).agg(F.round(F.avg("u"), 3).alias("tfidf_mean"))
    return vocabulary.join(mean, on, "left")


#: Terms of several words that are sent to all tasks.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 32 << 20


def vocabulary_counts(sentences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(req_no, term, tf): the n-grams of each sentence that are terms of the vocabulary.

    Words are those of the weights; a term that they do not spell, such as one
    with a hyphen or with a single letter, never occurs.  N-grams are made of the
    lengths that terms have and meet the terms of several words where they stand,
    if these fit a broadcast.  Overlapping n-grams count each.
    """
    parts = F.regexp_extract_all("term", F.lit(WEIGHT_WORD), F.lit(0))
    terms = vocabulary.select("term").where("term is not null").distinct().select("term", parts.alias("ws")).where(F.array_join("ws", " ") == F.col("term")).where(F.size("ws") > 0)
    terms = written(terms.select("term", F.size("ws").alias("n")), "vocabulary")
    # As many rows as there are lengths, and one.
    lengths = [r["n"] for r in terms.select("n").distinct().collect()]
    long = terms.where("n > 1").select("term", F.lit(True).alias("listed"))
    size = long.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    small = size["n"] <= SMALL_ROWS and (size["bytes"] or 0) <= SMALL_BYTES
    # Sentences move once, before they are cut: what is counted in one stays where it is.
    words = sentences.repartition("req_no").select("req_no", F.regexp_extract_all(F.coalesce("sentence", F.lit("")), F.lit(WEIGHT_WORD), F.lit(0)).alias("ws"))
    some = [F.transform("ws", lambda w: F.struct(F.lit(1).alias("n"), w.alias("term")))]
    some += [F.transform(T.ngrams(F.col("ws"), n), lambda g, n=n: F.struct(F.lit(n).alias("n"), g.alias("term"))) for n in sorted(lengths) if n > 1]
    grams = words.select("req_no", F.explode(F.concat(*some)).alias("x")).select("req_no", "x.*")
    # Terms of several words are few beside the runs of words: only runs that are terms go on.
    grams = grams.join(F.broadcast(long) if small else long, "term", "left").where("n = 1 or listed")
    counts = grams.groupBy("req_no", "term").agg(F.count("*").alias("tf"))
    return counts.join(terms.select("term"), "term", "left_semi").select("req_no", "term", "tf")


def ngram_tfidf(sentences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, tfidf_mean) of all terms, of one word or more, over whole rebuilt sentences (req_no, sentence).

    Weights as in ``mean_tfidf``; every sentence counts as a document, an empty or
    null one too; terms that no sentence holds are null.
    """
    counts = vocabulary_counts(sentences, vocabulary)
    return _mean_weights(counts, vocabulary.select("term").where("term is not null").distinct(), sentences.agg(F.count("*").alias("n_reqs")), [])


def word_length_range(vocabulary: DataFrame) -> DataFrame:
    """One row (shortest, longest): words of the shortest and of the longest term, for the n-grams of the weights."""
    n = F.size(F.split("term", " "))
    return vocabulary.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"))


def with_definitions(freq: DataFrame, abbreviations: DataFrame, terms: DataFrame) -> DataFrame:
    """Add abbrev_definition and term_definition, '' where none is known."""
    a, t = abbreviations.toDF("term", "abbrev_definition"), terms.toDF("term", "term_definition")
    return freq.join(a, "term", "left").join(t, "term", "left").fillna("", ["abbrev_definition", "term_definition"])


def term_statistics(reqs: DataFrame, domain: DataFrame, general: DataFrame, abbreviations: DataFrame, definitions: DataFrame, stops: list[str]) -> DataFrame:
    """The statistics table of all token candidates that are no stop-words.

    Texts are cut into tokens once; every column comes from the counts of terms
    in requirements.
    """
    # Texts move once, before they are cut: what is counted in a requirement stays where it is.
    found = K.longer_than(K.without(K.candidates(reqs.repartition("req_no")), stops))
    counts = written(found.groupBy("req_no", "term").agg(F.count("*").alias("tf")), "counts")
    total = K.total_words(reqs)
    freq = counts.groupBy("term").agg(F.sum("tf").alias("abs_freq"), F.count("*").alias("doc_freq"))
    rated = freq.crossJoin(F.broadcast(total)).select("term", "abs_freq", (F.col("abs_freq") / F.col("total_words")).alias("rel_freq"), "doc_freq")
    out = measures(with_references(rated, reference_rates(domain), reference_rates(general)), total)
    out = with_definitions(out, abbreviations, definitions)
    out = out.join(mean_tfidf_of(counts, reqs.agg(F.count("*").alias("n_reqs"))), "term")
    return out.join(alphabetical(freq.select("term")), "term")


def by_frequency(freq: DataFrame, buckets: int = 2) -> DataFrame:
    """All rows of (term, abs_freq) with ``frequency_order``, from 0: falling frequency, then the term.

    As in ``alphabetical``, only counts by frequency and leading characters are ordered as a whole.
    """
    headed = freq.withColumn("head", F.substring("term", 1, buckets))
    sizes = headed.groupBy("abs_freq", "head").agg(F.count("*").alias("m"))
    before = sizes.select("abs_freq", "head", (F.sum("m").over(Window.orderBy(F.desc("abs_freq"), "head")) - F.col("m")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("abs_freq", "head").orderBy("term"))
    return headed.withColumn("upto", inside).join(before, ["abs_freq", "head"]).withColumn("frequency_order", F.col("before") + F.col("upto") - 1).drop("head", "upto", "before")


def alphabetical(terms: DataFrame, buckets: int = 2) -> DataFrame:
    """(term, alphabetical_order): number of terms up to the term in code-point order, less one.

    Repeated terms share the last place.  Terms are counted for each leading
    pair of characters first; only those counts are ordered as a whole.
    """
    head = F.substring("term", 1, buckets)
    counted = terms.groupBy("term").agg(F.count("*").alias("n")).withColumn("head", head)
    heads = counted.groupBy("head").agg(F.sum("n").alias("m"))
    before = heads.select("head", (F.sum("m").over(Window.orderBy("head")) - F.col("m")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("head").orderBy("term"))
    return counted.withColumn("upto", inside).join(before, "head").select("term", (F.col("before") + F.col("upto") - 1).alias("alphabetical_order"))
