"""Word lists and the default annotator.

The annotator is a provider: any function from a word column to a tag or lemma
column can take its place.  The default uses closed-class lists and suffixes, so
it is one expression and stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import plural_base

# Words whose distinct occurrences decide between English and German.
ENGLISH_MARKERS = """the must shall should will have user allow provide ability be able to if with as of and are not any a that
it for on do at this but by from or one all would there what up out about who get which go when can like time no just take into
some other than only its over new these""".split()
GERMAN_MARKERS = """der auch die das muss kann soll wird haben Nutzer Bediener Möglichkeit stellen zu fähig sein ist falls solange
mit auf eine den von sich des für im dem nicht ein Die als es werden aus hat nach bei einer Der um am sind noch wie einem über Das
so zum und oder vor zur bis mehr durch Prozent gegen vom wenn unter zwei zwischen""".split()
# Template words.
CONDITIONALS = ["Im Falle", "Wenn", "Sobald", "Falls", "Bei", "Beim"]
MODALS = ["muss", "müssen", "soll", "sollen", "wird", "werden"]
ENGLISH_ARTICLES = ["the", "The", "a"]
GERMAN_ARTICLES = ["der", "die", "das", "Der", "Die", "Das"]

DETERMINERS = "the The a A an An this This that these those der die das den dem des Der Die Das ein eine einer einem einen le la les un une el los las".split()
ADPOSITIONS = "of in on at by to for with from into over under in auf mit von zu aus bei nach für über unter de en par pour por para".split()
CONJUNCTIONS = "and or und oder et ou y o".split()
ADVERBS = "not only also there here auch noch nicht so wie".split()
#: Default stop list; a parameter wherever it is used.
STOP_WORDS = sorted({*DETERMINERS, *ADPOSITIONS, *CONJUNCTIONS, *ADVERBS, "is", "are", "was", "be", "it", "he", "re", "that"})
VERB_SUFFIXES = "en eln ern ing ed".split()
ADJECTIVE_SUFFIXES = "lich ig isch bar able ous ful ive".split()
NOUN_SUFFIXES = "ung heit keit schaft tion ness ment".split()


def ends_in(word: Column, suffixes: list[str]) -> Column:
    """Whether a word has one of the endings; plain comparisons, no pattern."""
    out = F.lit(False)
    for suffix in suffixes:
        out = out | word.endswith(suffix)
    return out


def pos_tag(word: Column) -> Column:
    """Part of speech of a word by list, then suffix, then a leading capital."""
    return (
        F.when(word.isin(DETERMINERS), "DET")
        .when(word.isin(ADPOSITIONS), "ADP")
        .when(word.isin(CONJUNCTIONS), "CONJ")
        .when(word.isin(ADVERBS), "ADV")
        .when(ends_in(word, NOUN_SUFFIXES) | word.rlike(r"^\p{Lu}"), "NOUN")
        .when(ends_in(word, ADJECTIVE_SUFFIXES), "ADJ")
        .when(ends_in(word, VERB_SUFFIXES), "VERB")
        .otherwise("X")
    )


def lemma(word: Column) -> Column:
    """Lower case without a plural ending."""
    return plural_base(F.lower(word))


def lemma_phrase(phrase: Column, which: str = "all") -> Column:
    """A phrase with the lemmas of its words: of ``all``, of the ``last`` one only, or of all but ``determiners``."""
    words = F.split(phrase, " ")
    if which == "last":
        out = F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, lemma(w)).otherwise(w))
    elif which == "determiners":
        out = F.transform(words, lambda w: F.when(w.isin(DETERMINERS), w).otherwise(lemma(w)))
    else:
        out = F.transform(words, lemma)
    return F.array_join(out, " ")


def capital_tag(word: Column) -> Column:
    """A cruder annotator: capitals are nouns."""
    return F.when(word.rlike(r"^\p{Lu}"), "NOUN").otherwise("X")


def suffix_tag(word: Column) -> Column:
    """An annotator by endings alone."""
    return F.when(ends_in(word, NOUN_SUFFIXES), "NOUN").when(ends_in(word, ADJECTIVE_SUFFIXES), "ADJ").when(ends_in(word, VERB_SUFFIXES), "VERB").otherwise("X")


def sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def pos_sql(word: str) -> str:
    """The default tag as DuckDB SQL."""
    ends = lambda suffixes: " OR ".join(f"ends_with({word}, '{x}')" for x in suffixes)
    return f"""CASE WHEN {word} IN ({sql_list(DETERMINERS)}) THEN 'DET' WHEN {word} IN ({sql_list(ADPOSITIONS)}) THEN 'ADP'
      WHEN {word} IN ({sql_list(CONJUNCTIONS)}) THEN 'CONJ' WHEN {word} IN ({sql_list(ADVERBS)}) THEN 'ADV'
      WHEN {ends(NOUN_SUFFIXES)} OR regexp_matches({word}, '^\\p{{Lu}}') THEN 'NOUN'
      WHEN {ends(ADJECTIVE_SUFFIXES)} THEN 'ADJ' WHEN {ends(VERB_SUFFIXES)} THEN 'VERB' ELSE 'X' END"""


def lemma_sql(word: str) -> str:
    return f"(CASE WHEN length({word}) < 14 AND length({word}) > 2 AND ends_with(lower({word}), 's') THEN regexp_replace(lower({word}), 's$', '') ELSE lower({word}) END)"
