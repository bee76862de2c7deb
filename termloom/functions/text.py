"""Column functions on text.

Character classes are written out, as ``\\w`` of the JVM knows ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
MAIN = rf"[{WORD}]+[-\\.]?[{WORD}]+"
SPACE = r"[ \t\n\x0B\f\r]+"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def mask_digits(text: Column) -> Column:
    """Every run of digits becomes ``##``."""
    return F.regexp_replace(text, r"\p{Nd}+", "##")


def main_tokens(text: Column) -> Column:
    """Words of at least two characters with one inner hyphen, backslash or dot at most."""
    return _found(text, MAIN)


def split_blank(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def words_without_digits(text: Column) -> Column:
    """Runs of letters and underscores, joined by a blank."""
    return F.array_join(_found(text, r"[\p{L}_]+"), " ")


def words_plain(text: Column) -> Column:
    """Runs of word characters, joined by a blank."""
    return F.array_join(_found(text, rf"[{WORD}]+"), " ")


def words_hyphen(text: Column) -> Column:
    """Runs of word characters and hyphens, joined by a blank."""
    return F.array_join(_found(text, rf"[{WORD}-]+"), " ")


def strip_parentheses(text: Column) -> Column:
    return F.translate(text, "()", "")


def split_blank_hyphen(text: Column) -> Column:
    """Parts between single blanks and hyphens, empty ones included."""
    return F.split(text, "[ -]", -1)


def trim_hyphen(word: Column) -> Column:
    """Without a trailing hyphen, or else without a leading one."""
    return F.when(word.endswith("-"), F.regexp_replace(word, "-$", "")).otherwise(F.regexp_replace(word, "^-", ""))


def strip_article(chunk: Column, articles: list[str]) -> Column:
    """If the first word is an article, remove that article everywhere in the chunk."""
    first = F.split_part(chunk, F.lit(" "), F.lit(1))
    return F.when(first.isin(articles), F.replace(chunk, F.concat(first, F.lit(" ")), F.lit(""))).otherwise(chunk)


def drop_leading(chunk: Column, stops: list[str]) -> Column:
    """Without the first word if that is a stop-word."""
    words = F.split(chunk, " ")
    return F.when(F.element_at(words, 1).isin(stops), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), " ")).otherwise(chunk)


def last_word(text: Column) -> Column:
    """The last main token, null if there is none."""
    return F.try_element_at(main_tokens(text), F.lit(-1))


def ngrams(words: Column, n: int) -> Column:
    """All n consecutive words, joined by a blank."""
    made = lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)])
    return F.when(F.size(words) >= n, F.transform(F.slice(words, F.lit(1), F.size(words) - (n - 1)), made)).otherwise(F.array().cast("array<string>"))


def plural_base(word: Column) -> Column:
    """Words shorter than 14 characters lose a trailing ``s`` (after two other characters)."""
    return F.when((F.length(word) < 14) & (F.length(word) > 2) & word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)


def escape_brackets(text: Column) -> Column:
    """Brackets as literals of a regular expression."""
    return F.regexp_replace(text, r"([()\[\]])", r"\\$1")


# Contractions of preposition and article, in order.
PORTUGUESE = [("ao", "a o"), ("do", "de o"), ("da", "de a"), ("no", "em o"), ("na", "em a"), ("pelo", "por o"), ("pela", "por a")]


def split_contractions(text: Column, pairs: list[tuple[str, str]] = PORTUGUESE) -> Column:
    """Replace whole words by their parts, one pair after another."""
    for whole, parts in pairs:
        text = F.regexp_replace(text, rf"(^|[^{WORD}]){whole}([^{WORD}]|$)", rf"$1{parts}$2")
    return text


class ROMANIAN:
    """Patterns of Romanian clitics written with a hyphen."""

    # Clitics before and behind a word.
    BEFORE = "[\\p{L}]*ntr şi s n de i ţi pe te mi l m c le v dac ne ş parc d fii dă".split()
    BEHIND = "i l t m şi ţi o se mi n ului te un ul ai mă am le s a sa urilor ilor astea vă aşa ăla al ar aici eşte au mea ăştia napoi aş alea aţi ăsta".split()
    NASAL = ["n[ţtcvfgdşs][\\p{L}]*", "m[bp][\\p{L}]*"]

    head = f"^((?:{'|'.join(BEFORE)})-)(.+)$"
    tail = f"^(.+?)((?:-(?:{'|'.join([*NASAL, *BEHIND])}))*)$"


def split_romanian(word: Column) -> Column:
    """Parts of a word: a clitic with its hyphen, the word, and clitics behind it with theirs."""
    has = word.rlike(ROMANIAN.head)
    rest = F.when(has, F.regexp_extract(word, ROMANIAN.head, 2)).otherwise(word)
    behind = F.regexp_extract_all(F.regexp_extract(rest, ROMANIAN.tail, 2), F.lit("-[^-]+"), F.lit(0))
    return F.filter(F.concat(F.array(F.regexp_extract(word, ROMANIAN.head, 1), F.regexp_extract(rest, ROMANIAN.tail, 1)), behind), lambda x: x != "")


# Clitics before and behind a word, as patterns, by language.
CLITICS = {
    "catalan": ("[dlmnst]['’´]", "['’´](?:n|s|ls|l|hi|ns|t|m|ho)|-(?:se|lo|la|li|los|les|hi|ho|ne|nos|me|s|te|m)"),
    "english": ("", "['’´](?:s|re|ve|d|m|em|ll)|n['’´]t"),
    "french": (
        "(?:[dcjlmnst]|qu|jusqu|lorsqu|quoiqu|puisqu)['’´]",
        "-t-elles?|-t-ils?|-t-on|-ce|-elles?|-ils?|-je|-la|-les?|-leur|-lui|-mêmes?|-m['’´]|-moi|-nous|-on|-toi|-tu|-t['’´]|-vous|-en|-y|-ci|-là",
    ),
    "galician": ("", "-la|-las|-lo|-los|-nos"),
    "italian": ("(?:d[ae]ll|nell|all|[ld]|sull|quest|un|senz|tutt|c|s)['´’]", ""),
}


def clitic_pattern(language: str) -> str:
    """Clitics before, the word itself, clitics behind, as three groups."""
    before, behind = CLITICS[language]
    return f"^((?:{before})*)(.+?)((?:{behind})*)$" if before and behind else f"^((?:{before})*)(.+)()$" if before else f"^()(.+?)((?:{behind})*)$"


def split_clitics(word: Column, language: str) -> Column:
    """The parts of a word: clitics of the language before it, the word, clitics behind it."""
    before, behind = CLITICS[language]
    group = lambda k: F.regexp_extract(word, "(?iu)" + clitic_pattern(language), k)
    parts = lambda k, pattern: F.regexp_extract_all(group(k), F.lit("(?iu)" + pattern), F.lit(0)) if pattern else F.array().cast("array<string>")
    return F.when(word == "", F.array().cast("array<string>")).otherwise(F.concat(parts(1, before), F.array(group(2)), parts(3, behind)))
