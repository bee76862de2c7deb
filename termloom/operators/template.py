"""Slots of requirement sentences.

Everything is column expressions over the words of a sentence; a sentence
without a modal verb has empty slots and ``is_conformant`` false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import lexicon
from termloom.functions.text import WORD

# Wordings, edges to trim, in order, and the patterns of the final verb and of the basic template.
ABLE, OFFER = "fähig sein", "die Möglichkeit bieten"
EDGES = (" ", ", ", " zu", ", zu", ",")
VERB = rf"([{WORD}]+(\sund\s)?[{WORD}]+)(\s\(.+\))?(\.)?$"
REQUIREMENT = r"^(.+(muss|müssen|soll)) (.+(sein|bieten), )?(.+)( zu)? (.+n)\.$"


def is_conditional(s: Column) -> Column:
    out = F.lit(False)
    for word in lexicon.CONDITIONALS:
        out = out | s.startswith(word)
    return out


def condition_word(s: Column) -> Column:
    return F.when(is_conditional(s), F.split_part(s, F.lit(" "), F.lit(1))).otherwise(F.lit(""))


def path(s: Column) -> Column:
    """Which extra wording the sentence has; '' for none."""
    return F.when(F.contains(s, F.lit(OFFER)), OFFER).when(F.contains(s, F.lit(ABLE)), ABLE).otherwise("")


def actor(s: Column) -> Column:
    return F.when(F.contains(s, F.lit(OFFER)), F.regexp_extract(s, rf"([{WORD}]+) die Möglichkeit", 1)).otherwise(F.lit(""))


def words(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(rf"[{WORD}\-()'\".°,]+"), F.lit(0))


def modal(s: Column) -> Column:
    """The first modal verb that no comma follows; ''."""
    return F.coalesce(F.try_element_at(F.filter(words(s), lambda w: F.rtrim(w, F.lit('.")')).isin(lexicon.MODALS)), F.lit(1)), F.lit(""))


def verb(s: Column) -> Column:
    """The last word, or two joined by ``und``, with a list in parentheses.

    Without such a list the match lies in the last three parts between blanks,
    so only these are searched: from every place of a long sentence the pattern
    would run to its end.
    """
    last = F.regexp_extract(F.substring_index(s, " ", -3), VERB, 1)
    return F.when(s.rlike(r"\)\.?$"), F.concat(F.regexp_extract(s, VERB, 1), F.regexp_extract(s, VERB, 3))).otherwise(last)


def trimmed(s: Column) -> Column:
    """Without each of the fixed edges, in order, once at either end."""
    for edge in EDGES:
        s = F.regexp_replace(F.regexp_replace(s, f"^{edge}", ""), f"{edge}$", "")
    return s


def _first_chunk(name: str, low: Column, high: Column) -> list[dict[str, Column]]:
    """Steps that put the first run of determiners, adjectives and nouns between two places into column ``name``.

    A determiner begins the next chunk.
    """
    at, first, after = (F.col(f"{name}_{x}") for x in ("at", "first", "next"))
    nominal = lambda i: F.get("__tag", i - 1).isin("DET", "ADJ", "NOUN")
    places = F.when((F.col("__m") > 0) & (high >= low), F.filter(F.sequence(low, F.greatest(high, low)), nominal)).otherwise(F.array().cast("array<int>"))
    run = F.filter(at, lambda i, k: (i - k == first) & (after.isNull() | (i < after)))
    text = F.when(F.size(run) > 0, F.rtrim(F.array_join(F.slice("__w", first, F.greatest(F.size(run), F.lit(1))), " "), F.lit(".,"))).otherwise(F.lit(""))
    return [
        {f"{name}_at": places},
        {f"{name}_first": F.get(at, F.lit(0))},
        {f"{name}_next": F.get(F.filter(at, lambda i: (i > first) & (F.get("__tag", i - 1) == "DET")), F.lit(0))},
        {name: F.coalesce(text, F.lit(""))},
    ]


def slots(sentences: DataFrame, col: str = "sentence") -> DataFrame:
    """All columns with the slots of the sentence, all '' without a modal verb.

    condition, modal_verb, system_name, actor, object_complement, verb,
    leading_details (the sentence begins with an adposition, adverb or verb, and
    no condition), details_verb (what stands before the anchor then, or an
    adposition right behind the modal verb with its chunk) and is_conformant.
    Leading details are appended to object and complement.
    """
    s = F.col(col)
    one = sentences.withColumns({"__w": words(s), "__modal": modal(s), "__cond": is_conditional(s), "__verb": verb(s), "__path": path(s)})
    one = one.withColumn("__tag", F.transform("__w", lambda w: lexicon.pos_tag(F.rtrim(w, F.lit(".,)")))))
    one = one.withColumn("__m", F.array_position("__w", F.col("__modal")).cast("int"))
    lead = ~F.col("__cond") & F.coalesce(F.get("__tag", F.lit(0)).isin("ADP", "ADV", "VERB"), F.lit(False))
    one = one.withColumn("__lead", lead).withColumn("__inv", F.col("__cond") | F.col("__lead"))
    low, high = F.when(F.col("__inv"), F.col("__m") + 1).otherwise(F.lit(1)), F.when(F.col("__inv"), F.size("__w")).otherwise(F.col("__m") - 1)
    adposition = F.coalesce((F.col("__m") > 0) & (F.get("__tag", F.col("__m")) == "ADP"), F.lit(False))
    steps = [*_first_chunk("__sys", low, high), *_first_chunk("__near", F.when(adposition, F.col("__m") + 2).otherwise(F.lit(1)), F.when(adposition, F.size("__w")).otherwise(F.lit(0)))]
    for step in steps:
        one = one.withColumns(step)
    a, b = F.when(F.col("__inv"), F.col("__modal")).otherwise(F.col("__sys")), F.when(F.col("__inv"), F.col("__sys")).otherwise(F.col("__modal"))
    begin = F.instr(s, a)
    after = F.substr(s, begin, F.lit(1 << 30))
    length = F.instr(F.substr(after, F.length(a) + 1, F.lit(1 << 30)), b)
    anchor = F.when((a != "") & (b != "") & (begin > 0) & (length > 0), F.left(after, F.length(a) + length + F.length(b) - 1)).otherwise(F.lit(""))
    one = one.withColumn("__anchor", anchor)
    at = F.instr(s, F.col("__anchor"))
    condition = F.when(F.col("__cond") & (F.col("__anchor") != "") & (at > 1), F.left(s, F.greatest(at - 3, F.lit(0)))).otherwise(F.lit(""))
    start = F.when(F.col("__path") != "", F.instr(s, F.col("__path")) + F.length("__path")).otherwise(at + F.length("__anchor"))
    tail = F.substr(s, start, F.lit(1 << 30))
    till = F.when(F.col("__verb") != "", F.instr(tail, F.col("__verb"))).otherwise(F.lit(0))
    body = F.when((F.col("__anchor") != "") & (till > 1), F.left(tail, till - 1)).otherwise(F.lit(""))
    one = one.withColumn("__body", body)
    leading = F.when(F.col("__lead") & (F.col("__body") != ""), F.left(s, at - 1)).otherwise(F.lit(""))
    one = one.withColumn("__leading", leading)
    near = F.when(F.col("__near") != "", F.concat_ws(" ", F.get("__w", F.col("__m")), "__near")).otherwise(F.lit(""))
    details = F.when(F.col("__leading") != "", F.col("__leading")).otherwise(near)
    found = (F.col("__modal") != "") & (F.col("__sys") != "")
    blank = lambda c: F.when(F.col("__modal") != "", c).otherwise(F.lit(""))
    return one.select(
        *sentences.columns,
        blank(condition).alias("condition"),
        F.col("__modal").alias("modal_verb"),
        blank(F.col("__sys")).alias("system_name"),
        blank(actor(s)).alias("actor"),
        blank(F.concat(trimmed(F.col("__body")), "__leading")).alias("object_complement"),
        blank(F.col("__verb")).alias("verb"),
        F.col("__lead").alias("leading_details"),
        blank(details).alias("details_verb"),
        found.alias("is_conformant"),
    )


def requirement_parts(s: Column) -> Column:
    """(object, verb) of a sentence of the basic template; nulls if it does not match."""
    part = lambda k: F.when(s.rlike(REQUIREMENT), F.regexp_replace(F.regexp_extract(s, REQUIREMENT, k), " zu$", ""))
    return F.struct(part(5).alias("object"), part(7).alias("verb"))
