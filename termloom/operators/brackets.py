"""Chunks from tagged tokens: brackets, trees of sentences, coordinated noun phrases.

Labels are B-X, I-X, E-X and anything else for outside.  An I without an open
chunk of its name begins one; an E closes the open chunk of its name after its
token, and an E-PC closes an open NC, which then is a PC; any other E changes
nothing; a token outside closes, and so does the end of a sentence, a period.

A null label is outside; a requirement without tokens has no row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.transducer import Machine, in_order

#: Tokens that end a sentence for chunks, and tags that end one for trees.
PERIOD, SENTENCE_TAGS = ".", ["SENT", "$.", "FS"]
#: Names that an E of the first turns a chunk of the second into the first.
WIDER, NARROWER = "PC", "NC"
_OUTSIDE, _BEGINS, _INSIDE, _LAST, _WIDENED = range(5)


def chunk_machine(names: list[str]) -> Machine:
    """State: 0, or 1 + the number of the open chunk's name.  Classes: B, I, E of each name, then outside; twice, the second for a period."""
    many = len(names)

    def step(state: int, kind: int) -> tuple[int, int]:
        kind, final = divmod(kind, 2)
        name, place = divmod(kind, 3)
        own = 1 + name
        if name >= many:
            then, out = 0, _OUTSIDE
        elif place == 0 or (place == 1 and state != own):
            then, out = own, _BEGINS
        elif place == 1:
            then, out = own, _INSIDE
        elif state == own:
            then, out = 0, _LAST
        elif names[name] == WIDER and state and names[state - 1] == NARROWER:
            then, out = 0, _WIDENED
        else:
            then, out = state, _INSIDE if state else _OUTSIDE
        return (0 if final else then), out

    return Machine(1 + many, 2 * (3 * many + 1), step)


#: A mark of a token: 1 + the name of the chunk it opens, of the one it closes, and whether it is inside.
_OPENS, _CLOSES, _IN = 1, 1 << 8, 1 << 16


def _marks(names: list[str]) -> Callable:
    """Marks of all tokens from their classes and the machine's outputs."""

    def run(flat: np.ndarray, out: np.ndarray, offs: np.ndarray) -> np.ndarray:
        after = np.append(out[1:], _OUTSIDE)
        after[offs[1:][np.diff(offs) > 0] - 1] = _OUTSIDE
        begin = np.flatnonzero(out == _BEGINS)
        # A chunk has no gaps, so beginnings and ends alternate.
        end = np.flatnonzero((out != _OUTSIDE) & ((after == _OUTSIDE) | (after == _BEGINS)))
        name = flat[begin] // 6 + 1
        name[out[end] == _WIDENED] = names.index(WIDER) + 1 if WIDER in names else 0
        marks = (out != _OUTSIDE).astype(np.int32) * _IN
        marks[begin] += _OPENS * name
        marks[end] += _CLOSES * name
        return marks

    return run


def _marked(tagged: DataFrame, names: list[str]) -> DataFrame:
    """(req_no, items): tokens of a requirement in order, with ``inside`` and the names of the chunk that each ``opens`` and ``closes``.

    ``tagged`` has rows of tokens, or ``items``, arrays of whole requirements, which stay where they are.
    """
    labels = [f"{place}-{name}" for name in names for place in "BIE"]
    label = lambda x: F.coalesce(F.array_position(F.array(*map(F.lit, labels)), x["chunk_tag"]), F.lit(0)).cast("int")
    kind = lambda x: 2 * F.when(label(x) > 0, label(x) - 1).otherwise(len(labels)) + (x["term"] == PERIOD).cast("int")
    seq = in_order(tagged, "term", "tag", "chunk_tag")
    run = seq.select("req_no", "items", chunk_machine(names).outputs(F.transform("items", kind), _marks(names)).alias("o"))
    named = lambda o, shift: F.get(F.array(*map(F.lit, names)), F.shiftright(o, shift).bitwiseAND(255) - 1)
    item = lambda x, o: F.struct(x["pos"].alias("pos"), x["term"].alias("term"), x["tag"].alias("tag"), (o >= _IN).alias("inside"), named(o, 0).alias("opens"), named(o, 8).alias("closes"))
    return run.select("req_no", F.zip_with("items", "o", item).alias("items"))


def chunked(tagged: DataFrame, names: list[str]) -> DataFrame:
    """(req_no, pos, term, tag, chunk, name): the number of each token's chunk in its requirement, from 1, and its name; null outside."""
    rows = _marked(tagged, names).select("req_no", F.inline("items"))
    order = Window.partitionBy("req_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chunk, name = F.count("opens").over(order), F.last("opens", True).over(order)
    return rows.select("req_no", "pos", "term", "tag", *[F.when(F.col("inside"), c).alias(n) for n, c in (("chunk", chunk), ("name", name))])


def sentence_trees(tagged: DataFrame, names: list[str]) -> DataFrame:
    """(req_no, tree): words with tags in brackets inside chunks inside sentences; several sentences have one root.

    Trees are made inside the row of a requirement; terms and tags hold no NUL.
    """
    leaf = lambda x: F.concat(
        F.coalesce(F.concat(F.lit("("), x["opens"], F.lit(" ")), F.lit("")), F.lit("("), x["term"], F.lit(" "), x["tag"], F.lit(")"), F.when(x["closes"].isNotNull(), ")").otherwise(""), F.when(x["tag"].isin(SENTENCE_TAGS), "\x00").otherwise("")
    )
    joined = F.array_join(F.transform("items", leaf), " ")
    rows = _marked(tagged, names).select("req_no", F.regexp_replace(joined, "\x00$", "").alias("leaves"))
    node = F.concat(F.lit("(S "), F.replace("leaves", F.lit("\x00 "), F.lit(") (S ")), F.lit(")"))
    return rows.select("req_no", F.when(F.contains("leaves", F.lit("\x00")), F.concat(F.lit("(ROOT "), node, F.lit(")"))).otherwise(node).alias("tree"))


def chunk_lines(tagged: DataFrame, names: list[str]) -> DataFrame:
    """(req_no, lines): tokens in order with ``<X>`` before and ``</X>`` after each chunk."""
    some = lambda x: F.array_compact(F.array(F.concat(F.lit("<"), x["opens"], F.lit(">")), x["term"], F.concat(F.lit("</"), x["closes"], F.lit(">"))))
    return _marked(tagged, names).select("req_no", F.flatten(F.transform("items", some)).alias("lines"))


# One character for each mark that matters, so that what lies between is a class of characters.
_MARKS = {"<NP>": "\x03", "</NP>": "\x02", "</PP>": "\x04", "<COORD>": "\x05", "</COORD>": "\x06"}
#: A noun phrase, ends of prepositional phrases, a coordination, a noun phrase.
COORDINATED = "(\x03\n[^\x02]*+\x02\n)((?:\x04\n)*+)(\x05\n[^\x06]*+\x06\n)(\x03\n[^\x02]*+\x02\n)"
JOINED = "\x03\n$1$3$4\x02\n$2"


def coordinated(lines: Column) -> Column:
    """Lines with ``NP COORD NP`` inside one more ``NP``; ends of prepositional phrases after the first NP move behind it.

    From left to right, each phrase is used once: of three coordinated phrases
    the first two are joined.  Null stays null.
    """
    plain = lambda x: F.regexp_replace(x, "[\x02-\x06]", " ")
    code = F.create_map(*[F.lit(y) for pair in _MARKS.items() for y in pair])
    coded = F.transform(lines, lambda x: F.coalesce(code[x], plain(x)))
    text = F.regexp_replace(F.concat(F.array_join(coded, "\n"), F.lit("\n")), COORDINATED, JOINED)
    back = F.create_map(*[F.lit(y) for pair in _MARKS.items() for y in pair[::-1]])
    return F.when(lines.isNotNull(), F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.coalesce(back[x], x)))
