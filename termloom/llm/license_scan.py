"""Licence scan by Dice coefficient over word bigrams.

Only DataFrame operations are used.  A text is compared as a whole, line by
line, and in windows of consecutive words.  Both it and the templates are normalised: lower case, spelling of
licence, no copyright year lines, words of letters, digits and dots.  A unit
with n distinct bigrams and a template with m can reach a Dice coefficient d
only if d / (2 - d) <= n / m <= (2 - d) / d.  The admissible sizes of every
template are listed, so the bound is an equality join on the size: units of
other sizes are never compared, and nothing is shuffled before the matches.

Windows find what is wrapped over lines or stands inside a line.  A window that
reaches d shares at least m * d / (2 - d) bigrams with the template, so any set
of more than the rest of the template meets it: only texts with one of the
rarer bigrams, and enough bigrams of a template, are looked at word by word.
There every window that starts and ends with a bigram of the template, and has
at most (2 - d) / d times its bigrams, is compared; others score no higher.  A
whole text that matches a licence is not searched for it again.  Matching windows
of a licence that overlap are one passage; one that overlaps a matching line of
the licence is no unit of its own.

Templates are a fixed list, or a table of (license, text) whose size is checked
before it is broadcast.  The fixed list has notices, the full texts below
``licenses``, and the paragraphs of these that no other licence shares.
Templates of any length are searched in windows.  For a text that holds enough
bigrams of one this takes as many steps as there are pairs of a start and an end
inside a window, some 20 million for a licence of 3,000 bigrams; full texts of
more than ``LONG`` bigrams are therefore compared with whole texts first, and what
they match is not searched again.

Defined cases: a null text, or one without two words in a line, matches
nothing.  Repeated rows are reported alike.  Of equal scores all licences are
reported.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm._store import small, stored

DICE = 0.8
#: Full texts of more distinct bigrams are compared with whole texts and lines too.
LONG = 400
#: Fewest distinct bigrams of a paragraph that is a template of its own.
PARAGRAPH = 20
# Public licence notices and short licence texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def words(text: Column) -> Column:
    """Words of a normalised text."""
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("licence"), F.lit("license"))
    plain = F.when(F.contains(plain, F.lit("copyright")), F.regexp_replace(plain, r"copyright (\(c\) )?[0-9]{4}[^\n]*", " ")).otherwise(plain)
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+(\.[\p{N}]+)*"), F.lit(0))


def bigrams(ws: Column) -> Column:
    """Distinct bigrams of an array of words.

    The array should be a column of its own: it is read several times.
    """
    after = F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(1)))
    pairs = F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(1))), after, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(ws) > 1, pairs).otherwise(F.array().cast("array<string>")))


def _plain_grams(text: str) -> set[str]:
    """The bigrams of a text, as the columns make them, for the choice of paragraphs."""
    ws = re.findall(r"[^\W_]+(?:\.\d+)*", re.sub(r"copyright (\(c\) )?[0-9]{4}[^\n]*", " ", text.lower().replace("licence", "license")))
    return {f"{a} {b}" for a, b in zip(ws, ws[1:])}


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the full licences."""
    return [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def paragraphs(dice: float = DICE) -> list[tuple[str, str]]:
    """(license, paragraph) of the full licences, without those that resemble one of another licence."""
    cut = [(name, x, _plain_grams(x)) for name, text in full_texts() for x in re.split(r"\n\s*\n", text)]
    cut = [(name, x, g) for name, x, g in cut if len(g) >= PARAGRAPH]
    alike = lambda g, h: 2 * len(g & h) >= dice * (len(g) + len(h))
    return [(name, x) for name, x, g in cut if not any(name != other and alike(g, h) for other, _, h in cut)]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def _unit_templates(spark: SparkSession) -> DataFrame:
    """The templates of whole texts and lines."""
    return spark.createDataFrame(TEMPLATES + [x for x in full_texts() if len(_plain_grams(x[1])) > LONG], "license string, text string")


def _window_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES + full_texts() + paragraphs(), "license string, text string")


def _sized(bank: DataFrame) -> DataFrame:
    """(license, tgrams, m, long): the distinct bigrams of each template; ``long`` counts repeats too."""
    one = bank.select("license", words(F.col("text")).alias("ws")).select("license", bigrams(F.col("ws")).alias("tgrams"), (F.size("ws") - 1).alias("long"))
    return one.withColumn("m", F.size("tgrams")).where("m > 0").distinct()


def admissible(bank: DataFrame, dice: float) -> DataFrame:
    """(tid, n): each template under every size that can reach ``dice``."""
    one = bank.select("tid", "m")
    low, high = F.ceil(F.col("m") * (dice / (2 - dice)) - 1e-9).cast("int"), F.floor(F.col("m") * ((2 - dice) / dice) + 1e-9).cast("int")
    return one.select("tid", F.explode(F.sequence(low, high)).alias("n"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, unit, grams): the lines of every text, and the whole where it has several."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    parts = F.when(F.size(lines) > 1, F.concat(F.array(text), lines)).otherwise(lines)
    cut = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.posexplode(parts).alias("unit", "part"))
    return cut.select("rid", "unit", words(F.col("part")).alias("ws")).select("rid", "unit", bigrams(F.col("ws")).alias("grams"))


def _numbered(bank: DataFrame) -> DataFrame:
    return stored(_sized(bank).withColumn("tid", F.monotonically_increasing_id()), "templates")


def matches(docs: DataFrame, bank: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE) -> DataFrame:
    """(rid, unit, license, dice): units that reach ``dice`` with a template."""
    held = _numbered(_unit_templates(docs.sparkSession) if bank is None else bank)
    listed = small(stored(admissible(held, dice), "template-sizes"))
    met = units(docs, id_col, text_col).select("*", F.size("grams").alias("n")).join(listed, "n").join(small(held.select("tid", "license", "tgrams", "m")), "tid")
    score = 2 * F.size(F.array_intersect("grams", "tgrams")) / (F.col("n") + F.col("m"))
    return met.select("rid", "unit", "license", score.alias("dice")).where(F.col("dice") >= dice)


def _anchors(held: DataFrame) -> list[str]:
    """Bigrams of which each window that matches has one: of each template all but ``need`` - 1, the rarer and longer ones."""
    rows = held.select("tgrams", "need").collect()
    often: dict[str, int] = {}
    for r in rows:
        for g in r["tgrams"]:
            often[g] = often.get(g, 0) + 1
    out = set()
    for r in rows:
        rare = sorted(r["tgrams"], key=lambda g: (often[g], -len(g), g))
        out.update(rare[: len(rare) - r["need"] + 1])
    return sorted(out)


def passages(docs: DataFrame, found: DataFrame, bank: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE) -> DataFrame:
    """(rid, license, lo, hi, dice, new): passages of bigrams ``lo`` to ``hi``; ``new`` if no matching line of ``found`` overlaps."""
    need, most = F.ceil(F.col("m") * (dice / (2 - dice)) - 1e-9).cast("int"), F.floor(F.col("long") * ((2 - dice) / dice) + 1e-9).cast("int")
    held = stored(_numbered(_window_templates(docs.sparkSession) if bank is None else bank).select("*", need.alias("need"), most.alias("most")), "window-templates")
    grams_of = small(held.select("tid", "license", "need", F.explode("tgrams").alias("gram")))
    texts = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    # Texts with an anchor and enough distinct bigrams of a template.
    anchors = F.array(*[F.lit(g) for g in _anchors(held)]).cast("array<string>")
    some = texts.select("rid", words(F.col("text")).alias("ws")).select("rid", bigrams(F.col("ws")).alias("grams"))
    # Repeated rows share a rid: each counts on its own.
    # The condition stands inside explode: as a filter it would be moved below the arrays and repeat them.
    enough = some.withColumn("row", F.monotonically_increasing_id()).select("rid", "row", F.explode(F.when(F.arrays_overlap("grams", anchors), F.col("grams"))).alias("gram")).join(grams_of, "gram")
    live = enough.groupBy("rid", "row", "tid", "license").agg(F.count("*").alias("c"), F.first("need").alias("need")).where("c >= need").select("rid", "tid", "license").distinct()
    live = live.join(found.where("unit = 0").select("rid", "license").distinct(), ["rid", "license"], "left_anti")
    live = stored(live, "license-candidates")
    once = texts.join(small(live.select("rid").distinct()), "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text"))
    # The lines' words one after the other are those of the whole text.
    at = F.flatten(F.transform(F.split("text", "\n", -1), lambda l, k: F.transform(words(l), lambda w: F.struct(k.alias("line"), w.alias("w")))))
    pair = F.zip_with(F.slice("ws", 1, F.size("ws") - 1), F.slice("ws", 2, F.size("ws") - 1), lambda a, b: F.struct(a["line"].alias("line"), F.concat(a["w"], F.lit(" "), b["w"]).alias("gram")))
    cells = once.select("rid", at.alias("ws")).where(F.size("ws") > 1).select("rid", F.posexplode(pair).alias("p", "x")).select("rid", "p", "x.line", "x.gram")
    last = F.coalesce(F.lag("p").over(Window.partitionBy("rid", "gram").orderBy("p")), F.lit(-1))
    cells = stored(cells.withColumn("last", last), "license-words")
    # Where each bigram stood before: it is new in a window from i if that is below i.
    seen = cells.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "last"))), lambda x: x["last"]).alias("seen"))
    hits = cells.join(grams_of.drop("need"), "gram").join(live, ["rid", "tid", "license"], "left_semi")
    per = hits.groupBy("rid", "tid", "license").agg(F.array_sort(F.collect_list("p")).alias("h")).join(F.broadcast(held.select("tid", "m", "need", "most")), "tid")
    inside = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda k: F.get("h", k + F.col("need") - 1) < F.get("h", k) + F.col("most"))
    per = per.withColumn("starts", inside).where(F.size("starts") > 0).join(seen, "rid")
    one = per.select("rid", "license", "m", "most", "h", "seen", F.explode("starts").alias("k")).withColumn("i", F.get("h", F.col("k")))
    ends = F.filter(F.slice("h", F.col("k") + 1, F.least(F.col("most"), F.size("h") - F.col("k"))), lambda j: j < F.col("i") + F.col("most"))
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("n"), (F.col("i") - 1).alias("at"), F.lit(0.0).cast("double").alias("dice"), F.lit(-1).alias("hi"))

    def step(s: Column, j: Column) -> Column:
        n = s["n"] + F.size(F.filter(F.slice("seen", s["at"] + 2, j - s["at"]), lambda x: x < F.col("i")))
        c = s["c"] + (F.get("seen", j) < F.col("i")).cast("int")
        now = (2 * c / (n + F.col("m"))).cast("double")
        better = now > s["dice"]
        return F.struct(c.alias("c"), n.alias("n"), j.alias("at"), F.when(better, now).otherwise(s["dice"]).alias("dice"), F.when(better, j).otherwise(s["hi"]).alias("hi"))

    best = one.select("rid", "license", F.col("i").alias("lo"), F.aggregate(ends, zero, step).alias("x"))
    best = best.select("rid", "license", "lo", F.col("x.hi").alias("hi"), F.col("x.dice").alias("dice")).where(F.col("dice") >= dice)
    order = Window.partitionBy("rid", "license").orderBy("lo", "hi")
    ahead = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # A window that begins behind all before it begins a passage.
    marked = best.withColumn("first", F.coalesce((F.col("lo") > ahead).cast("int"), F.lit(1))).withColumn("no", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("rid", "license", "no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("dice").alias("dice"))
    done = found.where("unit > 0").select("rid", "license", (F.col("unit") - 1).alias("line")).distinct()
    lines = cells.join(done, ["rid", "line"]).groupBy("rid", "license", "line").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    met = whole.join(lines, ["rid", "license"], "left").groupBy("rid", "license", "lo", "hi", "dice").agg(F.max((F.col("a") <= F.col("hi")) & (F.col("b") >= F.col("lo"))).alias("old"))
    return met.select("rid", "license", "lo", "hi", "dice", (~F.coalesce("old", F.lit(False))).alias("new"))


def scan(docs: DataFrame, bank: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE) -> DataFrame:
    """(doc_id, n_units, licenses, best) for every row of ``docs``; licenses are sorted and comma-joined.

    ``n_units`` counts matching lines, the whole text if it has several and matches, and other
    passages; passages of several licences that overlap count once.
    """
    found = stored(matches(docs, bank, id_col, text_col, dice).groupBy("rid", "unit", "license").agg(F.max("dice").alias("dice")), "license-units")
    inner = passages(docs, found, bank, id_col, text_col, dice)
    before = F.max("hi").over(Window.partitionBy("rid", "new").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    apart = inner.withColumn("unit", F.when(F.col("new") & F.coalesce(F.col("lo") > before, F.lit(True)), -1 - F.col("lo"))).select("rid", "unit", "license", "dice")
    of = found.unionByName(apart).groupBy("rid").agg(F.countDistinct("unit").alias("n_units"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("best"))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("rid"))
    return ids.join(of, "rid", "left").select("doc_id", F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"))


def op8_license_scan(docs: DataFrame) -> DataFrame:
    """Licences of every document."""
    return scan(docs.select("doc_id", "text"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP8_SQL = r"""
WITH bank(license, text) AS (VALUES __BANK__),
parts AS (
  SELECT rid, doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS unit FROM (
    SELECT row_number() OVER () AS rid, doc_id, CASE WHEN contains(coalesce(text, ''), chr(10)) THEN list_prepend(text, string_split(text, chr(10))) ELSE [coalesce(text, '')] END AS ps FROM documents)
), pw AS (
  SELECT rid, unit, regexp_extract_all(regexp_replace(replace(lower(part), 'licence', 'license'), 'copyright (\(c\) )?[0-9]{4}[^\n]*', ' ', 'g'), '[\p{L}\p{N}]+(?:\.[\p{N}]+)*') AS ws FROM parts
), tw AS (
  SELECT license, regexp_extract_all(regexp_replace(replace(lower(text), 'licence', 'license'), 'copyright (\(c\) )?[0-9]{4}[^\n]*', ' ', 'g'), '[\p{L}\p{N}]+(?:\.[\p{N}]+)*') AS ws FROM bank
), pg AS (
  SELECT rid, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM pw WHERE len(ws) > 1
), tg AS (
  SELECT license, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM tw
), hit AS (
  SELECT rid, unit, license, 2.0 * len(list_intersect(p.g, t.g)) / (len(p.g) + len(t.g)) AS dice FROM pg p JOIN tg t ON len(p.g) BETWEEN 0.6 * len(t.g) AND 1.6 * len(t.g)
), agg AS (
  SELECT rid, count(DISTINCT unit) AS n_units, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best FROM hit WHERE dice >= 0.8 GROUP BY rid
)
SELECT d.doc_id, coalesce(a.n_units, 0) AS n_units, coalesce(a.licenses, '') AS licenses, round(coalesce(a.best, CAST(0 AS DOUBLE)), 6) AS best
FROM (SELECT DISTINCT rid, doc_id FROM parts) d LEFT JOIN agg a ON a.rid = d.rid
""".replace("__BANK__", ", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in TEMPLATES))
