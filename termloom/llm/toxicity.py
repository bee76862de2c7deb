"""Toxicity by class-conditional Kneser-Ney models of the spelling of words.

A text is the sequence of its words (runs of ASCII letters, lower-cased, and of
bytes beyond ASCII).  Each of two models, of toxic and of ordinary texts, gives
every byte of a word and its end a probability from the up to five bytes before
it.  They are interpolated Kneser-Ney models: at order 6 the counts of the class
are discounted, at orders 5 to 3 the numbers of bytes that an n-gram of the class
follows; below them both share one model, of orders 3 to 1, whose continuation
counts come from all documents, labelled or not.  So a rare expression, which
one class never showed, is judged by what both classes share.

Every word then has one log-likelihood ratio.  A document is described by its
mean ratio a byte, and by the ratio a byte, and in all, of its most toxic word;
a logistic regression on labelled rows that the counts did not use turns the
three into a score.

Counts cover all training rows, continuation counts all documents; nothing is
capped or hashed: an n-gram of at most 7 bytes is the integer of its bytes.  The
counts are grouped inside a task first, and the models are built by joins and
aggregations.  The finished table of ratios is broadcast up to ``MODEL_ROWS``
rows; beyond them distinct words are scored by joins, and documents by a join
with their distinct words.  Only the regression reads a bounded sample.

Folds, by crc32 of the id as text modulo 4: 0 and 1 give the counts, 3 the
regression, 2 is held out.

Defined cases: a row without a word, with a null or an empty text too, has the
share of toxic rows among the regression's; without labels to learn from that is
0.  A null id is never trained on and counts as not held out.  A null label is
none; of several labels of an id the largest counts.  Repeated rows are scored
alike.  Input columns named like an added one are replaced.  An empty table
gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import _text
from termloom.llm._store import forget, small, stored

#: Length of the longest n-gram, of the shortest that a class counts, and of those whose kinds the shared model counts.
ORDER, OWN, KINDS = 6, 3, 4
DISCOUNT = 0.75
#: Rows of the table of ratios that are broadcast, at 12 bytes each.
MODEL_ROWS = 2_500_000
#: Most rows that the regression is expected to read.
CALIBRATION_ROWS = 20_000
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3
#: Text bytes whose words are told apart at a time, and n-grams kept by a counting task before it passes them on.
PART, KEPT = 2 << 20, 1 << 20

_U8, _U64 = np.uint64(8), np.uint64
_APART = np.ones(256, bool)
_APART[65:91] = _APART[97:123] = _APART[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def distinct(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of one occurrence of each word, the word of every token, and the tokens before each row."""
    start, end, before = _text.words(raw, offs, _APART)
    _, first, which = np.unique(_text.word_hashes(raw, start, end, lower=True), return_index=True, return_inverse=True)
    return start[first], end[first], which, before


def windows(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(6-gram that ends at each byte and at the end of each word, first one of each word)."""
    size = end - start + 1
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    total = int(size.sum())
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(total) - first[word]
    symbol = np.full(total, 0x20, np.uint8)
    inside = place < size[word] - 1
    symbol[inside] = _LOWER[raw[(start[word] + place)[inside]]]
    out = np.zeros(total, _U64)
    for back in range(ORDER):
        past = np.full(total, 0x20, _U64)
        there = np.flatnonzero(place >= back)
        past[there] = symbol[there - back]
        out |= past << _U64(8 * back)
    return out, first


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first, axis=0) if len(first) else counts)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(gram, n, t, o) of (text, toxic) rows: occurrences of 6-grams in all, in toxic and in ordinary rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, _U64), np.zeros((0, 3), np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_text.signed(keys)), *(pa.array(counts[:, k].copy()) for k in range(3))], ["gram", "n", "t", "o"])

        for batch in batches:
            label = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offs in _text.pieces(batch.column(0), PART):
                start, end, which, before = distinct(raw, offs)
                if not len(start):
                    continue
                of = np.repeat(label[lo:hi], np.diff(before))
                n = np.stack([np.bincount(which, x, len(start)) for x in (None, of == 1, of == 0)], 1).astype(np.int64)
                grams, first = windows(raw, start, end)
                size = np.diff(np.append(first, len(grams)))
                keys, counts = _sums(np.concatenate([keys, grams]), np.concatenate([counts, np.repeat(n, size, axis=0)]))
                if len(keys) > KEPT:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out()

    parts = _text.mapped(docs.select("text", F.col("toxic").cast("long")), run, "gram long, n long, t long, o long")
    return parts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "t", "o")])


def _kinds(of: DataFrame, order: int, *columns: str) -> DataFrame:
    """How many n-grams of the next order end in each n-gram."""
    return of.groupBy(F.col("gram").bitwiseAND(F.lit(_mask(order))).alias("gram")).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in columns])


def _before() -> Column:
    return F.shiftright("gram", 8)


def shared_model(counts: DataFrame) -> DataFrame:
    """(gram, p): the interpolated Kneser-Ney probability of the last byte of every 3-gram of all documents."""
    kinds = counts.groupBy(F.col("gram").bitwiseAND(F.lit(_mask(KINDS))).alias("gram")).agg(F.sum("n").alias("n"))
    levels = {}
    for order in range(KINDS - 1, 0, -1):
        kinds = levels[order] = _kinds(kinds, order, "n")
    back = None
    for order in range(1, KINDS):
        of = levels[order].withColumn("h", _before())
        context = of.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        joined = of.join(context, "h")
        if back is None:
            joined = joined.withColumn("p", F.lit(1 / 256))
        else:
            joined = joined.withColumn("s", F.col("gram").bitwiseAND(F.lit(_mask(order - 1)))).join(back.select(F.col("gram").alias("s"), "p"), "s")
        back = joined.select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("all")).alias("p"))
    return back


def ratios(counts: DataFrame) -> DataFrame:
    """(part, order, gram, value): ratios of n-grams (part 0) and of the weights of contexts that back off (part 1).

    The ratio of a position is that of its longest n-gram in the table plus the
    weights of the longer contexts passed over.
    """
    back = stored(shared_model(counts), "shared-model").select("gram", F.col("p").alias("bt"), F.col("p").alias("bo"))
    levels = {ORDER: counts.where((F.col("t") > 0) | (F.col("o") > 0)).select("gram", "t", "o")}
    for order in range(ORDER - 1, OWN - 1, -1):
        levels[order] = _kinds(levels[order + 1], order, "t", "o")
    out = []
    for order in range(OWN, ORDER + 1):
        of = levels[order].withColumn("h", _before())
        context = of.groupBy("h").agg(*[f(F.col(c)).alias(c + name) for c in "to" for f, name in ((F.sum, "all"), (lambda x: F.sum((x > 0).cast("long")), "kinds"))])
        weight = {c: F.when(F.col(c + "all") > 0, DISCOUNT * F.col(c + "kinds") / F.col(c + "all")).otherwise(F.lit(1.0)) for c in "to"}
        rows = of.join(context, "h").withColumn("s", F.col("gram").bitwiseAND(F.lit(_mask(order if order == OWN else order - 1)))).join(back.withColumnRenamed("gram", "s"), "s")
        p = {c: F.when(F.col(c + "all") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(c + "all")).otherwise(F.lit(0.0)) + weight[c] * F.col("b" + c) for c in "to"}
        level = stored(rows.select("gram", p["t"].alias("bt"), p["o"].alias("bo")), "class-model")
        out.append(level.select(F.lit(0).alias("part"), F.lit(order).alias("order"), "gram", F.log(F.col("bt") / F.col("bo")).alias("value")))
        out.append(context.select(F.lit(1).alias("part"), F.lit(order).alias("order"), F.col("h").alias("gram"), F.log(weight["t"] / weight["o"]).alias("value")))
        back = level
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table


@dataclass
class Table:
    """The ratios as sorted arrays."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, part: int, order: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = gram | _U64((2 * order + part) << 56)
        if not len(self.keys):
            return np.zeros(len(gram), bool), np.zeros(len(gram), np.float32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.values[at]

    def of_windows(self, grams: np.ndarray) -> np.ndarray:
        """The ratio of each position: longer contexts' weights, down to the first n-gram known."""
        total, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, OWN - 1, -1):
            now = grams[open_] & _U64(_mask(order))
            known, value = self.find(0, order, now)
            total[open_[known]] += value[known]
            open_, now = open_[~known], now[~known]
            known, value = self.find(1, order, now >> _U8)
            total[open_[known]] += value[known]
        return total

    def features(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(bytes, ratio in all, best ratio a byte, best ratio) of every row; bytes count the words' ends."""
        out = np.zeros((len(offs) - 1, 4))
        start, end, which, before = distinct(raw, offs)
        if not len(start):
            return out
        grams, first = windows(raw, start, end)
        size = (end - start + 1).astype(np.float64)
        word = np.add.reduceat(self.of_windows(grams), first)
        full = np.flatnonzero(np.diff(before))
        at = before[:-1][full]
        out[full] = np.stack([np.add.reduceat(size[which], at), np.add.reduceat(word[which], at), np.maximum.reduceat((word / size)[which], at), np.maximum.reduceat(word[which], at)], 1)
        return out


@dataclass
class ToxicityModel:
    table: DataFrame
    rows: int
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    share: float = 0.0

    def broadcast(self) -> Table:
        """The table of ratios on the driver; only below ``MODEL_ROWS`` rows."""
        got = self.table.select((F.shiftleft(F.col("order").cast("long") * 2 + F.col("part"), 56) + F.col("gram")).alias("key"), F.col("value").cast("float")).toArrow()
        keys = got.column(0).to_numpy().view(_U64)
        order = np.argsort(keys)
        return Table(keys[order], got.column(1).to_numpy()[order])


def _local_features(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    at, names = docs.columns.index("__text"), [*docs.columns, "size", "total", "rate", "most"]
    kept = [c for c in docs.columns if c != "__text"]
    shared = docs.sparkSession.sparkContext.broadcast(model.broadcast())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.features(raw, offs) for _, _, raw, offs in _text.pieces(batch.column(at), PART)]
            x = np.concatenate(parts) if parts else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names) - 4) if k != at), *(pa.array(x[:, k].copy()) for k in range(4))], [*kept, *names[-4:]])

    return _text.mapped(docs, run, _text.extended(docs.drop("__text"), "size double, total double, rate double, most double"))


def word_ratios(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, size, ratio) of distinct words by joins with the table of ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in _text.pieces(batch.column(0)):
                grams, first = windows(raw, offs[:-1], offs[1:])
                size = np.diff(np.append(first, len(grams)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), size))), pa.array(_text.signed(grams))], ["word", "gram"])

    windowed = _text.mapped(words, run, "word string, gram long")
    distinct_grams = windowed.select("gram").distinct()
    for order in range(OWN, ORDER + 1):
        for part in (0, 1):
            cut = F.col("gram").bitwiseAND(F.lit(_mask(order)))
            one = table.where((F.col("part") == part) & (F.col("order") == order)).select(F.col("gram").alias("k"), F.col("value").cast("float").alias(f"v{part}{order}"))
            distinct_grams = distinct_grams.withColumn("k", F.shiftright(cut, 8) if part else cut).join(one, "k", "left").drop("k")
    value = F.lit(0.0)
    for order in range(OWN, ORDER + 1):
        value = F.coalesce(F.col(f"v0{order}").cast("double"), F.coalesce(F.col(f"v1{order}").cast("double"), F.lit(0.0)) + value)
    known = distinct_grams.select("gram", value.alias("value"))
    return windowed.join(known, "gram").groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("size"), F.sum("value").alias("ratio"))


def _joined_features(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    keyed = docs.withColumn("__key", F.xxhash64("__text"))
    at = keyed.columns.index("__text"), keyed.columns.index("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(at[1])
            for lo, hi, raw, offs in _text.pieces(batch.column(at[0])):
                start, end, which, before = distinct(raw, offs)
                row = np.repeat(np.arange(lo, hi), np.diff(before))
                pair, n = np.unique(row * max(1, len(start)) + which, return_counts=True)
                if not len(pair):
                    continue
                lower = [bytes(_LOWER[raw[a:b]]).decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(pair // len(start))), pa.array(lower).take(pa.array(pair % len(start))), pa.array(n)], ["__key", "word", "n"])

    tokens = stored(_text.mapped(keyed, run, "__key long, word string, n long").distinct(), "document-words")
    found = tokens.join(word_ratios(tokens.select("word").distinct(), model.table), "word")
    x = found.groupBy("__key").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum(F.col("ratio") * F.col("n")).alias("total"), F.max(F.col("ratio") / F.col("size")).alias("rate"), F.max("ratio").alias("most"))
    return keyed.drop("__text").join(x, "__key", "left").drop("__key").fillna(0.0, ["size", "total", "rate", "most"])


def features(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Replace the column ``__text`` by ``size``, ``total``, ``rate`` and ``most``."""
    return _local_features(docs, model) if model.rows <= MODEL_ROWS else _joined_features(docs, model)


def _described() -> list[Column]:
    return [F.col("total") / F.greatest("size", F.lit(1.0)), F.col("rate"), F.col("most")]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, centre, scale) by Newton steps; the ridge is a share of the rows."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([*np.full(x.shape[1], ridge), 0.0]) * np.sqrt(len(x))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-6 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w, centre, scale


def _fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = CALIBRATION_ROWS) -> ToxicityModel:
    """Count, build the models, and fit the regression; labels of the held-out fold are never read."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & (_fold("id") != 2))
    known = stored(known.groupBy("id").agg((F.max("y") > 0).cast("int").alias("toxic")), "toxic-labels")
    learned, tested = known.where(_fold("id") < 2), known.where(_fold("id") == 3)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = stored(count_ngrams(texts.join(small(learned), "id", "left")), "spelling-counts")
    table = stored(ratios(counts), "spelling-ratios")
    forget(counts)
    model = ToxicityModel(table, table.count())
    sizes = {r.toxic: r.n for r in tested.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        tested = known
        sizes = {r.toxic: r.n for r in tested.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return model
    model.share = sizes.get(1, 0) / sum(sizes.values())
    if len(sizes) < 2:
        return model
    draw = F.xxhash64("id", F.lit("toxicity sample")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    chosen = texts.join(small(tested.where(draw < min(1.0, rows / sum(sizes.values())))), "id").select(F.col("text").alias("__text"), "toxic")
    described = features(chosen, model).where("size > 0").select("toxic", *[c.alias(f"x{k}") for k, c in enumerate(_described())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) for b in batches]
        if got and len(np.unique((x := np.concatenate(got))[:, 0])) == 2:
            x = x[np.lexsort(x.T)]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps([v.tolist() for v in logistic(x[:, 1:], x[:, 0])])])], ["model"])

    fitted = stored(_text.mapped(described.repartition(1), learn, "model string"), "toxicity-regression")
    got = fitted.first()
    forget(fitted)
    if got:
        model.weights, model.centre, model.scale = json.loads(got["model"])
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to all columns of ``docs``."""
    kept = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != text_col)]
    plain = [f"__c{k}" for k in range(len(kept))]
    described = features(docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain, strict=True)], F.col(text_col).alias("__text")), model)
    value = F.lit(model.share)
    if model.weights:
        z = F.lit(model.weights[-1]) + sum(((c - m) / s * w for c, m, s, w in zip(_described(), model.centre, model.scale, model.weights, strict=False)), F.lit(0.0))
        value = F.when(F.col("size") > 0, 1 / (1 + F.exp(-z))).otherwise(value)
    scored = described.select(*[F.col(p).alias(c) for c, p in zip(kept, plain, strict=True)], value.cast("double").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels), keep_text=False)
    return out.select("doc_id", F.coalesce(_fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", "predicted")
