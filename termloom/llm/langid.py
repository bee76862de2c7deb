"""Language identification with averaged hashed subword embeddings.

Model: every byte 3-gram and 4-gram (ASCII letters lower-cased) is hashed into a
fixed number of buckets; a text is the mean of its bucket embeddings, followed
by a linear softmax.  Both layers are trained by mini-batch stochastic gradient
descent in numpy.  As the classifier is linear in the embeddings, prediction
may look up the product ``embedding @ weights`` instead, where that is smaller.

Calibration: a temperature is fitted on a part of the sample that training does
not see, and the rejection level is a low quantile of the scores of its
correctly predicted texts.

Training reads a bounded sample, chosen by a hash of the id: about
``per_language`` documents of each language, ``sample_rows`` documents and
``sample_bytes`` bytes of text in all, shared equally by the labels.  All labels
are learned.  The model is fitted in one task, whose input these bounds hold to
a few hundred MB; only the model, some 4 MB, reaches the driver.  Prediction
reads every whole text, a long one in parts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
A null ``lang`` or a null id is never trained on; a null id counts as not held
out.  With nothing to learn from, every text is ``und``.  Equal scores go to
the language that sorts first.  Repeated rows are predicted alike.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import _text
from termloom.llm._store import forget, small, stored

BUCKET_BITS = 16
#: Bounds of the training sample: documents of a label, documents, bytes of text.
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_BYTES = 1200, 24_000, 12 << 20
#: Text bytes whose n-grams are looked up at a time.
PART = 256 << 10
#: The rejection level is at most this, whatever the calibration says.
MOST_REJECTED = 0.4
UND = "und"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def grams(raw: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Buckets of the two n-grams that start at each of the first len(left) bytes.

    ``left`` counts the bytes from there to the end of the row; an n-gram that
    would leave its row is cut to these, so the shortest text has one too.
    """
    n = len(left)
    b = np.zeros(n + 3, np.uint32)
    have = min(len(raw), n + 3)
    b[:have] = _LOWER[raw[:have]]
    parts = [b[k : n + k] * (left > k) for k in range(4)]
    three = parts[0] | parts[1] << np.uint32(8) | parts[2] << np.uint32(16)
    four = three | parts[3] << np.uint32(24)
    shift = np.uint32(32 - BUCKET_BITS)
    out = np.empty(2 * n, np.int32)
    out[0::2] = (three * np.uint32(0x9E3779B1)) >> shift
    out[1::2] = ((four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA6B)) >> shift
    return out


def _parts(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first gram of each, buckets) of consecutive parts of at most ``PART`` bytes."""
    for lo in range(0, len(raw), PART):
        hi = min(lo + PART, len(raw))
        rows = np.arange(np.searchsorted(offs, lo, "right") - 1, np.searchsorted(offs, hi, "left"))
        rows = rows[offs[rows + 1] > offs[rows]]
        begin = np.maximum(offs[rows], lo)
        size = np.minimum(offs[rows + 1], hi) - begin
        left = np.repeat(offs[rows + 1], size) - np.arange(lo, hi)
        yield rows, 2 * (begin - lo), grams(raw[lo : hi + 3], left)


@dataclass
class LanguageModel:
    languages: list[str]
    embed: np.ndarray  # bucket x dimension
    weights: np.ndarray  # dimension x language
    bias: np.ndarray
    temperature: float
    reject_below: float

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, embed=self.embed, weights=self.weights, bias=self.bias, rest=np.frombuffer(json.dumps([self.languages, self.temperature, self.reject_below]).encode(), np.uint8))
        return out.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> LanguageModel:
        x = np.load(io.BytesIO(blob))
        languages, temperature, reject = json.loads(x["rest"].tobytes())
        return cls(languages, x["embed"], x["weights"], x["bias"], temperature, reject)

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean @ self.weights + self.bias) / self.temperature

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, score) for every row of a string column."""
        best, score = np.full(len(column), -1), np.zeros(len(column))
        if not self.languages:
            return best, score
        few = len(self.languages) <= self.embed.shape[1]
        table = (self.embed @ self.weights).astype(np.float32) if few else self.embed
        for lo, hi, raw, offs in _text.pieces(column):
            length = np.diff(offs)
            full = np.flatnonzero(length)
            if not len(full):
                continue
            sums = np.zeros((hi - lo, table.shape[1]))
            for rows, first, idx in _parts(raw, offs):
                sums[rows] += np.add.reduceat(table[idx], first, axis=0, dtype=np.float64)
            mean = sums[full] / (2 * length[full])[:, None]
            z = (mean + self.bias) / self.temperature if few else self.logits(mean)
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            best[lo + full], score[lo + full] = z.argmax(1), z.max(1)
            letter = np.add.reduceat(_LETTER[raw], offs[:-1][full], dtype=np.int64) > 0
            for k in full[~letter]:
                if not any(c.isalpha() for c in bytes(raw[offs[k] : offs[k + 1]]).decode("utf-8", "ignore")):
                    best[lo + k], score[lo + k] = -1, 0.0
        return best, score


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 4, rate: float = 20.0, batch: int = 16, seed: int = 7) -> LanguageModel:
    """Fit the model on (language, buckets, shares) rows; every fifth row calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((1, dim), np.float32), np.zeros((dim, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    of = {k: i for i, k in enumerate(languages)}
    order = rng.permutation(len(rows))
    held = order[::5] if len(rows) >= 50 else order
    fit = np.setdiff1d(order, held) if len(rows) >= 50 else order
    embed = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim))
    weights, bias = rng.normal(0, 1 / np.sqrt(dim), (dim, len(languages))), np.zeros(len(languages))
    steps, done = epochs * (len(fit) // batch + 1), 0
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for k in range(0, len(fit), batch):
            now = [rows[i] for i in fit[k : k + batch]]
            idx, share = np.concatenate([r[1] for r in now]), np.concatenate([r[2] for r in now])
            count = np.array([len(r[1]) for r in now])
            starts = np.concatenate([[0], np.cumsum(count)[:-1]])
            hidden = np.add.reduceat(embed[idx] * share[:, None], starts, axis=0)
            p = hidden @ weights + bias
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(now)), [of[r[0]] for r in now]] -= 1
            step = rate * (1 - done / steps) / len(now)
            back = p @ weights.T
            weights -= 0.05 * step * hidden.T @ p
            bias -= 0.01 * step * p.sum(0)
            np.subtract.at(embed, idx, step * share[:, None] * np.repeat(back, count, axis=0))
            done += 1
    embed = embed.astype(np.float32)
    z = np.array([(embed[rows[i][1]] * rows[i][2][:, None]).sum(0) @ weights + bias for i in held])
    y = np.array([of[rows[i][0]] for i in held])

    def softmax(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(temperature)
    right = p.max(1)[p.argmax(1) == y]
    # Never above MOST_REJECTED: a short clean text may well score low.
    reject = min(MOST_REJECTED, float(np.quantile(right, 0.001))) if len(right) else 0.0
    return LanguageModel(languages, embed, weights, bias, temperature, reject)


def _held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _bags(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, shares) of every row that is not empty; parts of a long text are merged as they come."""
    for k in np.flatnonzero(np.diff(offs)):
        total: np.ndarray | None = None
        one = raw[offs[k] : offs[k + 1]]
        for _, _, idx in _parts(one, np.array([0, len(one)])):
            bucket, n = np.unique(idx, return_counts=True)
            if total is None and len(one) <= PART:
                yield int(k), bucket.astype(np.int32), (n / n.sum()).astype(np.float32)
                break
            total = np.zeros(1 << BUCKET_BITS, np.int64) if total is None else total
            total[bucket] += n
        else:
            bucket = np.flatnonzero(total)
            yield int(k), bucket.astype(np.int32), (total[bucket] / total.sum()).astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Train on a bounded sample of the rows whose id does not fall into the held-out fold.

    The bounds are those of the expected sample; every row of a label has the
    same chance.  With more labels than ``sample_rows`` some stay unseen.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out("id")
    )
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "languages")
    labels = counts.count()
    if not labels:
        return train([])
    share = F.least(F.lit(1.0), F.lit(min(per_language, sample_rows / labels)) / F.col("n"), F.lit(sample_bytes / labels) / F.greatest("bytes", F.lit(1)))
    draw = (F.xxhash64("id", F.lit("language sample")).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    chosen = known.join(small(counts.select("lang", share.alias("share"))), "lang").where(draw < F.col("share")).select("lang", "text", F.col("id").cast("string"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, ids = batch.column(0), batch.column(2)
            for lo, _, raw, offs in _text.pieces(batch.column(1)):
                out = [(lang[lo + k].as_py(), ids[lo + k].as_py(), bucket.tobytes(), part.tobytes()) for k, bucket, part in _bags(raw, offs)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["lang", "id", "bucket", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for k in range(batch.num_rows):
                lang, id_, bucket, part = (c[k] for c in columns)
                rows.append((lang.as_py(), id_.as_py(), bucket.as_py(), part.as_py()))
        if rows:
            rows.sort()
            model = train([(lang, np.frombuffer(bucket, np.int32), np.frombuffer(part, np.float32)) for lang, _, bucket, part in rows])
            yield pa.RecordBatch.from_arrays([pa.array([model.dumps()], pa.binary())], ["model"])

    bags = _text.mapped(chosen, features, "lang string, id string, bucket binary, share binary")
    kept = stored(_text.mapped(bags.repartition(1), learn, "model binary"), "language-model")
    got = kept.first()
    for scratch in (kept, counts):
        forget(scratch)
    return LanguageModel.loads(bytes(got["model"])) if got else train([])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to all columns of ``docs``.

    Without ``keep_text`` the text column is read but not returned.

    A row is rejected if it is ``und`` or its score lies below the calibrated
    level.  Input columns of these names are replaced.
    """
    added = ["lang_pred", "score", "rejected"]
    given = docs.select(*[c for c in docs.columns if c not in added])
    kept = given if keep_text else given.drop(text_col)
    text_at, kept_at = given.columns.index(text_col), [given.columns.index(c) for c in kept.columns]
    names = [*kept.columns, *added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        label = np.array([*m.languages, UND], object)
        for batch in batches:
            best, score = m.scores(batch.column(text_at))
            off = (best < 0) | (score < m.reject_below)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept_at), pa.array(label[best], pa.string()), pa.array(score), pa.array(off)], names)

    return _text.mapped(given, run, _text.extended(kept, "lang_pred string, score double, rejected boolean"))


def op10_language_id(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, held_out, lang_pred, score (and rejected)."""
    out = identify(docs.select("doc_id", "text"), fit(docs), keep_text=False)
    return out.select("doc_id", _held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
