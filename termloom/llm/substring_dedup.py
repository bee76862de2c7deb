"""Substring deduplication with a log-structured fingerprint index.

A *window* is ``size`` consecutive words; a window that starts in two places is
repeated, and its words go.  Fingerprints are taken by winnowing: of the
``gram``-word hashes inside a window the smallest is its anchor, so two equal
windows share an anchor, and about one word in fourteen needs an index row.

Index: each batch of documents is fingerprinted, counted and written as an
immutable run, bucketed and sorted by fingerprint; a manifest in the same folder
names the runs, so an index can be opened again at any time.  A new batch is
merge-joined with each run: all have the same buckets, so no run is shuffled
again.  The join names the anchors that the batch or the history holds again.
When there are more than ``fanout`` runs they are compacted into one, which the
next batch then meets; the manifest is replaced before old runs are deleted.

Verification: anchors counted at least twice go into a Bloom filter of fixed
size (a false positive only costs work).  Windows whose anchor is in the filter
are hashed in full to 96 bits and counted exactly, first within each piece of
text, so a very common window reaches the shuffle once a piece; only windows
counted twice are removed.  No text is moved until the last step, which joins the removed
positions to their documents.  In incremental use the windows of a batch are
verified against the texts of the history that hold one of its anchors.

Defined cases: a null text has no words.  Each row is a document of its own, so
a repeated row of ``size`` or more words is removed whole from both.  An empty
table gives an empty result, a text of fewer than ``size`` words is kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import _text
from termloom.llm._store import drop, new_path, stored

U64 = np.uint64
SIZE, GRAM = 35, 8
#: Bits of the Bloom filter; 16 MB whatever the corpus.
BLOOM_BITS = 27
_gram_poly, _check_poly = _text.Poly(31), _text.Poly(32)


def _sliding(x: np.ndarray, k: int, f) -> np.ndarray:
    """f over all k consecutive values by doubling."""
    step, out = 1, x
    while 2 * step <= k:
        out = f(out[:-step], out[step:])
        step *= 2
    return f(out[: len(out) - (k - step)], out[k - step :]) if step < k else out


def _scan(raw: np.ndarray, offs: np.ndarray, size: int, gram: int):
    """Word hashes, words before each row, gram hashes, and each window's anchor hash (0: crosses rows)."""
    start, end, before = _text.words(raw, offs)
    hashes = _text.word_hashes(raw, start, end)
    n = len(hashes)
    if n < size:
        return hashes, before, np.zeros(0, U64), np.zeros(0, U64)
    grams = _gram_poly.windows(_gram_poly.prefix(hashes), gram) | U64(1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(before))
    low = _sliding(grams, size - gram + 1, np.minimum)
    return hashes, before, grams, np.where(row[: n - size + 1] == row[size - 1 :], low, U64(0))


def _anchor_hashes(grams: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Hash of every position that is the anchor of some window."""
    if not len(low):
        return low
    pad = np.zeros(width - 1, U64)
    return grams[_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == grams]


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(fp, n): anchors of all texts with the number of places, summed per piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offs in _text.pieces(batch.column(0)):
                _, _, grams, low = _scan(raw, offs, size, gram)
                fp, n = np.unique(_anchor_hashes(grams, low, size - gram + 1), return_counts=True)
                if len(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(_text.signed(fp)), pa.array(n)], ["fp", "n"])

    return _text.mapped(docs.select(text_col), run, "fp long, n long")


class FingerprintIndex:
    """Sorted immutable runs of (fp, n) in one folder that all executors reach.

    An index is opened, or begun if there is none, by its folder; without one it
    lies in the scratch folder.  ``buckets`` and the shape of the windows are
    those it was begun with.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, size: int = SIZE, gram: int = GRAM, buckets: int | None = None, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "fingerprints"), fanout
        self.number, found = self._newest()
        state = found or {"size": size, "gram": gram, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": []}
        self.size, self.gram, self.buckets, self.runs = state["size"], state["gram"], state["buckets"], state["runs"]

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder, jvm.org.apache.hadoop.fs.Path

    def _newest(self) -> tuple[int, dict | None]:
        """Number and content of the newest manifest; a broken one, of a writer that was lost, is passed over."""
        fs, folder, _ = self._files()
        if not fs.exists(folder):
            return 0, None
        names = [str(f.getPath().getName()) for f in fs.listStatus(folder)]
        numbers = sorted((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), reverse=True)
        for k in numbers:
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest-{k}.json").collect())
            try:
                return numbers[0], json.loads(text)
            except ValueError:
                continue
        return (numbers[0] if numbers else 0), None

    def _commit(self) -> None:
        fs, _, path = self._files()
        self.number += 1
        out = fs.create(path(f"{self.path}/manifest-{self.number}.json"), False)
        out.write(bytearray(json.dumps({"size": self.size, "gram": self.gram, "buckets": self.buckets, "runs": self.runs}).encode()))
        out.close()

    def _write(self, counted: DataFrame) -> str:
        name = f"termloom_run_{uuid.uuid4().hex}"
        dealt = counted.repartition(self.buckets, "fp")
        dealt.write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _read(self, name: str) -> DataFrame:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def close(self) -> None:
        """Take the runs out of the session's catalog; their files stay."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def ingest(self, batch: DataFrame, text_col: str = "text") -> DataFrame:
        """Append a run for ``batch`` and merge-join it with the earlier ones.

        Returns (fp, n, before): the anchors of the batch that it or the earlier
        runs hold again."""
        name = self._write(fingerprints(batch, text_col, self.size, self.gram).groupBy("fp").agg(F.sum("n").alias("n")))
        met, before = self._read(name), F.lit(0).cast("long")
        for k, run in enumerate(self.runs):
            met = met.join(self._read(run).withColumnRenamed("n", f"n{k}").hint("merge"), "fp", "left")
            before = before + F.coalesce(F.col(f"n{k}"), F.lit(0).cast("long"))
        again = stored(met.select("fp", "n", before.alias("before")).where("n + before > 1"), "anchors")
        self.runs = [*self.runs, name]
        self._commit()
        if len(self.runs) > self.fanout:
            self.compact()
        return again

    def merged(self) -> DataFrame:
        """All runs as one relation (fp, n)."""
        every = self.spark.createDataFrame([], "fp long, n long")
        for name in self.runs:
            every = every.unionByName(self._read(name))
        return every.groupBy("fp").agg(F.sum("n").alias("n"))

    def compact(self) -> None:
        """Merge all runs into one; the manifest names it before the others are deleted."""
        if len(self.runs) > 1:
            old, self.runs = self.runs, [self._write(self.merged())]
            self._commit()
            for name in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                drop(self.spark, f"{self.path}/{name}")


def _slots(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (fp >> U64(64 - bits)).astype(np.int64), ((fp >> U64(1)) & U64((1 << bits) - 1)).astype(np.int64)


def bloom(fps: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Bloom filter of column ``fp``: at most 2**(bits-6) words reach the driver."""
    fp = F.col("fp")
    both = fps.select(F.explode(F.array(F.shiftrightunsigned(fp, 64 - bits), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit((1 << bits) - 1)))).alias("at"))
    word = both.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v"))
    got = word.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out.view(U64)


def _in_bloom(table: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    a, b = _slots(fp, bits)
    one = U64(1)
    hit = (table[a >> 6] >> (a & 63).astype(U64)) & one
    return ((hit & (table[b >> 6] >> (b & 63).astype(U64))) & one).astype(bool)


def repeated_windows(docs: DataFrame, anchors: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(rid, starts): of every document, the first words of its repeated windows.

    ``anchors`` has column fp: all anchors that occur more than once in ``docs``.
    ``rid`` is xxhash64 of id and text.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(bloom(anchors.select("fp"), bloom_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(1).to_numpy()
            for lo, _, raw, offs in _text.pieces(batch.column(0)):
                hashes, before, _, low = _scan(raw, offs, size, gram)
                at = np.flatnonzero(low)
                at = at[_in_bloom(table.value, low[at], bloom_bits)]
                if not len(at):
                    continue
                first, second = (p.ranges(p.prefix(hashes), at, at + size) for p in (_text.word_poly, _check_poly))
                row = np.searchsorted(before, at, "right") - 1
                second >>= U64(32)
                place = (at - before[row]).astype(np.int32)
                order = np.lexsort((second, first))
                same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
                again = np.zeros(len(at), bool)
                again[order[1:]] = same
                lead = order[:-1][same & ~np.concatenate([[False], same[:-1]])]
                # A window seen twice here is settled: its places are dealt out by
                # a hash of their own (v = -1), and one row without a place (p = -1)
                # speaks for it to other texts.
                settled = again.copy()
                settled[lead] = True
                own = _text.mix(_text.mix(rid[lo + row].view(U64)) + place.astype(U64))
                w = np.concatenate([np.where(settled, own, first), first[lead]])
                v = np.concatenate([np.where(settled, -1, second.astype(np.int64)), second[lead].astype(np.int64)])
                of = pa.array(np.concatenate([rid[lo + row], np.zeros(len(lead), np.int64)]))
                p = np.concatenate([place, np.full(len(lead), -1, np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(w)), pa.array(v), of, pa.array(p)], ["w", "v", "rid", "p"])

    found = _text.mapped(docs.select(text_col, F.xxhash64(id_col, text_col)), run, "w long, v long, rid long, p int")
    view = f"termloom_windows_{uuid.uuid4().hex}"
    found.createOrReplaceTempView(view)
    twice = spark.sql(f"SELECT rid, p FROM (SELECT rid, p, v, count(*) OVER g AS c, min(p) OVER g AS q FROM {view} WINDOW g AS (PARTITION BY w, v)) WHERE (c > 1 OR q < 0 OR v < 0) AND p >= 0")
    spark.catalog.dropTempView(view)
    return twice.groupBy("rid").agg(F.collect_list("p").alias("starts"))


def _kept(raw: np.ndarray, offs: np.ndarray, starts: list[np.ndarray | None], size: int):
    """Words of each row, words removed, and the kept words joined by one space."""
    start, end, before = _text.words(raw, offs)
    n = len(start)
    cover = np.zeros(n + 1, np.int32)
    for k, p in enumerate(starts):
        if p is not None:
            at = before[k] + np.unique(p)
            cover[at] += 1
            np.subtract.at(cover, at + size, 1)
    gone = np.cumsum(cover[:n]) > 0
    live = np.flatnonzero(~gone)
    row = np.searchsorted(before, live, "right") - 1
    tail = end[live].copy()
    more = np.zeros(len(live), bool)
    more[:-1] = row[1:] == row[:-1]
    tail[more] += 1
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, start[live], 1)
    np.subtract.at(edge, tail, 1)
    mask = np.cumsum(edge[:-1]) > 0
    out = np.where(_text.SPACE[raw], np.uint8(32), raw)[mask]
    size_before = np.concatenate([[0], np.cumsum(mask)])[offs]
    data = memoryview(np.ascontiguousarray(out))
    texts = [data[a:b] for a, b in zip(size_before[:-1].tolist(), size_before[1:].tolist(), strict=True)]
    removed = np.concatenate([[0], np.cumsum(gone)])[before]
    return np.diff(before), np.diff(removed), texts


def _holding(docs: DataFrame, anchors: DataFrame, text_col: str, size: int, gram: int, bloom_bits: int) -> DataFrame:
    """The rows whose texts hold one of the anchors (or, rarely, seem to)."""
    table = docs.sparkSession.sparkContext.broadcast(bloom(anchors.select("fp"), bloom_bits))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, raw, offs in _text.pieces(batch.column(at)):
                _, before, _, low = _scan(raw, offs, size, gram)
                hit = np.flatnonzero(low)
                hit = hit[_in_bloom(table.value, low[hit], bloom_bits)]
                keep[lo + np.searchsorted(before, hit, "right") - 1] = True
            yield batch.filter(pa.array(keep))

    return _text.mapped(docs, run, docs.schema)


def remove_repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    gram: int = GRAM,
    batches: int = 2,
    digest: bool = False,
    keep_text: bool = True,
    bloom_bits: int = BLOOM_BITS,
    index: FingerprintIndex | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Remove every word that a repeated window covers.

    With an ``index``, ``docs`` is one new batch: it is ingested, and its windows
    count as repeated if they occur again in it or in ``history``, the rows (id,
    text) of all batches ingested before.  Without one, all rows are judged
    against each other: they are ingested in ``batches`` parts by a hash of the
    id into an index of their own.

    Returns all columns (the text replaced by its kept words, or left out), then
    n_words, n_removed and, with ``digest``, kept_sha256; input columns of those
    names are replaced.
    """
    seen = docs.select(id_col, text_col)
    if index is None:
        own = FingerprintIndex(docs.sparkSession, None, size, gram)
        part = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(batches))
        anchors = None
        for k in range(batches):
            more = own.ingest(docs.where(part == k).select(text_col), text_col).select("fp")
            anchors = more if anchors is None else anchors.unionByName(more)
        own.close()
    else:
        size, gram = index.size, index.gram
        anchors = index.ingest(docs.select(text_col), text_col).select("fp")
        if history is not None:
            seen = seen.unionByName(_holding(history.select(id_col, text_col), anchors, text_col, size, gram, bloom_bits))
    added = ["n_words", "n_removed", *(["kept_sha256"] if digest else [])]
    given = docs.select(*[c for c in docs.columns if c not in added])
    kept_cols = given if keep_text else given.drop(text_col)
    names, text_at = [*kept_cols.columns, *added], given.columns.index(text_col)
    at = [given.columns.index(c) for c in kept_cols.columns]
    out_at = kept_cols.columns.index(text_col) if keep_text else None
    marks = repeated_windows(seen, anchors, id_col, text_col, size, gram, bloom_bits).select(F.col("rid").alias("__rid"), F.col("starts").alias("__starts"))
    joined = given.withColumn("__rid", F.xxhash64(id_col, text_col)).join(marks, "__rid", "left").select(*given.columns, "__starts")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            marked = batch.column(batch.num_columns - 1)
            for lo, hi, raw, offs in _text.pieces(batch.column(text_at)):
                starts = [marked[k].values.to_numpy() if marked[k].is_valid else None for k in range(lo, hi)]
                n_words, n_removed, texts = _kept(raw, offs, starts, size)
                cols = [batch.column(i).slice(lo, hi - lo) for i in at]
                if out_at is not None:
                    cols[out_at] = pa.array([bytes(x) for x in texts], pa.binary()).cast(pa.string())
                more = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                if digest:
                    more.append(pa.array([hashlib.sha256(x).hexdigest() for x in texts]))
                yield pa.RecordBatch.from_arrays([*cols, *more], names)

    return _text.mapped(joined, run, _text.extended(kept_cols, "n_words long, n_removed long" + ", kept_sha256 string" * digest))


def op2_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeated(docs.select("doc_id", "text"), digest=True, keep_text=False)


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d
), win AS (
  SELECT rid, i AS p, md5(array_to_string(list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING), ' ')) AS h, n
  FROM w QUALIFY i + 34 <= n
), twice AS (
  SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1
), judged AS (
  SELECT w.rid, w.i, w.word, coalesce(max(t.p) OVER (PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS gone
  FROM w LEFT JOIN twice t ON t.rid = w.rid AND t.p = w.i
), agg AS (
  SELECT rid, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(a.n_removed, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN agg a ON a.rid = d.rid
"""
