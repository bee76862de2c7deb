"""Token ids in ORC files with pruning by document.

Layout: documents are range-partitioned and sorted by id, one file for each
range.  A row is a document: shard, doc_id, start (ids of the shard before it), n_tokens,
ids.  ORC stores integers with run-length encoding, cuts files into stripes
that are read in parallel, keeps min/max statistics of every stripe and of
every row-index group, and a Bloom filter on ``doc_id``; a reader that asks for
some ids skips all other stripes.  The offset of a document among all ids is
its offset in the shard plus the lengths of the shards before.

Encoding uses the tokenizers library.  Distinct words are independent, so each
worker has the library encode a word once, many words in one call, and keeps a
bounded cache.

Defined cases: a null text is empty and holds the end id only.  Rows without an
id come first, in any order among themselves; rows with equal ids are ordered
by a hash of their text.  An empty table writes an empty data set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm import _text
from termloom.llm._store import new_path, small, stored
from termloom.llm.bpe_automaton import END, Splitter

END_ID = 1
#: Words that a worker remembers, and characters of text handled at a time.
CACHE, PART = 700_000, 2 << 20
#: Bytes of text aimed at in one file.
FILE_BYTES = 32 << 20
#: Shards whose offsets are added up together.
SHARD_GROUP = 4096
ORC = {
    "orc.compress": "LZ4",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


class LibraryEncoder:
    """Encodes texts by a tokenizer file; the library encodes each distinct word once.

    Texts are split as in ``bpe_automaton``.  New words are joined by blanks into
    one call, and the result is cut behind the tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.ends = np.zeros(max([*vocab.values(), *self.special.values()]) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith(END)]] = True
        self.splitter = Splitter(self.special, self.tokenizer)
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            old = self.known
            self.known = {w: old[w] for w in words & old.keys()}
        new = list(words.difference(self.known))
        for w in [w for w in new if w[0] == "\n"]:
            self.known[w] = int(self.special[w[1:]]).to_bytes(4, "little")
        plain = [w for w in new if w[0] != "\n"]
        for lo in range(0, len(plain), 8192):
            part = plain[lo : lo + 8192]
            ids = self._ids(" ".join(part))
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                data, at = ids.tobytes(), 0
                for w, cut in zip(part, cuts, strict=True):
                    self.known[w] = data[at:cut]
                    at = cut
            else:  # a word that the library splits further
                for w in part:
                    self.known[w] = self._ids(w).tobytes()

    def encode(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """Little-endian 32-bit ids of each text, followed by ``end``."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            part, size = [], 0
            while lo < len(texts) and (size < PART or not part):
                part.append(self.splitter.split(texts[lo] or ""))
                size += len(texts[lo] or "")
                lo += 1
            self._learn(set().union(*part))
            get = self.known.__getitem__
            out += [b"".join(map(get, words)) + end for words in part]
        return out


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Write the token files of ``docs`` in ascending order of id.

    Texts are dealt and sorted before they are encoded: they are smaller than
    their ids, and the sampling of the ranges then encodes nothing.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(tokenizer), 0
        for batch in batches:
            for lo, hi, _, _ in _text.pieces(batch.column(2), PART):
                data = enc.encode(batch.column(2).slice(lo, hi - lo).to_pylist(), end)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(data), np.int32)))
                cols = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets).astype(np.int32)), ids]
                at += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "start", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(files, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    placed = _text.mapped(dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text"), run, "shard int, doc_id long, start long, n_tokens int, ids array<int>")
    placed.write.options(**ORC).orc(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The token files; a filter on doc_id prunes stripes by statistics and Bloom filter."""
    return spark.read.schema("shard int, doc_id long, start long, n_tokens int, ids array<int>").orc(out)


def documents(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, computed from the files."""
    files = read(spark, out)
    # One row for each file, read several times below.
    ends = stored(files.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).withColumn("group", F.floor(F.col("shard") / SHARD_GROUP)), "shards")
    # Shards are added up inside their group; only the groups are ordered as a whole.
    groups = ends.groupBy("group").agg(F.sum("n").alias("m")).select("group", (F.sum("m").over(Window.orderBy("group")) - F.col("m")).alias("groups_before"))
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("shard")) - F.col("n")
    before = ends.withColumn("inside", inside).join(groups, "group").select("shard", (F.col("groups_before") + F.col("inside")).alias("before"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            offs = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = _text.mapped(files, check, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(small(before), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_orc(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digest: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    out = new_path(spark, "token-orc")
    write(docs.select("doc_id", "text"), out, path)
    return documents(spark, out)
