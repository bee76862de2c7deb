"""Line deduplication by a sharded minimal perfect hash.

1. Every line is reduced to a key (ASCII white space stripped at both ends, A-Z
   lower-cased) and hashed to 128 bits.  Rows are counted per key before and
   after one shuffle.  Lines that only one row holds stay out of the index: no
   threshold can drop them, and they are found absent by fingerprint.
2. The distinct hashes left are dealt to shards of bounded size.  Each shard
   holds a minimal perfect hash function (levels of collision-free bits) and
   three arrays addressed by it: fingerprint, number of documents (four bytes),
   and the document that keeps the line.  The keys themselves are not kept.
3. Documents probe the arrays: a line goes if its fingerprint is there, its
   count reaches ``min_docs`` and another document keeps it.  Arrays of up to ``broadcast_bytes`` go to every
   task; larger ones stay sharded, and the hashes of the lines, salted, stream
   past them, so that no task holds more than one shard.

Defined cases: a null or empty text is one empty line.  Every row counts as a
document of its own; rows that share the largest id of a key all keep it.  A
null id ranks below all others; if only null ids hold a key, it stays.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import _text
from termloom.llm._store import stored

U64 = np.uint64
SHARD_KEYS = 500_000
BROADCAST_BYTES = 32 << 20
_second = _text.Poly(21)


class PerfectHash:
    """Minimal perfect hash: at each level the keys alone in their slot are placed."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base = 0
        for level in range(64):
            if not len(keys):
                break
            size = int(gamma * len(keys)) + 1
            slot = self._slot(keys, level, size)
            alone = np.bincount(slot, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - alone))
            base += int(alone.sum())
            keys = keys[~alone[slot]]
        self.size, self.rest = base, np.sort(keys)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_text.mix(keys + U64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % U64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key in the arrays; any place, or -1, for an unknown key."""
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            slot = self._slot(keys[todo], level, len(alone))
            hit = alone[slot]
            out[todo[hit]] = rank[slot[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        if len(todo) and len(self.rest):
            at = np.searchsorted(self.rest, keys[todo])
            at[at == len(self.rest)] = 0
            out[todo] = np.where(self.rest[at] == keys[todo], self.size + at, -1)
        return out

    def dump(self) -> dict[str, np.ndarray]:
        bits = [np.packbits(a) for a, _ in self.levels]
        return {"bits": np.concatenate([np.zeros(0, np.uint8), *bits]), "sizes": np.array([len(a) for a, _ in self.levels], np.int64), "rest": self.rest}

    @classmethod
    def load(cls, x: dict[str, np.ndarray]) -> PerfectHash:
        self, at, base = cls.__new__(cls), 0, 0
        self.levels = []
        for size in x["sizes"]:
            n = (int(size) + 7) // 8
            alone = np.unpackbits(x["bits"][at : at + n])[: int(size)].astype(bool)
            self.levels.append((alone, base + np.cumsum(alone) - alone))
            at, base = at + n, base + int(alone.sum())
        self.size, self.rest = base, x["rest"]
        return self


class Shard:
    """A perfect hash with its fingerprint, count and keeper arrays."""

    NO_KEEPER, MOST = np.iinfo(np.int64).min, np.iinfo(np.uint32).max

    def __init__(self, hash_: PerfectHash, fingerprint: np.ndarray, count: np.ndarray, keeper: np.ndarray):
        self.hash, self.fingerprint, self.keeper = hash_, fingerprint, keeper
        self.count = np.minimum(count, self.MOST).astype(np.uint32)

    @classmethod
    def build(cls, key: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> Shard:
        h = PerfectHash(key)
        at = h.index(key)
        arrays = [np.empty_like(x) for x in (fingerprint, count, keeper)]
        for a, x in zip(arrays, (fingerprint, count, keeper), strict=True):
            a[at] = x
        return cls(h, *arrays)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, fingerprint=self.fingerprint, count=self.count, keeper=self.keeper, **self.hash.dump())
        return out.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> Shard:
        x = dict(np.load(io.BytesIO(blob)))
        return cls(PerfectHash.load(x), x["fingerprint"], x["count"], x["keeper"])

    def drops(self, key: np.ndarray, fingerprint: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether at least ``min_docs`` documents hold each line and another one keeps it."""
        at = self.hash.index(key)
        known = at >= 0
        known[known] = self.fingerprint[at[known]] == fingerprint[known]
        out = np.zeros(len(key), bool)
        keeper = self.keeper[at[known]]
        out[known] = (self.count[at[known]] >= min_docs) & (keeper != doc[known]) & (keeper != self.NO_KEEPER)
        return out


def _lines(raw: np.ndarray, offs: np.ndarray, min_chars: int):
    """(row, start, end) of all lines, and of the long ones: line, key, fingerprint."""
    cut = np.flatnonzero(raw == 10)
    row = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, cut, "right") - 1])
    start = np.concatenate([offs[:-1], cut + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = np.empty_like(start)
    end[:-1] = np.where(row[1:] == row[:-1], start[1:] - 1, offs[row[:-1] + 1])
    end[-1] = len(raw)
    solid = np.flatnonzero(~_text.SPACE[raw])
    first, last = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = np.flatnonzero(last > first)
    begin, stop = solid[first[some]], solid[last[some] - 1] + 1
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    long = points[stop] - points[begin] >= min_chars
    line, begin, stop = some[long], begin[long], stop[long]
    values = _text._BYTES_LOWER[raw]
    key = _text.byte_poly.ranges(_text.byte_poly.prefix(values), begin, stop)
    fingerprint = _second.ranges(_second.prefix(_text.mix(values)), begin, stop)
    return row, start, end, line, key, fingerprint


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(Shard.NO_KEEPER).to_numpy(zero_copy_only=False)


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(key, fingerprint, n, keeper): rows that hold each long line, and the largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column(0))
            for lo, hi, raw, offs in _text.pieces(batch.column(1)):
                row, _, _, line, key, fp = _lines(raw, offs, min_chars)
                if not len(line):
                    continue
                one = pd.DataFrame({"key": _text.signed(key), "fp": _text.signed(fp), "row": row[line]}).drop_duplicates()
                one["doc"] = ids[lo + one["row"].to_numpy()]
                got = one.groupby(["key", "fp"], sort=False).agg(n=("row", "size"), keeper=("doc", "max")).reset_index()
                yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    part = _text.mapped(docs.select(id_col, text_col), run, "key long, fp long, n long, keeper long")
    return part.groupBy("key", "fp").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(shard, shards, blob): the index over all lines in more than one row."""
    keys = stored(line_counts(docs, id_col, text_col, min_chars).where("n > 1"), "line-keys")
    shards = max(1, -(-keys.count() // shard_keys))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.build(group["key"].to_numpy().view(U64), group["fp"].to_numpy().view(U64), group["n"].to_numpy(), group["keeper"].to_numpy())
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "shards": shards, "blob": [shard.dumps()]})

    dealt = keys.select("*", F.pmod("key", F.lit(shards)).cast("int").alias("shard"))
    return stored(dealt.groupBy("shard").applyInPandas(build, "shard int, shards int, blob binary"), "line-index")


def _rewrite(raw: np.ndarray, offs: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, drop: np.ndarray) -> list[bytes | memoryview]:
    """Text of every row without its dropped lines."""
    data = memoryview(np.ascontiguousarray(raw))
    out: list = [data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    if drop.any():
        bounds = np.searchsorted(row, np.arange(len(offs)))
        for r in np.unique(row[drop]):
            k = np.arange(bounds[r], bounds[r + 1])
            out[r] = b"\n".join(data[start[i] : end[i]] for i in k[~drop[k]])
    return out


def _output(batch_cols: list, names: list[str], text_at: int | None, kept: list, n_lines, n_dropped, digest: bool) -> pa.RecordBatch:
    cols = list(batch_cols)
    if text_at is not None:
        cols[text_at] = pa.array([bytes(x) for x in kept], pa.binary()).cast(pa.string())
    more = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    if digest:
        more.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
    return pa.RecordBatch.from_arrays([*cols, *more], names)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, digest: bool = False, keep_text: bool = True, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rewrite the texts of ``docs`` without repeated lines.

    Returns all columns (the text replaced, or left out without ``keep_text``),
    then n_lines, n_dropped and, with ``digest``, kept_sha256.  Input columns of
    those names are replaced.
    """
    spark = docs.sparkSession
    added = ["n_lines", "n_dropped", *(["kept_sha256"] if digest else [])]
    given = docs.select(*[c for c in docs.columns if c not in added])
    kept_cols = given if keep_text else given.drop(text_col)
    names = [*kept_cols.columns, *added]
    id_at, text_at = given.columns.index(id_col), given.columns.index(text_col)
    at = [given.columns.index(c) for c in kept_cols.columns]
    out_at = kept_cols.columns.index(text_col) if keep_text else None
    schema = _text.extended(kept_cols, "n_lines long, n_dropped long" + ", kept_sha256 string" * digest)
    index = build_index(docs, id_col, text_col, min_chars, shard_keys)
    total = index.agg(F.sum(F.length("blob")), F.max("shards")).first()

    if (total[0] or 0) <= broadcast_bytes:
        shards = total[1] or 1
        blobs = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {k: Shard.loads(v) for k, v in blobs.value.items()}
            for batch in batches:
                ids = _ids(batch.column(id_at))
                for lo, hi, raw, offs in _text.pieces(batch.column(text_at)):
                    row, start, end, line, key, fp = _lines(raw, offs, min_chars)
                    drop = np.zeros(len(row), bool)
                    of = key.view(np.int64) % shards
                    for s, shard in loaded.items():
                        mine = np.flatnonzero(of == s)
                        drop[line[mine]] = shard.drops(key[mine], fp[mine], ids[lo + row[line[mine]]], min_docs)
                    kept = _rewrite(raw, offs, row, start, end, drop)
                    n = hi - lo
                    yield _output([batch.column(i).slice(lo, n) for i in at], names, out_at, kept, np.bincount(row, minlength=n), np.bincount(row[drop], minlength=n), digest)

        return _text.mapped(given, run, schema)

    drops = _streamed_drops(docs, index, int(total[1]), id_col, text_col, min_chars, min_docs)
    rid = F.xxhash64(id_col, text_col)
    joined = given.withColumn("__rid", rid).join(drops.withColumnRenamed("rid", "__rid"), "__rid", "left").select(*given.columns, "__lines")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.num_columns - 1)
            for lo, hi, raw, offs in _text.pieces(batch.column(text_at)):
                row, start, end, *_ = _lines(raw, offs, min_chars)
                drop = np.zeros(len(row), bool)
                first = np.searchsorted(row, np.arange(hi - lo))
                for k in range(hi - lo):
                    if gone[lo + k].is_valid:
                        drop[first[k] + np.array(gone[lo + k].as_py())] = True
                kept = _rewrite(raw, offs, row, start, end, drop)
                n = hi - lo
                yield _output([batch.column(i).slice(lo, n) for i in at], names, out_at, kept, np.bincount(row, minlength=n), np.bincount(row[drop], minlength=n), digest)

    return _text.mapped(joined, rewrite, schema)


def _streamed_drops(docs: DataFrame, index: DataFrame, shards: int, id_col: str, text_col: str, min_chars: int, min_docs: int, salts: int = 8) -> DataFrame:
    """(rid, __lines): numbers of the lines to drop of every document that has some.

    The rows of a partition are sorted so that a shard comes before the lines
    that probe it; a task holds one shard at a time.
    """

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rid = _ids(batch.column(0)), batch.column(2).to_numpy()
            for lo, hi, raw, offs in _text.pieces(batch.column(1)):
                row, _, _, line, key, fp = _lines(raw, offs, min_chars)
                r = row[line]
                number = line - np.searchsorted(row, r)
                signed = _text.signed(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((signed % shards).astype(np.int32)), pa.array((r % salts).astype(np.int32)), pa.array(np.ones(len(r), np.int32)), pa.nulls(len(r), pa.binary()), pa.array(rid[lo + r]), pa.array(number.astype(np.int32)), pa.array(signed), pa.array(_text.signed(fp)), pa.array(ids[lo + r])],
                    ["shard", "salt", "kind", "blob", "rid", "line", "key", "fp", "doc"],
                )

    kinds = "shard int, salt int, kind int, blob binary, rid long, line int, key long, fp long, doc long"
    rows = _text.mapped(docs.select(id_col, text_col, F.xxhash64(id_col, text_col)), probes, kinds)
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "blob")
    both = arrays.unionByName(rows, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Shard] | None = None
        for batch in batches:
            shard, kind, blob = (batch.column(i) for i in (0, 2, 3))
            shard_of, kinds_of = shard.to_numpy(), kind.to_numpy()
            cuts = [*np.flatnonzero(kinds_of == 0).tolist(), len(kinds_of)]
            spans = [(-1, 0, cuts[0])] if cuts[0] else []
            spans += [(k, k + 1, nxt) for k, nxt in zip(cuts[:-1], cuts[1:], strict=True)]
            for at, lo, hi in spans:
                if at >= 0:
                    held = (int(shard_of[at]), Shard.loads(blob[at].as_py()))
                if hi <= lo or held is None:
                    continue
                key, fp, doc = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in (6, 7, 8))
                mine = shard_of[lo:hi] == held[0]
                out = np.zeros(hi - lo, bool)
                out[mine] = held[1].drops(key[mine].view(U64), fp[mine].view(U64), doc[mine], min_docs)
                yield pa.RecordBatch.from_arrays([batch.column(4).slice(lo, hi - lo).filter(pa.array(out)), batch.column(5).slice(lo, hi - lo).filter(pa.array(out))], ["rid", "line"])

    found = _text.mapped(both, probe, "rid long, line int")
    return found.groupBy("rid").agg(F.collect_set("line").alias("__lines"))


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_repeated_lines(docs.select("doc_id", "text"), digest=True, keep_text=False)


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), one AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines
), keyed AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM one
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rid) >= 5
), judged AS (
  SELECT e.*, o.k IS NOT NULL AND coalesce(e.doc_id <> o.keeper, o.keeper IS NOT NULL) AS gone FROM keyed e LEFT JOIN often o ON e.k = o.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""
