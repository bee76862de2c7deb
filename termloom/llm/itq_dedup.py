"""Embedding near-deduplication: ITQ codes, multi-index Hamming tables, reranking.

1. *Rotation.*  Iterative quantisation alternates between the nearest binary
   code and the orthogonal Procrustes rotation, on a bounded sample of unit
   vectors.  A vector's code is the signs of its rotated components.
2. *Tables.*  The code is cut into m substrings; table t is keyed by substring t.
   A vector lies in the bucket of its own substring and, with ``radius`` 1, is
   also sent to the buckets whose keys lack one of its bits.  So two vectors meet
   in table t if their substrings t differ in at most ``radius`` bits, in the
   bucket of the smaller one; by the pigeonhole principle every pair whose codes
   differ in fewer than (radius + 1) * m bits meets.  A pair counts in the first
   table where it meets, so no pair is judged twice and none is written out.
3. *Reranking.*  The vectors of a bucket are compared by cosine in double
   precision.  A bucket returns, for each vector, its number of links and one
   member of its local class: rows grow with the vectors, not with the pairs.
4. *Hot buckets.*  A bucket larger than ``block`` is split by a hash of the row
   into blocks; each pair of blocks is a task of its own of at most twice that
   size.  Nothing is capped.

The number of bits of a substring follows from the number of vectors, the number
of tables from these bits: shorter substrings find more, so longer ones get more
tables.  A pair of cosine 0.95 differs in about a tenth of its bits; with 8
tables of 8 bits 99 % of such pairs meet, as with 13 of 12 bits or 21 of 16,
closer ones more often.  Where one code has too few substrings, further codes by
random rotations give the rest.  Radius 0 reaches a recall with the fewest
moved vectors (a table of radius 1 moves each about width / 2 times more and
finds 1 + width / 9 times as many pairs), so it is the default.

Vectors of different lengths are never compared; all lengths share one
dataflow.  The rotation is learned for the ``LEARNED`` most frequent lengths and
drawn at random, from the length, for any further one.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and those without an id, link with nothing; they are returned with
no links and themselves as class.  Rows are the vectors: of rows with the same
id each is a vector of its own and links with the others like any other.  A
class is named by its smallest id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import _text
from termloom.llm._components import components
from termloom.llm._store import small, stored

COSINE = 0.95
#: Vectors of a length that its rotation is learned from, and lengths that get a learned one.
SAMPLE, LEARNED = 4096, 64
BLOCK = 2048
#: Share of the pairs at the threshold that are to meet in a table.
RECALL = 0.985


def learn_rotation(x: np.ndarray, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """The ITQ rotation of unit vectors x: signs of x @ R are balanced codes."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for _ in range(rounds if len(x) else 0):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = vt.T @ u.T
    return r


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors in double precision) of the usable vectors of length ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim)
    if not len(rows):
        return rows, np.zeros((0, dim))
    values = column.take(pa.array(rows)).flatten()
    x = np.asarray(values.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    rows, x = rows[good], x[good]
    # Scaling first keeps the squares of very large or small numbers finite.
    top = np.abs(x).max(1) if dim else np.zeros(len(x))
    rows, x, top = rows[top > 0], x[top > 0], top[top > 0]
    x = x / top[:, None]
    return rows, x / np.sqrt((x * x).sum(1))[:, None]


def _apart(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether each key of a differs from each of b in more than ``radius`` bits."""
    x = a[:, None] ^ b[None, :]
    return x != 0 if radius == 0 else np.bitwise_count(x) > radius


def _local_links(ids: np.ndarray, x: np.ndarray, keys: np.ndarray, table: int, cosine: float, left: np.ndarray | None, guest: np.ndarray | None = None, radius: int = 0) -> pd.DataFrame:
    """Links of a bucket, or between the two halves of it marked by ``left``.

    ``keys`` holds all substrings of each vector; pairs that meet in an earlier
    table are left to that table.  ``guest`` marks the vectors sent here by a
    neighbouring bucket, which meet only those at home.
    """
    n = len(ids)
    count, parent = np.zeros(n, np.int64), np.arange(n)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    rows_at = np.arange(n) if left is None else np.flatnonzero(left)
    cols_at = np.arange(n) if left is None else np.flatnonzero(~left)
    step = 512
    for lo in range(0, len(rows_at), step):
        a = rows_at[lo : lo + step]
        cols = cols_at[lo:] if left is None else cols_at
        hit = x[a] @ x[cols].T >= cosine
        if left is None:
            hit &= cols[None, :] > a[:, None]
        if guest is not None:
            hit &= ~(guest[a][:, None] & guest[cols][None, :])
        if table and hit.any():
            for t in range(table):
                hit &= _apart(keys[a, t], keys[cols, t], radius)
        count[a] += hit.sum(1)
        count[cols] += hit.sum(0)
        for k in np.flatnonzero(hit.any(1)):
            with_ = cols[hit[k]]
            r = root(int(a[k]))
            # One row joins all its partners; roots of partners are few.
            for q in np.unique(parent[with_]):
                q = root(int(q))
                if q != r:
                    parent[max(q, r)] = min(q, r)
                    r = min(q, r)
            parent[with_] = r
    some = np.flatnonzero(count)
    return pd.DataFrame({"u": ids[some], "n": count[some], "mate": ids[[root(int(k)) for k in some]] if len(some) else ids[:0]})


def _substring_bits(n: int, dim: int) -> int:
    """About log2(n) / 2 bits, at least 8: tables hold the square root of n vectors a bucket."""
    return min(max(8, int(np.ceil(np.log2(max(n, 2)) / 2))), 16, dim)


def _tables(width: int, dim: int, cosine: float, radius: int = 0, recall: float = RECALL) -> int:
    """Tables of ``width`` bits in which a pair at the threshold meets with probability ``recall``; all of one code at least.

    A random hyperplane separates two vectors with probability angle / pi.
    """
    off = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    same = (1 - off) ** width + (width * off * (1 - off) ** (width - 1) if radius else 0.0)
    need = 1 if same >= recall else int(np.ceil(np.log(1 - recall) / np.log1p(-max(same, 1e-12))))
    return max(dim // width, need)


class Codes:
    """Keys of the vectors of one length: width, tables, and the hyperplanes of their bits."""

    def __init__(self, dim: int, n: int, cosine: float, bits: int | None, radius: int, rotation: np.ndarray | None = None):
        self.dim, self.width = dim, min(bits or _substring_bits(n, dim), dim)
        self.tables, self.each = _tables(self.width, dim, cosine, radius), dim // self.width
        rng = np.random.default_rng(11)
        first = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0] if rotation is None else rotation
        more = -(-self.tables // self.each) - 1
        self.planes = np.hstack([first, *(np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(more))])

    def keys(self, x: np.ndarray) -> np.ndarray:
        signs = (x @ self.planes >= 0).reshape(len(x), -1, self.dim)[:, :, : self.each * self.width]
        weights = 1 << np.arange(self.width, dtype=np.int64)
        return (signs.reshape(len(x), -1, self.width)[:, : self.tables] * weights).sum(2)


@lru_cache(maxsize=16)
def _drawn(*of) -> Codes:
    """The codes of a length without a learned rotation."""
    return Codes(*of)


def _codes(rows: DataFrame, cosine: float, sample: int, bits: int | None, radius: int) -> tuple[dict[int, Codes], int]:
    """Codes of the most frequent lengths, and the most rows of any other length."""
    counts = stored(rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")), "lengths")
    top = counts.orderBy(F.desc("n"), "dim").limit(LEARNED).collect()
    share = F.lit(1.0) * sample / F.col("n")
    draw = F.xxhash64("u", F.lit("rotation")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    learned = counts.where(F.col("dim").isin([r["dim"] for r in top]))
    drawn = rows.withColumn("dim", F.size("v")).join(F.broadcast(learned), "dim").where(draw < share).select("dim", "v")

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = _unit(table.column("v"), dim)[1]
        return pa.table({"dim": pa.array([dim], pa.int32()), "r": pa.array([learn_rotation(x).tobytes() if len(x) else None], pa.binary())})

    got = {r["dim"]: r["r"] for r in drawn.groupBy("dim").applyInArrow(learn, "dim int, r binary").collect()}
    out = {}
    for r in top:
        dim, blob = r["dim"], got.get(r["dim"])
        out[dim] = Codes(dim, r["n"], cosine, bits, radius, None if blob is None else np.frombuffer(blob).reshape(dim, dim))
    return out, min((r["n"] for r in top), default=0)


def near_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """(u, n, mate): links of vectors by bucket, to be summed over rows of a u.

    ``u`` numbers the rows; ``mate`` is the u of a vector of the same class, the
    vector itself at least once in each bucket.  Options as of ``deduplicate``.
    """
    return _links(vectors, id_col, vec_col, **options)[1]


def _links(vectors: DataFrame, id_col: str, vec_col: str, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK, bits: int | None = None, radius: int = 0) -> tuple[DataFrame, DataFrame]:
    """The numbered rows (id, v, u) and their links (u, n, mate)."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    # Numbered rows are written before they are used, so that a number never changes.
    rows = stored(given.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).withColumn("u", F.monotonically_increasing_id()), "vectors")
    learned, rest = _codes(rows, cosine, sample, bits, radius)
    shared = spark.sparkContext.broadcast(learned)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(sizes).tolist():
                at, x = _unit(batch.column(1), dim)
                if not len(at):
                    continue
                codes = shared.value.get(dim) or _drawn(dim, rest, cosine, bits, radius)
                code = pa.FixedSizeListArray.from_arrays(pa.array(codes.keys(x).astype(np.int32).ravel()), codes.tables).cast(pa.list_(pa.int32()))
                took = [batch.column(k).take(pa.array(at)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*took, pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), codes.width, np.int32)), code], ["id", "v", "u", "dim", "width", "code"])

    coded = stored(_text.mapped(rows, place, _text.extended(rows, "dim int, width int, code array<int>")), "codes")
    home = coded.select("*", F.posexplode("code").alias("t", "key")).withColumn("guest", F.lit(False))
    placed = home
    if radius:
        flips = F.expr("filter(sequence(0, width - 1), b -> (key & shiftleft(1, b)) <> 0)")
        sent = home.select(*coded.columns, "t", "key", F.explode(flips).alias("b")).withColumn("key", F.expr("key ^ shiftleft(1, b)")).drop("b").withColumn("guest", F.lit(True))
        placed = home.unionByName(sent)
    # At most tables * 2**width rows of a length.
    load = placed.groupBy("dim", "t", "key").agg(F.count("*").alias("load"), F.min("guest").alias("lonely")).where("load > 1 and not lonely").drop("lonely")
    load = stored(load, "loads")
    cut = placed.join(small(load), ["dim", "t", "key"])
    cut = cut.withColumn("blocks", F.ceil(F.col("load") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    second = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = cut.withColumn("other", second).select("dim", "t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "guest", "u", "v", "code")

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        dim, t, _, i, j = (k.as_py() for k in key)
        u = table.column("u").to_numpy()
        x = _unit(table.column("v"), dim)[1]
        code = np.asarray(table.column("code").combine_chunks().flatten()).reshape(len(u), -1)
        left = None if i == j else table.column("mine").to_numpy() == i
        guest = np.asarray(table.column("guest")) if radius else None
        return pa.Table.from_pandas(_local_links(u, x, code, t, cosine, left, guest, radius), schema=pa.schema([("u", pa.int64()), ("n", pa.int64()), ("mate", pa.int64())]), preserve_index=False)

    return rows, dealt.groupBy("dim", "t", "key", "i", "j").applyInArrow(judge, "u long, n long, mate long")


def deduplicate(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """All columns of ``vectors`` with n_links, component_id and kept; columns of these names are replaced."""
    rows, links = _links(vectors, id_col, vec_col, **options)
    found = stored(links, "vector-links")
    counts = found.groupBy("u").agg(F.sum("n").alias("n_links"))
    classes = components(found.where("u <> mate").select(F.col("u").alias("a"), F.col("mate").alias("b")))
    numbered = rows.select("u", "id", F.xxhash64("v").alias("hash")).join(counts, "u")
    linked = stored(numbered.join(classes.withColumnRenamed("node", "u"), "u"), "vector-classes")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    # Rows of equal id and vector have equal links.
    named = linked.join(small(least), "component").groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.max("n_links").alias("__n"), F.min("least").alias("__least"))
    given = vectors.select(*[c for c in vectors.columns if c not in ("n_links", "component_id", "kept")])
    own = F.col(id_col).cast("long")
    out = given.join(named, (own == F.col("__id")) & (F.xxhash64(vec_col) == F.col("__hash")), "left")
    component = F.coalesce("__least", own)
    return out.select(*given.columns, F.coalesce("__n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == own, F.lit(True)).alias("kept"))


def op1_embedding_dedup(vectors: DataFrame) -> DataFrame:
    """The contract's digest: vec_id, n_links, component_id, kept."""
    return deduplicate(vectors.select("vec_id", "embedding")).drop("embedding")


OP1_SQL = r"""
WITH RECURSIVE n AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (
  SELECT rid, e FROM n WHERE e IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.rid AS x, b.rid AS y FROM v a JOIN v b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(x, y) AS (
  SELECT rid, rid FROM n UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), cls AS (SELECT r.x, min(n.vec_id) AS component_id FROM reach r JOIN n ON n.rid = r.y GROUP BY r.x),
deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT n.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, coalesce(n.vec_id = c.component_id, true) AS kept
FROM n JOIN cls c ON c.x = n.rid LEFT JOIN deg d ON d.x = n.rid
"""
