"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct ``size``-word shingles; two documents
link when 100 * |A and B| >= percent * |A or B|.  The join returns connected
classes; it never needs every pair of a class.

1. *Order.*  Document frequencies of all shingles are summed in a fixed-size
   sketch.  It only decides the order of shingles (rare ones first, then by
   hash); any common order gives exact results.
2. *Lists.*  A document of n shingles that links with another shares at least
   ceil(n * percent / 100) of them, so its first n - ceil(...) + 1 shingles in
   that order meet those of the partner.  Only these are posted in inverted
   lists: they are the short ones.  The lists behind that prefix, the long ones
   of a corpus, are set aside as DivideSkip does, and only probed.  Shingles of
   one distinct set are left out after one count by partial aggregation.  Equal
   sets are one node, named by a hash of the set.
3. *Hubs.*  Long lists of near copies would emit the square of their length.
   So first the index holds only one hub of each list, the set in most
   lists; sets joined to a hub need no further comparison with each
   other.  Merging lists of one member is counting, which the aggregation does.
   A set in too few lists to reach the overlap with any size present in a list
   leaves it.
4. *Search.*  Then every set asks the lists of all other classes, so no link
   between classes is lost.  Its lists are joined to it as sorted arrays, cut
   into the same ranges of members, and ``divide_skip`` finds in each range the
   members in at least T of them: the longest lists are put aside, the others
   merged by a heap that skips, and what reaches T without them is looked up in
   these by binary search.  T is the least number of common prefix shingles that
   any size present would need.
   Tables by shingle grow with the corpus and are never broadcast.
5. *Probing.*  A found pair is kept if its count and the most that the lists
   behind the prefixes could add reach the overlap of its sizes; then its
   shingles are looked up in the sorted set of the partner (whether a member is
   on a long list is whether its set holds that shingle), and the pair links if
   the required overlap is reached.

Defined cases: a null text or one without words has an empty set, links with
nothing and is its own class; fewer words than ``size`` are one shingle.
Repeated rows have equal sets and share a class.  A null id never names a class
while another id is in it.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import _text
from termloom.llm._components import components
from termloom.llm._store import BROADCAST_ROWS, merged, small, stored
from termloom.llm.substring_dedup import BLOOM_BITS, _in_bloom, bloom

U64 = np.uint64
SIZE, PERCENT = 5, 75
CELL_BITS, BLOCKS = 18, 16
#: Lists are merged in full once their open pairs are at most this many for each row.
MERGE_FACTOR = 8
#: A further round of hubs follows only one that left at most this share of the open pairs.
HELPED = 0.8
#: Weight of a binary search against a step of the merge, and members of all lists that one search holds.
PROBE_WEIGHT, SEARCH_ROWS = 0.1, 1 << 18
#: Members of a list in one row, and members of a class in a list from which on they have rows of their own.
ROW_MEMBERS, OWN_ROWS = 128, 32
_shingle_poly = _text.Poly(41)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    start, end, before = _text.words(raw, offs)
    hashes = _text.word_hashes(raw, start, end, lower=True)
    prefix = _shingle_poly.prefix(hashes)
    grams = _shingle_poly.windows(prefix, size)
    count = np.diff(before)
    out = []
    for k in range(len(offs) - 1):
        n, at = count[k], before[k]
        if n >= size:
            s = np.sort(grams[at : at + n - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(_shingle_poly.ranges(prefix, np.array([at]), np.array([at + n])))
        else:
            out.append(np.zeros(0, U64))
    return out


def _name(s: np.ndarray) -> int:
    """A hash of the set that does not depend on its order."""
    with np.errstate(over="ignore"):
        total = _text.mix(s + U64(0x9E3779B97F4A7C15)).sum(dtype=U64)
        return int(_text.mix(np.array([total + U64(len(s))]))[0].view(np.int64))


def _scan(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (id, rid, sig, n) of the documents, and the blocks (block, cells) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            sig, count = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, raw, offs in _text.pieces(batch.column(2)):
                sets = shingle_sets(raw, offs, size)
                sig[lo:hi], count[lo:hi] = [_name(s) for s in sets], [len(s) for s in sets]
                every = np.concatenate(sets)
                cells += np.bincount((every >> U64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)).astype(np.int32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sig), pa.array(count), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if cells.any():
            parts = [x.tobytes() for x in np.split(cells, BLOCKS)]
            empty = pa.nulls(BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, id_type), empty, empty, empty, pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(parts, pa.binary())], names)

    names = ["id", "rid", "sig", "n", "block", "cells"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    id_type = pa.int64()
    return stored(_text.mapped(rows, run, "id long, rid long, sig long, n long, block int, cells binary"), "shingle-scan")


def _ranks(scan: DataFrame) -> np.ndarray:
    """A rank class for every cell of the sketch, 0 for shingles of usual frequency; 256 KB."""

    def total(key: tuple, table: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in table.column("cells"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    blocks = scan.where("block is not null").select("block", "cells")
    # Partial sums by chance of a task keep a group at a few blocks for each.
    first = blocks.withColumn("part", F.pmod(F.xxhash64("cells"), F.lit(8)).cast("int"))

    def partial(key: tuple, table: pa.Table) -> pa.Table:
        cells = np.zeros((1 << CELL_BITS) // BLOCKS, np.int64)
        for x in table.column("cells"):
            cells += np.frombuffer(x.as_py(), np.int32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([np.minimum(cells, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    # 16 blocks, in 8 parts at most.
    some = merged(first.groupBy("block", "part").applyInArrow(partial, "block int, cells binary"), 8 * BLOCKS)
    summed = merged(some.groupBy("block").applyInArrow(total, "block int, cells binary"), BLOCKS)
    cells = np.zeros((BLOCKS, (1 << CELL_BITS) // BLOCKS))
    for r in summed.collect():
        cells[r["block"]] = np.frombuffer(r["cells"], np.int64)
    flat = cells.ravel()
    mean = max(flat.mean(), 1.0)
    return np.log2(1 + np.maximum(0, flat - mean) / (0.25 * mean + 32)).astype(np.uint8)


def _prefixes(docs: DataFrame, ranks, text_col: str, size: int, percent: int, known=None, bits: int = 0) -> DataFrame:
    """Postings (h, sig, n, s) of the prefixes; with a Bloom filter ``known``, only of shingles in it.

    s is the number of postings of the set: at least that of its lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = ranks.value, set()
        for batch in batches:
            for _, _, raw, offs in _text.pieces(batch.column(0)):
                heads, names, counts = [], [], []
                for s in shingle_sets(raw, offs, size):
                    n = len(s)
                    if not n:
                        continue
                    name = _name(s)
                    if name in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(name)
                    p = n - (n * percent + 99) // 100 + 1
                    cls = rank[(s >> U64(64 - CELL_BITS)).astype(np.int64)]
                    head = s[:p] if not cls.any() else s[np.lexsort((s, cls))[:p]]
                    heads.append(head if known is None else head[_in_bloom(known.value, head, bits)])
                    names.append(name)
                    counts.append(n)
                if heads:
                    of = np.array([len(x) for x in heads])
                    columns = [pa.array(_text.signed(np.concatenate(heads))), pa.array(np.repeat(np.array(names, np.int64), of)), pa.array(np.repeat(np.array(counts, np.int32), of)), pa.array(np.repeat(of, of).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "sig", "n", "s"])

    return _text.mapped(docs.select(text_col), run, "h long, sig long, n int, s int")


def _lists(docs: DataFrame, ranks: np.ndarray, text_col: str, size: int, percent: int) -> DataFrame:
    """Inverted lists (h, sig, n, s, m, n0, n1) over the prefixes, lists of one set left out.

    s is at least the number of lists a set is in, m at least the length of the
    list, n0 and n1 are the sizes of its smallest and largest set.
    """
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(ranks)
    every = _prefixes(docs, rank, text_col, size, percent)
    shared = every.groupBy("h").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("m"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    shared = stored(shared.where("lo <> hi").select("h", F.least("m", F.lit(2**31 - 1)).cast("int").alias("m"), "n0", "n1"), "shared-shingles")
    count, rows = shared.agg(F.count("*"), F.sum(F.col("m").cast("long"))).first()
    bits = min(BLOOM_BITS, max(12, (16 * count).bit_length()))
    known = spark.sparkContext.broadcast(bloom(shared.select(F.col("h").alias("fp")), bits))
    # The filter keeps most single shingles from the shuffle, the join the rest.
    found = _prefixes(docs, rank, text_col, size, percent, known, bits).join(shared, "h").select("h", "sig", "n", "s", "m", "n0", "n1")
    return stored(merged(found.dropDuplicates(["h", "sig"]), rows or 0), "shingle-lists")


def divide_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(member, number of lists) of all members that are in at least ``need`` of the sorted lists.

    The longest lists are set aside.  The others are merged by a heap; a member
    that cannot reach what is needed without the long lists is skipped, along
    with all smaller ones, by binary search.  Those left are looked up in the
    long lists.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < need:
        return []
    aside = min(need - 1, int(need / (PROBE_WEIGHT * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    need_short = need - aside
    at = [0] * len(short)
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= need_short:
        member, taken = heap[0][0], []
        while heap and heap[0][0] == member:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= need_short:
            count = len(taken)
            for k, x in enumerate(long):
                if count + len(long) - k < need:
                    break
                i = bisect_left(x, member)
                count += i < len(x) and x[i] == member
            if count >= need:
                out.append((member, count))
            target = member + 1
        else:
            while heap and len(taken) < need_short - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for k in taken:
            at[k] = bisect_left(short[k], target, at[k])
            if at[k] < len(short[k]):
                heapq.heappush(heap, (short[k][at[k]], k))
    return out


def _needed(n: int, m: int, percent: int) -> int:
    """Least number of common prefix shingles of linked sets of n and m shingles."""
    part = lambda x: -(-x * percent // 100)
    return -(-percent * (n + m) // (100 + percent)) - max(part(n), part(m)) + 1


def _asked(n: int, lists: list[list[int]], sizes: dict[int, int], percent: int) -> list[tuple[int, int, int]]:
    """(member, its size, common lists) of the members that may link with a set of n shingles."""
    fits = [m for m in set(sizes.values()) if percent * max(n, m) <= 100 * min(n, m)]
    if not fits:
        return []
    need = max(1, min(_needed(n, m, percent) for m in fits))
    found = ((b, sizes[b], c) for b, c in divide_skip(lists, need))
    return [(b, m, c) for b, m, c in found if percent * max(n, m) <= 100 * min(n, m) and c >= _needed(n, m, percent)]


def _enough(percent: int, shared):
    """Whether ``shared`` common prefix shingles leave the required overlap possible (columns a_n, b_n).

    Behind the prefix that ends first lie at most ceil(n * percent / 100) - 1 shingles.
    """
    need = lambda n: F.ceil(F.col(n) * percent / 100)
    rest = F.greatest(need("a_n"), need("b_n")) - 1
    return ((100 + percent) * (shared + rest) >= percent * (F.col("a_n") + F.col("b_n"))) & (percent * F.greatest("a_n", "b_n") <= 100 * F.least("a_n", "b_n"))


def _hub_pairs(open_: DataFrame, rank, percent: int) -> DataFrame:
    """Pairs (a, b) of the hub of a list and a set of another class in it that may link."""
    hubs = open_.groupBy("h").agg(F.max(F.struct(rank.alias("d"), "sig", "n", "class")).alias("hub")).select("h", F.col("hub.sig").alias("a"), F.col("hub.n").alias("a_n"), F.col("hub.class").alias("a_class"))
    met = open_.select("h", F.col("sig").alias("b"), F.col("n").alias("b_n"), "class").join(hubs, "h").where("class <> a_class")
    return met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.count("*").alias("c")).where(_enough(percent, F.col("c"))).select("a", "b")


def _search(open_: DataFrame, large: DataFrame, heavy: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different classes in ``open_`` (h, sig, n, s, class) that may link.

    ``large`` (h, class, own) names the large classes of a list; ``heavy`` bounds
    the members of all lists of one set.  Every member lies in
    one of ``parts`` ranges, and a search is made for each range, so none holds
    many more than ``SEARCH_ROWS`` members.  The set with the smaller name asks.
    """
    parts = max(1, -(-heavy // SEARCH_ROWS))
    in_range = open_.withColumn("part", F.pmod(F.xxhash64("sig"), F.lit(parts)).cast("int"))
    # A large class has rows of its own, which its members never ask.
    marked = in_range.join(large, ["h", "class"], "left")
    lists = marked.groupBy("h", "own", "part").agg(F.array_sort(F.collect_list(F.struct("sig", "n", "s", "class"))).alias("x"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / ROW_MEMBERS).cast("int"))).alias("c")
    lists = lists.select("h", "own", "part", "x", chunk).select("h", "own", "part", F.slice("x", F.col("c") * ROW_MEMBERS + 1, F.lit(ROW_MEMBERS)).alias("x"))
    asks = open_.select("h", "sig", "n", F.col("s").alias("a_s"), "class")
    met = asks.join(lists, "h").where(F.col("own").isNull() | (F.col("own") != F.col("class")))

    def may(m):
        n, need = F.col("n"), lambda c: F.ceil(c * percent / 100)
        rest = F.greatest(need(n), need(m["n"])) - 1
        sizes_fit = percent * F.greatest(n, m["n"]) <= 100 * F.least(n, m["n"])
        return (m["sig"] > F.col("sig")) & (m["class"] != F.col("class")) & sizes_fit & ((100 + percent) * (F.least(F.col("a_s"), m["s"]) + rest) >= percent * (n + m["n"]))

    some = met.select("sig", "part", "n", F.filter("x", may).alias("x")).where(F.size("x") > 0)
    joined = some.select("sig", "part", "n", F.col("x.sig").alias("members"), F.col("x.n").alias("sizes"))
    dealt = joined.repartition("sig", "part").sortWithinPartitions("sig", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, lists, sizes, out = None, 0, [], {}, []

        def answer() -> None:
            out.extend((now[0], b) for b, _, _ in _asked(n, lists, sizes, percent))

        for batch in batches:
            sig, part, count = (batch.column(k).to_numpy() for k in range(3))
            members, of = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            ends = np.cumsum(np.asarray(batch.column(3).value_lengths()))
            first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])])
            cuts = [*np.flatnonzero(first).tolist(), len(sig)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if now != (sig[lo], part[lo]):
                    if now is not None:
                        answer()
                    now, n, lists, sizes = (int(sig[lo]), int(part[lo])), int(count[lo]), [], {}
                begin = int(ends[lo - 1]) if lo else 0
                span = members[begin : int(ends[hi - 1])].tolist()
                sizes.update(zip(span, of[begin : int(ends[hi - 1])].tolist(), strict=True))
                marks = [0, *(ends[lo:hi] - begin).tolist()]
                new = [span[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
                lists += new
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if now is not None:
            answer()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return _text.mapped(dealt, run, "a long, b long")


def _verified(docs: DataFrame, scan: DataFrame, pairs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by binary probing of whole sets."""
    most = 2 * pairs.count()
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))
    wanted = F.broadcast(wanted) if most <= BROADCAST_ROWS else wanted.distinct()
    reps = scan.where("n > 0").join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("rid").alias("rid")).select("rid")
    reps = stored(merged(reps, most), "candidates")
    rows = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text")).join(small(reps), "rid", "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offs in _text.pieces(batch.column(0)):
                found = [s for s in shingle_sets(raw, offs, size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["sig", "items"])

    known = _text.mapped(rows, sets, "sig long, items binary").groupBy("sig").agg(F.first("items").alias("items"))
    left = known.select(F.col("sig").alias("a"), F.col("items").alias("x"))
    right = known.select(F.col("sig").alias("b"), F.col("items").alias("y"))
    # Rows of two whole sets: a task for every hundredth of what narrow rows have.
    met = merged(pairs.select("a", "b").join(right, "b"), 50 * most)
    both = merged(met.join(left, "a").select("a", "b", "x", "y"), 50 * most)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                common = int((v[at] == u).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return stored(_text.mapped(both, probe, "a long, b long"), "links")


def _labelled(lists: DataFrame, links: DataFrame | None) -> DataFrame:
    """``lists`` with ``class``: a set that a row's set is known to link with, or itself."""
    if links is None:
        return lists.withColumn("class", F.col("sig"))
    hub = links.groupBy(F.col("b").alias("sig")).agg(F.min("a").alias("class"))
    return lists.join(hub, "sig", "left").withColumn("class", F.coalesce("class", "sig"))


def _reaching(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of lists that could reach the overlap with some size in their list.

    A set that shares all its lists with a partner of its own size may still be
    too small; then only much larger or smaller partners remain, and the sizes
    present in the list tell whether there are any.
    """
    part, keep = percent / (100 + percent), percent / 100
    larger = (part * F.col("n") - F.col("s")) / (keep - part)
    smaller = (F.col("s") + (keep - part) * F.col("n")) / part
    return rows.where((F.col("n1") + 1 >= larger) | (F.col("n0") - 1 <= smaller))


def _open(lists: DataFrame, links: DataFrame | None, percent: int) -> DataFrame:
    """Rows of ``lists`` in lists of several classes that could still link, with ``class``."""
    if links is None:
        return _reaching(lists.withColumn("class", F.col("sig")), percent)
    labelled = _labelled(lists, links)
    spread = labelled.groupBy("h").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1").select("h")
    return _reaching(labelled, percent).join(spread, "h", "left_semi")


def _classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, merge_factor: int = MERGE_FACTOR, max_hub_rounds: int = 3) -> DataFrame:
    """(id, rid, n_shingles, component, class): as ``link_classes``; ``class`` is a set of the class, null for empty sets."""
    scan = _scan(docs, id_col, text_col, size)
    lists = _lists(docs, _ranks(scan), text_col, size, percent)
    rows = lists.count()
    links, fresh, turn, before = None, 1, 0, math.inf
    while True:
        open_ = stored(merged(_open(lists, links, percent), rows), "open-lists")
        if turn:
            per = stored(merged(open_.groupBy("h", "class").agg(F.count("*").alias("k")), rows), "class-sizes")
            cross = merged(per.groupBy("h").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("x")), rows).agg(F.sum("x")).first()[0] or 0
            if turn >= max_hub_rounds or not fresh or cross <= merge_factor * rows or cross > HELPED * before:
                break
            before = cross
        # The set in most lists leads a list; later rounds draw by hash.
        rank = F.col("s").cast("long") if turn == 0 else F.xxhash64("sig", F.lit(turn))
        new = _verified(docs, scan, stored(merged(_hub_pairs(open_, rank, percent), rows), "pairs"), id_col, text_col, size, percent)
        fresh = new.count()
        links = new if links is None else links.unionByName(new)
        turn += 1
    large = per.where(F.col("k") >= OWN_ROWS).select("h", "class", F.col("class").alias("own"))
    heavy = merged(open_.groupBy("sig").agg(F.sum(F.col("m").cast("long")).alias("w")), rows).agg(F.max("w")).first()[0] or 0
    links = links.unionByName(_verified(docs, scan, stored(_search(open_, large, heavy, percent), "pairs"), id_col, text_col, size, percent))
    classes = components(links).select(F.col("node").alias("sig"), "component")
    nodes = scan.where("rid is not null")
    full = nodes.where("n > 0").join(classes, "sig", "left").withColumn("class", F.coalesce("component", "sig")).drop("component")
    least = full.groupBy("class").agg(F.min("id").alias("component"))
    whole = full.join(least, "class").select("id", "rid", F.col("n").alias("n_shingles"), "component", "class")
    return whole.unionByName(nodes.where("n = 0").select("id", "rid", F.col("n").alias("n_shingles"), F.col("id").alias("component"), F.lit(None).cast("long").alias("class")))


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, rid, n_shingles, component): the class of every row.

    ``rid`` is xxhash64 of id and text; ``component`` is the smallest id of the class.
    """
    return _classes(docs, id_col, text_col, **options).drop("class")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with all columns: one whose id names the class.

    A class without ids keeps a row too.  Of rows with equal id and text one
    stays, the first by a hash of all columns; rows without words and without
    id are different documents and all stay.
    """
    chosen = _classes(docs, id_col, text_col, **options).where(F.col("id").eqNullSafe(F.col("component")))
    # Counted by row first: a class may hold one row many times.
    times = chosen.groupBy("class", F.col("rid").alias("__rid")).agg(F.count("*").alias("n"), F.max("id").alias("id"))
    whole = times.where("class is not null").groupBy("class").agg(F.min(F.struct("__rid", "n")).alias("x")).select("x.__rid", (F.col("x.n") > 1).alias("__again"))
    one = stored(whole.unionByName(times.where("class is null").select("__rid", ((F.col("n") > 1) & F.col("id").isNotNull()).alias("__again"))), "kept")
    keyed = docs.withColumn("__rid", F.xxhash64(id_col, text_col))
    single = keyed.join(small(one.where("not __again").select("__rid")), "__rid", "left_semi").drop("__rid")
    if one.where("__again").isEmpty():
        return single
    again = keyed.join(small(one.where("__again").select("__rid")), "__rid", "left_semi")
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    # An aggregate keeps one row of each task before the shuffle.
    first = again.groupBy("__rid").agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return single.unionByName(first)


def op9_ngram_join(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n_shingles, component_id."""
    found = link_classes(docs.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT rid, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d
), sh AS MATERIALIZED (
  SELECT DISTINCT rid, s FROM (
    SELECT rid, i, n, array_to_string(list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS s FROM w)
  WHERE i + 4 <= n OR (i = 1 AND n < 5)
), size AS (SELECT rid, count(*) AS k FROM sh GROUP BY rid),
link AS MATERIALIZED (
  SELECT p.x, p.y FROM (
    SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2) p
  JOIN size u ON u.rid = p.x JOIN size v ON v.rid = p.y WHERE 100 * c >= 75 * (u.k + v.k - c)
), reach(x, y) AS (
  SELECT rid, rid FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
)
SELECT d.doc_id, coalesce(any_value(s.k), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach r ON r.x = d.rid JOIN d o ON o.rid = r.y LEFT JOIN size s ON s.rid = d.rid GROUP BY d.rid, d.doc_id
"""
