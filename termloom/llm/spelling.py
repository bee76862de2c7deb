"""Spelling variants: words one edit apart, grouped by their most frequent forms.

Words are runs of letters; every occurrence whose hash falls on a fixed residue
has one code point deleted first, which plants misspellings.  Words that are long
and frequent enough are sorted and dealt into shards, each a compact trie: a node
that holds one word only keeps the word instead of a chain of children.  A shard
has at most ``SHARD_WORDS`` words and about ``SHARD_BYTES`` bytes; a single
longer word is a shard of its own.

All words, in blocks, meet every shard that they can reach: the automaton of all
strings one insertion, deletion or replacement away is run on the prefix that the
shard's words share, and dies there or not.  Where it lives, a worker intersects
the automata of the block's words with the trie, depth-first: a stack holds sets
of (word, place in the word, edit made or not, node), numpy advances one set at a
time, so memory follows the depth of the trie and not the number of paths.
Accepting states are near words; each block hands on, for each word, their number
and the best.  Shards of a measured size are broadcast to the blocks, larger ones
are joined on the shard's number.

Roots come by pointer jumping over words that have a form.  A form has at least
twice the occurrences, so chains are no longer than the logarithm of the largest
count; a word whose pointer is at a root leaves the loop, so no root becomes a
hot key.

Code points of words are below U+0100, so a word is one byte for each of them in
Latin-1, and the order of these bytes is the code-point order.

Defined cases: a null text has no words, a null id is hashed as an empty string.
Repeated rows count each.  Of near words equally frequent the smallest in
code-point order is the form.  An empty table, or one without such words, gives
an empty table.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import _text
from termloom.llm._store import forget, small, stored

#: Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One occurrence in so many is misspelt.
MISSPELT = 97
#: A form has at least so many times the occurrences of its variant.
FACTOR = 2
#: Most words and bytes of a shard, words of a block, states in a set of the stack.
SHARD_WORDS, SHARD_BYTES, BLOCK, STATES = 1 << 18, 4 << 20, 1 << 15, 1 << 20
#: Words that a counting task keeps before it hands them on.
KEPT = 1 << 19

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _misspelt(run: bytes, h: int) -> bytes:
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all whole texts, planted misspellings included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, raw, offs in _text.pieces(batch.column(1)):
                data, edges = bytes(raw), offs.tolist()
                for k in range(hi - lo):
                    seed = crc32(f"{'' if ids[lo + k] is None else ids[lo + k]}:".encode())
                    for x in _RUN.finditer(data[edges[k] : edges[k + 1]].lower()):
                        word = x[0]
                        h = crc32(word, seed)
                        if not h % MISSPELT:
                            word = _misspelt(word, h)
                        total[word] = total.get(word, 0) + 1
                    if len(total) > KEPT:
                        yield out()
                        total.clear()
        if total:
            yield out()

    parts = _text.mapped(docs.select(F.col(id_col).cast("string"), text_col), run, "word string, n long")
    return parts.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Sorted Latin-1 words and the nodes above them.

    A node is a range of words with a common prefix.  Nodes of more than one word
    have their children side by side, by label; a node of one word is a leaf, and
    what is left of its word is read from the word itself.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        size = np.diff(offs)
        n = len(size)
        label, depth, low, count, child, kids = ([] for _ in range(6))
        at, now_low, now_n, now_label, deep = 0, np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n), np.zeros(min(n, 1), np.uint8), 0
        while len(now_low):
            label.append(now_label)
            depth.append(np.full(len(now_low), deep, np.int32))
            low.append(now_low)
            count.append(now_n)
            open_ = now_n > 1
            # Words of open nodes that go on after this depth; a word that ends here is the first of its node.
            words = np.repeat(now_low[open_], now_n[open_]) + _within(now_n[open_])
            of = np.repeat(np.flatnonzero(open_), now_n[open_])
            on = size[words] > deep
            words, of = words[on], of[on]
            byte = data[offs[words] + deep]
            new = np.ones(len(words), bool)
            new[1:] = (of[1:] != of[:-1]) | (byte[1:] != byte[:-1])
            first = np.flatnonzero(new)
            begin = np.zeros(len(now_low), np.int64)
            many = np.bincount(of[first], minlength=len(now_low))
            begin[:] = at + len(now_low) + np.cumsum(many) - many
            child.append(begin)
            kids.append(many)
            at += len(now_low)
            now_low, now_label, deep = words[first], byte[first], deep + 1
            now_n = np.diff(np.append(first, len(words)))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.label, self.depth, self.low, self.count = join(label, np.uint8), join(depth, np.int32), join(low, np.int32), join(count, np.int32)
        self.child, self.kids = join(child, np.int32), join(kids, np.int32)
        # The word that ends at an inner node, or -1.
        self.ends = np.where((self.count > 1) & (size[self.low] == self.depth), self.low, -1) if n else self.low


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive ranges of these sizes."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.arange(len(first)) - first


def _tails_equal(a: np.ndarray, a_at: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the bytes a[a_at:a_end] and b[b_at:b_end] are equal, for many ranges."""
    same = a_end - a_at == b_end - b_at
    left, k = np.flatnonzero(same), 0
    while len(left):
        left = left[a_at[left] + k < a_end[left]]
        equal = a[a_at[left] + k] == b[b_at[left] + k]
        same[left[~equal]] = False
        left, k = left[equal], k + 1
    return same


def _common(a: np.ndarray, a_at: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Length of the common prefix of many pairs of ranges."""
    out = np.zeros(len(a_at), np.int64)
    left = np.flatnonzero((a_at < a_end) & (b_at < b_end))
    while len(left):
        left = left[a[a_at[left] + out[left]] == b[b_at[left] + out[left]]]
        out[left] += 1
        left = left[(a_at[left] + out[left] < a_end[left]) & (b_at[left] + out[left] < b_end[left])]
    return out


def near(trie: Trie, data: np.ndarray, offs: np.ndarray, states: int = STATES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word of the block, word of the shard) pairs exactly one edit apart, some at a time.

    A pair may be emitted more than once where edits of equal letters meet in the
    same word; callers keep distinct pairs.
    """
    end = offs[1:]
    n = len(end)
    if not n or not len(trie.low):
        return
    stack = [(np.arange(lo, min(lo + BLOCK, n)), offs[lo : min(lo + BLOCK, n)].copy(), np.zeros(min(lo + BLOCK, n) - lo, bool), np.zeros(min(lo + BLOCK, n) - lo, np.int64)) for lo in range(0, n, BLOCK)][::-1]
    while stack:
        word, at, edited, node = stack.pop()
        if len(word) > states:
            half = len(word) // 2
            stack.append((word[half:], at[half:], edited[half:], node[half:]))
            word, at, edited, node = word[:half], at[:half], edited[:half], node[:half]
        leaf = trie.count[node] == 1
        if leaf.any():
            yield from _leaves(trie, data, end, word[leaf], at[leaf], edited[leaf], node[leaf])
            word, at, edited, node = (x[~leaf] for x in (word, at, edited, node))
        if not len(word):
            continue
        # A word that ends at this node accepts an edited word read to its end, or deletes the last letter.
        here = trie.ends[node]
        left = end[word] - at
        done = (here >= 0) & np.where(edited, left == 0, left == 1)
        if done.any():
            yield word[done], here[done].astype(np.int64)
        found = []
        whole = np.flatnonzero(~edited)
        # Deletion of the letter: stay at the node.
        cut = whole[left[whole] > 0]
        found.append((word[cut], at[cut] + 1, np.ones(len(cut), bool), node[cut]))
        # Every child of an unedited state: the same letter goes on unedited, others replace; each may be inserted.
        many = trie.kids[node[whole]]
        of = np.repeat(whole, many)
        kid = np.repeat(trie.child[node[whole]], many) + _within(many)
        more = left[of] > 0
        same = np.zeros(len(of), bool)
        same[more] = trie.label[kid[more]] == data[at[of[more]]]
        found.append((word[of[same]], at[of[same]] + 1, np.zeros(int(same.sum()), bool), kid[same].astype(np.int64)))
        swap = more & ~same
        found.append((word[of[swap]], at[of[swap]] + 1, np.ones(int(swap.sum()), bool), kid[swap].astype(np.int64)))
        found.append((word[of], at[of], np.ones(len(of), bool), kid.astype(np.int64)))
        # An edited state goes on by its own letter alone, found by bisection among the sorted children.
        rest = np.flatnonzero(edited & (left > 0))
        if len(rest):
            letter = data[at[rest]]
            lo, hi = trie.child[node[rest]].astype(np.int64), (trie.child[node[rest]] + trie.kids[node[rest]]).astype(np.int64)
            stop = hi.copy()
            while (lo < hi).any():
                mid = np.minimum((lo + hi) >> 1, len(trie.label) - 1)
                right = (lo < hi) & (trie.label[mid] < letter)
                lo, hi = np.where(right, mid + 1, lo), np.where((lo < hi) & ~right, mid, hi)
            hit = (lo < stop) & (trie.label[np.minimum(lo, len(trie.label) - 1)] == letter)
            found.append((word[rest[hit]], at[rest[hit]] + 1, np.ones(int(hit.sum()), bool), lo[hit]))
        joined = tuple(np.concatenate(x) for x in zip(*found, strict=True))
        if len(joined[0]):
            stack.append(joined)


def _leaves(trie: Trie, data: np.ndarray, end: np.ndarray, word: np.ndarray, at: np.ndarray, edited: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Judge states at leaves by the rest of both words."""
    own = trie.low[node].astype(np.int64)
    b_at, b_end = trie.offs[own] + trie.depth[node], trie.offs[own + 1]
    stop = end[word]
    ok = np.zeros(len(word), bool)
    e = np.flatnonzero(edited)
    ok[e] = _tails_equal(data, at[e], stop[e], trie.data, b_at[e], b_end[e])
    u = np.flatnonzero(~edited & (np.abs((stop - at) - (b_end - b_at)) <= 1))
    c = _common(data, at[u], stop[u], trie.data, b_at[u], b_end[u])
    x, y = at[u] + c, b_at[u] + c
    a_left, b_left = stop[u] - x, b_end[u] - y
    for da, db in ((1, 1), (1, 0), (0, 1)):
        can = np.flatnonzero((a_left >= da) & (b_left >= db) & (a_left - da == b_left - db))
        ok[u[can]] |= _tails_equal(data, x[can] + da, stop[u[can]], trie.data, y[can] + db, b_end[u[can]])
    if ok.any():
        yield word[ok], own[ok]


def _packed(words: list[bytes]) -> tuple[bytes, bytes]:
    """Words one after another, and their ends as 64-bit integers."""
    return b"".join(words), np.cumsum([0, *map(len, words)], dtype=np.int64).tobytes()


def _unpacked(data: bytes, offs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.uint8), np.frombuffer(offs, np.int64)


def _latin(column: pa.Array) -> list[bytes]:
    return [x.encode("latin-1") for x in column.to_pylist()]


def shards(words: DataFrame, size: int = SHARD_WORDS, most: int = SHARD_BYTES) -> DataFrame:
    """(shard, prefix, data, offs, n) of (word, n): sorted words dealt into shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[bytes] = []
        counts: list[int] = []
        held = 0

        def out() -> pa.RecordBatch:
            a, b = now[0], now[-1]
            k = 0
            while k < min(len(a), len(b), 64) and a[k] == b[k]:
                k += 1
            data, offs = _packed(now)
            row = [[f"{crc32(a)}-{a[:32].decode('latin-1')}-{len(now)}-{crc32(data)}"], [a[:k]], [data], [offs], [np.array(counts, np.int64).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), *(pa.array(x, pa.binary()) for x in row[1:])], ["shard", "prefix", "data", "offs", "n"])

        for batch in batches:
            for word, n in zip(_latin(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if now and (len(now) >= size or held + len(word) > most):
                    yield out()
                    now, counts, held = [], [], 0
                now.append(word)
                counts.append(n)
                held += len(word)
        if now:
            yield out()

    ordered = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return _text.mapped(ordered, run, "shard string, prefix binary, data binary, offs binary, n binary")


def reaches(data: np.ndarray, offs: np.ndarray, prefix: bytes) -> np.ndarray:
    """Whether the automaton of each word is alive after the prefix."""
    n, p = len(offs) - 1, np.frombuffer(prefix, np.uint8)
    at, stop, m = offs[:-1], offs[1:], len(p)
    zero, full = np.zeros(n, np.int64), np.full(n, m)
    c = _common(data, at, stop, p, zero, full)
    alive = c == m
    for da, db in ((1, 1), (1, 0), (0, 1)):
        k = np.flatnonzero(~alive & (stop - at >= c + da))
        rest = _common(data, at[k] + c[k] + da, stop[k], p, c[k] + db, full[k])
        # A word that runs out has no edit left for what remains of the prefix.
        alive[k[c[k] + db + rest >= m]] = True
    return alive


def _reduced(word: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, number of distinct others, the most frequent of these, the first of equals) of pairs."""
    pair = np.unique(word * len(n) + other)
    word, other = pair // len(n), pair % len(n)
    order = np.lexsort((other, -n[other], word))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return word[first], np.diff(np.append(first, len(word))), other[order][first]


def _neighbours(blocks: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of rows that pair a block with a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                shard, data, offs, counts, mine, mine_offs = (batch.column(i)[k].as_py() for i in range(6))
                if shard != known:
                    trie, known = Trie(*_unpacked(data, offs)), shard
                    n = np.frombuffer(counts, np.int64)
                words, ends = _unpacked(mine, mine_offs)
                got = list(near(trie, words, ends))
                if not got:
                    continue
                word, total, best = _reduced(*(np.concatenate(x) for x in zip(*got, strict=True)), n)
                text = [bytes(words[ends[w] : ends[w + 1]]).decode("latin-1") for w in word.tolist()]
                form = [bytes(trie.data[trie.offs[w] : trie.offs[w + 1]]).decode("latin-1") for w in best.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(total), pa.array(n[best]), pa.array(form, pa.string())], ["word", "n_near", "form_n", "form"])

    return _text.mapped(blocks, run, "word string, n_near long, form_n long, form string")


def neighbours(words: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, best_n, best) of distinct (word, n): number of near words and the most frequent of them."""
    tries = stored(shards(words, size), "trie-shards")
    edges = tries.select("shard", "prefix")
    # One row of at most 100 bytes for each shard.
    reach = words.sparkSession.sparkContext.broadcast([(r.shard, bytes(r.prefix)) for r in edges.collect()])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _latin(batch.column(0))
            for lo in range(0, len(every), BLOCK):
                data, offs = _unpacked(*_packed(every[lo : lo + BLOCK]))
                for shard, prefix in reach.value:
                    keep = np.flatnonzero(reaches(data, offs, prefix))
                    if len(keep):
                        mine = _packed([every[lo + k] for k in keep.tolist()])
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.string()), *(pa.array([x], pa.binary()) for x in mine)], ["shard", "mine", "mine_offs"])

    blocks = stored(_text.mapped(words.select("word"), deal, "shard string, mine binary, mine_offs binary"), "word-blocks")
    met = blocks.join(small(tries.drop("prefix")), "shard").select("shard", "data", "offs", "n", "mine", "mine_offs")
    parts = _neighbours(met).select("word", F.lit(None).cast("long").alias("n"), "n_near", "form_n", "form")
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    out = alone.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.form").alias("best"))


def roots(linked: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: the end of each chain of forms.

    A pointer of one round is that of the pointed word in the round before, so
    chains halve; rows whose pointer is a root are finished.
    """
    heads = linked.select(F.col("word").alias("form"), F.lit(False).alias("top"))
    now = linked.select("word", "form").join(small(heads), "form", "left").select("word", F.col("form").alias("root"), F.coalesce("top", F.lit(True)).alias("top"))
    finished, now = [], stored(now, "spelling-roots")
    while now.where(~F.col("top")).limit(1).count():
        finished.append(now.where("top").select("word", "root"))
        every = finished[0]
        for more in finished[1:]:
            every = every.unionByName(more)
        ahead = every.withColumn("top", F.lit(True)).unionByName(now.where(~F.col("top")).select("word", "root", "top"))
        ahead = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("top").alias("last"))
        now = stored(now.where(~F.col("top")).join(small(ahead), "root").select("word", F.col("next").alias("root"), F.col("last").alias("top")), "spelling-roots")
    out = now.where("top").select("word", "root")
    for more in finished:
        out = out.unionByName(more)
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: float = FACTOR, size: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words long and frequent enough."""
    words = stored(count_words(docs, id_col, text_col).where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "spelling-words")
    found = neighbours(words, size)
    better: Column = F.col("best_n") >= factor * F.col("n")
    table = stored(found.select("word", F.when(better, F.col("best")).alias("form"), "n", "n_near", F.when(better, F.col("best_n")).alias("form_n")), "spelling-forms")
    forget(words)
    ends = roots(table.where("form is not null").select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(docs: DataFrame) -> DataFrame:
    """The contract's rows: word, form, root, n, n_near, form_n."""
    return variants(docs.select("doc_id", "text"))


def _crc_table() -> list[int]:
    """Remainders of all bytes by the reflected polynomial of CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


_UPPER, _LOW = ("".join(chr(k + i) for i in range(26)) for k in (65, 97))
_BYTES = "flatten(list_transform(regexp_extract_all({0}, '.'), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))"
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {0}), lambda c, b: xor(c >> 8, CAST({1} AS BIGINT[])[(xor(c, b) & 255) + 1])))"
OP12_SQL = f"""WITH RECURSIVE run AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOW}') AS run FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, k, {_CRC.format(_BYTES.format("doc_id || ':' || run"), _crc_table())} AS h FROM run),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
del AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM del a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM del a JOIN words b ON a.d = b.word),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS n FROM near GROUP BY word),
linked AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * words.n THEN other END AS form, CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM linked UNION ALL SELECT walk.word, linked.form FROM walk JOIN linked ON linked.word = walk.root WHERE linked.form IS NOT NULL),
top AS (SELECT walk.word, walk.root FROM walk JOIN linked ON linked.word = walk.root WHERE linked.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN top USING (word)"""
