"""Many patterns at once: strings inside texts, and units of several words.

Strings are compiled into an automaton with failure links: from every state each
class of bytes leads to one state, so a text is read once, whatever the number of
patterns.  A batch of texts is cut into lanes that advance side by side in
numpy; a lane begins as many bytes early as the longest pattern needs.

Patterns are dealt into shards of bounded size; each is broadcast and meets all
texts in a pass of its own, so the number of passes is the size of the patterns
over ``SHARD_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termloom.operators.transducer import in_order

#: Bytes of patterns in a shard, and the length from which a pattern is looked up by itself.
SHARD_BYTES, LONG_PATTERN = 1 << 18, 1 << 12
#: Bytes of texts that are read at a time; a longer text is read alone.
PIECE_BYTES = 4 << 20
#: Lanes that a batch is cut into.
LANES = 4096


class Automaton:
    """Finds all occurrences of byte strings."""

    def __init__(self, patterns: list[bytes]):
        used = sorted(set(b"".join(patterns)))
        self.classes = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        accept = [-1]
        for k, pattern in enumerate(patterns):
            state = 0
            for c in self.classes[list(pattern)].tolist():
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                    accept.append(-1)
                state = children[state][c]
            accept[state] = k
        n = len(children)
        self.next = np.zeros((n, width), np.int32)
        self.accept = np.array(accept, np.int64)
        # The longest proper suffix that accepts, or 0.
        self.shorter = np.zeros(n, np.int32)
        fail = np.zeros(n, np.int32)
        level = [0]
        while level:
            deeper = []
            for state in level:
                row = self.next[fail[state]].copy() if state else self.next[0]
                for c, child in children[state].items():
                    fail[child] = row[c] if state else 0
                    deeper.append(child)
                for c, child in children[state].items():
                    row[c] = child
                self.next[state] = row
            for child in deeper:
                back = fail[child]
                self.shorter[child] = back if self.accept[back] >= 0 else self.shorter[back]
            level = deeper
        self.ends = (self.accept >= 0) | (self.shorter > 0)
        self.longest = max(map(len, patterns), default=1)

    def occurrences(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, pattern) of every occurrence, in no order."""
        rows = len(offs) - 1
        # Class 0 between rows leads back to the beginning.
        read = np.zeros(len(raw) + rows, self.classes.dtype)
        begin = offs[:-1] + np.arange(rows)
        inside = np.ones(len(read), bool)
        inside[offs[1:] + np.arange(rows)] = False
        read[inside] = self.classes[raw]
        if not len(read):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        early = self.longest - 1
        step = max(-(-len(read) // LANES), 4 * early, 64)
        lanes = -(-len(read) // step)
        padded = np.concatenate([np.zeros(early, read.dtype), read, np.zeros(lanes * step - len(read), read.dtype)])
        first = np.arange(lanes) * step
        state = np.zeros(lanes, np.int32)
        at, of = [], []
        for k in range(early + step):
            state = self.next[state, padded[first + k]]
            if k >= early:
                hit = np.flatnonzero(self.ends[state])
                if len(hit):
                    at.append(first[hit] + k - early)
                    of.append(state[hit])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, now = np.concatenate(at), np.concatenate(of)
        row = np.searchsorted(begin, place, "right") - 1
        got_row, got = [], []
        while len(now):
            own = self.accept[now] >= 0
            got_row.append(row[own])
            got.append(self.accept[now[own]])
            now = self.shorter[now]
            row, now = row[now > 0], now[now > 0]
        return np.concatenate(got_row), np.concatenate(got)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _shards(values: DataFrame, key: str, size: int) -> Iterator[list]:
    """The rows of a table of distinct values, some at a time: at most about ``size`` bytes of ``key``, rows of equal ``shard`` together."""
    held = values.agg(F.sum(F.octet_length(key) + 1)).first()[0] or 0
    shards = -(-held // size)
    for k in range(shards):
        yield values.where(F.pmod("shard", F.lit(shards)) == k).collect()


def hits(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern", keep: list[str] | None = None) -> DataFrame:
    """(keep, pattern): the patterns that each row's whole text holds, each once a row; null texts hold none.

    The empty pattern is in every text that is there.  Null patterns are left
    out.  Patterns of ``LONG_PATTERN`` bytes or more are few and meet the texts
    one by one in ``contains``.
    """
    keep = keep or []
    given = texts.select(*keep, F.col(text).alias("__text")).where("__text is not null")
    distinct = patterns.select(F.col(pattern).alias("pattern")).where("pattern is not null").distinct().withColumn("shard", F.xxhash64("pattern"))
    schema = StructType([*given.select(*keep).schema.fields, *StructType.fromDDL("pattern string").fields])
    long = distinct.where((F.octet_length("pattern") >= LONG_PATTERN) | (F.col("pattern") == ""))
    out = given.where(F.lit(False)).select(*keep, F.lit("").alias("pattern"))
    for r in long.select("pattern").toLocalIterator():
        out = out.unionByName(given.where(F.contains("__text", F.lit(r["pattern"]))).select(*keep, F.lit(r["pattern"]).alias("pattern")))
    for rows in _shards(distinct.where((F.octet_length("pattern") < LONG_PATTERN) & (F.col("pattern") != "")), "pattern", SHARD_BYTES):
        if not rows:
            continue
        shared = texts.sparkSession.sparkContext.broadcast(sorted(r["pattern"] for r in rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = shared.value
            machine = Automaton([w.encode() for w in words])
            names = pa.array(words, pa.string())
            for batch in batches:
                raw, offs = _buffers(batch.column(len(keep)))
                lo = 0
                while lo < len(batch):
                    hi = max(int(np.searchsorted(offs, offs[lo] + PIECE_BYTES, "right")) - 1, lo + 1)
                    row, which = machine.occurrences(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    pair = np.unique((row + lo) * len(words) + which)
                    if len(pair):
                        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(pair // len(words))) for k in range(len(keep))), names.take(pa.array(pair % len(words)))], [*keep, "pattern"])
                    lo = hi

        out = out.unionByName(given.mapInArrow(run, schema))
    return out


def trie_of(units: list[tuple[str, str | None]]) -> dict:
    """Nested tables by word; the key None holds the tags of the unit that ends there."""
    root: dict = {}
    for unit, tags in units:
        at = root
        for word in unit.split(" "):
            at = at.setdefault(word, {})
        at[None] = tags
    return root


def longest_unit(trie: dict, words: list[str], start: int) -> tuple[int, str | None]:
    """(words, tags) of the longest unit that begins at a place; 0 if there is none of two words or more.

    A word follows the arc of its own form, else of its lower case, else of that
    with a capital; there is no way back.
    """
    at, found, k = trie, (0, None), start
    while k < len(words):
        word = words[k]
        low = word.lower()
        arc = at.get(word)
        arc = at.get(low) if arc is None else arc
        arc = at.get(low[:1].upper() + low[1:]) if arc is None else arc
        if arc is None:
            break
        at, k = arc, k + 1
        if None in at and k - start > 1:
            found = (k - start, at[None])
    return found


def unit_matches(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """(req_no, pos, n, unit, tags): the longest unit at every place of each sequence (req_no, pos, term), or of arrays (req_no, items).

    ``units`` has ``unit``, words with single blanks, and may have ``tags``.
    Units of the same first word, whatever its case, are in one shard, and so
    are all arcs that a first word can follow.
    """
    tagged = units if "tags" in units.columns else units.withColumn("tags", F.lit(None).cast("string"))
    tagged = tagged.where("unit is not null and unit like '% %'").groupBy("unit").agg(F.min("tags").alias("tags"))
    tagged = tagged.withColumn("shard", F.xxhash64(F.lower(F.substring_index("unit", " ", 1))))
    rows = in_order(tokens, "term").select("req_no", F.col("items.pos").alias("ps"), F.col("items.term").alias("ws"))
    id_type = tokens.schema["req_no"]
    schema = StructType([id_type, *StructType.fromDDL("pos int, n int, unit string, tags string").fields])
    out = tokens.select("req_no", F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("tags")).where(F.lit(False))
    for some in _shards(tagged, "unit", SHARD_BYTES):
        shared = tokens.sparkSession.sparkContext.broadcast([(r["unit"], r["tags"]) for r in some])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = trie_of(shared.value)
            first = {w.lower() for w in trie}
            for batch in batches:
                found = []
                for k, (places, words) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    for start, word in enumerate(words):
                        if word.lower() in first:
                            n, tags = longest_unit(trie, words, start)
                            if n:
                                found.append((k, places[start], n, " ".join(words[start : start + n]), tags))
                if found:
                    row, pos, n, unit, tags = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(unit, pa.string()), pa.array(tags, pa.string())], schema.fieldNames())

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out
