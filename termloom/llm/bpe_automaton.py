"""BPE encoding and decoding by a compiled tokenization automaton.

The states are the tokens (the last one read) and a start state; an arc
``x -> y`` is labelled with token y.  A path spells a word, and exactly one path
spells each word: its BPE tokenization.  The automaton is made by merge gadgets,
one for each merge (a, b) -> c in order of priority:

* the arc a -> b is removed, as its label pair is now merged;
* c takes over the ways out of b and the ways in to a.

Arcs are bits: one row for every label, one bit for every state that can be
left.  Tokens that end a word cannot be left and need no state.  Labels with
equal rows and states with equal columns are then merged into classes, which
leaves about a fifth of the table.  It is compiled once, in one task, written to
the shared folder and broadcast; its size depends on the vocabulary only.

Encoding walks a word from left to right.  All prefixes of a word are paths
too, so each position has one state, found by trying the labels that end there
and looking up one bit.  Words of all lengths are walked together in numpy.
Decoding emits the labels of the arcs.

A text is normalised and pre-split as the tokenizer file says (NFC, lower case,
white space dropped, words by pattern); special tokens in the text are kept
whole.  Words are independent of each other, so each distinct word is walked
once per worker and kept in a bounded cache.

Defined cases: a null or empty text has no tokens.  Repeated rows are encoded
alike.  Any number of columns may follow; names of the results replace theirs.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from termloom.llm import _text
from termloom.llm._store import forget, stored

U64 = np.uint64
END = "</w>"
#: Words of a generation of a worker's memory; it keeps two.
CACHE = 300_000
#: Characters of text handled at a time.
PART = 1 << 20
#: Longer words, and fewer words, are walked one at a time, in plain Python.
LONG, FEW = 48, 48
#: Texts of these characters only (Latin letters that are their own normal form
#: and have plain lower-case forms) are split by a pattern over whole texts;
#: pieces of all others by the library's own tables.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-įıĲ-ſ–—‘’“”„…]*")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")
_poly = _text.Poly(51)
_SYMBOLS = np.random.default_rng(52).integers(1, 1 << 63, 512, dtype=np.uint64)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


_BYTE_OF = {c: b for b, c in enumerate(byte_letters())}


@dataclass
class Arcs:
    """Arcs between classes: bit ``column[state]`` of ``rows[row[label]]`` tells whether label may follow state."""

    rows: np.ndarray
    row: np.ndarray
    column: np.ndarray

    def __call__(self, label, place):
        """Whether each label may follow each state, given by its place."""
        at = self.column[place]
        return self.rows[self.row[label], at >> 3] >> (at & 7).astype(np.uint8) & 1

    @classmethod
    def merged(cls, table: np.ndarray) -> Arcs:
        """The classes of a table with one row for each label and one bit for each state."""
        kinds, row = np.unique(table.view(np.dtype((np.void, table.shape[1]))).ravel(), return_inverse=True)
        rows = np.frombuffer(kinds.tobytes(), np.uint8).reshape(len(kinds), -1)
        # Columns are compared in full, eight at a time.
        seen: dict[bytes, int] = {}
        column = np.zeros(8 * rows.shape[1], np.int32)
        packed = []
        for k in range(rows.shape[1]):
            bits = np.unpackbits(rows[:, k, None], axis=1, bitorder="little")
            for j in range(8):
                one = np.packbits(bits[:, j])
                digest = hashlib.blake2b(one.tobytes(), digest_size=16).digest()
                if digest not in seen:
                    seen[digest] = len(packed)
                    packed.append(one)
                column[8 * k + j] = seen[digest]
        out = np.empty((len(rows), (len(packed) + 7) // 8), np.uint8)
        for k in range(out.shape[1]):
            part = np.stack([np.unpackbits(x)[: len(rows)] for x in packed[8 * k : 8 * k + 8]])
            out[:, k] = np.packbits(part.T, axis=1, bitorder="little")[:, 0]
        return cls(out, row.astype(np.int32), column)


class Automaton:
    """The compiled automaton of a byte-level BPE with word-end symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        self.special, self.size = special, max([*vocab.values(), *special.values()]) + 1
        self.label = [""] * self.size
        for token, k in [*vocab.items(), *special.items()]:
            self.label[k] = token
        code = _BYTE_OF
        self.symbols: dict[int, bytes] = {}
        for token, k in vocab.items():
            ends = token.endswith(END) and token != END
            body = [code[c] for c in (token[: -len(END)] if ends else token)]
            if ends:
                body[-1] += 256
            self.symbols[k] = np.array(body, np.int16).tobytes()
        self.length = np.zeros(self.size + 1, np.int32)
        for k, s in self.symbols.items():
            self.length[k] = len(s) // 2
        self.longest = int(self.length.max())
        self.base = np.full(512, -1)
        last = {}
        for k, s in self.symbols.items():
            last[k] = int.from_bytes(s[-2:], "little")
            if len(s) == 2:
                self.base[last[k]] = k
        # Places of the states: tokens that do not end a word, and the start at 0.
        self.place = np.zeros(self.size + 1, np.int32)
        inner = [k for k in sorted(self.symbols) if last[k] < 256]
        self.place[inner] = np.arange(1, len(inner) + 1)
        self.inner = np.zeros(self.size, bool)
        self.inner[inner] = True
        self.arcs = Arcs.merged(self._compile(vocab, merges, 1 + len(inner)))
        self._index()

    def _compile(self, vocab: dict[str, int], merges: list[tuple[str, str]], states: int) -> np.ndarray:
        width = (states + 7) // 8
        arcs = np.zeros((self.size, width), np.uint8)
        known = np.zeros(self.size, bool)
        base = self.base[self.base >= 0]
        ways = np.zeros(width * 8, np.uint8)
        ways[0] = 1
        ways[self.place[base[self.inner[base]]]] = 1
        arcs[base] = np.packbits(ways, bitorder="little")
        known[base] = True
        live = np.zeros(self.size, np.int64)
        live[: len(base)] = base
        n = len(base)
        for left, right in merges:
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            pa_ = self.place[a]
            into_a, out_byte, out_bit = arcs[a].copy(), self.place[b] >> 3, int(self.place[b] & 7)
            loop = False
            if self.inner[c]:
                labels = live[:n]
                column = arcs[labels, out_byte] >> out_bit & 1
                loop = bool(arcs[a, out_byte] >> out_bit & 1)
                to_byte, to_bit = self.place[c] >> 3, int(self.place[c] & 7)
                arcs[labels, to_byte] |= column << np.uint8(to_bit)
                if loop:
                    into_a[to_byte] |= np.uint8(1 << to_bit)
            if a == b:
                into_a[pa_ >> 3] &= ~np.uint8(1 << (pa_ & 7)) & np.uint8(255)
            arcs[b, pa_ >> 3] &= ~np.uint8(1 << (pa_ & 7)) & np.uint8(255)
            arcs[c] = into_a
            live[n] = c
            n += 1
        return arcs

    def _index(self) -> None:
        """A table from the hash of a label's symbols to its token, by two probes."""
        tokens = np.array(sorted(self.symbols))
        hashes = np.array([self._hash(np.frombuffer(self.symbols[k], np.int16)) for k in tokens], U64)
        bits = max(8, int(4 * len(tokens)).bit_length())
        self.shift, size = U64(64 - bits), 1 << bits
        self.slots, self.keys = np.full(size + 64, -1, np.int32), np.zeros(size + 64, U64)
        self.probes = 1
        for k, h in zip(tokens.tolist(), hashes, strict=True):
            at = int(h >> self.shift)
            step = 0
            while self.slots[at + step] >= 0:
                step += 1
            self.slots[at + step], self.keys[at + step] = k, h
            self.probes = max(self.probes, step + 1)
        self.words = {s: k for k, s in self.symbols.items()}
        del self.symbols

    @staticmethod
    def _hash(symbols: np.ndarray) -> np.uint64:
        prefix = _poly.prefix(_SYMBOLS[symbols])
        return _poly.ranges(prefix, np.array([0]), np.array([len(symbols)]))[0]

    def _token(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == h, self.slots[at], -1)
        for step in range(1, self.probes):
            todo = np.flatnonzero((out < 0) & (self.slots[at + step - 1] >= 0))
            if not len(todo):
                break
            near = at[todo] + step
            out[todo] = np.where(self.keys[near] == h[todo], self.slots[near], -1)
        return out

    def _walk(self, symbols: np.ndarray, lengths: np.ndarray | None = None) -> list[list[int]]:
        """Tokenizations of words, given as rows of a table of symbols; the longest come first."""
        n, length = symbols.shape
        lengths = np.full(n, length) if lengths is None else lengths
        reach = np.searchsorted(-lengths, -np.arange(length + 1), "right")
        values = _SYMBOLS[symbols] * _poly.powers[:length]
        prefix = np.zeros((n, length + 1), U64)
        np.cumsum(values, axis=1, out=prefix[:, 1:])
        state = np.full((n, length + 1), -1, np.int32)
        state[:, 0] = self.size
        for end in range(1, length + 1):
            todo = np.arange(reach[end])
            # Just one label fits; short ones are the likely ones.
            for size in range(1, min(end, self.longest) + 1):
                begin = end - size
                h = _text.mix((prefix[todo, end] - prefix[todo, begin]) * _poly.inverses[begin])
                token = self._token(h)
                some = np.flatnonzero((token >= 0) & (state[todo, begin] >= 0))
                if not len(some):
                    continue
                place = self.place[state[todo[some], begin]]
                fits = self.arcs(token[some], place) > 0
                hit = some[fits]
                state[todo[hit], end] = token[hit]
                left = np.ones(len(todo), bool)
                left[hit] = False
                todo = todo[left]
                if not len(todo):
                    break
        # All paths are followed back side by side, from the end of the word.
        back, steps = np.empty((n, length), np.int32), np.zeros(n, np.int64)
        at, live, k = lengths.copy(), np.arange(n), 0
        while len(live):
            token = state[live, at[live]]
            back[live, k] = token
            at[live] -= self.length[token]
            k += 1
            steps[live] = k
            live = live[at[live] > 0]
        return [row[m::-1] for row, m in zip(back[:, :k].tolist(), (steps - 1).tolist(), strict=True)]

    def _walk_alone(self, symbols: np.ndarray) -> list[int]:
        length, symbols = len(symbols), symbols.astype(np.int16)
        state = [self.size] + [-1] * length
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                last = state[end - size]
                token = self.words.get(symbols[end - size : end].tobytes()) if last >= 0 else None
                if token is not None and self.arcs(token, self.place[last]):
                    state[end] = token
                    break
        path, at = [], length
        while at:
            path.append(state[at])
            at -= int(self.length[state[at]])
        return path[::-1]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each pre-split, normalised word."""
        data = [w.encode("utf-8") for w in words]
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(d) for d in data], np.int64)
        order = np.argsort(-size, kind="stable")
        alone = int(np.count_nonzero(size > LONG)) if len(data) >= FEW else len(data)
        for k in order[:alone].tolist():
            symbols = np.frombuffer(data[k], np.uint8).astype(np.int64)
            symbols[-1] += 256
            out[k] = self._walk_alone(symbols)
        for lo in range(alone, len(data), 8192):
            part = order[lo : lo + 8192]
            lengths = size[part]
            table = np.zeros((len(part), lengths[0]), np.int64)
            table[np.arange(lengths[0]) < lengths[:, None]] = np.frombuffer(b"".join([data[k] for k in part.tolist()]), np.uint8)
            table[np.arange(len(part)), lengths - 1] += 256
            for k, path in zip(part.tolist(), self._walk(table, lengths), strict=True):
                out[k] = path
        return out

    def decode(self, ids) -> str:
        """The labels of the path, one space between two."""
        return " ".join(self.label[k] for k in ids)


class Splitter:
    """Normalises and pre-splits texts as the tokenizer file says."""

    def __init__(self, special: dict[str, int], library: Tokenizer):
        self.library = library
        self.marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def _piece(self, piece: str) -> list[str]:
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(map(_BYTE_OF.__getitem__, w)).decode("utf-8") for w, _ in parts]

    def split(self, text: str) -> list[str]:
        """Normalised words; a special token is marked by a leading line feed."""
        if "<|" in text and self.marks:
            out: list[str] = []
            for k, part in enumerate(self.marks.split(text)):
                out += ["\n" + part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text.lower())
        out: list[str] = []
        for piece in text.replace("\n", " ").split(" "):
            if piece:
                out += _WORD.findall(piece.lower()) if _PLAIN.fullmatch(piece) else self._piece(piece)
        return out


class Encoder:
    """Encodes texts word by word with a bounded memory of words.

    The memory has two generations: words that are met again move to the young
    one, and when that is full it becomes the old one, whose words go.
    """

    def __init__(self, automaton: Automaton, library: Tokenizer):
        self.automaton = automaton
        self.splitter = Splitter(automaton.special, library)
        self.number = [str(k) for k in range(automaton.size)]
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}
        #: The labels of the words of both, in the same way.
        self.known_labels: dict[str, str] = {}
        self.old_labels: dict[str, str] = {}

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.old, self.known = self.known, {}
            self.old_labels, self.known_labels = self.known_labels, {}
            new = words
        again = new & self.old.keys()
        for known, old in ((self.known, self.old), (self.known_labels, self.old_labels)):
            known.update([(w, old[w]) for w in again])
        label, number = self.automaton.label, self.number
        plain = []
        for w in new - again:
            if w[0] == "\n":
                self.known[w], self.known_labels[w] = str(self.automaton.special[w[1:]]), w[1:]
            else:
                plain.append(w)
        for w, path in zip(plain, self.automaton.encode_words(plain), strict=True):
            self.known[w], self.known_labels[w] = " ".join([number[k] for k in path]), " ".join([label[k] for k in path])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text: its ids and its labels, joined by spaces."""
        lo = 0
        while lo < len(texts):
            part, size = [], 0
            while lo < len(texts) and (size < PART or not part):
                part.append(self.splitter.split(texts[lo] or ""))
                size += len(texts[lo] or "")
                lo += 1
            self._learn(set().union(*part))
            numbers, labels = self.known.__getitem__, self.known_labels.__getitem__
            for words in part:
                yield " ".join(map(numbers, words)), " ".join(map(labels, words))


def read_tokenizer(path: str) -> Automaton:
    """Compile a tokenizer file; its merges must be in order and its words end in ``</w>``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


def _without_model(path: str) -> str:
    """The tokenizer file without its model: normalisation and pre-splitting only."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= {"vocab": {}, "merges": [], "unk_token": None}
    return json.dumps(spec | {"added_tokens": [], "post_processor": None, "decoder": None})


def packed(path: str) -> bytes:
    """The compiled automaton and the normaliser, for shipping to the workers."""
    return zlib.compress(pickle.dumps((read_tokenizer(path), _without_model(path)), 5), 1)


def unpacked(blob: bytes) -> Encoder:
    automaton, rest = pickle.loads(zlib.decompress(blob))
    return Encoder(automaton, Tokenizer.from_str(rest))


_compiled: dict[tuple, bytes] = {}


def packed_once(spark: SparkSession, path: str) -> bytes:
    """``packed``, compiled in a task; some 4 MB, kept by the driver."""
    key = (path, os.path.getmtime(path))
    if key not in _compiled:

        def compile_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([packed(path)], pa.binary())], ["automaton"])

        table = stored(_text.mapped(spark.range(1, numPartitions=1), compile_, "automaton binary"), "automaton")
        _compiled[key] = bytes(table.first()["automaton"])
        forget(table)
    return _compiled[key]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, shared: Broadcast) -> Encoder:
    """The encoder of this worker; the automaton is unpacked, not compiled again."""
    if path not in _encoders:
        _encoders[path] = unpacked(shared.value)
        shared.__dict__.pop("_value", None)  # the packed copy is not needed again
        _text.release()
    return _encoders[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = True, with_ids: bool = True, digest: bool = False, with_decoded: bool = True) -> DataFrame:
    """Add n_tokens and, as asked, ids, decoded, ids_sha256 and decoded_sha256 to all columns of ``docs``."""
    with_decoded = with_decoded and with_ids
    added = ["n_tokens", *["ids"] * with_ids, *["decoded"] * with_decoded, *(["ids_sha256", "decoded_sha256"] if digest else [])]
    given = docs.select(*[c for c in docs.columns if c not in added])
    kept = given if keep_text else given.drop(text_col)
    text_at, at = given.columns.index(text_col), [given.columns.index(c) for c in kept.columns]
    names = [*kept.columns, *added]
    shared = docs.sparkSession.sparkContext.broadcast(packed_once(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared)
        for batch in batches:
            for lo, hi, _, _ in _text.pieces(batch.column(text_at), PART):
                texts = batch.column(text_at).slice(lo, hi - lo).to_pylist()
                cols: list[list] = [[] for _ in added]
                for number, text in encoder.encode(texts):
                    row: list = [number.count(" ") + 1 if number else 0]
                    if with_ids:
                        row.append(np.fromstring(number, np.int32, sep=" "))
                    if with_decoded:
                        row.append(text)
                    if digest:
                        row += [hashlib.sha256(number.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.int64(), *[pa.list_(pa.int32())] * with_ids, *[pa.string()] * with_decoded, *([pa.string()] * 2 if digest else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in at), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    schema = "n_tokens long" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded + ", ids_sha256 string, decoded_sha256 string" * digest
    return _text.mapped(given, run, _text.extended(kept, schema))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the arc labels of an array of ids joined by spaces; a null array gives null."""
    given = tokens.select(*[c for c in tokens.columns if c != "decoded"])
    at, names = given.columns.index(ids_col), [*given.columns, "decoded"]
    labels = tokens.sparkSession.sparkContext.broadcast(_labels(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labels.value
        for batch in batches:
            out = [None if ids is None else " ".join(label[k] for k in ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names)

    return _text.mapped(given, run, _text.extended(given, "decoded string"))


def _labels(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
    out = [""] * (1 + max(k for _, k in pairs))
    for token, k in pairs:
        out[k] = token
    return out


def op3_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digest: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encode(docs.select("doc_id", "text"), path, keep_text=False, with_ids=False, digest=True)
