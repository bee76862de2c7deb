"""Fill-in-the-middle: cut texts into prefix, middle and suffix and reorder them.

One numpy kernel works on the UTF-8 buffer of a whole Arrow column at once.  A
table gives the class of every byte; a mask marks the bytes that begin a unit (a
run of ASCII letters, or any other single code point), compared with the byte
before them and set anew at the first byte of every document.  Its cumulative
sum, less the sum at the document's first byte, numbers the units; the cuts of
all rows are found in it by one ``searchsorted``.

Units before the cuts are drawn from a hash of seed and id, so the outcome
depends neither on partitions nor on retries.  ``restored`` is the inverse and
needs the output and its form alone: a text that holds a marker stays plain, and
no marker can arise where parts meet, because each begins with ``<`` and none
has a second one.

Defined cases: a null text is empty, and an empty one stays plain.  A null id is
hashed as an empty string.  Repeated rows are cut alike.  Input columns named
like an added one are replaced.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import _text

#: Fixed markers of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
#: Of 100 texts, those that are cut; of 100 of these, those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes that begin a code point.
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def draws(id_col: str, seed: int) -> Column:
    """Four numbers of 32 bits from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _marks(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places of the markers that lie inside one row."""
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((raw[:-2] == 0x3C) & (raw[2:] == 0x3E) & ((raw[1:-1] == PREFIX[1]) | (raw[1:-1] == SUFFIX[1]) | (raw[1:-1] == MIDDLE[1])))
    return at[offs[np.searchsorted(offs, at, "right")] >= at + 3]


def _gather(source: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All segments one after another, and the end of each row of segments in them."""
    rows = np.concatenate([[0], np.cumsum((end - start).sum(1))])
    parts = [source[a:b] for a, b in zip(start.ravel().tolist(), end.ravel().tolist(), strict=True)]
    return (np.concatenate(parts) if parts else source[:0]), rows


def _column(raw: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def cut(raw: np.ndarray, offs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, form, first byte of middle, first byte of suffix, code points before each byte) of all rows."""
    letter, lead = _LETTER[raw], _LEAD[raw]
    begins = lead.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    full = offs[:-1][np.diff(offs) > 0]
    begins[full] = True
    units = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(begins, out=units[1:])
    base = units[offs[:-1]]
    n = units[offs[1:]] - base
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    # The unit after the last begins where the next row does, that is at the row's end.
    low, high = (np.searchsorted(units[1:], base + 1 + f(a, b), "left") for f in (np.minimum, np.maximum))
    held = np.bincount(np.searchsorted(offs, _marks(raw, offs), "right") - 1, minlength=len(n)) > 0
    form = np.where((n == 0) | held | (h[:, 2] % 100 >= CUT), PLAIN, np.where(h[:, 3] % 100 < SUFFIX_FIRST, SPM, PSM))
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    return n, form, low, high, points


def transform(raw: np.ndarray, offs: np.ndarray, form: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the reordered rows."""
    source = np.concatenate([raw, np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)])
    n, size = len(form), len(raw)
    p, s, m = (np.full(n, size + k) for k in (0, 3, 6))
    begin, end = offs[:-1], offs[1:]
    none = np.zeros(n, np.int64)
    first, last = np.where(form == PLAIN, begin, low), np.where(form == PLAIN, end, high)
    psm, spm = form == PSM, form == SPM
    one, two = np.where(psm, begin, high), np.where(psm, low, end)  # the part that comes first
    three, four = np.where(psm, high, begin), np.where(psm, end, low)
    marked = (psm | spm).astype(np.int64)
    lead, then = np.where(psm, p, s), np.where(psm, s, p)
    start = np.stack([lead, np.where(marked, one, none), then, np.where(marked, three, none), m, first], 1)
    stop = np.stack([lead + 3 * marked, np.where(marked, two, none), then + 3 * marked, np.where(marked, four, none), m + 3 * marked, last], 1)
    return _gather(source, start, stop)


def restore(raw: np.ndarray, offs: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that outputs of these forms were made of."""
    n, done = len(form), np.flatnonzero(form != PLAIN)
    at = _marks(raw, offs)
    at = at[form[np.searchsorted(offs, at, "right") - 1] != PLAIN]
    if len(at) != 3 * len(done):
        raise ValueError("an output does not have three markers")
    start, end = np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64)
    start[:, 0], end[:, 0] = offs[:-1], offs[1:]
    one, two, three = at.reshape(-1, 3).T
    before = (one + 3, two), (two + 3, three)
    swap = form[done] == SPM
    for k, (a, b) in enumerate((before, before[::-1])):
        start[done, 2 * k], end[done, 2 * k] = np.where(swap, b[0], a[0]), np.where(swap, b[1], a[1])
    start[done, 1], end[done, 1] = three + 3, offs[1:][done]
    return _gather(raw, start, end)


def _digests(raw: np.ndarray, offs: np.ndarray) -> list[str]:
    data = memoryview(np.ascontiguousarray(raw))
    edges = offs.tolist()
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, digest: bool = False) -> DataFrame:
    """Add ``n``, ``form``, ``output``, ``prefix_chars`` and ``middle_chars`` to all columns.

    With ``digest``, hashes of the output and of the text restored from it take
    the place of text and output.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digest else ["output"])]
    kept = [c for c in docs.columns if c not in added and not (digest and c == text_col)]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__text"), draws(id_col, seed).alias("__h"))
    schema = _text.extended(docs.select(*[F.col(f"`{c}`") for c in kept]), "n long, form string, prefix_chars long, middle_chars long, " + ("output_sha256 string, restored_sha256 string" if digest else "output string"))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drawn = batch.column(len(kept)), batch.column(len(kept) + 1)
            if isinstance(drawn, pa.ChunkedArray):
                drawn = drawn.combine_chunks()
            h = drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            for lo, hi, raw, offs in _text.pieces(texts):
                n, form, low, high, points = cut(raw, offs, h[lo:hi])
                out, ends = transform(raw, offs, form, low, high)
                plain = form == PLAIN
                numbers = [pa.array(n), pa.array(FORMS[form])]
                numbers += [pa.array(x, mask=plain) for x in (points[low] - points[offs[:-1]], points[high] - points[low])]
                if digest:
                    rest = [pa.array(_digests(out, ends), pa.string()), pa.array(_digests(*restore(out, ends, form)), pa.string())]
                else:
                    rest = [_column(out, ends).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(kept))), *numbers, *rest], names)

    return _text.mapped(given, run, schema)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """Add the text that each output was made of; a null form or output counts as plain or empty."""
    kept = [c for c in df.columns if c != name]
    given = df.select(*[F.col(f"`{c}`") for c in kept])
    out_at, form_at = kept.index(output_col), kept.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = np.array([{"psm": PSM, "spm": SPM}.get(x, PLAIN) for x in batch.column(form_at).to_pylist()], np.int64)
            for lo, hi, raw, offs in _text.pieces(batch.column(out_at)):
                text = _column(*restore(raw, offs, form[lo:hi])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(kept))), text], [*kept, name])

    return _text.mapped(given, run, _text.extended(given, f"`{name}` string"))


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return fill_in_middle(docs.select("doc_id", "text"), digest=True)


OP13_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS s, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, s, regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]') AS us, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
n AS (SELECT *, CAST(len(us) AS BIGINT) AS n FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(s) AS restored_sha256 FROM p"""
