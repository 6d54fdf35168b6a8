"""Fill-in-the-middle transformation of whole texts at line ends.

A kernel works on the Arrow buffers of a batch, all rows together: a lookup gives
each byte its class, neighbouring bytes show where lines begin, running sums that
are reset at every document count lines and code points, and binary searches in
these sums find the bytes of all cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Marks before prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
#: Most bytes that the kernel takes at a time (a longer text comes alone).
TOGETHER = 8 << 20

LINE_END, FOLLOWS, OPENS, CLOSES, LETTER = 1, 2, 4, 8, 16
#: The class of each byte: ends of lines, later bytes of a code point, the parts of a mark.
CLASS = np.zeros(256, np.uint8)
CLASS[ord("\n")] = LINE_END
CLASS[0x80:0xC0] = FOLLOWS
CLASS[ord("<")] = OPENS
CLASS[ord(">")] = CLOSES
CLASS[[ord(c) for c in "PSM"]] = LETTER


def draws(ids: list, seed: int) -> np.ndarray:
    """Four numbers below 2**32 for each id, from the SHA-256 of ``seed:id``; a null id counts as an empty one."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


class Lines:
    """Line starts and code points of the texts at ``offsets`` in one buffer of UTF-8."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.size, self.offsets = len(data), offsets
        kind = CLASS[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:] = np.append(kind, 0)[:-1] & LINE_END
        starts[offsets] = True
        starts = starts[:-1]
        #: Lines begun up to each byte, and how many before each document: the sums less these are reset there.
        self.begun = np.cumsum(starts, dtype=np.int64)
        self.before = np.concatenate(([0], self.begun))[offsets]
        self.points = np.concatenate(([0], np.cumsum(kind & FOLLOWS == 0, dtype=np.int64)))
        self.n = np.diff(self.before)
        hit = np.zeros(len(data), bool)
        if len(data) > 2:
            hit[:-2] = (kind[:-2] & OPENS > 0) & (kind[1:-1] & LETTER > 0) & (kind[2:] & CLOSES > 0)
        at = np.nonzero(hit)[0]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[doc + 1]
        #: Documents that hold a mark.
        self.marked = np.bincount(doc[inside], minlength=len(offsets) - 1) > 0

    def cut(self, lines: np.ndarray) -> np.ndarray:
        """The byte at which each document has had so many lines."""
        found = np.searchsorted(self.begun, self.before[:-1] + lines + 1)
        return np.minimum(found, self.offsets[1:])

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.points[end] - self.points[start]


def pieces_of(batch: pa.RecordBatch, together: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null texts are empty."""
    text = batch.column("text").cast(pa.large_string())
    if not len(text):
        return
    buffers = text.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + together, side="right")) - 1)
        last = min(last, len(text))
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def solve(data: np.ndarray, offsets: np.ndarray, ids: list, seed: int, rate: int, spm: int) -> dict[str, list]:
    lines, h = Lines(data, offsets), draws(ids, seed)
    ways = lines.n + 1
    x, y = h[:, 0] % ways, h[:, 1] % ways
    a, b = lines.cut(np.minimum(x, y)), lines.cut(np.maximum(x, y))
    plain = (lines.n == 0) | lines.marked | (h[:, 2] % 100 >= rate)
    back = h[:, 3] % 100 < spm
    whole, (p, s, m) = data.tobytes(), MARKS
    out, bounds = [], zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), plain.tolist(), back.tolist(), strict=True)
    for o, i, j, e, as_is, suffix_first in bounds:
        if as_is:
            out.append(whole[o:e])
        elif suffix_first:
            out.append(b"".join((s, whole[j:e], p, whole[o:i], m, whole[i:j])))
        else:
            out.append(b"".join((p, whole[o:i], s, whole[j:e], m, whole[i:j])))
    chars = lambda i, j: [None if z else c for z, c in zip(plain.tolist(), lines.chars(i, j).tolist(), strict=True)]
    forms = np.where(plain, PLAIN, np.where(back, SPM, PSM)).tolist()
    return {"n": lines.n.tolist(), "form": forms, "prefix_chars": chars(offsets[:-1], a), "middle_chars": chars(a, b), "output": out}


FIELDS = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()), ("output", T.StringType(), pa.string())]


def transform(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Per row: doc_id, ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Two cuts after whole lines, drawn from a hash of ``seed`` and doc_id, part a text
    in prefix, middle and suffix.  ``rate`` percent of the rows are parted, ``spm``
    percent of them with the suffix first.  Null texts are empty; empty texts and
    those that hold one of the marks stay as they are (form 'plain', null counts).
    A null id draws as an empty one, rows that repeat an id draw alike; every row
    gives one row and an empty table an empty result.  Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for first, data, offsets in pieces_of(b):
                own = ids.slice(first, len(offsets) - 1)
                cols = solve(data, offsets, own.to_pylist(), seed, rate, spm)
                arrays = [pa.array(cols[n], pa.binary()).cast(t) if n == "output" else pa.array(cols[n], t) for n, _, t in FIELDS]
                yield pa.RecordBatch.from_arrays([own, *arrays], ["doc_id", *cols])

    source = documents.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(n, t) for n, t, _ in FIELDS)])
    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of which ``output`` was made; a text that is not plain holds each mark once."""
    part = F.split(output, "<[PSM]>")
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == PSM, F.concat(at(1), at(3), at(2))).when(form == SPM, F.concat(at(2), at(3), at(1))).otherwise(output)
