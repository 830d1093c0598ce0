"""Fill-in-middle transformation over seekable compressed frames.

``store`` keeps a text as independent zstandard frames of ``FRAME_BYTES`` with an index of cumulative bytes, line ends and
code points. ``fill_in_middle`` cuts a stored text after whole lines: a binary search in the index finds the frame that
holds a cut, and only that frame is decompressed. The transformed text is stored the same way: frames that lie whole in
one part are taken over as they are, only those at cuts are compressed anew. Digests stream over the frames in order, one
decompressed at a time. The source text is rebuilt from the output's frames and the form alone: the marks are searched for
in the stream, and the parts between them are read in the order of the source.

No shuffle: each document is handled alone, inside the scan's partitions, so hot sources or copies change nothing. Beside a
batch of texts a task holds one document's frames and one decompressed frame. All choices come from SHA-256 of a seed and
doc_id, so a repeated task gives the same rows.

Defined cases: a null text is empty; an empty text, and one that contains a mark, stays plain; a null doc_id is hashed as an
empty string; a text without a line break is one line; equal rows give equal results; an empty table gives an empty result;
extra columns pass through, and one that bears an output name is replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowlens.llm.textbytes import in_arrow, without

FRAME_BYTES = 1 << 16
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ROWS_OUT = 512

_INDEX = T.ArrayType(T.LongType())
STORED = T.StructType([T.StructField("frames", T.ArrayType(T.BinaryType())), T.StructField("bytes", _INDEX),
                       T.StructField("line_ends", _INDEX), T.StructField("chars", _INDEX),
                       T.StructField("n_lines", T.LongType()), T.StructField("marked", T.BooleanType())])


@dataclass(frozen=True)
class Rule:
    """What the choices depend on: a seed, the share of transformed documents, and the share of these in spm form."""

    seed: str = "7"
    percent: int = 100
    spm_percent: int = 50


@dataclass
class Frames:
    """A text as compressed frames; ``bytes``, ``line_ends`` and ``chars`` count up to the end of each frame."""

    frames: list[bytes] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)
    line_ends: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    n_lines: int = 0
    marked: bool = False

    @property
    def size(self) -> int:
        return self.bytes[-1] if self.bytes else 0

    def add(self, frame: bytes, size: int, line_ends: int, chars: int) -> None:
        for index, n in ((self.bytes, size), (self.line_ends, line_ends), (self.chars, chars)):
            index.append((index[-1] if index else 0) + n)
        self.frames.append(frame)

    def before(self, index: list[int], k: int) -> int:
        return index[k - 1] if k else 0


def code_points(data: bytes) -> int:
    """Characters that begin in a piece of UTF-8."""
    return len(data) if data.isascii() else int(((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80).sum())


class Shelf:
    """Writes and reads frames."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard
        self.frame_bytes = frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.decompress = zstandard.ZstdDecompressor().decompress

    def put(self, into: Frames, data: bytes) -> None:
        for at in range(0, len(data), self.frame_bytes):
            part = data[at:at + self.frame_bytes]
            into.add(self.compress(part), len(part), part.count(b"\n"), code_points(part))

    def store(self, text: bytes) -> Frames:
        out = Frames(marked=any(m in text for m in (PREFIX, SUFFIX, MIDDLE)))
        self.put(out, text)
        out.n_lines = text.count(b"\n") + (not text.endswith(b"\n") and len(text) > 0)
        return out

    def cut(self, stored: Frames, lines: int) -> tuple[int, int]:
        """Bytes and code points before the end of so many lines."""
        if lines == 0:
            return 0, 0
        k = bisect_left(stored.line_ends, lines)
        if k == len(stored.frames):  # the last line has no line break
            return stored.size, stored.chars[-1]
        data = self.decompress(stored.frames[k])
        nth = lines - stored.before(stored.line_ends, k)
        at = int(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)[nth - 1]) + 1
        return stored.before(stored.bytes, k) + at, stored.before(stored.chars, k) + code_points(data[:at])

    def pieces(self, stored: Frames, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(frame, first byte, end byte in it) of the frames that hold bytes [start, end)."""
        k = bisect_right(stored.bytes, start)
        while start < end:
            base = stored.before(stored.bytes, k)
            stop = min(end, stored.bytes[k])
            yield k, start - base, stop - base
            start, k = stop, k + 1

    def read(self, stored: Frames, start: int, end: int) -> Iterator[bytes]:
        for k, lo, hi in self.pieces(stored, start, end):
            yield self.decompress(stored.frames[k])[lo:hi]

    def copy(self, into: Frames, stored: Frames, start: int, end: int) -> None:
        """Appends bytes [start, end): whole frames as they are, others compressed anew."""
        for k, lo, hi in self.pieces(stored, start, end):
            if lo == 0 and hi == stored.bytes[k] - stored.before(stored.bytes, k):
                counts = [index[k] - stored.before(index, k) for index in (stored.bytes, stored.line_ends, stored.chars)]
                into.add(stored.frames[k], *counts)
            else:
                self.put(into, self.decompress(stored.frames[k])[lo:hi])

    def digest(self, stored: Frames, *spans: tuple[int, int]) -> str:
        sha = hashlib.sha256()
        for start, end in spans or ((0, stored.size),):
            for data in self.read(stored, start, end):
                sha.update(data)
        return sha.hexdigest()

    def find(self, stored: Frames, mark: bytes, start: int) -> int:
        """First byte of a mark at or after ``start``, also where it lies across frames."""
        held, at = b"", start
        for data in self.read(stored, start, stored.size):
            held += data
            if (found := held.find(mark)) >= 0:
                return at + found
            keep = min(len(held), len(mark) - 1)
            at, held = at + len(held) - keep, held[len(held) - keep:]
        raise ValueError(f"no {mark!r} in the output")


def hashes(seed: str, doc_id: object) -> list[int]:
    made = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(made[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(shelf: Shelf, stored: Frames, doc_id: object, rule: Rule) -> tuple[Frames, str, tuple | None]:
    """Output, its form, and (prefix, middle) sizes in code points, None where it is plain."""
    h = hashes(rule.seed, doc_id)
    if not stored.frames or stored.marked or h[2] % 100 >= rule.percent:
        return stored, "plain", None
    one, two = sorted((h[0] % (stored.n_lines + 1), h[1] % (stored.n_lines + 1)))
    (first, first_chars), (second, second_chars) = shelf.cut(stored, one), shelf.cut(stored, two)
    form = "spm" if h[3] % 100 < rule.spm_percent else "psm"
    prefix, middle, suffix = (PREFIX, 0, first), (MIDDLE, first, second), (SUFFIX, second, stored.size)
    out = Frames()
    for mark, start, end in (suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle):
        shelf.put(out, mark)
        shelf.copy(out, stored, start, end)
    out.n_lines = out.line_ends[-1] + (next(shelf.read(out, out.size - 1, out.size)) != b"\n")
    return out, form, (first_chars, second_chars - first_chars)


def source_spans(shelf: Shelf, output: Frames, form: str) -> list[tuple[int, int]]:
    """Where the parts of the source lie in an output, in the order of the source."""
    if form == "plain":
        return [(0, output.size)]
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    second = shelf.find(output, two, len(one))
    middle = shelf.find(output, MIDDLE, second + len(two))
    parts = {one: (len(one), second), two: (second + len(two), middle)}
    return [parts[PREFIX], (middle + len(MIDDLE), output.size), parts[SUFFIX]]


def _map(docs: DataFrame, dropped: str, fields: list[T.StructField], make: Callable[[tuple], tuple], inputs: list[str]) -> DataFrame:
    """Replace column ``dropped`` by the fields that ``make`` computes from the inputs of each row."""
    names = [c for c in without(docs, [f.name for f in fields]) if c.lower() != dropped]
    schema = T.StructType([*[docs.schema[c] for c in names], *fields])
    # inputs come last, so that extra columns of any name stay apart from them
    asked = docs.select(*[docs[c] for c in names], *[docs[c].alias(f"in {i}") for i, c in enumerate(inputs)])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(lo, ROWS_OUT)
                columns = [part.column(len(names) + i) for i in range(len(inputs))]
                columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in columns]
                made = list(zip(*[worker(*(c[r].as_py() for c in columns)) for r in range(part.num_rows)], strict=True))
                arrays = [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], *arrays], names=schema.names)

    return in_arrow(asked, run, schema)


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """``docs`` with column ``stored`` (frames and their index) in place of ``text``."""
    def make():
        shelf = Shelf(frame_bytes, level)

        def row(text):
            s = shelf.store(text or b"")
            return ({f.name: getattr(s, f.name) for f in STORED.fields},)
        return row

    return _map(docs, "text", [T.StructField("stored", STORED)], make, ["text"])


def fill_in_middle(stored: DataFrame, rule: Rule = Rule(), frame_bytes: int = FRAME_BYTES, level: int = LEVEL,
                   outputs: bool = True) -> DataFrame:
    """Stored documents with n (lines), form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, unless
    declined, ``output``: the transformed text as frames and index. Column ``stored`` goes."""
    long, text = T.LongType(), T.StringType()
    fields = [T.StructField("n", long), T.StructField("form", text), T.StructField("prefix_chars", long),
              T.StructField("middle_chars", long), T.StructField("output_sha256", text), T.StructField("restored_sha256", text)]
    if outputs:
        fields.append(T.StructField("output", STORED))

    def make():
        shelf = Shelf(frame_bytes, level)

        def row(doc_id, held):
            source = Frames(**held)
            out, form, chars = transform(shelf, source, doc_id, rule)
            made = (source.n_lines, form, *(chars or (None, None)), shelf.digest(out),
                    shelf.digest(out, *source_spans(shelf, out, form)))
            return (*made, {f.name: getattr(out, f.name) for f in STORED.fields}) if outputs else made
        return row

    return _map(stored, "stored", fields, make, ["doc_id", "stored"])


def texts(docs: DataFrame, name: str = "stored") -> DataFrame:
    """Column ``text`` read back from a column of frames."""
    def make():
        shelf = Shelf()

        def row(held):
            held = Frames(**held)
            return (b"".join(shelf.read(held, 0, held.size)).decode("utf-8"),)
        return row

    return _map(docs, name.lower(), [T.StructField("text", T.StringType())], make, [name])
