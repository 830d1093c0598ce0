"""Arrow string columns as flat UTF-8 bytes: words, lines and hashes of many documents at once in numpy.

White space is the six ASCII characters 0x09-0x0D and 0x20, so words of the form ``[^\\x20\\x09-\\x0D]+`` are found on
bytes. Hashes are polynomial over a table-mapped byte (mod 2^64) with a final mix; equal input gives equal hashes in
every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BATCH_ROWS = 2048
CHUNK_BYTES = 1 << 20  # documents are handled in groups of about this size; one longer document is a group

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses mod 2^64
_BASE_INV = pow(BASE, -1, 1 << 64)
WORD_BASE = _U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (xor-shift and multiply, three steps)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(BASE))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), _U(base), dtype=np.uint64)
        steps[0] = 1
        got = np.multiply.accumulate(steps)
        if n <= CHUNK_BYTES + 1:  # longer ones, of single long documents, are not kept
            _powers[kind] = got
    return got[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums of uint64 codes; see ``span_hash``."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _power("up", BASE, len(codes)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for many spans, from running sums; length is mixed in."""
    raw = (sums[ends] - sums[starts]) * _power("down", _BASE_INV, len(sums))[starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64) + _U(1)))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of all spans of one width, in order."""
    n = max(len(sums) - width, 0)
    raw = (sums[width:] - sums[:n]) * _power("down", _BASE_INV, len(sums))[:n]
    return mix(raw ^ mix(np.array([width + 1], dtype=np.uint64)))


class Texts:
    """Documents of one chunk: ``data`` (uint8, concatenated) and int64 ``starts`` and ``ends`` into it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        self.n = len(starts)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Document that holds byte ``at`` (empty documents hold none)."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def _edges(self) -> np.ndarray:
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.starts] = True
        edge[self.ends] = True
        return edge

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans (starts, ends) of all words, in order; none crosses documents."""
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = ~IS_SPACE[self.data]
        edge = self._edges()
        first = inside[1:-1] & (~inside[:-2] | edge[:-1])
        last = inside[1:-1] & (~inside[2:] | edge[1:])
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of the lines of non-empty documents (split at \\n, which belongs to no line)."""
        breaks = np.flatnonzero(self.data == 10)
        full = self.ends > self.starts
        starts = np.sort(np.concatenate([self.starts[full], breaks + 1]))
        ends = np.sort(np.concatenate([self.ends[full], breaks]))
        return starts, ends


def lowered(texts: Texts) -> Texts:
    """The same documents with A-Z in lower case."""
    return Texts(LOWER[texts.data], texts.starts, texts.ends)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, Texts) groups of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=width, count=column.offset + n + 1)[column.offset:].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        lo, hi = bounds[at], bounds[end]
        yield at, end, Texts(data[lo:hi], bounds[at:end] - lo, bounds[at + 1:end + 1] - lo)
        at = end


def word_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(BYTE_CODE[texts.data]), starts, ends)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once, and is it a repeat of an earlier one."""
    n = len(keys)
    many, later = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n < 2:
        return many, later
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return many, later
    run = np.concatenate([[0], np.flatnonzero(~same) + 1])
    long = np.diff(np.append(run, n)) > 1
    firsts = np.minimum.reduceat(order, run)[long]
    member = np.zeros(n, dtype=bool)
    member[1:] |= same
    member[:-1] |= same
    many[order[member]] = True
    later |= many
    later[firsts] = False
    return many, later


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of weights, per document as int64."""
    if weights is None:
        return np.bincount(doc, minlength=n).astype(np.int64)
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def release() -> None:
    """Gives memory that is free back to the machine: a worker process lives on after its task, and what it keeps adds to
    what later stages need."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that ends with ``release``."""
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def in_arrow(rows: DataFrame, run: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` of a function that handles texts: in batches of at most ``BATCH_ROWS``, as both the executor and its
    worker hold one of them or more, and with ``release`` at the end of a task."""
    conf, most = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(most)) <= BATCH_ROWS:
        conf.set(most, BATCH_ROWS)
    return rows.mapInArrow(released(run), schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def without(docs: DataFrame, names: list[str]) -> list[str]:
    """Columns of docs that bear none of the names (letter case aside): outputs replace columns of their name."""
    taken = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in taken]


def with_columns(docs: DataFrame, fields: list[tuple[str, T.DataType]],
                 compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Append columns that ``compute`` makes from Arrow batches; they replace columns of the same name."""
    docs = docs.select(*without(docs, [n for n, _ in fields]))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    kinds = [to_arrow_type(t) for _, t in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(v, type=k) for v, k in zip(compute(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return in_arrow(docs, run, schema)
