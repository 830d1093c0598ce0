"""Exact substring dedup over the whole corpus with suffix arrays built by two-stage sorting.

Every byte that lies in a ``length``-byte string which also starts anywhere else in the corpus is removed.

1. Each such string (a window) has one anchor: the least hash of its k-grams, leftmost on ties. Neighbouring windows
   share anchors, so a document falls into segments of windows with one anchor each, about two per ``length`` bytes.
   Equal windows have equal anchors, so all that can match meets under its anchor's hash.
2. Equal segments are counted by digest, combined before the shuffle; a segment seen twice is removed entirely, and one
   of each goes on. Anchors with a single kind of segment are done.
3. The distinct segments of an anchor are laid end to end with those of other anchors, and a suffix array orders all
   their suffixes: suffixes smaller than their successor are sorted directly, all others are induced by one scan over
   the first-byte buckets. Adjacent common prefixes of ``length`` bytes or more mark the windows that repeat.
4. An anchor with more than ``HOT`` distinct segments never meets in one task. Its windows are split by their distance to
   the anchor into blocks; equal windows have equal distances, and all windows of a block contain a common core around
   the anchor, whose hash becomes the finer key. Blocks shrink (64, 8, 1 windows), so the rare rest ends in keys that
   are whole windows, which step 2 counts.

Bytes move three times: the scan's texts for step 1 are only hashed; documents that hold undecided segments are
shuffled once to cut those out; and all documents meet their spans once at the end.

Defined cases: a null text is empty; a text shorter than ``length`` is never touched; equal rows are copies of each
other; matches may start inside a UTF-8 character (``strip`` drops a character cut in two); null doc_ids are fine; an
empty table gives an empty result. Segments are taken as equal on equal 64-bit anchor and content hashes and length.
Extra columns pass through; one that bears an output name is replaced.

``strip_passages`` asks for equal runs of words instead, whatever their bytes: each word becomes a code of ``CODE`` bytes and
the same search runs on the codes. A window that starts inside a code shares nearly all of a word's code at one of its
ends, so what it finds is found by whole words too, and spans are cut back to whole words. White space between words does
not matter. A character of a script written without spaces is a word, and a run of ``LENGTH`` bytes or more without white
space is a word for every eight bytes.

``digests`` also counts the words in such runs of ``PASSAGE`` words, most of which have less than 400 bytes, without removing
them. Steps 1 and 2 take these windows of words along as segments of a second unit, and the documents that hold undecided
segments of either unit are shuffled once. The windows of the undecided ones are compared by hash under their anchor, those
of an anchor with more than ``HOT`` segments under both hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowlens.llm import textbytes as tb
from flowlens.session import materialize

LENGTH = 400
PASSAGE = 51  # words
CODE = 6  # bytes of a word's code
LONG_STEP = 8  # bytes of a word inside a run that is too long for one
GRAM = 32
WORD_GRAM = 12
HOT = 256
BLOCKS = (64, 8, 1)
PIECE = 1 << 22  # longer documents are cut into pieces that overlap by length - 1 bytes
BATCH = 1 << 18  # bytes of segments that are sorted together
_U = np.uint64
_PLACE_BITS = 24  # place of an anchor inside a chunk, below the 40 bits of hash that order anchors


# ---- anchors ---------------------------------------------------------------------------------------------

def _pieces(texts: tb.Texts, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, tb.Texts]]:
    """(document, offset in it) of each piece and the pieces, a few documents or one long document's part at a time."""
    if len(texts.data) <= 2 * PIECE:
        yield np.arange(texts.n), np.zeros(texts.n, dtype=np.int64), texts
        return
    for doc in range(texts.n):
        lo, hi = int(texts.starts[doc]), int(texts.ends[doc])
        for at in range(lo, max(hi, lo + 1), PIECE):
            end = min(hi, at + PIECE + length - 1)
            yield (np.array([doc]), np.array([at - lo]),
                   tb.Texts(texts.data[at:end], np.array([0]), np.array([end - at])))


def segments_of(texts: tb.Texts, length: int) -> tuple[np.ndarray, ...]:
    """(doc, start, n, times, anchor hash, content hash) of the segments of documents or pieces.

    A segment is ``n`` consecutive windows from ``start``; ``times`` counts equal segments that follow each other
    directly, as in runs of one character. ``texts`` holds bytes, or hashes of words as ``_in_words`` gives them.
    """
    in_bytes = texts.data.dtype == np.uint8
    size, gram = len(texts.data), min(GRAM if in_bytes else WORD_GRAM, length)
    windows = np.maximum(texts.ends - texts.starts - length + 1, 0)
    at = np.repeat(texts.starts - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    sums = tb.prefix_hash(tb.BYTE_CODE[texts.data] if in_bytes else texts.data)
    hashes = tb.window_hash(sums, gram)
    least = (hashes & _U(((1 << 40) - 1) << _PLACE_BITS)) | np.arange(size - gram + 1, dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[:reach - width], least[width - reach:])
    anchor = (least[at] & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    key = hashes[anchor[first]]
    content = tb.span_hash(sums, start, start + n + length - 1)
    doc = texts.doc_of(start)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = ((key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (n[1:] != n[:-1])
                 | (start[1:] != start[:-1] + n[:-1]) | (doc[1:] != doc[:-1]))
    head = np.flatnonzero(fresh)
    times = np.diff(np.append(head, len(start)))
    return doc[head], start[head] - texts.starts[doc[head]], n[head], times, key[head], content[head]


# ---- suffix array ----------------------------------------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of a byte array, ordered by their first ``depth`` bytes (ties in any order).

    A suffix smaller than its successor is sorted directly; the others are induced: scanning the ordered suffixes
    bucket by bucket, the one that starts a byte earlier goes to the next free place at the front of its own bucket.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    change = np.full(n, n, dtype=np.int64)
    differs = np.flatnonzero(text[1:] != text[:-1])
    change[differs] = differs
    change = np.minimum.accumulate(change[::-1])[::-1]  # the last byte of the run that holds i, n in the last run
    small = np.zeros(n, dtype=bool)
    inner = change < n
    small[inner] = text[change[inner]] < text[change[inner] + 1]
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    direct = np.flatnonzero(small)
    if len(direct):
        keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct].view(f"S{depth}").ravel()
        direct = direct[np.argsort(keys, kind="stable")]
        del keys
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # precedes the empty suffix, the least of all
    out = []
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        large = [wave]
        while len(wave):  # runs of this byte: predecessors that fall into the same bucket
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == byte]
            large.append(wave)
        bucket = np.concatenate([*large, direct[edges[byte]:edges[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        if len(before):
            byte_of = text[before]
            before = before[np.argsort(byte_of, kind="stable")]
            cuts = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, at most ``depth``; eight bytes are compared at a time."""
    steps = -(-depth // 8)
    padded = np.concatenate([text, np.zeros(8 * steps + 8, dtype=np.uint8)])
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    out = np.full(len(left), depth, dtype=np.int64)
    alive = np.arange(len(left))
    for step in range(steps):
        x = word[left[alive] + 8 * step] ^ word[right[alive] + 8 * step]
        differ = x != 0
        if differ.any():
            byte = np.argmax(np.ascontiguousarray(x[differ]).view(np.uint8).reshape(-1, 8) != 0, axis=1)
            out[alive[differ]] = np.minimum(8 * step + byte, depth)
            alive = alive[~differ]
    ends = len(text) - np.maximum(left, right)  # the padding is no text
    return np.minimum(out, ends)


def repeated_windows(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Of the valid window starts: which windows equal another valid one."""
    order = suffix_order(text, length)
    order = order[valid[order]]
    twin = np.flatnonzero(common_prefixes(text, order[:-1], order[1:], length) >= length)
    out = np.zeros(len(text), dtype=bool)
    out[order[twin]] = True
    out[order[twin + 1]] = True
    return out


# ---- Spark stages ----------------------------------------------------------------------------------------

def _segments(rows: DataFrame, length: int, passage: int = 0) -> DataFrame:
    """(doc_id, k, h, g, n, start, times) of every document's segments; with ``passage``, those of so many words too, and
    unit (0 for bytes, 1 for words)."""
    names = ["k", "h", "g", "n", "start", "times", *(["unit"] if passage else [])]
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, texts in tb.chunks(batch.column(2)):
                for unit, size in enumerate([length, passage] if passage else [length]):
                    for docs, bases, part in _pieces(_in_words(texts) if unit else texts, size):
                        doc, start, n, times, key, content = segments_of(part, size)
                        if len(doc):
                            row = pa.array(docs[doc] + lo)
                            last = [pa.array(np.full(len(doc), unit))] if passage else []
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).take(row), batch.column(1).take(row), pa.array(key.view(np.int64)),
                                 pa.array(content.view(np.int64)), pa.array(n), pa.array(start + bases[doc]),
                                 pa.array(times), *last], names=schema.names)

    return tb.in_arrow(rows.select("doc_id", "k", "text"), run, schema)


def _cut_out(rows: DataFrame, wanted: DataFrame, length: int, passage: int = 0) -> DataFrame:
    """The bytes of wanted segments (doc_id, k, h, start, n, seen), cut from their documents; with ``passage``, those of
    unit 1 have no bytes but the hashes of their windows of words."""
    fields = ["h", "start", "n", "seen", *(["unit", "crowd"] if passage else [])]
    lists = (wanted.groupBy("doc_id", "k").agg(F.collect_set(F.struct(*fields)).alias("segs"))
             .withColumnsRenamed({"doc_id": "id", "k": "key"}))
    joined = (rows.select("doc_id", "k", "text").join(lists, F.expr("doc_id <=> id and k = key"))
              .select("doc_id", "k", "text", "segs"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in
                                                    ("k", "h", "start", "n", "seen")],
                           T.StructField("bytes", T.BinaryType()),
                           *([T.StructField("windows", T.ArrayType(T.LongType())), T.StructField("crowd", T.LongType())]
                             if passage else [])])
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, segs = batch.column(2).cast(pa.binary()), batch.column(3)
            for row in range(batch.num_rows):
                data, found = texts[row].as_py(), segs[row].values
                if passage:
                    found = found.take(pa.array(np.flatnonzero(found.field("unit").to_numpy() == 0)))
                start, n = (found.field(c).to_numpy() for c in ("start", "n"))
                same = pa.array(np.full(len(start), row))
                cut = [data[s:s + m + length - 1] for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                none = [pa.nulls(len(start), kind), found.field("crowd")] if passage else []
                if len(start):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), found.field("h"), found.field("start"),
                         found.field("n"), found.field("seen"), pa.array(cut, pa.binary()), *none], names=schema.names)
            if passage:
                yield from windows(batch, texts, segs)

    def windows(batch: pa.RecordBatch, texts: pa.Array, segs: pa.ListArray) -> Iterator[pa.RecordBatch]:
        found, row = segs.flatten(), np.repeat(np.arange(batch.num_rows), segs.value_lengths().to_numpy())
        words = np.flatnonzero(found.field("unit").to_numpy() == 1)
        found, row = found.take(pa.array(words)), row[words]
        held = np.unique(row)
        start, n = (found.field(c).to_numpy() for c in ("start", "n"))
        for lo, hi, part in tb.chunks(texts.take(pa.array(held))):
            a, b = np.searchsorted(row, [held[lo], held[hi - 1] + 1])
            part, m = _in_words(part), n[a:b]
            ends = np.cumsum(m)
            first = part.starts[np.searchsorted(held, row[a:b]) - lo] + start[a:b]
            at = np.repeat(first - ends + m, m) + np.arange(int(ends[-1]))
            hashes = tb.span_hash(tb.prefix_hash(part.data), at, at + passage)
            made = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(hashes.view(np.int64)))
            same, seg = pa.array(row[a:b]), found.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(same), batch.column(1).take(same),
                 *[seg.field(c) for c in ("h", "start", "n", "seen")], pa.nulls(b - a, pa.binary()), made, seg.field("crowd")],
                names=schema.names)

    return tb.in_arrow(joined, _merged(run), schema)


def _merged(run, rows: int = 2000):
    """Join the many small batches of a generator into larger ones."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in run(batches):
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, count = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return wrapped


def _byte_hits(table: pa.Table, n: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the segments occur twice, by the suffix array of their bytes."""
    text = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(n + length - 1)])[:-1]
    window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(begin, n) + window
    valid = np.zeros(len(text), dtype=bool)
    valid[starts] = True
    return repeated_windows(text, valid, length)[starts]


def _word_hits(table: pa.Table, n: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the segments occur twice, by the hashes of anchor and words."""
    anchor = np.repeat(table.column("h").to_numpy(), n)
    window = table.column("windows").combine_chunks().flatten().to_numpy()
    order = np.lexsort((window, anchor))
    twin = np.flatnonzero((window[order[1:]] == window[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]]))
    out = np.zeros(len(window), dtype=bool)
    out[order[twin]] = True
    out[order[twin + 1]] = True
    return out


def _sorted_repeats(segs: DataFrame, length: int, words: bool = False) -> DataFrame:
    """(doc_id, k, lo, hi) of windows that repeat among the segments of one anchor; only segments seen once report,
    as the others are removed entirely."""
    what, hits = ("windows", _word_hits) if words else ("bytes", _byte_hits)
    schema = T.StructType([segs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("k", "lo", "hi")]])

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        n = table.column("n").to_numpy()
        window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = hits(table, n, length)
        owner = np.repeat(np.arange(len(n)), n)
        hit &= (table.column("seen").to_numpy() == 1)[owner]
        owner, window = owner[hit], window[hit]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner)) - 1 if len(owner) else first
        who = pa.array(owner[first])
        at = table.column("start").to_numpy()[owner[first]]
        columns = [table.column(c).combine_chunks().take(who) for c in ("doc_id", "k")]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(at + window[first]),
                                           pa.array(at + window[last] + length)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            anchors = batch.column(batch.schema.names.index("h")).to_numpy()
            sizes = batch.column(batch.schema.names.index("n")).to_numpy() + length - 1
            cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if size >= BATCH and anchors[lo] != last:
                    yield solve(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += int(sizes[lo:hi].sum())
                last = anchors[lo]
        if held:
            yield solve(pa.Table.from_batches(held))

    grouped = segs.select("doc_id", "k", "h", "start", "n", "seen", what).repartition("h").sortWithinPartitions("h")
    return tb.in_arrow(grouped, run, schema)


def _refined(segs: DataFrame, block: int, length: int) -> DataFrame:
    """Segments of hot anchors split into blocks of windows at equal distances from the anchor, under the hash of
    what all windows of such a block contain; adds g, the content hash."""
    schema = T.StructType([segs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in
                                                    ("k", "h", "start", "n", "seen")],
                           T.StructField("bytes", T.BinaryType()), T.StructField("anchor", T.LongType()),
                           T.StructField("g", T.LongType())])

    def split(batch: pa.RecordBatch, lo: int, texts: tb.Texts) -> list[pa.RecordBatch]:
        col = {c: batch.column(batch.schema.names.index(c)) for c in batch.schema.names}
        start, n, anchor, h = (col[c].to_numpy()[lo:lo + texts.n] for c in ("start", "n", "anchor", "h"))
        far = anchor - start  # distance of the first window; it falls by one from window to window
        parts = far // block - (far - n + 1) // block + 1
        owner = np.repeat(np.arange(texts.n), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        top = far[owner] // block - nth  # number of the block
        first = np.minimum(far[owner], (top + 1) * block - 1)
        last = np.maximum((far - n + 1)[owner], top * block)
        begin = texts.starts[owner] + far[owner] - first
        end = texts.starts[owner] + far[owner] - last + length
        core = texts.starts[owner] + far[owner] - top * block
        sums = tb.prefix_hash(tb.BYTE_CODE[texts.data])
        core_hash = tb.span_hash(sums, core, core + max(0, length - block + 1))
        key = tb.mix(core_hash ^ tb.mix(h.view(np.uint64)[owner] + top.astype(np.uint64) * tb.WORD_BASE))
        content = tb.span_hash(sums, begin, end)
        row = pa.array(owner + lo)
        data = texts.data.tobytes()
        cut = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        return [pa.RecordBatch.from_arrays(
            [col["doc_id"].take(row), col["k"].take(row), pa.array(key.view(np.int64)),
             pa.array(start[owner] + far[owner] - first), pa.array(first - last + 1), col["seen"].take(row),
             pa.array(cut, pa.binary()), col["anchor"].take(row), pa.array(content.view(np.int64))],
            names=schema.names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, texts in tb.chunks(batch.column(batch.schema.names.index("bytes"))):
                yield from split(batch, lo, texts)

    return tb.in_arrow(segs, run, schema)


def _with_anchor(segs: DataFrame, length: int) -> DataFrame:
    """Adds the anchor's place in its document: the least k-gram of the segment, leftmost, as in ``segments_of``."""
    schema = T.StructType([*segs.schema.fields, T.StructField("anchor", T.LongType())])
    gram = min(GRAM, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            column = batch.column(batch.schema.names.index("bytes"))
            start = batch.column(batch.schema.names.index("start")).to_numpy()
            n = batch.column(batch.schema.names.index("n")).to_numpy()
            for lo, hi, texts in tb.chunks(column):
                sums = tb.prefix_hash(tb.BYTE_CODE[texts.data])
                # the anchor lies in every window of the segment: between the last start and the first window's end
                room = length - gram + 1 - (n[lo:hi] - 1)
                at = np.repeat(texts.starts + n[lo:hi] - 1, room) + np.arange(int(room.sum())) - np.repeat(
                    np.cumsum(room) - room, room)
                hashes = tb.span_hash(sums, at, at + gram) >> _U(_PLACE_BITS) << _U(_PLACE_BITS)
                best = np.minimum.reduceat(hashes, np.cumsum(room) - room)
                hit = np.flatnonzero(hashes == np.repeat(best, room))
                owner = np.repeat(np.arange(texts.n), room)[hit]
                _, leftmost = np.unique(owner, return_index=True)
                places.append(at[hit[leftmost]] - texts.starts + start[lo:hi])
            made = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=schema.names)

    return tb.in_arrow(segs, run, schema)


def _repeated_words(segs: DataFrame, passage: int) -> DataFrame:
    """(doc_id, k, lo, hi) in words: as ``_sorted_repeats``, for hot anchors, whose windows are dealt out one by one."""
    windows = segs.select("doc_id", "k", "h", "start", "seen", F.posexplode("windows").alias("nth", "window"))
    twice = windows.groupBy("h", "window").agg(F.count("*").alias("found")).where("found > 1").select("h", "window")
    lo = F.col("start") + F.col("nth")
    return windows.where("seen = 1").join(twice, ["h", "window"]).select(
        "doc_id", "k", lo.alias("lo"), (lo + passage).alias("hi"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, passage: int = 0) -> DataFrame:
    """(doc_id, k, spans) of documents with something to remove; spans are unmerged (lo, hi) byte ranges. With ``passage``,
    also ``passages``: (lo, hi) ranges of words in runs of so many words that occur twice.

    ``rows`` has doc_id, text and k, a hash of the text, so that rows of one doc_id with other texts stay apart.
    """
    unit = ["unit"] if passage else []
    key = [*unit, "h", "g", "n"]
    segs = materialize(_segments(rows, length, passage), "segments")
    rank = F.xxhash64("doc_id", "k", "start")
    kinds = materialize(segs.groupBy(*key).agg(F.sum("times").alias("seen"), F.min(rank).alias("rank")), "segment_kinds")

    def crowds(table: DataFrame, *by: str) -> DataFrame:
        """The number of distinct segments of an anchor; anchors with one are decided already."""
        return table.groupBy(*by, "h").agg(F.count("*").alias("crowd")).where("crowd > 1")

    wanted = kinds.join(crowds(kinds, *unit), [*unit, "h"], "left").where("seen > 1 or crowd is not null")
    marked = materialize(segs.join(wanted, key).withColumn("one", rank == F.col("rank")).drop("g", "rank"), "marked_segments")
    size = F.when(F.col("unit") == 1, passage).otherwise(length) if passage else F.lit(length)
    whole = marked.where("seen > 1").select(
        "doc_id", "k", *unit, F.col("start").alias("lo"),
        (F.col("start") + F.col("n") * F.col("times") + (size - 1)).alias("hi"))
    found = [whole.where("unit = 0").drop("unit") if passage else whole]
    open_segs = _cut_out(rows, marked.where("one and crowd is not null"), length, passage)
    open_segs = materialize(open_segs, "open_segments")
    if passage:
        in_words = open_segs.where("windows is not null")
        passages = whole.where("unit = 1").drop("unit").union(
            _sorted_repeats(in_words.where(F.col("crowd") <= HOT), passage, words=True)).union(
            _repeated_words(in_words.where(F.col("crowd") > HOT), passage))
        open_segs = open_segs.where("windows is null").drop("windows", "crowd")
    for block in BLOCKS:
        crowded = open_segs.join(crowds(open_segs), "h")
        found.append(materialize(_sorted_repeats(crowded.where(F.col("crowd") <= HOT), length), "repeats"))
        hot = crowded.where(F.col("crowd") > HOT).drop("crowd")
        if hot.isEmpty():
            break
        if "anchor" not in hot.columns:
            hot = _with_anchor(hot, length)
        finer = materialize(_refined(hot, block, length), "refined")
        rank = F.xxhash64("doc_id", "k", "start")
        kinds = finer.groupBy("h", "g", "n").agg(F.sum("seen").alias("total"), F.min(rank).alias("rank"))
        finer = finer.join(kinds, ["h", "g", "n"])
        found.append(finer.where("total > 1 and seen = 1").select(
            "doc_id", "k", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (length - 1)).alias("hi")))
        open_segs = materialize(finer.where(rank == F.col("rank")).dropDuplicates(["h", "g", "n"])
                                .withColumn("seen", F.col("total")).drop("total", "rank", "g"), "open_segments")
    else:
        # blocks of one window: an anchor's segments can differ only if two windows' hashes agree
        found.append(_sorted_repeats(open_segs.join(crowds(open_segs), "h"), length))
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    place = F.struct("lo", "hi")
    if not passage:
        return spans.groupBy("doc_id", "k").agg(F.collect_set(place).alias("spans"))
    both = spans.withColumn("unit", F.lit(0)).union(passages.withColumn("unit", F.lit(1)))
    return both.groupBy("doc_id", "k").agg(F.collect_set(F.when(F.col("unit") == 0, place)).alias("spans"),
                                           F.collect_list(F.when(F.col("unit") == 1, place)).alias("passages"))


def word_spans(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans (starts, ends) of the words of documents, for passages; see the module's docstring."""
    starts, ends = texts.words()
    data = texts.data
    follow = [np.append(data[i:], np.zeros(min(i, len(data)), dtype=np.uint8)) for i in (0, 1)]
    # kana and ideographs; Thai and Lao; Burmese and Khmer: three bytes each; supplementary ideographs have four
    alone = (((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (follow[1] >= 0xB8) & (follow[1] <= 0xBB))
             | ((data == 0xE1) & (((follow[1] >= 0x80) & (follow[1] <= 0x82)) | ((follow[1] >= 0x9E) & (follow[1] <= 0x9F)))))
    four = (data == 0xF0) & (follow[1] >= 0xA0) & (follow[1] <= 0xB1)
    cut = np.concatenate([np.flatnonzero(alone), np.flatnonzero(alone) + 3, np.flatnonzero(four), np.flatnonzero(four) + 4])
    long = np.flatnonzero(ends - starts >= LENGTH)
    steps = (ends[long] - starts[long] - 1) // LONG_STEP
    nth = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    cut = np.concatenate([cut, np.repeat(starts[long], steps) + nth * LONG_STEP])
    if not len(cut):
        return starts, ends
    cut = np.unique(cut)
    word = np.searchsorted(starts, cut, side="right") - 1
    cut = cut[(word >= 0) & (cut > starts[word]) & (cut < ends[word])]
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


def _in_words(texts: tb.Texts) -> tb.Texts:
    """The documents with a hash for each word in place of its bytes."""
    starts, ends = word_spans(texts)
    n = np.searchsorted(starts, np.append(texts.starts, len(texts.data)))
    return tb.Texts(tb.word_hashes(texts, starts, ends), n[:-1], n[1:])


def _coded(rows: DataFrame) -> DataFrame:
    """The rows with ``CODE`` bytes for each word of the text."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("k", T.LongType()), T.StructField("text", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in tb.chunks(batch.column(2)):
                starts, ends = word_spans(texts)
                codes = tb.word_hashes(texts, starts, ends).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
                n = tb.per_doc(texts.doc_of(starts), texts.n) * CODE
                edges = np.concatenate([[0], np.cumsum(n)]).tolist()
                data = codes.tobytes()
                made = pa.array([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                                                  made], names=schema.names)

    return tb.in_arrow(rows.select("doc_id", "k", "text"), run, schema)


def _joined(docs: DataFrame, length: int, words: bool = False, passage: int = 0) -> DataFrame:
    """(row, spans): every document as a struct, beside the ranges to remove, of bytes or of codes; with ``passage``, the
    ranges of words of ``passages`` too."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("text"))
    if words:
        rows, length = _coded(rows), length * CODE
    spans = repeated_spans(rows, length, passage).withColumnsRenamed({"doc_id": "span_id", "k": "span_k"})
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("k"))
    return keyed.join(spans, F.expr("row.doc_id <=> span_id and k = span_k"), "left").select(
        "row", "spans", *(["passages"] if passage else []))


def _runs(spans: pa.StructArray | None, data: bytes | None = None) -> list[tuple[int, int]]:
    """Maximal removed runs of a document's ranges; with ``data``, of ranges of its words' codes."""
    if spans is None or len(spans) == 0:
        return []
    lo, hi = spans.field("lo").to_numpy(), spans.field("hi").to_numpy()
    if data is not None:
        starts, ends = word_spans(tb.Texts(np.frombuffer(data, dtype=np.uint8), np.array([0]), np.array([len(data)])))
        whole = _runs(pa.StructArray.from_arrays([pa.array(-(-lo // CODE)), pa.array(hi // CODE)], names=["lo", "hi"]))
        return [(int(starts[a]), int(ends[b - 1])) for a, b in whole]
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(lo)) - 1].tolist(), strict=True))


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return data
    edges = [0, *[e for run in runs for e in run], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _apply(docs: DataFrame, length: int, fields: list[tuple[str, T.DataType]], make, words: bool = False,
           passage: int = 0) -> DataFrame:
    joined = _joined(docs.select(*tb.without(docs, [n for n, _ in fields])), length, words, passage)
    place = joined.schema["row"].dataType.names.index("text")
    made = T.StructType([T.StructField("row", joined.schema["row"].dataType), *[T.StructField(n, t) for n, t in fields]])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(0).field(place).cast(pa.binary()), batch.column(1)
            rows = []
            for i in range(batch.num_rows):
                data = texts[i].as_py() or b""
                more = [_runs(batch.column(2)[i].values if lists[i].is_valid else None)] if passage else []
                rows.append(make(data, _runs(lists[i].values if lists[i].is_valid else None, data if words else None), *more))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            columns = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=made.names)

    return tb.in_arrow(joined, run, made).select("row.*", *[n for n, _ in fields])


def digests(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes), and n_passage_words, the words
    in runs of ``passage`` words that also start anywhere else; these are counted, not removed."""
    long = T.LongType()
    fields = [("n_bytes", long), ("n_removed", long), ("n_spans", long), ("kept_sha256", T.StringType()),
              ("n_passage_words", long)]
    return _apply(docs, length, fields, lambda data, runs, passages: (
        len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(data, runs)).hexdigest(),
        sum(b - a for a, b in passages)), passage=passage)


def strip_passages(docs: DataFrame, words: int) -> DataFrame:
    """As ``strip``, but what goes are runs of ``words`` words or more that occur twice, from first to last word."""
    return strip(docs, words, words=True)


def strip(docs: DataFrame, length: int = LENGTH, words: bool = False) -> DataFrame:
    """The documents with ``remaining``, their text reduced to what is left (null for a null text), and n_removed."""
    fields = [("remaining", T.StringType()), ("n_removed", T.LongType())]
    out = _apply(docs, length, fields, lambda data, runs: (
        _kept(data, runs).decode("utf-8", "ignore"), sum(b - a for a, b in runs)), words)
    return out.withColumn("remaining", F.when(F.col("text").isNotNull(), F.col("remaining")))
