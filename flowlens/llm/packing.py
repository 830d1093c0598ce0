"""Packing token sequences as vector bin packing with the dot-product heuristic.

A sequence has limits on three things at once: tokens, segments, and loss-bearing tokens. Documents become token ids and
an end id; parts that fill a sequence alone are cut off first, and what is left waits in a pool. An open sequence takes,
among the items that fit in every dimension, the one with the largest dot product of its demand and the sequence's
remaining room, weighted by the pool's mean demand per dimension. When nothing fits and cutting is allowed, the longest
item is cut to fill the gap, and its rest stays in the pool.

No shuffle and bounded memory: tokenizing and packing stream through each input partition with a pool of ``POOL`` items, and
only a partition's last sequence is left short for want of items. A sequence id is the partition's number and a counter,
so a repeated task gives the same ids.

Where a vocabulary's pre-tokenizer never joins over ASCII white space (checked when it is loaded), texts are split there, the
distinct words of about ``GROUP_BYTES`` of texts are looked up together by 64-bit hashes, and their ids are remembered within
``WORD_MEMORY`` bytes a worker; the result equals encoding the whole text. With any other vocabulary whole texts are encoded.

Defined cases: a null text is empty, so its ids are the end id alone; a null doc_id is kept; equal rows are packed each on
their own; an empty table gives no pieces; extra columns are ignored. Without cutting, an example above a limit is still cut
so that each part fits.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlens.llm import textbytes as tb

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core

END_ID = 1
END = np.array([END_ID], dtype="<u4")
POOL = 512
WORD_MEMORY = 64 << 20  # bytes of remembered words a worker process keeps
GROUP_BYTES = 1 << 20  # texts looked up together
IS_MARK = np.zeros(256, dtype=bool)
IS_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True  # neither space, letter nor digit
IS_PART = np.zeros(256, dtype=bool)  # letters and digits that are parted from marks after them
IS_PART[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
#: Fixed value: the split pattern of a pre-tokenizer under which words can be looked up alone.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ROWS_OUT = 4096


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Item:
    """Ids [start, start + len(ids)) of a document; those from ``loss_from`` on bear loss."""

    doc: object
    start: int
    ids: np.ndarray
    loss_from: int
    doc_tokens: int

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.loss_from))

    def fitting(self, tokens: int, loss: int) -> int:
        """Most leading ids within so many tokens and loss-bearing tokens."""
        return min(len(self.ids), tokens, max(0, self.loss_from - self.start) + loss)

    def cut(self, n: int) -> tuple[Item, Item]:
        return (Item(self.doc, self.start, self.ids[:n], self.loss_from, self.doc_tokens),
                Item(self.doc, self.start + n, self.ids[n:], self.loss_from, self.doc_tokens))


class Memory:
    """Ids of words under 64-bit hashes of the words: sorted keys with places in one flat array of ids. A young part takes
    new words and is merged into the old one when it has grown; past ``WORD_MEMORY`` bytes the old part is dropped."""

    def __init__(self):
        self.old, self.young = _table(), _table()
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, size) of each key; size -1 where it is not known."""
        place, size = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), -1, dtype=np.int64)
        for known, places, sizes in (self.old, self.young):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                place[hit], size[hit] = places[at[hit]], sizes[at[hit]]
        return place, size

    def add(self, keys: np.ndarray, ids: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        """Takes new keys, whose ids are at their places in ``ids``."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(self.used // 4 + len(ids), dtype="<u4")])
        self.flat[self.used:self.used + len(ids)] = ids
        self.young = _merged(self.young, (keys, (place + self.used).astype(np.uint32), size.astype(np.uint32)))
        self.used += len(ids)
        if len(self.young[0]) > max(1 << 15, len(self.old[0]) // 4):
            self.old, self.young = _merged(self.old, self.young), _table()

    def trim(self) -> None:
        """Called between groups, so that no place in use moves."""
        if 16 * (len(self.old[0]) + len(self.young[0])) + 4 * len(self.flat) > WORD_MEMORY:
            self.__init__()


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)


def _merged(one: tuple, two: tuple) -> tuple:
    columns = [np.concatenate(c) for c in zip(one, two, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


class Words:
    """Token ids of texts: by way of remembered words where the vocabulary's pre-tokenizer allows it, else whole texts.

    Word by word, each distinct word of a group of texts is looked up once. New ones are encoded together: one of letters
    only is one unit of the pre-tokenizer, so it ends with the first id that stands for an end of word; the others get a
    separator word between them, whose single id no other word contains, and those that hold the separator's character are
    encoded alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _parts_words(self.tokenizer)
        if self.by_word:
            self.memory = Memory()
            (self.separator,) = self.tokenizer.encode("~", add_special_tokens=False).ids
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, dtype="<u4")

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place and size of each word's ids in them)."""
        texts = [w.decode("utf-8", "replace") for w in words]
        place, size = np.zeros((2, len(words)), dtype=np.int64)
        made, used = [], 0

        def put(which, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
            nonlocal used
            place[which], size[which] = used + begin, end - begin
            made.append(ids)
            used += len(ids)

        plain = np.fromiter(map(str.isalpha, texts), dtype=bool, count=len(texts))
        letters, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        if len(letters):
            ids = self._ids(" ".join([texts[i] for i in letters.tolist()]))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(letters):
                put(letters, ids, np.concatenate([[0], ends[:-1]]), ends)
            else:
                others = np.arange(len(texts))
        odd = np.array(["~" in texts[i] for i in others.tolist()], dtype=bool)
        if len(marked := others[~odd]):
            ids = self._ids(" ~ ".join([texts[i] for i in marked.tolist()]))
            cuts = np.flatnonzero(ids == self.separator)
            put(marked, ids, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]]))
        for i in others[odd].tolist():
            ids = self._ids(texts[i])
            put(i, ids, 0, len(ids))
        return np.concatenate(made), place, size

    def ids(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a group, end of each text's ids)."""
        return self._words_ids(texts) if self.by_word else self._whole_ids(texts)

    def _whole_ids(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        data = texts.data.tobytes()
        spans = zip(texts.starts.tolist(), texts.ends.tolist(), strict=True)
        made = self.tokenizer.encode_batch_fast([data[a:b].decode("utf-8", "replace") for a, b in spans], add_special_tokens=False)
        return (np.concatenate([np.array(m.ids, dtype="<u4") for m in made]),
                np.cumsum([len(m.ids) for m in made], dtype=np.int64))

    def _words_ids(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        self.memory.trim()
        data, starts, ends = _pieces(texts)
        if not len(starts):
            return END[:0], np.zeros(texts.n, dtype=np.int64)
        keys, first, back = np.unique(tb.span_hash(tb.prefix_hash(tb.BYTE_CODE[data]), starts, ends), return_index=True,
                                      return_inverse=True)
        place, size = self.memory.find(keys)
        if len(fresh := np.flatnonzero(size < 0)):
            held = data.tobytes()
            spans = zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)
            self.memory.add(keys[fresh], *self._encode([held[a:b] for a, b in spans]))
            place, size = self.memory.find(keys)
        place, size = place[back], size[back]
        to = np.cumsum(size)
        ids = self.memory.flat[np.repeat(place - to + size, size) + np.arange(to[-1])]
        done = np.searchsorted(starts, texts.ends)  # pieces before each text's end
        return ids, np.concatenate([[0], to])[done]


def _parts_words(tokenizer) -> bool:
    """Whether the vocabulary is lower case, and its pre-tokenizer joins nothing over white space and parts letters and
    digits from the marks after them: then words may be looked up in lower case, without the marks that end them."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    steps = json.loads(tokenizer.normalizer.__getstate__()).get("normalizers", [])
    parts = json.loads(tokenizer.pre_tokenizer.__getstate__()).get("pretokenizers", [{}])
    return ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern") == {"Regex": WORD_PATTERN}
            and parts[0].get("behavior") == "Removed" and getattr(tokenizer.model, "end_of_word_suffix", None) == "</w>")


def _pieces(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, starts, ends) of the words of a group, marks that end a word as pieces of their own. A word
    that may hold a special token's name stays as it is."""
    data = tb.LOWER[texts.data]
    starts, ends = texts.words()
    if not len(starts):
        return data, starts, ends
    plain = np.flatnonzero(~IS_MARK[data])
    core = np.searchsorted(plain, ends) - 1  # the last byte of a word that is no mark
    core = np.where(core >= 0, plain[np.maximum(core, 0)] if len(plain) else -1, -1) + 1
    cut = (core > starts) & (core < ends)
    cut[cut] = IS_PART[data[core[cut] - 1]]
    for at in np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))):
        k = np.searchsorted(starts, at, side="right") - 1
        if k >= 0 and at + 1 < ends[k]:
            data[starts[k]:ends[k]], cut[k] = texts.data[starts[k]:ends[k]], False
    return data, np.sort(np.concatenate([starts, core[cut]])), np.sort(np.concatenate([ends, core[cut]]))


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One Words a worker process and vocabulary, so later tasks of the process start with its memory."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


class Packer:
    """Sequences from a stream of items; ``ready`` holds finished ones as lists of items."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut, self.pool, self.ready = limits, cut, [], deque()

    def add(self, item: Item) -> None:
        limits = self.limits
        while len(item.ids) >= limits.tokens or item.loss > limits.loss:
            part, item = item.cut(item.fitting(limits.tokens, limits.loss))
            if len(part.ids) == limits.tokens:
                self.ready.append([part])
            else:
                self.pool.append(part)
        if len(item.ids):
            item.ids = item.ids.copy()  # not a view that keeps the whole document
            self.pool.append(item)
        if len(self.pool) >= POOL:
            self._pack(POOL // 2)

    def finish(self) -> None:
        self._pack(0)

    def _pack(self, leave: int) -> None:
        limits = self.limits
        room_all = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        size = np.array([[len(i.ids), 1, i.loss] for i in self.pool], dtype=float).reshape(-1, 3) / room_all
        here = np.ones(len(size), dtype=bool)
        while here.sum() > leave:
            weight = size[here].mean(axis=0)
            room, chosen, slack = np.ones(3), [], 1e-9
            while True:
                fits = here & (size <= room + slack).all(axis=1)
                if not fits.any():
                    break
                at = int(np.argmax(np.where(fits, size @ (weight * room), -1.0)))
                chosen.append(self.pool[at])
                here[at] = False
                room = room - size[at]
            left = (room * room_all).round().astype(int)
            if self.cut and left[0] > 0 and left[1] > 0 and here.any():
                at = int(np.argmax(np.where(here, size[:, 0], -1.0)))
                n = self.pool[at].fitting(int(left[0]), int(left[2]))
                if 0 < n < len(self.pool[at].ids):
                    part, rest = self.pool[at].cut(n)
                    chosen.append(part)
                    self.pool[at] = rest
                    size[at] = np.array([len(rest.ids), 1, rest.loss]) / room_all
            self.ready.append(chosen)
        self.pool = [i for i, stays in zip(self.pool, here, strict=True) if stays]


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), cut: bool = True, prompt: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, loss_tokens,
    sequence_id, offset and, if asked for, ids. Ids of the text of the column named by ``prompt`` come first and bear no
    loss; all others do."""
    long = T.LongType()
    fields = [docs.schema["doc_id"], *[T.StructField(c, long) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(long)))
    schema = T.StructType(fields)

    def rows(packer: Packer, base: int, count: int) -> Iterator[tuple]:
        while packer.ready:
            at = 0
            for item in packer.ready.popleft():
                crc = zlib.crc32(item.ids.tobytes())
                row = (item.doc, item.start, len(item.ids), crc, item.doc_tokens, item.loss, base + count, at)
                yield (*row, item.ids.tolist()) if with_ids else row
                at += len(item.ids)
            count += 1

    def batch_of(held: list[tuple], first: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        arrays = [pa.array(columns[0], type=first), *[pa.array(c, type=pa.int64()) for c in columns[1:8]]]
        if with_ids:
            arrays.append(pa.array(columns[8], type=pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = words_of(tokenizer), Packer(limits, cut)
        base, held, first = TaskContext.get().partitionId() << 36, [], None
        done = 0
        for batch in batches:
            first = batch.column(0).type
            for lo, hi, texts in tb.chunks(batch.column(1), GROUP_BYTES):
                parts = [words.ids(texts)]
                if prompt:
                    ((_, _, asked),) = tb.chunks(batch.column(2).slice(lo, hi - lo), 1 << 62)
                    parts.insert(0, words.ids(asked))
                for k, row in enumerate(range(lo, hi)):
                    mine = [ids[ends[k - 1] if k else 0:ends[k]] for ids, ends in parts]
                    whole = np.concatenate([*mine, END])
                    packer.add(Item(batch.column(0)[row].as_py(), 0, whole, len(mine[0]) if prompt else 0, len(whole)))
                    ready = len(packer.ready)
                    held.extend(rows(packer, base, done))
                    done += ready
                    if len(held) >= ROWS_OUT:
                        yield batch_of(held, first)
                        held = []
        packer.finish()
        held.extend(rows(packer, base, done))
        if held:
            yield batch_of(held, first)

    return tb.in_arrow(docs.select("doc_id", "text", *([prompt] if prompt else [])), run, schema)
