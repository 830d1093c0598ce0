"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's largest response in a fixed-length window
is kept (max pooling), and a dense layer with softmax gives the window's language. A text is cut into consecutive
windows (a filter at a window's end sees into the next, padding follows the last), so every byte counts; the windows'
probabilities are averaged by their bytes. Windows of many documents go through the network together, in blocks.

Training runs in numpy on the driver, on windows of at most about ``TRAIN_DOCS`` labelled documents (a documented bound
on a fitted model): rates per label come from a count over all labelled documents, so labels are balanced and the
sample is drawn by hash over the whole table. Nothing else is sampled. Inference is one pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null label is never learned from; with no
labelled text everything is ``und``; with one label that label has probability 1; a null doc_id is neither held out nor
learned from; ties go to the first label in code point order; equal texts get equal results; an empty table gives an empty
result. Extra columns pass through; one that bears an output name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import textbytes as tb

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBED = 8
TRAIN_DOCS = 6000  # labelled documents to learn from, in expectation
TRAIN_WINDOWS, WINDOWS_PER_DOC = 12_000, 16  # windows cut from them: about so many, and at most so many of one document
STEPS, BATCH, RATE = 1200, 64, 4e-3  # so many steps whatever the sample: a small one is seen more often
PAD = 256  # index of the padding byte
BLOCK = 1 << 15  # byte positions computed at once
UNKNOWN = "und"


@dataclass
class Network:
    """Weights: embedding (257, EMBED), filters (max width * EMBED, all filters), dense layer; and the labels."""

    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, index: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window of (windows, WINDOW + max width - 1) byte indices."""
        x = self.embed[index]
        span = max(WIDTHS) * EMBED
        near = np.lib.stride_tricks.as_strided(x, (len(x), WINDOW, span), (x.strides[0], x.strides[1], x.strides[2]))
        out = np.ascontiguousarray(near).reshape(-1, span) @ self.filters
        return out.reshape(len(x), WINDOW, -1).max(axis=1)

    def probabilities(self, index: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(index) + self.bias, 0) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _filter_mask() -> np.ndarray:
    """Which weights of the widest filter each narrower one has."""
    mask = np.zeros((max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width * EMBED, i * FILTERS:(i + 1) * FILTERS] = 1
    return mask


def train(windows: np.ndarray, truth: np.ndarray, labels: list[str], seed: int = 1) -> Network:
    """Fit by Adam on (n, WINDOW + max width - 1) byte indices and label numbers."""
    rng = np.random.default_rng(seed)
    wide, total = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = _filter_mask()
    net = Network(labels, rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
                  (rng.normal(0, 0.15, mask.shape) * mask).astype(np.float32), np.zeros(total, np.float32),
                  rng.normal(0, 0.1, (total, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    names = ["embed", "filters", "bias", "dense", "dense_bias"]
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    while step < STEPS:
        order = rng.permutation(len(windows))
        for at in range(0, min(len(order), (STEPS - step) * BATCH), BATCH):
            pick = order[at:at + BATCH]
            index, want, n = windows[pick], truth[pick], len(pick)
            x = net.embed[index]
            near = np.stack([x[:, j:j + WINDOW] for j in range(wide)], axis=2).reshape(n, WINDOW, wide * EMBED)
            response = near @ net.filters
            where = response.argmax(axis=1)
            top = np.take_along_axis(response, where[:, None, :], axis=1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            z = hidden @ net.dense + net.dense_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), want] -= 1
            p /= n
            back = (p @ net.dense.T) * (top > 0)
            seen = near[np.arange(n)[:, None], where]  # (n, filters, wide * EMBED)
            to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(n, total, wide, EMBED)
            touched = index[np.arange(n)[:, None, None], where[:, :, None] + np.arange(wide)]
            embed = np.zeros_like(net.embed)
            np.add.at(embed, touched.ravel(), to_bytes.reshape(-1, EMBED))
            slopes = {"embed": embed, "filters": np.einsum("nk,nkd->dk", back, seen) * mask, "bias": back.sum(axis=0),
                      "dense": hidden.T @ p, "dense_bias": p.sum(axis=0)}
            step += 1
            for name, g in slopes.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                move = first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - RATE * move).astype(np.float32))
    return net


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | None:
    """Learn from text and lang of documents that are not held out; None if there are none."""
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return None
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("lang") == label, min(1.0, train_docs / len(labels) / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.where(has_letter(F.col("text")) & (draw < share)).select(
        "lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit(12)).alias("h"))
    length = WINDOW + max(WIDTHS) - 1
    expected = sum(min(n, train_docs / len(labels)) for n in counts.values())
    per_doc = max(1, min(WINDOWS_PER_DOC, round(TRAIN_WINDOWS / expected)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column(1).cast(pa.binary())
            for lang, text, h in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                data = text.as_py()
                room = max(1, len(data) - WINDOW + 1)
                for k in range(min(per_doc, -(-len(data) // WINDOW))):
                    at = (h // (k * 7919 + 1)) % room
                    out.append((lang, data[at:at + length], h, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(
                    zip(*out, strict=True), (pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                    names=["lang", "window", "h", "k"])

    rows = sorted(tuple(r) for r in sample.mapInArrow(cut, "lang string, window binary, h long, k long").collect())
    if not rows:
        return None
    windows = np.full((len(rows), length), PAD, dtype=np.int16)
    for i, r in enumerate(rows):
        windows[i, :len(r[1])] = np.frombuffer(bytes(r[1]), dtype=np.uint8)
    number = {label: i for i, label in enumerate(labels)}
    return train(windows, np.array([number[r[0]] for r in rows]), labels)


def identify(texts: tb.Texts, net: Network) -> np.ndarray:
    """(documents, labels) probabilities; documents without bytes get zeros."""
    sizes = texts.ends - texts.starts
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(texts.n), windows)
    out = np.zeros((texts.n, len(net.labels)))
    if not len(owner):
        return out
    begin = texts.starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
    end = texts.ends[owner]
    reach = np.arange(WINDOW + max(WIDTHS) - 1)
    got = []
    for at in range(0, len(owner), BLOCK // WINDOW):
        place = begin[at:at + BLOCK // WINDOW, None] + reach
        inside = place < end[at:at + BLOCK // WINDOW, None]
        index = np.where(inside, texts.data[np.minimum(place, len(texts.data) - 1)], np.int16(PAD))
        got.append(net.probabilities(index))
    scored = np.concatenate(got) * np.minimum(end - begin, WINDOW)[:, None]
    for k in range(len(net.labels)):
        out[:, k] = np.bincount(owner, weights=scored[:, k], minlength=texts.n)
    return out / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """The documents with lang_pred and score (the label's mean probability)."""
    marker = "has letter"
    while marker in map(str.lower, docs.columns):
        marker += "'"
    docs = docs.withColumn(marker, has_letter(F.col("text")))

    def compute(batch: pa.RecordBatch) -> list:
        letters = tb.column(batch, marker).to_numpy(zero_copy_only=False)
        names, scores = [], []
        if net is None:
            return [[UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows]
        for lo, hi, texts in tb.chunks(tb.column(batch, "text")):
            p = identify(texts, net)
            best = p.argmax(axis=1)
            known = letters[lo:hi]
            names += [net.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            scores += np.where(known, np.minimum(p.max(axis=1), 1.0), 0.0).tolist()
        return [names, scores]

    return tb.with_columns(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())], compute).drop(marker)
