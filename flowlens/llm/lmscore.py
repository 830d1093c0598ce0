"""Language-model scoring by cross-entropy difference.

Two bigram models of one form score every document: one of target documents, one of the whole corpus as background. They
share words (lower case), smoothing and order, so their losses differ only by what was counted. A document's score is its
mean loss per token under the target model less that under the background model: the lower, the closer to the target.

Counts cover every word and every pair of neighbouring words of every document under keys of their own, so the tables grow
with the corpus and nothing of them reaches the driver. The documents fall into blocks of about ``BLOCK`` bytes of text by a
hash of id and text. A block sends what it holds of each key (a word, or a pair) to the key's bucket: sorted keys and counts,
compressed. However common a word or pair is, its bucket gets it once a block. The bucket adds up and answers every block
in the order of its keys with what the other blocks hold. A block's texts and answers then meet in one task, which scores
its documents.

Words are told apart by 63 bits of a hash, as pairs are; a pair's second word does not share its count with other pairs.
The prior is spread over the distinct words of the corpus, or ``2 ** WORD_BITS`` if they are fewer.

Defined cases: a text that is null or has no word has 0 tokens and null losses and score; a null id or label row marks no
target, nor does a label without a document; ids that repeat in the labels count once, rows that repeat in the corpus each
time; without target documents the target model is uniform; an empty table gives an empty result. Extra columns pass
through; one that bears an output name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import textbytes as tb

WORD_BITS = 18
MIX = 0.6  # weight of the pair estimate where its first word was seen
PRIOR = 0.5  # added to each word's count
BLOCK, MIN_BLOCKS = 1 << 23, 128  # bytes of text, number
BUCKET, MIN_BUCKETS = 1 << 22, 128  # bytes of text for each bucket of keys, number
FIELDS = [("n_tokens", T.LongType()), *[(n, T.DoubleType()) for n in ("loss_target", "loss_background", "score")]]
_U = np.uint64


def tokens(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document of every word, and its keys: rows word (even), word before it (even, 0 at the start) and pair (odd)."""
    texts = tb.lowered(texts)
    starts, ends = texts.words()
    doc = texts.doc_of(starts)
    hashes = tb.word_hashes(texts, starts, ends)
    opening = np.ones(len(doc), dtype=bool)
    opening[1:] = doc[1:] != doc[:-1]
    before = np.roll(hashes, 1)
    before[opening] = 0
    keys = np.stack([hashes, before, tb.mix(before * tb.WORD_BASE + hashes)])
    return doc, keys >> _U(1) << _U(1) | np.array([[0], [0], [1]], dtype=np.uint64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of the columns of values by key."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    return ranked[first], np.add.reduceat(values[:, order], first, axis=1)


def _tally(column: pa.Array, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the texts, and their counts: as word or pair, as first word of a pair, and both in target documents."""
    held = [(np.zeros(0, dtype=np.uint64), np.zeros((4, 0), dtype=np.int64))]
    for lo, hi, texts in tb.chunks(column):
        doc, keys = tokens(texts)
        chosen = target[lo:hi][doc].astype(np.int64)
        one, none = np.ones_like(chosen), np.zeros_like(chosen)
        held.append(_summed(keys.ravel(), np.stack([np.concatenate(c) for c in (
            (one, none, one), (none, one, none), (chosen, none, chosen), (none, chosen, none))])))
    return _summed(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held], axis=1))


def _packed(rows: np.ndarray) -> bytes:
    """Rows of 64-bit numbers, compressed by places of their bytes."""
    planes = np.ascontiguousarray(rows).view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, rows: int, size: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, rows * size * 8, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(rows, 8, size).transpose(0, 2, 1)).view(np.int64).reshape(rows, size)


def _marked(left: pa.Table, ids: pa.ChunkedArray) -> tuple[pa.StructArray, np.ndarray]:
    """The rows of a block, and which are target documents."""
    boxed = left.column("row").combine_chunks()
    boxed = boxed.combine_chunks() if isinstance(boxed, pa.ChunkedArray) else boxed
    found = pc.is_in(boxed.field("doc_id"), value_set=ids.drop_null().cast(boxed.field("doc_id").type))
    return boxed, found.to_numpy(zero_copy_only=False)


def _asked(rows: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, size, data): what each block holds of each key, a row for every bucket."""
    shift = _U(64 - (buckets.bit_length() - 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        boxed, target = _marked(left, right.column("target_id"))
        keys, counts = _tally(boxed.field("text"), target)
        edges = np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))
        out = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            steps = np.diff(keys[lo:hi], prepend=_U(0)).view(np.int64)
            out.append(_packed(np.concatenate([steps[None], counts[:, lo:hi]])))
        block = left.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(buckets, block)), "bucket": pa.array(np.arange(buckets)),
                         "size": pa.array(np.diff(edges)), "data": pa.array(out, pa.binary())})

    return rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        run, "block long, bucket long, size long, data binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(block, bucket, size, data, words, n, n_target): what the other blocks hold of each key asked for, and the bucket's
    distinct words, tokens and tokens of target documents."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        parts = [_unpacked(d, 5, m) for d, m in zip(table.column("data").to_pylist(), sizes, strict=True)]
        keys = [np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in parts]
        known, counts = _summed(np.concatenate(keys), np.concatenate([p[1:] for p in parts], axis=1))
        data = [_packed(counts[:, np.searchsorted(known, k)] - p[1:]) for k, p in zip(keys, parts, strict=True)]
        word = (known & _U(1)) == 0
        totals = [int((word & (counts[0] > 0)).sum()), int(counts[0, word].sum()), int(counts[2, word].sum())]
        made = {n: pa.array(np.full(len(sizes), t)) for n, t in zip(("words", "n", "n_target"), totals, strict=True)}
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "size": table.column("size"),
                         "data": pa.array(data, pa.binary()), **made})

    return asked.groupBy("bucket").applyInArrow(
        run, "block long, bucket long, size long, data binary, words long, n long, n_target long")


def _losses(places: list[np.ndarray], counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """Negative log probability of each token after the one before it."""
    word, before, pair = places
    single = (counts[0, word] + PRIOR) / (total + PRIOR * size)
    before = counts[1, before]
    return -np.log(np.where(before > 0, MIX * (counts[0, pair] / np.maximum(before, 1)) + (1 - MIX) * single, single))


def _places(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of keys among the known ones; distinct keys are looked up in order, which is faster than as they come."""
    distinct, back = np.unique(keys, return_inverse=True)
    return np.searchsorted(known, distinct)[back]


def _scored(rows: DataFrame, marks: DataFrame, answers: DataFrame) -> DataFrame:
    """(row, n_tokens, loss_target, loss_background, score) of all blocks' documents."""
    made = T.StructType([rows.schema["row"], *[T.StructField(n, t) for n, t in FIELDS]])
    sent = answers.withColumn("target_id", F.lit(None).cast(marks.schema["target_id"].dataType)).unionByName(
        marks, allowMissingColumns=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        boxed, target = _marked(left, right.column("target_id"))
        right = right.filter(right.column("bucket").is_valid()).sort_by("bucket")
        known, counts = _tally(boxed.field("text"), target)
        counts += np.concatenate([_unpacked(d, 4, m) for d, m in zip(
            right.column("data").to_pylist(), right.column("size").to_pylist(), strict=True)], axis=1)
        words, n, n_target = (sum(right.column(c).to_pylist()) for c in ("words", "n", "n_target"))
        size, length, losses = max(words, 1 << WORD_BITS), [], []
        for _, _, texts in tb.chunks(boxed.field("text")):
            doc, keys = tokens(texts)
            places = [_places(k, known) for k in keys]
            length.append(tb.per_doc(doc, texts.n))
            losses.append([np.bincount(doc, weights=_losses(places, c, total, size), minlength=texts.n)
                           / np.maximum(length[-1], 1) for c, total in ((counts[2:], n_target), (counts[:2], n))])
        length, losses = np.concatenate(length), [np.concatenate(m) for m in zip(*losses, strict=True)]
        columns = [pa.array(v, mask=length == 0) for v in (*losses, losses[0] - losses[1])]
        return pa.Table.from_arrays([boxed, pa.array(length), *columns], names=made.names)

    return rows.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, made)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Score all documents against the model of those whose doc_id is among ``target_ids``: n_tokens, loss_target,
    loss_background (means per token) and score, their difference."""
    docs = docs.select(*tb.without(docs, [n for n, _ in FIELDS]))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(MIN_BLOCKS, -(-n_bytes // BLOCK))
    buckets = 1 << (max(MIN_BUCKETS, -(-n_bytes // BUCKET)) - 1).bit_length()
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), block.alias("block"))
    chosen = target_ids.select(F.col("doc_id").alias("target_id")).where("target_id is not null").distinct()
    marks = docs.select("doc_id", block.alias("block")).join(chosen, F.expr("doc_id = target_id")).select("block", "target_id")
    answers = _answered(_asked(rows, marks, buckets))
    return _scored(rows, marks, answers).select("row.*", *[n for n, _ in FIELDS])
