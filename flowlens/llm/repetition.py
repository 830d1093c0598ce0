"""Quality rules by repetition coverage.

Rolling hashes of several word n-gram lengths, over all documents of a batch at once in numpy, give the code points
that lie inside n-grams seen earlier in the same text; lines equal to an earlier line are measured alike. A document
is kept if it passes the base rules and no coverage exceeds its share of the text's word characters.

No shuffle: each document is judged alone, inside the scan's partitions; hot sources or copies change nothing.

Defined cases: a null, empty or blank text has zero words and fails the base rules; a line without a word is no
line; ties (equal lines or n-grams) count the first as the original; equal rows get equal results; an empty table
gives an empty result. n-grams are compared by 64-bit hashes within one document. Extra columns pass
through; one that bears an output name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlens.llm import textbytes as tb

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Largest share of word characters inside repeated n-grams, by n-gram length in words.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters inside repeated lines.
LINE_SHARE = 0.20

LONG = T.LongType()
FIELDS = [("n_words", LONG), ("word_chars", LONG), ("n_symbols", LONG), ("n_dup_lines", LONG), ("n_repeat_words", LONG),
          ("dup_line_chars", LONG), ("dup_ngram_chars", T.ArrayType(LONG)), ("base_failed", T.BooleanType()),
          ("kept", T.BooleanType())]


def measure(texts: tb.Texts, shares: dict[int, float] = NGRAM_SHARES, line_share: float = LINE_SHARE) -> dict:
    """Counts and verdicts of one chunk of documents, as arrays in document order."""
    n, data = texts.n, texts.data
    starts, ends = texts.words()
    doc = texts.doc_of(starts)
    sums = tb.prefix_hash(tb.BYTE_CODE[data])
    words = tb.span_hash(sums, starts, ends)
    point = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])
    chars = point[ends] - point[starts]
    salt = tb.mix(np.arange(1, n + 1, dtype=np.uint64))
    symbol = np.zeros(256, dtype=np.int64)
    symbol[list(SYMBOLS)] = 1
    marks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(symbol[data], out=marks[1:])
    out = {"n_words": tb.per_doc(doc, n), "word_chars": tb.per_doc(doc, n, chars),
           "n_symbols": marks[texts.ends] - marks[texts.starts]}

    line_starts, line_ends = texts.lines()
    line_doc = texts.doc_of(np.minimum(line_starts, max(len(data) - 1, 0)))
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~tb.IS_SPACE[data] & ((data & 0xC0) != 0x80), out=inside[1:])
    line_chars = inside[line_ends] - inside[line_starts]
    real = line_chars > 0
    line_doc, line_chars = line_doc[real], line_chars[real]
    _, later = tb.repeats(tb.span_hash(sums, line_starts[real], line_ends[real]) ^ salt[line_doc])
    out["n_dup_lines"] = tb.per_doc(line_doc[later], n)
    out["dup_line_chars"] = tb.per_doc(line_doc[later], n, line_chars[later])

    rolled = words.copy()
    covers = {}
    for size in range(2, max([3, *shares]) + 1):
        if size > len(words):
            covers.setdefault("none", None)
            break
        rolled = rolled[:-1] * tb.WORD_BASE + words[size - 1:]
        if size != 3 and size not in shares:
            continue
        whole = np.flatnonzero(doc[:len(rolled)] == doc[size - 1:])
        many, later = tb.repeats(tb.mix(rolled[whole]) ^ salt[doc[whole]])
        if size == 3:
            covers["all"] = _covered(whole[many], 3, len(words))
        if size in shares:
            covers[size] = _covered(whole[later], size, len(words))
    nothing = np.zeros(len(words), dtype=bool)
    out["n_repeat_words"] = tb.per_doc(doc[covers.get("all", nothing)], n)
    dup = [tb.per_doc(doc[c], n, chars[c]) for c in (covers.get(size, nothing) for size in shares)]
    out["dup_ngram_chars"] = list(np.stack(dup, axis=1)) if dup else [[]] * n

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    kept = ~out["base_failed"] & (out["dup_line_chars"] <= line_share * out["word_chars"])
    for share, covered in zip(shares.values(), dup, strict=True):
        kept &= covered <= share * out["word_chars"]
    out["kept"] = kept
    return out


def _covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words that lie inside the n-grams that start at ``at``."""
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


def judge(docs: DataFrame, shares: dict[int, float] = NGRAM_SHARES, line_share: float = LINE_SHARE) -> DataFrame:
    """The documents with FIELDS appended (counts, coverage by n-gram length in the order of ``shares``, verdict)."""

    def compute(batch: pa.RecordBatch) -> list:
        parts = [measure(texts, shares, line_share) for _, _, texts in tb.chunks(tb.column(batch, "text"))]
        return [[v for p in parts for v in p[name]] for name, _ in FIELDS]

    return tb.with_columns(docs, FIELDS, compute)
