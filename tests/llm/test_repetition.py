"""Repetition coverage against a plain Python count."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from flowlens.llm import repetition as R
from flowlens.llm import textbytes as tb

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup_lines += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    cover = []
    for n in R.NGRAM_SHARES:
        seen, covered = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i:i + n])
            if g in seen:
                covered |= set(range(i, i + n))
            seen.add(g)
        cover.append(sum(len(words[i]) for i in covered))
    chars = sum(map(len, words))
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    kept = not failed and dup_chars <= 0.20 * chars and all(
        c <= s * chars for c, s in zip(cover, R.NGRAM_SHARES.values(), strict=True))
    return {"n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": dup_lines, "n_repeat_words": len(hit), "dup_line_chars": dup_chars,
            "dup_ngram_chars": cover, "base_failed": failed, "kept": kept}


def measured(texts, limit=tb.CHUNK_BYTES):
    rows = []
    for _, _, t in tb.chunks(pa.array(texts, pa.string()), limit):
        got = R.measure(t)
        rows += [{k: np.asarray(v[i]).tolist() for k, v in got.items()} for i in range(t.n)]
    return rows


TEXTS = st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "cé", "d#", " ", "\n", "\t", " ", "漢", "x y"]),
                                      max_size=150).map(" ".join), st.text(max_size=60))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_equals_plain_count(texts):
    assert measured(texts) == [plain(t) for t in texts]
    assert measured(texts, limit=1) == [plain(t) for t in texts]


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b\na b", 5), (3, " \n\n", 5), (4, "w " * 200_000, 5), (4, "w " * 200_000, 5),
            (5, " ".join(f"w{i}" for i in range(60)), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = R.judge(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in got) == sorted(
        [("1", 0, False), ("2", 0, False), ("None", 4, False), ("3", 0, False), ("4", 200_000, False),
         ("4", 200_000, False), ("5", 60, True)])
    assert {r.extra for r in got} == {5}
    assert R.judge(df.limit(0)).count() == 0
    clash = R.judge(df.withColumnRenamed("extra", "kept"))
    assert clash.columns.count("kept") == 1 and {r.kept for r in clash.collect()} == {True, False}
