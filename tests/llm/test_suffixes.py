"""Suffix-array dedup against a plain search for equal windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import suffixes as S


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("ab", max_size=80), st.text("\x00abc", max_size=60), st.binary(max_size=60)), st.integers(1, 12))
def test_suffix_order(text, depth):
    text = text.encode() if isinstance(text, str) else text
    order = S.suffix_order(np.frombuffer(text, dtype=np.uint8), depth)
    assert sorted(order.tolist()) == list(range(len(text)))
    cut = [(text[i:i + depth] + b"\0" * depth)[:depth] for i in order]
    assert cut == sorted(cut)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=2, max_size=60), st.integers(1, 20), st.data())
def test_common_prefixes(text, depth, data):
    text = text.encode()
    pairs = [data.draw(st.permutations(range(len(text))))[:2] for _ in range(5)]
    got = S.common_prefixes(np.frombuffer(text, np.uint8), np.array([p[0] for p in pairs]),
                            np.array([p[1] for p in pairs]), depth)
    for (a, b), n in zip(pairs, got, strict=True):
        want = 0
        while want < depth and max(a, b) + want < len(text) and text[a + want] == text[b + want]:
            want += 1
        assert n == want


def corpus(rng, length):
    words = ["ab", "c", "dé", "the", "e\n", "漢", "xyz "]
    shared = ["".join(rng.choices(words, k=length)) for _ in range(3)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choices(words, k=rng.randint(0, 60))))
            if rng.random() < 0.2:
                s = rng.choice(shared)
                parts.append(s[rng.randint(0, 9):rng.randint(10, len(s))])
        texts.append("".join(parts))
    return [*texts, None, "", "a" * 300, "a" * 300 + "b", "ab" * 150, texts[0], texts[0]]


@pytest.mark.parametrize(("length", "hot"), [(40, 256), (40, 2), (23, 1)])
def test_equals_plain_search(spark, monkeypatch, length, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = corpus(random.Random(length + hot), length)
    rows = [(None if i == 3 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int, n_spans string")
    got = {r.k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(df, length).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, length)


def test_planted_passages_of_over_50_words(spark):
    rng = random.Random(8)

    def words(n, low, high):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(low, high))) for _ in range(n))

    long, short = words(60, 7, 9), words(60, 3, 5)
    assert len(long.encode()) > 400 > len(short.encode())
    texts = [f"{words(80, 3, 9)} {p}{end} {words(70, 3, 9)}" for p in (long, short) for end in (".", "!")]
    texts.append(words(150, 3, 9))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in S.digests(df).collect()}
    got = [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(5)]
    assert got == plain(texts, 400)
    assert all(rows[i].n_removed >= len(long.encode()) for i in (0, 1))
    assert [rows[i].n_removed for i in (2, 3, 4)] == [0, 0, 0]


def passage_words(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in split for i in range(len(w) - size + 1))
    return [len({j for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1 for j in range(i, i + size)})
            for w in split]


@pytest.mark.parametrize(("size", "hot", "piece"), [(51, 256, 1 << 22), (14, 2, 1 << 22), (5, 1, 64)])
def test_words_of_passages(spark, monkeypatch, size, hot, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(size)

    def words(n, low=1, high=6):
        return " ".join("".join(rng.choices("abcdefghijké", k=rng.randint(low, high))) for _ in range(n))

    shared = [words(2 * size) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(shared).split()
            cut = s[rng.randint(0, 4):rng.randint(size - 1, 2 * size)]
            parts.append(rng.choice([" ", "\n"]).join(cut) if rng.random() < 0.5 else words(rng.randint(0, 60)))
        texts.append(rng.choice([" ", "\t", "  "]).join(parts))
    texts += [None, "", " ", texts[0], texts[1] + " end", "a " * (3 * size), f"{shared[0]} x {shared[0]}", "é" * 150]
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, i, 7) for i, t in enumerate(texts)],
                               "doc_id long, text string, k int, n_passage_words int")
    got = {r.k: r for r in S.digests(df, passage=size).collect()}
    assert [got[i].n_passage_words for i in range(len(texts))] == passage_words(texts, size)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256)
            for i in range(len(texts))] == plain(texts, 400)


def test_passages_shorter_than_400_bytes_are_told(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(600)]
    long, short = " ".join(words[:51]), " ".join(words[51:101])
    texts = [f"{' '.join(words[110 + 60 * i:170 + 60 * i])} {p}{end}" for i, (p, end) in enumerate(
        [(long, " x"), (long, " y"), (short, " x"), (short, " y"), ("", "")])]
    rows = {r.doc_id: r for r in S.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].n_passage_words for i in range(5)] == [51, 51, 0, 0, 0]
    assert [rows[i].n_removed for i in range(5)] == [0] * 5


def test_pieces_of_a_long_text(monkeypatch, spark):
    monkeypatch.setattr(S, "PIECE", 64)
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdef", k=90))
    texts = ["".join(rng.choices("abcdef", k=700)) + passage + "".join(rng.choices("abcdef", k=333)), "z" + passage, passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(df, 40).collect()}
    assert [got[i] for i in range(3)] == plain(texts, 40)


def test_strip_and_empty(spark):
    texts = ["é" * 30, "é" * 30, None, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.remaining, r.n_removed) for r in S.strip(df, 40).collect()}
    assert got == {0: ("", 60), 1: ("", 60), 2: (None, 0), 3: ("short", 0)}
    assert S.digests(df.limit(0), 40).count() == 0
