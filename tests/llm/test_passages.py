"""Passages of the substring stage against a plain search for equal runs of words."""

import random
from collections import Counter

import pytest

from flowlens.llm import suffixes as S


def plain(texts, size):
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1 for j in range(i, i + size)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


def text(rng, n, low=1, high=8):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(low, high))) for _ in range(n))


def test_stage_finds_51_words_under_400_bytes(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C
    rng = random.Random(3)
    passage, short, tiny = text(rng, 51, 2, 5), text(rng, 50, 8, 9), text(rng, 51, 1, 1)
    assert 200 < len(passage.encode()) < 300 and len(short.encode()) > 400
    texts = [f"{text(rng, 80)} {p} {text(rng, 70)}" for p in (passage, passage, short, short, tiny, tiny)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in C.substring_dedup(spark, docs, "").collect()}
    assert [got[i].text.split() for i in range(6)] == plain(texts, 51)
    assert [len(got[i].text.split()) for i in range(6)] == [150, 150, 200, 200, 150, 150]
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize(("size", "hot"), [(5, 256), (5, 1), (51, 256)])
def test_equals_plain_search(spark, monkeypatch, size, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(size + hot)
    shared = [text(rng, 2 * size) for _ in range(3)]
    texts = []
    for _ in range(30):
        parts = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(shared).split()
            parts.append(" ".join(s[rng.randint(0, 4):rng.randint(size - 1, 2 * size)]) if rng.random() < 0.5 else text(rng, rng.randint(0, 60)))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[0], "", "a " * (3 * size)]
    df = spark.createDataFrame([(i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, k int")
    got = {r.k: r.remaining.split() for r in S.strip_passages(df, size).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, size)


def test_scripts_without_spaces(spark):
    rng = random.Random(9)
    han = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(60))
    blob = "".join(rng.choices("0123456789abcdef", k=900))
    texts = [f"a{han}b", f"cd {han}", f"x {blob} y", f"z {blob}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.remaining for r in S.strip_passages(df, 51).collect()}
    assert got == {0: "ab", 1: "cd ", 2: "x  y", 3: "z "}
