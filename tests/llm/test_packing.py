"""Packing: pieces tile documents and sequences, limits hold, ids equal a plain encoding of the whole text."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from flowlens.llm import packing as P  # noqa: E402
from flowlens.llm import textbytes as tb  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
WORDS = P.Words(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(
    ["it's", "we'll", "Σας", "İI", "a", " ", "\n", "\x1c", "\x85", "́", "é", "é", "<|endoftext|>", "12.5", "漢字",
     "~~", " ", "'s", "ǅ", "<|startoftext|>x", "<|ENDOFTEXT|>", "Ab.,", "x).", "»,", "~", "a~b.", "3.5.", "it's.", "...", "İ."]), max_size=20).map("".join)))
def test_ids_equal_whole_text(text):
    assert ids_of(WORDS, [text])[0] == PLAIN.encode(text, add_special_tokens=False).ids


def ids_of(words, texts):
    ((_, _, group),) = tb.chunks(pa.array(texts))
    ids, ends = words.ids(group)
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@pytest.mark.parametrize("memory", [1 << 26, 1])
def test_groups_of_texts(monkeypatch, memory):
    """Texts without white space between them, words known from earlier groups, and a memory that is dropped every time."""
    monkeypatch.setattr(P, "WORD_MEMORY", memory)
    rng, words = random.Random(4), P.Words(PATH)
    for _ in range(30):
        group = ["".join(rng.choices(["it", "x9", ".", "., ", " ", "\n", "é", "~", "<|endoftext|>", "漢", "ab"], k=rng.randint(0, 30)))
                 for _ in range(rng.randint(1, 12))]
        assert ids_of(words, group) == [PLAIN.encode(t, add_special_tokens=False).ids for t in group]


def test_other_vocabularies_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, rows = Tokenizer.from_file(path), [*texts(20, 6), (90, None), (91, "  Two  spaces.\n")]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, with_ids=True).collect()
    made = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        made[r.doc_id] += r.ids
    assert made == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}


def checked(rows, pieces, limits):
    want = {i: [*PLAIN.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p.doc_id][p.start:p.start + p.length]
        assert len(ids) == p.length > 0 and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        docs[p.doc_id].append((p.start, p.length))
        seqs[p.sequence_id].append((p.offset, p.length, p.loss_tokens))
    for group, ends in ((docs, {i: len(v) for i, v in want.items()}), (seqs, {})):
        for key, spans in group.items():
            at = 0
            for start, length, *_ in sorted(spans):
                assert start == at
                at += length
            assert at == ends.get(key, at)
    assert docs.keys() == want.keys()
    for spans in seqs.values():
        assert sum(s[1] for s in spans) <= limits.tokens and len(spans) <= limits.segments
        assert sum(s[2] for s in spans) <= limits.loss
    return [sum(s[1] for s in spans) for spans in seqs.values()]


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["a", "lorem", "x1", "größe", "zzz,"], k=rng.choice([0, 1, 5, 60, 300, 4000])))) for i in range(n)]


@pytest.mark.parametrize("limits", [P.Limits(), P.Limits(256, 3, 256), P.Limits(128, 64, 50)])
def test_pieces(spark, limits):
    rows = [*texts(150, 1), (900, None), (901, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    out = P.pack(df, PATH, limits)
    got = out.collect()
    full = checked(rows, got, limits)
    if limits == P.Limits():
        assert sum(n < limits.tokens for n in full) <= 3
    # a table gives the same sequences again
    assert P.pack(df.limit(0), PATH, limits).count() == 0


def test_reruns_agree(spark, tmp_path):
    spark.createDataFrame(texts(80, 3), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    runs = [sorted(P.pack(spark.read.parquet(str(tmp_path / "t")), PATH).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string").coalesce(1)
    got = P.pack(df, PATH, with_ids=True).collect()
    assert sorted(len(r.ids) for r in got) == [1, 3, 3] and {r.doc_id for r in got} == {None}


def test_whole_examples_with_prompts(spark):
    rows = [(i, f"q{i} " * (i % 7), "answer " * (i % 11 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(1)
    limits = P.Limits(40, 5, 20)
    got = P.pack(df, PATH, limits, cut=False, prompt="prompt").collect()
    assert len(got) == 60 and all(r.length == r.doc_tokens for r in got)
    loss = {i: len(PLAIN.encode(a, add_special_tokens=False).ids) + 1 for i, _, a in rows}
    assert all(r.loss_tokens == loss[r.doc_id] for r in got)
    groups = defaultdict(list)
    for r in got:
        groups[r.sequence_id].append(r)
    for g in groups.values():
        assert sum(r.length for r in g) <= 40 and len(g) <= 5 and sum(r.loss_tokens for r in g) <= 20
