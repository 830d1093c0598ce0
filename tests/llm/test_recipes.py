"""Chunk recipes against a plain grouping of the lower-cased texts."""

import hashlib
import random
import string
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm import recipes as R

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string"


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and how many rows of each group stay."""
    held = defaultdict(list)
    for i, t in rows:
        held[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in held.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out


def agrees(got, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(plain(rows), key=key)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({r.text_sha256 for r in got})


def prose(rng, n):
    return " ".join("".join(rng.choices("aeionsbcdgüÄ漢𝄞", k=rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (0, 1, 40, 300, 300, 3000)] + ["x" * 30_000, "漢" * 9_000, "\n" * 700]
    near = [t[:-1] + "!" for t in base if t] + [t[:len(t) // 2] + t[len(t) // 2 + 1:] for t in base if t]
    texts = [rng.choice([*base, *near]) for _ in range(120)]
    texts = [t.upper().replace("Ü", "ü").replace("Ä", "Ä") if k % 5 == 0 and t.isascii() else t for k, t in enumerate(texts)]
    made = [(rng.randint(-50, 60), t) for t in texts] + [(None, base[3]), (None, base[3]), (None, "only null"), (7, None), (8, "")]
    return made + made[:9]


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_groups_equal_plain_grouping(spark, rows, bits):
    """Few bits give the same fingerprint to many chunks: identifiers must still tell them apart."""
    agrees(R.groups(spark.createDataFrame(rows, SCHEMA), bits=bits).collect(), rows)


def test_hot_group_and_layout(spark):
    rows = [(i, "the same words " * 40 if i % 3 == 0 else f"words of {i} " * 30) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    agrees(R.groups(df).collect(), rows)
    agrees(R.groups(df.repartition(13).orderBy("text")).collect(), rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAéÉ \n漢𝄞ſK", max_size=12)), min_size=1, max_size=12))
def test_lower_case_is_ascii_only(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(R.lowered(F.col("t")).alias("low"))
    assert [r.low for r in df.collect()] == [(t or "").translate(LOWER) for t in texts]


def test_chunks_are_cut_by_content(spark):
    rng = random.Random(8)
    a, b = prose(rng, 2500), prose(rng, 2500)
    df = spark.createDataFrame([(0, a), (1, "zz " + a), (2, a[:4000] + b), (3, "")], SCHEMA)
    got = {r.doc_id: r.c for r in df.select("doc_id", R.chunks(F.col("text")).alias("c")).collect()}
    assert ["".join(got[i]) for i in range(4)] == [a, "zz " + a, a[:4000] + b, ""]
    assert max(map(len, got[0])) <= R.MAX_CHARS and min(map(len, got[0][:-1])) >= R.MIN_CHARS
    assert len(set(got[0]) & set(got[1])) > len(got[0]) // 2  # a moved text finds its cuts again
    assert got[0][:3] == got[2][:3]


def test_dedup_keeps_columns(spark):
    rows = [(1, "A b", 5, "u"), (2, "a B", 6, "v"), (2, "a B", 6, "v"), (3, "other", None, None), (None, None, 1, "w"), (4, "", 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_id long, kept string")
    got = R.dedup(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[1], rows[3], rows[5]]))
    assert R.dedup(df.limit(0)).count() == 0 and R.groups(df.limit(0)).count() == 0
