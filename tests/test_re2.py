"""Patterns in RE2 syntax: which compile, and what Java finds in their place."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlens.config import DEFAULT
from flowlens.functions import text as T
from flowlens.functions.re2 import to_java

ACCEPTED = [r"^\++$", r"^[*+]x$", r"^[a-z&&[^b]+$", r"[]a]+", r"[^]a]", r"^*", r"(?i)abc", r"\pL+", r"\p{Greek}", r"[[:alpha:]_-]",
            r"\Q.*\E+", r"a$b", r"(?m)^a$", r"\x{61}\x62", r"\07", r"[\w.-]+", r"(?U)a+", r"()*", r"x{,3}", r"\_", r"\z", r"[--a]",
            r"[a-c-e]", r"[\d-z]", r"x*?", r"(?i-s:a.)b", r"(?)", r"]", r"}", r"{", r"a{", r"a{2", r"|", r"a|b|", r"(?P<n>a)"]
REJECTED = [r"^\h+$", r"a**", r"a*+", r"a++", r"a{2}{3}", r"(?=a)b", r"(?<!a)b", r"(?>a)", r"(a)\1", r"a{1001}", r"a|*", r"*a", r"(*a)",
            r"(?P<n>a)(?P<n>b)", r"[a-\d]", r"a{3,2}", r"[b-a]", r"\C", r"\Z", r"a)", r"(a", r"[a", r"[a-", r"\8", r"\18", r"(?i", r"[[:foo:]]",
            r"\e", r"\p{Foo}", r"\G", r"\k<a>", r"a\ ".strip(), "\\", r"\x{110000}", r"(?-)", r"(?i-)"]


@pytest.mark.parametrize("pattern", ACCEPTED)
def test_accepted(pattern):
    assert to_java(pattern) is not None


@pytest.mark.parametrize("pattern", REJECTED)
def test_rejected(pattern):
    assert to_java(pattern) is None


TEXTS = ["", "a", "b", "ab", "aB", "+", "++", "*x", "+x", "a&b", "[", "]", "a]", "é", "Ω", "ω", "a\n", "\na", "a\nb", "x\ra", "x\x85a",
         " ", "\t", "\x0b", "\n", "a.b", "..", "aaa", "aaaa", "-", "a-b", "7", "77", "_", "a_", "A", "ABC", "abc", "{", "a{2", "}",
         "x{,3}", "\\", "K", "ſ", "漢", "𝄞", "a b", "b a", "é a", "\x07"]


def found(spark, patterns):
    """Per pattern the texts it is found in, by DuckDB's RE2 (None where it does not compile) and by Spark."""
    con, out = duckdb.connect(), []
    usable = [p for p in patterns if to_java(p) is not None]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string")
    rows = df.select("i", *[F.col("t").rlike(to_java(p)).alias(f"c{k}") for k, p in enumerate(usable)]).collect()
    for k, p in enumerate(usable):
        try:
            want = {i for i, t in enumerate(TEXTS) if con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0]}
        except duckdb.Error:
            want = None
        out.append((p, want, {r["i"] for r in rows if r[f"c{k}"]}))
    return out


def test_same_texts_are_found(spark):
    for p, want, got in found(spark, [p for p in ACCEPTED if p not in (r"(?)",)]):
        if want is not None:
            assert got == want, (p, [TEXTS[i] for i in got ^ want])


def test_random_patterns(spark):
    rng = random.Random(3)
    atoms = ["a", "b", ".", "[ab]", "[^a]", "[a&&[b]", r"\d", r"\W", r"\s", "(a|b)", "(?:ab)", "^", "$", r"\b", r"\B", "[[:punct:]]",
             r"\n", "é", r"\pL", "(?i)A", "(?m)^", "(?s).", "[+*]", r"\+", "-", "&", "]", r"[\s\w]", r"[\]\[]", r"\x{e9}", "(?i:B)"]
    tails = ["", "", "", "*", "+", "?", "{2}", "{1,}", "*?", "{0,2}?"]
    patterns = ["".join(rng.choice(atoms) + rng.choice(tails) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    checked = 0
    for p, want, got in found(spark, patterns):
        if want is not None:
            checked += 1
            if r"\B" in p:  # DuckDB's engine also looks between the bytes of one character
                want, got = ({i for i in x if TEXTS[i].isascii()} for x in (want, got))
            assert got == want, (p, to_java(p), [TEXTS[i] for i in got ^ want])
    assert checked > 90


def test_user_patterns_normalize(spark):
    opts = DEFAULT.with_(user_patterns=(r"^\++$", r"^[*+]x$", r"^[a-z&&[^b]]+$", r"^\h+$"))
    rows = [("/+++/y",), ("/*x",), ("/c]",), ("/cd",), ("/ ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(T.normalize_path("p", opts)).collect()]
    assert got == ["/{id}/y", "/{id}", "/{id}", "/cd", "/ "]
