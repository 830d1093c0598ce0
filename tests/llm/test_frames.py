"""Fill-in-middle over frames against plain strings, and exact round trips."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import frames as X


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain(doc_id, text, rule=X.Rule()):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = sha(f"{rule.seed}:{'' if doc_id is None else doc_id}")
    h = [int(hexed[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rule.percent:
        return n, "plain", None, None, text
    if h[3] % 100 < rule.spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXT = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(
    ["a", "né", "\n", "\n\n", "漢字", "𝄞", "<", "<P", "P>", "<S>", "<M", "\r\n", " "]), max_size=60).map("".join))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 10**12)), TEXT, st.integers(1, 9), st.sampled_from([0, 30, 100]))
def test_one_document(doc_id, text, frame, percent):
    shelf, rule = X.Shelf(frame), X.Rule(percent=percent, spm_percent=40)
    stored = shelf.store(text.encode())
    out, form, chars = X.transform(shelf, stored, doc_id, rule)
    n, want_form, p, m, output = plain(doc_id, text, rule)
    assert (stored.n_lines, form, chars) == (n, want_form, None if p is None else (p, m))
    assert b"".join(shelf.read(out, 0, out.size)) == output.encode()
    assert shelf.digest(out) == sha(output)
    spans = X.source_spans(shelf, out, form)
    assert b"".join(d for a, b in spans for d in shelf.read(out, a, b)) == text.encode()
    assert (out.size, out.chars[-1] if out.chars else 0) == (len(output.encode()), len(output))
    assert out.n_lines == len(re.findall(r"[^\n]*\n|[^\n]+", output))


def test_only_cut_frames_are_opened():
    shelf = X.Shelf(1000)
    text = "".join(f"line {i} é\n" for i in range(20_000)).encode()
    stored = shelf.store(text)
    opened, inner = [], shelf.decompress
    shelf.decompress = lambda f: opened.append(1) or inner(f)
    assert shelf.cut(stored, 12_345)[0] == len("".join(f"line {i} é\n" for i in range(12_345)).encode())
    assert len(opened) == 1
    out, _, _ = X.transform(shelf, stored, 3, X.Rule())
    assert len(opened) <= 8  # two cuts, a first and a last piece of each part at most, the last byte
    assert len(set(stored.frames) & set(out.frames)) >= len(stored.frames) - 3


def test_whole_table(spark):
    rng = random.Random(2)
    texts = ["\n".join("wörd " * rng.randint(0, 30) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n"]) for _ in range(60)]
    rows = [(i, t, i) for i, t in enumerate([*texts, None, "", "\n", "no break", "has <S> mark", "x" * 300_000 + "\n" + "é\n" * 90_000])]
    rows += [rows[3], (None, "null id\nb", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form int")
    stored = X.store(df, frame_bytes=1 << 12)
    got = X.fill_in_middle(stored, frame_bytes=1 << 12)
    assert X.texts(stored).columns == ["doc_id", "form", "text"]
    assert sorted(map(str, X.texts(stored).select("doc_id", "text").collect())) == sorted(
        map(str, df.na.fill({"text": ""}).select("doc_id", "text").collect()))
    made = X.texts(got.drop("form"), "output").collect()
    key = lambda r: tuple(map(str, r))
    want = [(i, *plain(i, t)) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.n, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256, r.text) for r in made), key=key) \
        == sorted(((i, n, p, m, sha(o), sha(dict((a, b) for a, b, _ in rows)[i] or ""), o) for i, n, _, p, m, o in want), key=key)
    assert sorted(str(r.form) for r in got.collect()) == sorted(w[2] for w in want)
    assert {"plain", "spm", "psm"} == {w[2] for w in want}
    assert X.fill_in_middle(X.store(df.limit(0))).count() == 0


@pytest.mark.parametrize("mark", [b"<P>", b"<M>"])
def test_marks_across_frames(mark):
    for frame in (1, 2, 3, 4):
        shelf = X.Shelf(frame)
        held = X.Frames()
        shelf.put(held, b"<<S<" + mark + b"z")
        assert shelf.find(held, mark, 0) == 4
    with pytest.raises(ValueError):
        shelf.find(held, b"<Q>", 0)
