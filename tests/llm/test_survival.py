"""Filter interactions against plain sequential filtering in all 120 orders."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import survival as V

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def failed(rows, i):
    doc_id, text, _ = rows[i]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {f for f, bad in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
                            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", bool(re.search("[#$%&*|]", text))),
                            ("E", doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows)))
           if bad}
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = [failed(rows, i) for i in range(len(rows))]
    out, shapley = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [i for i in left if f in fails[i]]
                stay = [i for i in left if f not in fails[i]]
                redundant = sum(f in fails[i] for i in mine) - len(gone)
                out[part, "".join(order), k + 1] = [len(stay), len(gone), redundant, sum(fails[i] == {f} for i in mine),
                                                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
                shapley[part, f] += len(gone)
                left = stay
    return {(p, o, k, *v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def corpus(rng, n):
    rows = []
    for i in range(n):
        size = rng.choice([0, 10, 49, 50, 51, 80, 200])
        words = [rng.choice(["Wort", "wörd", f"w{rng.randint(0, 300)}", f"v{rng.randint(0, 300)}", "漢字"]) for _ in range(size)]
        text = rng.choice([" ", "\n", " \t"]).join(words)
        if rng.random() < 0.2:
            text += rng.choice([" #", "|", " 5%", "$"])
        if rng.random() < 0.2:
            text = text.upper()
        if rng.random() < 0.3 and rows:
            text = rng.choice(rows)[1]
        rows.append((rng.choice([i, i, i, rng.randint(0, n), None]), rng.choice([text] * 9 + [None]), rng.choice(["a", "b", "b", "", None])))
    return rows


def test_equals_every_order(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = corpus(rng, 150)
        rows += rows[:5]
        labels = [(rng.choice([rng.randint(0, 150), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
        got = V.interactions(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 600 * len({r[2] or "" for r in rows})
        assert {tuple(r) for r in got} == plain(rows, labels)


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "w " * 300_000, "x"), (3, "w " * 300_000, "x"), (None, "", "x")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], DOCS + ", label int, part string")
    none = spark.createDataFrame([], LABELS)
    assert {tuple(r) for r in V.interactions(docs, none).collect()} == plain(rows, [])
    assert V.interactions(docs.limit(0), none).count() == 0
    schema = dict(V.interactions(docs, none).dtypes)
    assert schema.pop("part") == schema.pop("filter_order") == "string" and schema.pop("step") == "int"
    assert set(schema.values()) == {"bigint"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 2**32 - 1)), max_size=80))
def test_positional_counts(pairs):
    pairs = sorted(pairs, key=lambda p: p[0])
    got = V.bit_counts(np.array([w for _, w in pairs], dtype=np.uint32), np.array([g for g, _ in pairs], dtype=np.int64), 8)
    want = np.zeros((8, 32), dtype=int)
    for g, w in pairs:
        want[g] += [(w >> b) & 1 for b in range(32)]
    assert (got == want).all()


def test_words():
    assert V.WORDS[0] == 2**32 - 1 and V.WORDS[31] == 1
    assert all(bool(V.WORDS[f] >> s & 1) == (f & s == 0) for f in range(32) for s in range(32))
