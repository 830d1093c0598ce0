"""Each stage of the pipeline against a brute-force version, on its own input."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402
from test_minhash import plain as near_plain  # noqa: E402
from test_mixing import plain as mix_plain  # noqa: E402
from test_packing import checked  # noqa: E402
from test_passages import plain as cut_plain  # noqa: E402

from flowlens.llm import langid, packing  # noqa: E402

SF = "/root/testdata/sf0.001"


def row_key(r):
    return tuple(str(v) for v in r)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = {}
    for k, (name, stage) in enumerate(C.STAGES):
        inputs[name] = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    names = inputs["language_id"].columns
    assert all(d.columns == names for d in inputs.values())
    rows = {n: d.collect() for n, d in inputs.items()}

    net = langid.fit(inputs["language_id"])
    scored = langid.predict(inputs["language_id"], net).collect()
    good = {r.doc_id for r in scored if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in rows["near_dedup"]} == good and len(good) > 0.97 * len(scored)

    groups = near_plain([(r.doc_id, r.text) for r in rows["near_dedup"]], 5, 80)
    want = [r for r in rows["near_dedup"] if groups[r.doc_id] == r.doc_id]
    assert sorted(map(row_key, rows["substring_dedup"])) == sorted(map(row_key, want)) and len(want) < len(good)

    before = rows["substring_dedup"]
    after = {r.doc_id: r for r in rows["mix_sources"]}
    left = cut_plain([r.text for r in before], C.PASSAGE_WORDS)
    for r, words in zip(before, left, strict=True):
        if r.doc_id in after:
            assert after[r.doc_id].text.split() == words
            assert after[r.doc_id].n_chars == (len(after[r.doc_id].text) if after[r.doc_id].text != r.text else r.n_chars)
        else:
            assert not words
    assert any(len(w) < len(r.text.split()) for r, w in zip(before, left, strict=True))

    mixed = rows["mix_sources"]
    plan = mix_plain([(r.doc_id, r.source, r.text) for r in mixed], (5.0, 2.0, 1.0), 3, 1.0, "mix-1")
    want = Counter({p[0]: p[4] // p[1] for p in plan if p[4]})
    assert Counter(r.doc_id for r in rows["pack_sequences"]) == want

    twice = Counter(r.doc_id for r in rows["pack_sequences"])
    single = docs.collect()
    assert Counter(r.doc_id for r in single if r.start == 0) == twice
    tokens = Counter()
    for r in single:
        tokens[r.sequence_id] += r.length
    assert max(tokens.values()) <= 2048
    once = inputs["pack_sequences"].dropDuplicates(["doc_id"])
    checked([(r.doc_id, r.text) for r in once.collect()],
            packing.pack(once, C.public_tokenizers.path(C.TOKENIZER)).collect(), packing.Limits())


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(None, None, None, None, None, None), (1, "", "en", "a", 0, 1), (2, "the cat sat " * 300, None, None, 1, 2),
            (2, "the cat sat " * 300, None, None, 1, 2), (3, "the cat sat " * 300, "en", "a", 1, 2), (4, "der Hund " * 90_000, "de", "a", 1, 2),
            (5, "a b c", "en", "b", 5, 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        C.STAGES[-1][1](spark, docs, SF).collect()


def test_run_is_registered(spark):
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"] is C.run and C.ORACLE_SQL is None
