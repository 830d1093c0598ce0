"""Registered queries of the corpus operators: each applies one operator, with production parameters, to its whole
table and derives the digest columns of its contract from the operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import (frames, html, langid, lmscore, minhash, mixing, nndescent, packing, recipes, repetition, sharding,
                          suffixes, survival)

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a byte convolutional network learned from those not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings of a label at a cosine of 0.98."""
    return nndescent.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document by repetition coverage."""
    out = repetition.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    coverage = [F.get("dup_ngram_chars", F.lit(i)).alias(f"dup_{n}gram_chars") for i, n in enumerate(repetition.NGRAM_SHARES)]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "dup_line_chars", *coverage)


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into 24 shards through fixed virtual slots; law: bytes."""
    out = sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op6_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 400-byte strings that occur twice in the corpus, removed from every document."""
    return suffixes.digests(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents by weighted fair queueing."""
    out = mixing.allot(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the language of the documents labelled as good, and of all."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lmscore.cross_entropy_difference(docs, good).drop("text")


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of all documents on sets of 3-word shingles at a similarity of 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of all documents, letter case of A-Z aside, by recipes of content-defined chunks."""
    out = recipes.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, cut and digested on its compressed frames."""
    stored = frames.store(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return frames.fill_in_middle(stored, outputs=False)


def op13_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters over all documents, from the survivors of their subsets."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return survival.interactions(docs, _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_byte_network, op2_nn_descent, op3_layout_rendering, op4_repetition_coverage, op5_virtual_slots,
    op6_two_stage_suffixes, op7_fair_queueing, op8_cross_entropy_difference, op9_vector_packing,
    op10_fast_similarity_sketching, op11_chunk_recipes, op12_seekable_frames, op13_survival_words)} | {"pipeline": corpus_pipeline.run}

_GRAMS = ", ".join(f"({n})" for n in (3, *repetition.NGRAM_SHARES))
_COVER = ",\n  ".join(f"coalesce(max(chars) FILTER (WHERE n = {n}), 0)::BIGINT AS dup_{n}gram_chars"
                     for n in repetition.NGRAM_SHARES)
_LOW = " AND ".join(f"dup_{n}gram_chars <= {share}::DOUBLE * word_chars" for n, share in repetition.NGRAM_SHARES.items())

_STEPS = ",\n  ".join(
    f"('{o}', {k + 1}, {1 << survival.FILTERS.index(o[k])}, {sum(1 << survival.FILTERS.index(c) for c in o[:k])})"
    for o in survival.ORDERS for k in range(len(o)))

ORACLE_SQL = {
    "op11_chunk_recipes": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY low ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(low) AS text_sha256
FROM n WINDOW same AS (PARTITION BY low)
""",
    "op12_seekable_frames": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
hashed AS (
  SELECT *, len(u) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
         ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
         THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:one], ''), '') AS p, coalesce(array_to_string(u[one + 1:two], ''), '') AS m,
         coalesce(array_to_string(u[two + 1:n], ''), '') AS s FROM cuts),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                 ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(substr(output, 4), '<S>', 1) || split_part(output, '<M>', 2)
                    || split_part(split_part(output, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2)
         || split_part(substr(output, 4), '<P>', 1) END) AS restored_sha256
FROM made
""",
    "op13_survival_words": f"""
WITH told AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
  FROM labels GROUP BY doc_id),
w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id FROM documents),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 50)::INT * 1 + (100 * len(list_distinct(ws)) < 65 * len(ws))::INT * 2
    + (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT * 4
    + regexp_matches(text, '[#$%&*|]')::INT * 8 + coalesce(doc_id > least_id, false)::INT * 16 AS failed
  FROM w LEFT JOIN told USING (doc_id)),
steps(filter_order, step, bit, before) AS (VALUES
  {_STEPS}),
tallied AS (SELECT part, good, toxic, failed, count(*) AS c FROM judged GROUP BY ALL),
counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(c) FILTER (WHERE failed & (before + bit) = 0), 0) AS kept,
    coalesce(sum(c) FILTER (WHERE failed & before = 0 AND failed & bit > 0), 0) AS removed,
    coalesce(sum(c) FILTER (WHERE failed & before > 0 AND failed & bit > 0), 0) AS redundant,
    coalesce(sum(c) FILTER (WHERE failed = bit), 0) AS unique_fails,
    coalesce(sum(c) FILTER (WHERE failed & before = 0 AND failed & bit > 0 AND good = 1), 0) AS good_lost,
    coalesce(sum(c) FILTER (WHERE failed & before = 0 AND failed & bit > 0 AND toxic = 1), 0) AS toxic_lost
  FROM tallied, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
""",
    "op2_nn_descent": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON x = vec_id
""",
    "op4_repetition_coverage": f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
grams AS (
  SELECT rid, n, s, array_to_string(ws[s:s + n - 1], ' ') AS gram
  FROM (SELECT rid, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS s FROM w, (VALUES {_GRAMS}) sizes(n)) x),
marked AS (
  SELECT rid, n, s, count(*) OVER (PARTITION BY rid, n, gram) AS times,
         row_number() OVER (PARTITION BY rid, n, gram ORDER BY s) AS nth FROM grams),
covered AS (
  SELECT DISTINCT rid, n, s + k AS i FROM marked, range(0, 10) steps(k)
  WHERE k < n AND CASE WHEN n = 3 THEN times > 1 ELSE nth > 1 END),
cover AS (
  SELECT c.rid, c.n, count(*) AS words, sum(length(w.ws[c.i])) AS chars FROM covered c JOIN w ON w.rid = c.rid GROUP BY ALL),
lines AS (
  SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS nth
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) x
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup_lines AS (
  SELECT rid, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_line_chars
  FROM lines WHERE nth > 1 GROUP BY rid),
per_doc AS (
  SELECT rid, coalesce(max(words) FILTER (WHERE n = 3), 0)::BIGINT AS n_repeat_words,
  {_COVER}
  FROM (SELECT rid, n, words, chars FROM cover UNION ALL SELECT rid, 0, 0, 0 FROM w) x GROUP BY rid),
counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
    p.* EXCLUDE (rid), len(ws) < 50 OR 100 * p.n_repeat_words > 50 * len(ws) AS base_failed
  FROM w JOIN per_doc p ON p.rid = w.rid LEFT JOIN dup_lines l ON l.rid = w.rid)
SELECT *, NOT base_failed AND dup_line_chars <= {repetition.LINE_SHARE}::DOUBLE * word_chars AND {_LOW} AS kept FROM counted
""",
    "op10_fast_similarity_sketching": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON x = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
""",
    "op7_fair_queueing": """
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src_rank FROM sizes),
weighted AS (
  SELECT *, CASE src_rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, src_rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, src_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v
  FROM weighted),
targets AS (
  SELECT *, least(cap, weight * max(CASE WHEN v <= cap / weight THEN v END) OVER ()) AS target FROM levels),
queued AS (
  SELECT s.*, t.source_size, t.target, t.total, t.weight, t.src_rank,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, e, (e * source_size + cum)::DOUBLE / weight AS finish
  FROM queued q, (VALUES (0), (1), (2)) AS epochs(e) WHERE size > 0),
run AS (
  SELECT h, source, size, total, sum(size) OVER (ORDER BY finish, src_rank, h, e ROWS UNBOUNDED PRECEDING) AS upto
  FROM copies),
taken AS (SELECT h, source, sum(size)::BIGINT AS taken FROM run WHERE upto <= total GROUP BY h, source)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.h = t.h AND q.source IS NOT DISTINCT FROM t.source
""",
}
