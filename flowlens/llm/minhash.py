"""MinHash near-dedup by fast similarity sketching.

Sketch: in each round every shingle of a document is hashed to a bin and a value; a round's values lie above those of
all earlier rounds, and the sketch keeps the least value of each bin. After ``COORDINATES`` random rounds as many
rounds follow whose bin is the round's own, so every coordinate is filled, whatever the size of the set; two sets agree
in a coordinate with probability equal to their similarity, concentrated as for independent samples. Rounds stop for
a document as soon as its bins are full, which is after the first round for all but short texts.

Candidates: a few coordinates make a band (``ROWS``, fewer for lower thresholds); documents that share a band meet in a
bucket. Copies
(equal word sequences) are one class before any of this. In a bucket no pairs are listed: all members meet one leader,
links found so far are closed to components, and only buckets that still hold several components go on. In those of more
than ``WIDE`` members, blocks of documents that differ in component are compared by products of shingle incidence matrices,
which report at most one link a document. In the others, members of the smallest components are the next leaders, until
every member has met or is joined to all others. So no link between co-bucketed documents is lost, and no step emits more
than a bounded number of rows per member.

Every link is confirmed on the full shingle sets.

Defined cases: a null text, or one without words, has an empty set and links with nothing; with fewer words than a
shingle the whole sequence is the one shingle; a null doc_id takes no part (component null, kept); rows that share a
doc_id are one document, whose rows' links add up; equal rows get equal results; an empty table gives an empty result.
Shingles are compared by 64-bit hashes within a pair of documents. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowlens.llm import textbytes as tb
from flowlens.llm.components import components
from flowlens.session import materialize

COORDINATES = 120
#: Rows of a band by least similarity in percent: copies at the threshold share no band in fewer than one case in 10,000.
ROWS = {85: 6, 80: 5, 70: 4, 0: 3}
WIDE = 64  # members of a bucket beyond which documents are compared in blocks
BLOCK = 512  # documents of a block, at most about so many
VOCABULARY = 4096  # shingles of an incidence matrix at a time
FIRST_LEADERS = 16  # four times as many in each round that is still needed
_U = np.uint64


def shingle_hashes(texts: tb.Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash) of every shingle in text order, repeats included, and two 64-bit digests of each document's whole
    word sequence."""
    texts = tb.lowered(texts)
    starts, ends = texts.words()
    doc = texts.doc_of(starts)
    words = tb.word_hashes(texts, starts, ends)
    count = tb.per_doc(doc, texts.n)
    first = np.concatenate([[0], np.cumsum(count)])
    d1 = tb.span_hash(tb.prefix_hash(words), first[:-1], first[1:])
    d2 = tb.span_hash(tb.prefix_hash(tb.mix(words ^ _U(0x5851F42D4C957F2D))), first[:-1], first[1:])
    rolled = words.copy()
    for n in range(2, size + 1):
        rolled = rolled[:-1] * tb.WORD_BASE + words[n - 1:] if len(rolled) else rolled
    whole = doc[:len(rolled)] == doc[size - 1:] if len(rolled) else np.zeros(0, dtype=bool)
    short = np.flatnonzero((count > 0) & (count < size))
    docs = np.concatenate([doc[:len(rolled)][whole], short])
    hashes = np.concatenate([tb.mix(rolled[whole]), d1[short]])
    order = np.argsort(docs, kind="stable") if len(short) else slice(None)
    return docs[order], hashes[order], d1, d2


def distinct(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, sorted by document."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def sketch(docs: np.ndarray, hashes: np.ndarray, n: int, coordinates: int = COORDINATES) -> np.ndarray:
    """(n, coordinates) uint64 sketches; rows of documents without shingles stay at the largest value."""
    empty = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * coordinates, empty, dtype=np.uint64)
    for r in range(2 * coordinates):
        x = tb.mix(hashes + tb.mix(np.full(1, r + 1, dtype=np.uint64)))
        if r < coordinates:
            bins = ((x >> _U(32)) * _U(coordinates) >> _U(32)).astype(np.int64)
        else:
            bins = r - coordinates
        np.minimum.at(out, docs * coordinates + bins, (_U(r) << _U(32)) | (x & _U(0xFFFFFFFF)))
        open_docs = (out.reshape(n, coordinates) == empty).any(axis=1)
        going = open_docs[docs]
        if not going.any():
            break
        if not going.all():
            docs, hashes = docs[going], hashes[going]
    return out.reshape(n, coordinates)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value per band of ``rows`` coordinates."""
    parts = tb.mix(sketches).reshape(len(sketches), -1, rows)
    out = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(rows):
        out = tb.mix(out * tb.WORD_BASE + parts[:, :, k])
    return out


def sketched(docs: DataFrame, size: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands) of every row of docs."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in tb.chunks(batch.column(1)):
                doc, hashes, d1, d2 = shingle_hashes(texts, size)
                doc, hashes = distinct(doc, hashes)
                count = tb.per_doc(doc, texts.n)
                made = bands(sketch(doc, hashes, texts.n), rows).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(count > 0, made.shape[1], 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[count > 0].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(d1.view(np.int64)),
                     pa.array(d2.view(np.int64)), lists], names=schema.names)

    return tb.in_arrow(docs.select("doc_id", "text"), run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets satisfy 100 * intersection >= percent * union, as (src, dst)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts_a in tb.chunks(batch.column(2)):
                for at, end, texts_b in tb.chunks(batch.column(3).slice(lo, hi - lo)):
                    part = tb.Texts(texts_a.data, texts_a.starts[at:end], texts_a.ends[at:end])
                    part = tb.Texts(part.data[part.starts[0]:part.ends[-1]], part.starts - part.starts[0],
                                    part.ends - part.starts[0])
                    doc_a, hash_a = distinct(*shingle_hashes(part, size)[:2])
                    doc_b, hash_b = distinct(*shingle_hashes(texts_b, size)[:2])
                    n = end - at
                    total = tb.per_doc(doc_a, n) + tb.per_doc(doc_b, n)
                    doc = np.concatenate([doc_a, doc_b])
                    union = tb.per_doc(distinct(doc, np.concatenate([hash_a, hash_b]))[0], n)
                    good = (union > 0) & (100 * (total - union) >= percent * union)
                    rows = np.flatnonzero(good) + lo + at
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)),
                                                      batch.column(1).take(pa.array(rows))], names=["src", "dst"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return tb.in_arrow(joined, run, "src long, dst long")


def _joined_in_block(texts: tb.Texts, size: int, percent: int) -> np.ndarray:
    """For each document the first of the block that it reaches by links inside the block."""
    doc, hashes = distinct(*shingle_hashes(texts, size)[:2])
    n = texts.n
    count = tb.per_doc(doc, n)
    _, number, often = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = often[number] > 1
    doc, number = doc[shared], np.unique(number[shared], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    doc, number = doc[order], number[order]
    both = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, VOCABULARY):
        a, b = np.searchsorted(number, [lo, lo + VOCABULARY])
        part = np.zeros((n, VOCABULARY), dtype=np.float32)
        part[doc[a:b], number[a:b] - lo] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    link = (100 * both >= percent * (count[:, None] + count[None, :] - both)) & (both > 0)
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        low = np.where(link, label[None, :], n).min(axis=1)
        if (low == label).all():
            return label
        label = low


def block_links(split: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(src, dst) that join all documents of a (bucket, node, component) table which reach each other by links within
    a bucket, as far as their components differ. A large component has blocks of its own, which are not compared with
    each other; small ones share blocks."""
    sizes = split.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("large", F.col("size") > BLOCK // 2)
    rest = sizes.groupBy("bucket").agg(F.sum(F.when(F.col("large"), 0).otherwise(F.col("size"))).alias("rest"))
    bins = lambda n: F.ceil(n / F.lit(BLOCK // 2)).cast("long")
    place = F.when(F.col("large"), F.concat_ws("-", F.col("component"), F.pmod(F.xxhash64("node"), bins(F.col("size"))))
                   ).otherwise(F.concat_ws("-", F.lit("rest"), F.pmod(F.xxhash64("component"), bins(F.col("rest")))))
    placed = split.join(sizes, ["bucket", "component"]).join(rest, "bucket").select(
        "bucket", "node", place.alias("block"), F.when(F.col("large"), F.col("component")).alias("own"))
    placed = materialize(placed, "blocks")
    kinds = placed.select("bucket", "block", "own").distinct()
    others = kinds.select("bucket", F.col("block").alias("other"), F.col("own").alias("other_own"))
    pairs = kinds.join(others, "bucket").where("block <= other and not coalesce(own = other_own, false)")
    pairs = pairs.select("bucket", "block", "other")
    left = pairs.join(placed, ["bucket", "block"]).select("bucket", "block", "other", "node")
    right = pairs.where("block <> other").join(placed.withColumnRenamed("block", "other"), ["bucket", "other"])
    rows = left.union(right.select("bucket", "block", "other", "node"))
    rows = rows.join(texts.select(F.col("doc_id").alias("node"), "text"), "node")

    def compare(table: pa.Table) -> pa.Table:
        node, text = (table.column(c).combine_chunks() for c in ("node", "text"))
        if isinstance(text, pa.ChunkedArray):
            node, text = pa.concat_arrays(node.chunks), pa.concat_arrays(text.chunks)
        nodes = node.to_numpy()
        ((_, _, whole),) = tb.chunks(text, limit=1 << 40)
        label = _joined_in_block(whole, size, percent)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"src": pa.array(nodes[moved]), "dst": pa.array(nodes[label[moved]])})

    return rows.select("bucket", "block", "other", "node", "text").groupBy("bucket", "block", "other").applyInArrow(
        compare, "src long, dst long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity
    percent / 100 or more on shingles of ``size`` words) and kept (doc_id = component_id)."""
    rows = next(r for least, r in ROWS.items() if percent >= least)
    made = materialize(sketched(docs, size, rows), "sketches")
    known = made.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "copy_classes")
    one = (known.join(classes, ["d1", "d2"]).where("doc_id = node").dropDuplicates(["d1", "d2"])
           .select("node", F.posexplode("bands").alias("band", "value")))
    rows = materialize(one.select("node", F.xxhash64("band", "value").alias("bucket")).distinct(), "bands")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.expr("node ^ bucket")).alias("low"))
    shared = shared.where("n > 1").select("bucket", "n", F.expr("low ^ bucket").alias("leader"))
    members = materialize(rows.join(shared, "bucket"), "bucket_members")
    # the texts are dealt by id at every size: no plan that holds for a short list of candidates only
    wanted = members.select(F.col("node").alias("doc_id")).distinct().hint("shuffle_merge")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    texts = materialize(texts, "candidate_texts")
    pairs = materialize(_ordered(members, "node", "leader"), "pairs")
    links = materialize(confirmed(pairs, texts, size, percent), "links")
    joined = components(links)
    met, leaders = pairs, FIRST_LEADERS
    members = members.select("bucket", "node", "n")
    while True:
        labelled = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        split = materialize(labelled.join(mixed.where("lo <> hi").select("bucket"), "bucket"), "split_buckets")
        if split.isEmpty():
            break
        wide = split.where(F.col("n") > WIDE)
        if not wide.isEmpty():
            links = links.union(materialize(block_links(wide.drop("n"), texts, size, percent), "links"))
            joined = components(links)
            members = split.where(F.col("n") <= WIDE).select("bucket", "node", "n")
            continue
        sizes = split.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        order = Window.partitionBy("bucket").orderBy("size", "component", F.expr("node ^ bucket"))
        chosen = (split.join(sizes, ["bucket", "component"]).withColumn("place", F.row_number().over(order))
                  .where(F.col("place") <= leaders)
                  .select("bucket", F.col("node").alias("leader"), F.col("component").alias("own")))
        chosen = materialize(chosen, "leaders")
        across = split.join(chosen, "bucket").where("component <> own")
        fresh = _ordered(across, "node", "leader").join(met, ["a", "b"], "left_anti")
        pairs = materialize(fresh, "pairs")
        if not pairs.isEmpty():
            met = met.union(pairs)
            links = links.union(materialize(confirmed(pairs, texts, size, percent), "links"))
            joined = components(links)
        members = split.select("bucket", "node", "n").join(chosen.select("bucket", F.col("leader").alias("node")),
                                                           ["bucket", "node"], "left_anti")
        leaders *= 4
    # rows of one doc_id with unlike texts make their texts' documents reachable from one another
    text = F.xxhash64("d1", "d2")
    many = known.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi").select("doc_id")
    if not many.isEmpty():
        spread = known.join(many, "doc_id").join(classes, ["d1", "d2"]).select("doc_id", "node")
        low = spread.groupBy("doc_id").agg(F.min("node").alias("low"))
        tied = spread.join(low, "doc_id").where("node <> low").select(F.col("low").alias("src"), F.col("node").alias("dst"))
        joined = components(links.select("src", "dst").union(materialize(tied, "tied")))
    per_row = (made.join(classes, ["d1", "d2"], "left").join(joined, "node", "left")
               .withColumn("component", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "node"))))
    lowest = per_row.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = (per_row.select(F.col("doc_id").alias("id"), "n_shingles").join(lowest, F.expr("id <=> doc_id"), "left")
           .withColumn("component_id", F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return (pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the rows of its smallest doc_id, equal rows once."""
    drop = near_duplicates(docs, size, percent).where("not kept").select("doc_id").distinct()
    return docs.dropDuplicates().join(drop, "doc_id", "left_anti").select(*docs.columns)
