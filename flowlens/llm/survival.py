"""Filter interaction audit by truth-table survival words.

Five filters have 32 subsets. A document becomes a 32-bit word whose bit S is set when the document survives the filters
of subset S. The bits of all words of a part and label are counted position by position: words are added in threes by a
carry-save adder (one xor for the sum, one majority for the carry), so 32 counters advance at once, and only what is left
of each weight is read out. From these survivors of subsets follow the results of every order of the filters: a filter
removes what the filters before it leave and it does not, and no order is ever run.

Scale: a text is read once and leaves its task as five verdicts, a digest and ids. The smallest doc_id of equal texts is a
grouped minimum (combined in each task) and is joined back on digest and doc_id, so a hot text is no hot key. Labels are
joined on doc_id. A batch of words leaves one row per part and label, added up by part.

Defined cases: a null text is empty; a null source is the part ''; a null doc_id has no label, is identical to no smaller one
and makes no other row fail; of rows with the same doc_id and text none is smaller; a doc_id with several label rows is good
or toxic if one of them says so; an empty table has no parts; extra columns are ignored. Words of one text are compared
whole, texts by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
GOOD, TOXIC = 1, 2  # bits of a label

#: Word of each set of failed filters: bit S is set where S holds none of them.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32)


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed): ``failed`` has a bit for each of A to D that the text fails."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
                        F.array_remove(F.split(text, SPACE), "").alias("words"))
    n, points = F.size("words"), F.length("text")
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * n,
             100 * upper > MAX_UPPER_PERCENT * points, F.col("text").rlike(SYMBOLS)]
    failed = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, label (bits GOOD and TOXIC) and failed (a bit for each filter)."""
    facts = materialize(verdicts(docs), "verdicts")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int"))
    told = (labels.where("doc_id is not null").groupBy("doc_id")
            .agg((says("quality") * GOOD + says("toxic") * TOXIC).alias("label")))
    repeat = (F.col("first").isNull() & F.col("doc_id").isNotNull()).cast("int") * (1 << FILTERS.index("E"))
    return (facts.join(told, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
            .select("doc_id", "part", F.coalesce("label", F.lit(0)).alias("label"), (F.col("failed") + repeat).alias("failed")))


def bit_counts(words: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """How many words of each of ``n`` groups have each bit: an (n, 32) table. ``group`` must be in ascending order."""
    out, weight = np.zeros((n, 32), dtype=np.int64), 1
    bits = np.arange(32, dtype=np.uint32)
    while len(words):
        carried, owners = [], []
        while True:  # full adders: three words of a weight become one, and one carry of twice the weight
            starts = np.searchsorted(group, np.arange(n))
            rank = np.arange(len(words)) - starts[group]
            left = np.bincount(group, minlength=n)[group] - rank // 3 * 3
            at = np.flatnonzero((left >= 3) & (rank % 3 == 0))
            if not len(at):
                break
            a, b, c = words[at], words[at + 1], words[at + 2]
            half = a ^ b
            carried.append((a & b) | (c & half))
            owners.append(group[at])
            words[at] = half ^ c
            stay = (left < 3) | (rank % 3 == 0)
            words, group = words[stay], group[stay]
        np.add.at(out, group, weight * ((words[:, None] >> bits) & 1).astype(np.int64))  # one or two a group are left
        if not carried:
            break
        words, group = np.concatenate(carried), np.concatenate(owners)
        order = np.argsort(group, kind="stable")
        words, group, weight = words[order], group[order], 2 * weight
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").dictionary_encode()
        key = part.indices.to_numpy().astype(np.int64) * 4 + batch.column("label").to_numpy()
        found, group = np.unique(key, return_inverse=True)
        order = np.argsort(group, kind="stable")
        words = WORDS[batch.column("failed").to_numpy()[order]]
        counts = bit_counts(words, group[order], len(found))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * 32, type=pa.int32()), pa.array(counts.ravel()))
        yield pa.RecordBatch.from_arrays(
            [part.dictionary.take(pa.array(found // 4)), pa.array(found % 4, type=pa.int32()), flat],
            names=["part", "label", "survivors"])


def survivors(rows: DataFrame) -> DataFrame:
    """Per part: ``every``, ``good`` and ``toxic``, how many of its documents survive each of the 32 subsets."""
    counted = rows.select("part", "label", "failed").mapInArrow(_count, "part string, label int, survivors array<long>")
    has = {"every": F.lit(True), "good": F.col("label").bitwiseAND(GOOD) > 0, "toxic": F.col("label").bitwiseAND(TOXIC) > 0}
    sums = [F.sum(F.when(c, F.col("survivors")[s]).otherwise(0)).alias(f"{k}_{s}") for k, c in has.items() for s in range(SUBSETS)]
    table = counted.groupBy("part").agg(*sums)
    return table.select("part", *[F.array(*[f"{k}_{s}" for s in range(SUBSETS)]).alias(k) for k in has])


def _shapley(at: int) -> Column:
    """What filter ``at`` removes, summed over all orders: each set of others comes before it in |S|! (4 - |S|)! of them."""
    bit, last = 1 << at, len(FILTERS) - 1
    terms = [factorial(s.bit_count()) * factorial(last - s.bit_count()) * (F.col("every")[s] - F.col("every")[s | bit])
             for s in range(SUBSETS) if not s & bit]
    return sum(terms[1:], terms[0])


def audit(table: DataFrame) -> DataFrame:
    """Of ``survivors``: one row per part, filter_order and step with the audit's counts."""
    subset = lambda letters: sum((F.when(F.instr(letters, f) > 0, 1 << i).otherwise(0)
                                  for i, f in enumerate(FILTERS)), F.lit(0))
    steps = (table.withColumn("worth", F.array(*[_shapley(i) for i in range(len(FILTERS))]))
             .withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
             .withColumn("before", subset(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
             .withColumn("at", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
             .withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("at")))
             .withColumn("after", F.col("before") + F.col("bit")))
    lost = lambda k: F.get(k, F.col("before")) - F.get(k, F.col("after"))
    every = lambda s: F.get("every", s)
    return steps.select(
        "part", "filter_order", "step", every(F.col("after")).alias("kept"), lost("every").alias("removed"),
        (every(F.lit(0)) - every(F.col("bit")) - lost("every")).alias("redundant"),
        (every(F.lit(SUBSETS - 1) - F.col("bit")) - every(F.lit(SUBSETS - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("worth", F.col("at")).alias("shapley"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole audit of ``docs`` (doc_id, text, source) against ``labels`` (doc_id, quality, toxic)."""
    return audit(survivors(judged(docs, labels)))
