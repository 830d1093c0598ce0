"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in shuffled order, repeated for ``max_epochs`` rounds. The copy that
ends at ``c`` cumulative source words has the virtual finish time ``c / weight``; the mix is the global order of
all copies by finish time, truncated where the running total reaches the budget. A source that runs out of copies
stops, and the others go on in proportion to their weights, so the words taken per source come to the capped,
reshared targets without a second rule.

Scale: the cumulative sum is two-level. Shuffled documents fall into ``16 ** BUCKET_DIGITS`` buckets a source;
sizes are pre-aggregated per bucket, summed up over buckets, and a window runs inside a bucket only, so a source
with a third of all rows is spread over thousands of groups. The global order is never materialised: a histogram
of finish times (map-side combined) finds the one cell in which the budget ends, and only that cell is sorted.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, ranked
last; a null doc_id takes part like any other; rows that are equal in doc_id, source and text are interchangeable in
``allot``, and keep their other columns in ``mix``; an empty table gives an empty mix. Extra columns of ``docs`` are
kept by ``mix`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowlens.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BUDGET_SHARE = 1.0
SEED = "mix-1"
BUCKET_DIGITS = 3
CELLS = 1 << 15  # finish-time cells up to the analytic level; as many again beyond it, then one open cell


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: str, doc_id: Column, source: Column, text: Column) -> Column:
    """Hex digest that fixes a row's place in its source's shuffled order."""
    parts = [F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")),
             F.coalesce(text, F.lit(""))]
    return F.md5(F.concat_ws("|", *parts))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int, share: float) -> DataFrame:
    """Targets per source from (source, source_size): weights repeat along the sources in code point order, null
    last; a target stops at ``max_epochs`` times its source's size and the excess goes to the others by weight.

    Adds src_rank, weight, total, level (the common finish time at which the budget is met, null when every source
    is exhausted before) and target. One row a source: the unpartitioned windows run over sources, not documents.
    """
    ranked = sizes.withColumn("src_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (ranked.withColumn("weight", F.get(pattern, F.col("src_rank") % len(weights)))
              .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
              .withColumn("runs_out", F.col("cap") / F.col("weight")))
    order = Window.orderBy("runs_out", "src_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    filled = (ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
              .withColumn("v", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / F.sum("weight").over(rest))
              .withColumn("level", F.max(F.when(F.col("v") <= F.col("runs_out"), F.col("v"))).over(every)))
    return filled.withColumn("target", F.when(F.col("level").isNull(), F.col("cap"))
                             .otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level"))))


def allot(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
          share: float = BUDGET_SHARE, seed: str = SEED, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, shuffle key ``h``, source_size, target, epochs (copies taken)
    and taken (words taken, repeats counted); then the narrow columns of ``carry``, by which rows with one ``h`` are
    put in order."""
    carried = list(carry or {})
    sized = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size"),
                                    shuffle_key(seed, F.col("doc_id"), F.col("source"), F.col("text")).alias("h"),
                                    *[c.alias(n) for n, c in (carry or {}).items()]),
                        "mix_sizes")
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    per_bucket = materialize(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")),
                             "mix_buckets")
    sources = materialize(source_targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")),
                                         weights, max_epochs, share), "mix_sources")
    head = sources.select("total", "level").first()
    if head is None:
        return (sized.withColumn("source_size", F.lit(0).cast("long")).withColumn("target", F.lit(0.0))
                .withColumn("epochs", F.lit(0).cast("long")).withColumn("taken", F.lit(0).cast("long"))
                .select("doc_id", "source", "size", "h", "source_size", "target", "epochs", "taken", *carried))
    total, level = head["total"], head["level"]

    bucket_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (per_bucket.withColumn("base", F.coalesce(F.sum("bucket_size").over(bucket_order), F.lit(0)))
             .select("source", "bucket", "base").alias("b"))
    info = sources.select("source", "src_rank", "weight", "source_size", "target").alias("s")
    inside = (Window.partitionBy("source", "bucket").orderBy("h", *carried)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = sized.withColumn("bucket", bucket).withColumn("within", F.sum("size").over(inside)).alias("d")
    queued = (queued.join(bases, F.expr("d.source <=> b.source and d.bucket = b.bucket"))
              .join(info, F.expr("d.source <=> s.source"))
              .select("d.doc_id", "d.source", "size", "h", "source_size", "target", "src_rank", "weight",
                      (F.col("base") + F.col("within")).alias("cum"), *carried))
    if level is None or not level > 0:  # the budget covers every copy, or there are no words
        epochs = F.when(F.col("size") > 0, F.lit(max_epochs if level is None else 0)).otherwise(0).cast("long")
        return queued.select("doc_id", "source", "size", "h", "source_size", "target", epochs.alias("epochs"),
                             (epochs * F.col("size")).alias("taken"), *carried)

    queued = materialize(queued, "mix_queues")
    finish = (F.col("e") * F.col("source_size") + F.col("cum")).cast("double") / F.col("weight")
    cell = F.least(F.floor(F.col("finish") / F.lit(level) * F.lit(float(CELLS))), F.lit(2 * CELLS))
    copies = (queued.where("size > 0").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
              .withColumn("finish", finish).withColumn("cell", cell))
    cut, before = _cut(copies.groupBy("cell").agg(F.sum("size").alias("n")), total)
    running = Window.partitionBy("cell").orderBy("finish", "src_rank", "h", "e")
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (copies.where(F.col("cell") == cut).withColumn("run", F.sum("size").over(running) + F.lit(before))
            .where(F.col("run") <= F.lit(total)).groupBy("h", "source").agg(F.count("*").alias("more")).alias("m"))
    # epochs that lie whole cells before the cut need no explode: count them from the row itself
    earlier = F.lit(0).cast("long")
    for e in range(max_epochs):
        at = ((F.lit(e) * F.col("source_size") + F.col("cum")).cast("double") / F.col("weight"))
        at = F.least(F.floor(at / F.lit(level) * F.lit(float(CELLS))), F.lit(2 * CELLS))
        earlier = earlier + F.when((F.col("size") > 0) & (at < cut), 1).otherwise(0)
    # equal rows share h: the boundary count is dealt to them in order, as they are interchangeable
    twin = F.row_number().over(Window.partitionBy("h", "source").orderBy("cum", *carried))
    room = F.lit(max_epochs) - F.col("earlier")
    prior = F.coalesce(F.sum(room).over(Window.partitionBy("h", "source").orderBy("twin")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = (queued.withColumn("earlier", earlier).withColumn("twin", twin).withColumn("prior", prior).alias("q")
           .join(last, F.expr("q.h = m.h and q.source <=> m.source"), "left"))
    extra = F.greatest(F.lit(0), F.least(F.coalesce(F.col("more"), F.lit(0)) - F.col("prior"), room))
    epochs = F.when(F.col("size") > 0, F.col("earlier") + extra).otherwise(0).cast("long")
    return out.select("doc_id", "q.source", "size", "q.h", "source_size", "target", epochs.alias("epochs"),
                      (epochs * F.col("size")).alias("taken"), *carried)


def _cut(histogram: DataFrame, total: float) -> tuple[int, int]:
    """First cell in which the running total passes the budget, and the words before it (at most 2 * CELLS + 1
    rows reach the driver)."""
    run = 0
    for r in sorted(histogram.collect(), key=lambda r: r["cell"]):
        if run + r["n"] > total:
            return r["cell"], run
        run += r["n"]
    return 2 * CELLS + 1, run


def _row_key(docs: DataFrame) -> Column:
    """Digest of a whole row; a null is no value of any type."""
    texts = [docs[c].cast("string") for c in docs.columns]
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of ``docs``. Rows that are equal in
    all columns share what is taken of them."""
    key = _row_key(docs)
    taken = allot(docs, **params, carry={"row_key": key}).groupBy("row_key").agg(
        F.sum("epochs").alias("n"), F.count("*").alias("rows"))
    taken = materialize(taken.where("n > 0"), "mix_taken")
    boxed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("row_key"))

    def times(rows: DataFrame, n: Column) -> DataFrame:
        counted = rows.withColumn("times", n.cast(T.LongType())).where("times > 0")
        return counted.select("row", F.explode(F.sequence(F.lit(1).cast(T.LongType()), "times")).alias("copy")).select("row.*")

    out = times(boxed.join(taken, "row_key"), F.floor(F.col("n") / F.col("rows")))
    uneven = taken.where("n % rows > 0")
    if uneven.isEmpty():
        return out
    # of equal rows that cannot share evenly, one stands for the rest of the copies
    one = boxed.join(uneven, "row_key").dropDuplicates(["row_key"])
    return out.union(times(one, F.col("n") % F.col("rows")))
