"""Embedding near-dedup on a neighbour graph refined by NN-descent.

1. Equal vectors of a label become one node with a count of copies.
2. The first graph links each node to its neighbours in a few sorted orders by sign codes of random projections (range
   partitioned, so a hot label or a tight group spreads over tasks).
3. A round joins the neighbours of each node with one another: a node's list and the best of those that list it meet in
   one small matrix product, and every pair that improves a list is kept. Lists hold ``K`` neighbours. Rounds end when few
   entries change.
4. A list whose ``K``-th neighbour is still a link is saturated and takes no more. Components with such lists are compared
   with one another: their smallest nodes by products of blocks, and all their members where the angle between the two
   nodes, the components' angular radii and the threshold allow a link. So components that are linked become one, and
   their lists are enlarged to the whole component by products of fixed-size blocks, which report counts and never pairs.
5. The audit compares a sample of nodes (by hash, as many as the root of the table's, and as many again of those whose
   best neighbour is near the threshold) with all vectors and measures the recall of links per node, for nodes of few and
   of many links apart. The sample is a table that meets parts of the vectors in products of blocks. It grows while fewer
   than ``FEW_LINKED`` of its nodes have a link. Recall that cannot be measured on less than a quarter of the table counts
   as none: all vectors of a label are then compared by products of blocks, as they are where ``MAX_AUDITS`` attempts, each
   with further sorted orders and rounds, stay below ``RECALL``, or where components are so wide that their angles tell
   nothing apart.

Only pairs computed in double precision with cosine >= threshold are links.

Defined cases: a vector that is null, empty or zero or holds a null or non-finite component, or whose label is null, links
with nothing; so do vectors of different lengths; equal vectors of a label are links of each other; a null vec_id is counted
as a vector and gets its group's component, null if there is no other; a vec_id that repeats is a vector per row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.components import components
from flowlens.session import materialize

K = 10  # neighbours a list holds
REVERSE = 6  # of the nodes that list a node, so many join in its round
ORDERS, REACH = 6, 3  # sorted orders of the first graph and neighbours taken to either side
MAX_ROUNDS, FEW = 5, 0.002  # rounds at most, and the share of changed entries that ends them
BLOCK = 1024
AUDIT, RECALL, MAX_AUDITS = 512, 0.95, 3  # nodes audited at least
NEAR = 0.1  # below the threshold: a best neighbour that makes a node likely to have links
FEW_LINKED = 32  # linked nodes that make an audit
WIDE = 64  # close pairs a component beyond which bridges are left to the whole comparison
STRATA = (1, 2, K + 1)  # least links of nodes whose recall is taken apart
CODE_BITS = 62


def _vectors(column: pa.Array) -> np.ndarray:
    """(rows, dimension) doubles of a list column whose rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[np.ndarray]:
    """Row numbers of a batch by length of the list in column ``at``."""
    sizes = np.diff(batch.column(at).offsets.to_numpy())
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, label, vec, copies, least): the distinct usable vectors of each label."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
                           & F.exists("embedding", lambda x: x != 0))
    classes = usable.groupBy("label", F.col("embedding").alias("vec")).agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return materialize(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def sorted_neighbours(nodes: DataFrame, seed: int, orders: int = ORDERS, reach: int = REACH) -> DataFrame:
    """(a, b, s): pairs of nodes of a label within ``reach`` places in one of the sorted orders."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch, 2):
                part = batch.take(pa.array(rows))
                x = _vectors(part.column(2))
                for order in range(orders):
                    planes = np.random.default_rng([seed, order, x.shape[1]]).standard_normal((x.shape[1], CODE_BITS))
                    code = ((x @ planes) > 0) @ (np.int64(1) << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(rows), order)),
                         pa.array(np.full(len(rows), x.shape[1])), pa.array(code)],
                        names=["node", "label", "vec", "turn", "dim", "code"])

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    coded = nodes.select("node", "label", "vec").mapInArrow(
        codes, f"node long, label {kinds['label']}, vec {kinds['vec']}, turn long, dim long, code long")
    # the node ends the key, so a group with one code is cut at any place
    places = coded.repartitionByRange("turn", "label", "dim", "code", "node")
    places = places.sortWithinPartitions("turn", "label", "dim", "code", "node").select("turn", "label", "dim", "node", "vec")

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([b for b in (tail, batch) if b is not None]).combine_chunks()
            old = 0 if tail is None else tail.num_rows
            both = table.to_batches()[0] if table.num_rows else batch
            group = [both.column(i).to_pandas().to_numpy() for i in range(3)]
            new = np.zeros(both.num_rows, dtype=np.int64)
            for g in group:
                new[1:] += g[1:] != g[:-1]
            group_of = np.cumsum(new > 0)
            sizes = np.diff(both.column(4).offsets.to_numpy())
            node = both.column(3).to_numpy()
            values = both.column(4).flatten().to_numpy().astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                for gap in range(1, reach + 1):
                    left = np.arange(max(0, old - gap), both.num_rows - gap)
                    left = left[(left + gap >= old) & (sizes[left] == size) & (group_of[left] == group_of[left + gap])]
                    if not len(left):
                        continue
                    x = values[begin[left][:, None] + np.arange(size)]
                    y = values[begin[left + gap][:, None] + np.arange(size)]
                    s = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
                    a, b = node[left], node[left + gap]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)],
                                                     names=["a", "b", "s"])
            tail = both.slice(max(0, both.num_rows - reach))

    return places.mapInArrow(adjacent, "a long, b long, s double").groupBy("a", "b").agg(F.max("s").alias("s"))


def _lists(pairs: DataFrame) -> DataFrame:
    """(u, v, s, place): each node's best K partners."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "s").union(
        pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "s"))
    order = Window.partitionBy("u").orderBy(F.col("s").desc(), "v")
    return both.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= K)


def neighbours_of_neighbours(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b, s): pairs that meet in some node's list and improve the list of one of them."""
    order = Window.partitionBy("v").orderBy(F.col("s").desc(), "u")
    back = lists.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE)
    meet = (lists.select(F.col("u").alias("pivot"), F.col("v").alias("node"))
            .union(back.select(F.col("v").alias("pivot"), F.col("u").alias("node"))).distinct())
    # a saturated list takes no more: its node is left to the enlargement
    worst = lists.where(F.col("place") == K).select(
        F.col("u").alias("node"), F.when(F.col("s") >= threshold, 2.0).otherwise(F.col("s")).alias("worst"))
    info = nodes.select("node", "vec").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    rows = meet.join(info, "node").select("pivot", "node", "worst", "vec")
    rows = rows.repartition("pivot").sortWithinPartitions("pivot")

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            pivot, node, worst = (batch.column(i).to_numpy() for i in range(3))
            x = _vectors(batch.column(3))
            norm = np.linalg.norm(x, axis=1)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]])
            out = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                s = (x[lo:hi] @ x[lo:hi].T) / norm[lo:hi, None] / norm[None, lo:hi]
                low = np.minimum(worst[lo:hi, None], worst[None, lo:hi])
                i, j = np.nonzero(np.triu(s > low, 1))
                out.append((node[lo + i], node[lo + j], s[i, j]))
            if out:
                a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)],
                                                 names=["a", "b", "s"])

    found = rows.mapInArrow(local_join, "a long, b long, s double")
    return found.groupBy("a", "b").agg(F.max("s").alias("s"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regroup sorted batches so that rows with one value in the first column, and of one vector length (last column),
    come in one batch; a group has at most K + REVERSE rows."""
    held: list[pa.RecordBatch] = []

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = table.combine_chunks().to_batches()
        for batch in whole:
            for rows in _by_length(batch, batch.num_columns - 1):
                yield batch.take(pa.array(rows))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last > 0:
            yield from parts(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield from parts(pa.Table.from_batches(held))


def enlarged(nodes: DataFrame, grouped: DataFrame, threshold: float) -> DataFrame:
    """(node, links): for (node, component) rows, the vectors linked to each node within its component, counted by
    products of BLOCK by BLOCK vectors. A block pair is a task's unit, whatever the size of the component."""
    sizes = grouped.groupBy("component").agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("component", "bin").orderBy("node")) - 1
    # numbered inside hash bins, so that no window holds a whole component
    binned = grouped.join(sizes, "component").withColumn(
        "bins", F.ceil(F.col("size") / F.lit(BLOCK // 2)).cast("long")).withColumn(
        "bin", F.pmod(F.xxhash64("node"), F.col("bins")))
    binned = binned.withColumn("part", F.floor(place / F.lit(BLOCK)))  # a bin is one part but for rare large bins
    block = F.concat_ws("-", "bin", "part")
    blocks = materialize(binned.select("node", "component", block.alias("block")), "blocks")
    kinds = blocks.select("component", "block").distinct()
    pairs = kinds.join(kinds.withColumnRenamed("block", "other"), "component").where("block <= other")
    rows = nodes.select("node", "vec", "copies").join(blocks, "node")
    left = pairs.join(rows, ["component", "block"]).select("component", "block", "other", F.lit(0).alias("side"), "node",
                                                          "copies", "vec")
    right = (pairs.join(rows.withColumnRenamed("block", "other"), ["component", "other"])
             .select("component", "block", "other", F.lit(1).alias("side"), "node", "copies", "vec"))

    def count(key, pdf):
        x, y = (pdf[pdf["side"] == side] for side in (0, 1))
        links = _cosines(np.stack(x["vec"].to_numpy()).astype(np.float64),
                         np.stack(y["vec"].to_numpy()).astype(np.float64)) >= threshold
        if key[1] == key[2]:
            own = x["node"].to_numpy()[:, None] == y["node"].to_numpy()[None, :]
            out = x[["node"]].assign(links=(links & ~own) @ y["copies"].to_numpy())
            return out
        a = x[["node"]].assign(links=links @ y["copies"].to_numpy())
        b = y[["node"]].assign(links=links.T @ x["copies"].to_numpy())
        return a._append(b)

    found = left.union(right).groupBy("component", "block", "other").applyInPandas(count, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _numbered(rows: DataFrame, group: str) -> DataFrame:
    """Adds key: the group and one of its parts of about BLOCK // 2 rows."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(BLOCK // 2)).alias("bins"))
    part = F.pmod(F.xxhash64("node"), F.col("bins"))
    return rows.join(sizes, group).withColumn("key", F.concat_ws("/", group, part)).drop("bins")


def _met(rows: DataFrame, pairs: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows (node, vec, reach) of each pair (x, y) of keys."""
    sides = [pairs.join(rows.withColumnRenamed("key", key), key).select("x", "y", F.lit(side).alias("side"), "node", "vec",
                                                                        "reach") for side, key in ((0, "x"), (1, "y"))]

    def run(pdf):
        a, b = (pdf[pdf["side"] == side] for side in (0, 1))
        s = _cosines(*(np.stack(p["vec"].to_numpy()).astype(np.float64) for p in (a, b)))
        return work(a, b, s)

    return sides[0].union(sides[1]).groupBy("x", "y").applyInPandas(run, schema)


def _same_kind(nodes: DataFrame) -> DataFrame:
    """Adds kind: label and length of the vector."""
    return nodes.withColumn("kind", F.concat_ws("/", F.size("vec"), "label"))


def _pairs_in(rows: DataFrame, group: str) -> DataFrame:
    """(x, y): pairs of the keys of a group, each also with itself."""
    keys = rows.select(group, F.col("key").alias("x")).distinct()
    return keys.join(keys.withColumnRenamed("x", "y"), group).where("x <= y").select("x", "y")


def bridges(nodes: DataFrame, crowded: DataFrame, threshold: float) -> DataFrame | None:
    """(a, b): at least one link for any two linked components of (node, component) rows; None where in some pair of
    blocks more than ``WIDE`` pairs a component are close enough for one."""
    rows = nodes.select("node", "label", "vec").join(crowded, "node")
    tips = rows.where("node = component").select("component", F.col("vec").alias("tip"))

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)

    cosine = dot("vec", "tip") / F.sqrt(dot("vec", "vec")) / F.sqrt(dot("tip", "tip"))
    # joined by parts of components, so that a large one spreads over tasks
    members = rows.select("node", "vec", "component", F.lit(0.0).alias("reach"))
    members = materialize(_numbered(members, "component"), "members")
    keys = members.select("component", "key").distinct()
    radii = members.select("key", "vec").join(keys.join(tips, "component"), "key").groupBy("component", "key").agg(
        F.max(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))).alias("reach"))
    radii = radii.groupBy("component").agg(F.max("reach").alias("reach"))
    tips = _same_kind(rows.where("node = component")).join(radii, "component").select("kind", "node", "vec", "reach")
    tips = materialize(_numbered(tips, "kind"), "tips")
    angle = float(np.arccos(np.clip(threshold, -1, 1)))

    def near(a, b, s):
        far = a["reach"].to_numpy()[:, None] + b["reach"].to_numpy()[None, :] + angle + 1e-6
        i, j = np.nonzero(np.arccos(np.clip(s, -1, 1)) <= far)
        out = pa.table({"a": a["node"].to_numpy()[i], "b": b["node"].to_numpy()[j]}).to_pandas()
        out = out[out["a"] != out["b"]]
        if len(out) > WIDE * (len(a) + len(b)):  # too many to be told one by one
            return pa.table({"a": [-1], "b": [-1]}).to_pandas()
        return out

    close = _met(tips, _pairs_in(tips, "kind"), near, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    close = materialize(close, "close_tips")
    if not close.where("a < 0").isEmpty():
        return None
    pairs = close.join(keys.toDF("a", "x"), "a").join(keys.toDF("b", "y"), "b").select("x", "y")

    def link(a, b, s):
        i, j = np.unravel_index(np.argmax(s), s.shape)
        out = pa.table({"a": a["node"].to_numpy()[[i]], "b": b["node"].to_numpy()[[j]]}).to_pandas()
        return out[[bool(s[i, j] >= threshold)]]

    return _met(members, pairs, link, "a long, b long")


def compared(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, component) of all vectors, by products of blocks within a label."""
    rows = _same_kind(nodes).select("kind", "node", "vec", F.lit(0.0).alias("reach"))
    rows = materialize(_numbered(rows, "kind"), "members")

    def forest(a, b, s):
        # smallest node reachable inside the two blocks: as many rows as nodes, whatever the links
        linked, left, right = s >= threshold, a["node"].to_numpy(), b["node"].to_numpy()
        low, high = left.copy(), right.copy()
        top = np.iinfo(np.int64).max
        while True:
            up = np.minimum(high, np.where(linked, low[:, None], top).min(axis=0))
            down = np.minimum(low, np.where(linked, up[None, :], top).min(axis=1))
            if (up == high).all() and (down == low).all():
                break
            low, high = down, up
        return pa.table({"a": np.concatenate([left, right]), "b": np.concatenate([low, high])}).to_pandas()

    ties = _met(rows, _pairs_in(rows, "kind"), forest, "a long, b long").where("a <> b").distinct()
    joined = components(materialize(ties, "ties").toDF("src", "dst"))
    grouped = rows.select("node", F.col("kind").alias("component"))
    return materialize(enlarged(nodes, grouped, threshold).where("links > 0"), "counted"), joined


def audit(nodes: DataFrame, counted: DataFrame, likely: DataFrame, threshold: float, size: int = AUDIT) -> float | None:
    """Least mean recall of links per node, over all linked nodes of a sample and over its strata by number of links; None
    where too few nodes of a quarter of the table have links. ``likely`` holds the nodes to be asked besides."""
    total = nodes.count()
    size = max(size, int(total ** 0.5))
    hopes = likely.count()
    while 4 * size <= total:
        share = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / max(n, 1)))
        asked = nodes.select("node").where(share(total)).union(likely.select("node").where(share(hopes))).distinct()
        asked = materialize(asked, "asked")
        bins = -(-total // max(asked.count(), BLOCK))
        found = _recalled(nodes, counted, asked, threshold, bins).groupBy("links", "real").agg(F.count("*").alias("n"))
        pairs = [(r["links"], r["real"], r["n"]) for r in found.collect()]  # one row for each pair of counts
        if sum(n for *_, n in pairs) >= FEW_LINKED:
            strata = [[(f / t, n) for f, t, n in pairs if lo <= t < hi]
                      for lo, hi in [(1, 1 << 62), *zip(STRATA, [*STRATA[1:], 1 << 62], strict=True)]]
            counts = [sum(n for _, n in part) for part in strata]
            return min(sum(r * n for r, n in part) / m for k, (part, m) in enumerate(zip(strata, counts, strict=True))
                       if m >= (1 if k == 0 else FEW_LINKED // 4))
        size *= 2
    return None


def _recalled(nodes: DataFrame, counted: DataFrame, asked: DataFrame, threshold: float, bins: int) -> DataFrame:
    """(links found, links by comparison with all vectors) of those asked nodes that have links.

    The vectors fall into ``bins`` parts of about as many as are asked, and the asked ones go to each part: about as many
    rows again."""
    rows = _same_kind(nodes).select("kind", "node", "vec", "copies")
    left = rows.withColumn("bin", F.pmod(F.xxhash64("node"), F.lit(bins)))
    right = rows.join(asked, "node").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    right = right.select("kind", "bin", "node", "vec").toDF("asked_kind", "asked_bin", "node", "vec")

    def compare(those: pa.Table, these: pa.Table) -> pa.Table:
        y, known, copies = _matrix(those), those.column("node").to_numpy(), those.column("copies").to_numpy()
        x, node = _matrix(these), these.column("node").to_numpy()
        links = np.zeros(len(node), dtype=np.int64)
        if len(known) and len(node):
            for a in range(0, len(node), BLOCK):
                for b in range(0, len(known), BLOCK):
                    hit = _cosines(x[a:a + BLOCK], y[b:b + BLOCK]) >= threshold
                    hit &= node[a:a + BLOCK, None] != known[None, b:b + BLOCK]
                    links[a:a + BLOCK] += hit @ copies[b:b + BLOCK]
        return pa.table({"node": node, "part": links})

    met = left.groupBy("kind", "bin").cogroup(right.groupBy("asked_kind", "asked_bin")).applyInArrow(compare, "node long, part long")
    true = met.groupBy("node").agg(F.sum("part").alias("real")).where("real > 0")
    return true.join(counted, "node", "left").select(F.least(F.coalesce("links", F.lit(0)), "real").alias("links"), "real")


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    return _vectors(pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable) and kept."""
    nodes = nodes_of(vectors.select("vec_id", "embedding", "label"))
    pairs = links = None
    for attempt in range(MAX_AUDITS):
        first = materialize(sorted_neighbours(nodes, seed=attempt), "first_graph")
        pairs = first if pairs is None else pairs.union(first)
        lists = materialize(_lists(pairs), "lists")
        edges = first.where(F.col("s") >= threshold).select("a", "b")
        links = edges if links is None else links.union(edges)
        for _ in range(MAX_ROUNDS):
            fresh = materialize(neighbours_of_neighbours(nodes, lists, threshold), "round")
            links = links.union(fresh.where(F.col("s") >= threshold).select("a", "b"))
            old = lists.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "s")
            before, lists = lists, materialize(_lists(old.union(fresh)), "lists")
            entries = lists.count()
            changed = lists.join(before.select("u", "v"), ["u", "v"], "left_anti").count()
            if changed <= FEW * entries:
                break
        pairs = lists.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "s")
        links = materialize(links.distinct(), "links")
        joined = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        degrees = ends.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(
            F.sum("copies").alias("links"), F.count("*").alias("degree"))
        crowded = degrees.where(F.col("degree") >= K).join(joined, "node").select("component").distinct()
        crowded = materialize(joined.join(crowded, "component"), "crowded")
        across = bridges(nodes, crowded, threshold)
        if across is None:
            counted, joined = compared(nodes, threshold)
            break
        across = materialize(across, "bridges")
        if not across.isEmpty():
            joined = components(links.union(across).toDF("src", "dst"))
            crowded = materialize(joined.join(crowded.select("node"), "node").select("component").distinct()
                                  .join(joined, "component").select("node", "component"), "crowded")
        counted = degrees.join(crowded, "node", "left_anti").select("node", "links").union(
            enlarged(nodes, crowded, threshold))
        counted = materialize(counted, "counted")
        likely = lists.where((F.col("place") == 1) & (F.col("s") >= threshold - NEAR)).select(F.col("u").alias("node"))
        recall = audit(nodes, counted, likely, threshold)
        if recall is None:
            counted, joined = compared(nodes, threshold)
        if recall is None or recall >= RECALL:
            break
    else:
        counted, joined = compared(nodes, threshold)
    whole = nodes.select("node", "label", "vec", "copies", "least").join(counted, "node", "left").join(joined, "node", "left")
    whole = whole.withColumn("component", F.coalesce("component", "node"))
    lowest = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(lowest, "component").select(
        F.col("label").alias("l"), "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = vectors.select("vec_id", "embedding", "label").join(whole, F.expr("label = l and embedding = vec"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.when(F.col("l").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
