"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text, lower-cased in A-Z only, is cut where its content says so: a chunk has at least ``MIN_CHARS`` characters and ends
at the next boundary pair of characters, or at ``MAX_CHARS``. Equal texts have equal cuts, and unequal ones that share
passages share chunks. A document becomes its recipe, the ordered list of its chunks' 64-bit fingerprints, each with a
SHA-256 digest. Distinct chunks are gathered once; a fingerprint that stands for one digest is the chunk's verified
identifier, one that stands for several gets a number a digest. Documents are equal when their ordered identifier lists are.

Scale: the texts are read once and never shuffled; what moves are recipes, about 4 % of the texts. Equal chunks are combined
in each task before the shuffle. A group of equal documents is split over ``SALTS`` parts for counting and for handing its
result back, so a group with a third of all rows is nowhere one task's work. Recipes are a written table, so a lost
executor repeats no chunking.

Defined cases: a null text is empty, and empty texts are one group with the empty recipe; a null doc_id is smaller than any
other, and keep_id is null only where all of a group are; of rows equal in text and doc_id exactly one stays; an empty table
gives an empty result; extra columns of any name are ignored by ``groups`` and kept by ``dedup``. Long texts have long
recipes, one entry for some hundred characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.session import discard, materialize

MIN_CHARS = 256
MAX_CHARS = 8192
BOUNDARY = r"[aeiosn][ \n][a-g]"  # ends a chunk; characters around word ends, so boundaries come every hundred or so
SALTS = 256
BITS = 64  # of a fingerprint

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null as empty. ``lower`` does just that where every character is one byte."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def chunks(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """Content-defined chunks of a text, in order; joined they are the text."""
    pattern = rf"(?s).{{{low},{high - 3}}}?(?:{BOUNDARY}|\z)|.{{1,{high}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, low: int = MIN_CHARS, high: int = MAX_CHARS, bits: int = BITS) -> DataFrame:
    """One row per document: row_id, doc_id, text_sha256 and chunks, the list of (fp, digest). ``docs`` may bring a
    row_id of its own."""
    row = F.col("row_id") if "row_id" in docs.columns else F.monotonically_increasing_id()
    mask = F.lit((1 << (bits - 1)) - 1 if bits < 64 else -1).cast("long")
    texts = docs.select(row.alias("row_id"), F.col("doc_id").cast("long"), lowered(F.col("text")).alias("low"))
    entry = lambda c: F.struct(F.xxhash64(c).bitwiseAND(mask).alias("fp"), F.unhex(F.sha2(c, 256)).alias("digest"))
    return texts.select("row_id", "doc_id", F.sha2("low", 256).alias("text_sha256"),
                        F.transform(chunks(F.col("low"), low, high), entry).alias("chunks"))


def identified(made: DataFrame) -> DataFrame:
    """Recipes with ``ids``, their ordered lists of verified identifiers. ``made`` must be a written table."""
    store = made.select(F.explode("chunks").alias("c")).select("c.fp", "c.digest").distinct()
    shared = store.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    shared = materialize(shared, "recipe_shared_fingerprints")
    if shared.isEmpty():  # every fingerprint stands for one digest, so it is the identifier
        discard(shared)
        return made.select("row_id", "doc_id", "text_sha256", F.col("chunks.fp").alias("ids"))
    numbered = store.join(shared, "fp").select(
        "fp", "digest", F.row_number().over(Window.partitionBy("fp").orderBy("digest")).alias("n"))
    told = (made.select("row_id", F.explode(F.array_distinct("chunks")).alias("c")).select("row_id", "c.fp", "c.digest")
            .join(numbered, ["fp", "digest"]).groupBy("row_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("digest", "n"))).alias("told")))
    number = lambda c: F.struct(c["fp"].alias("fp"), F.coalesce(F.col("told")[c["digest"]], F.lit(0)).alias("n"))
    return (made.join(told, "row_id", "left")
            .select("row_id", "doc_id", "text_sha256", F.transform("chunks", number).alias("ids")))


def groups(docs: DataFrame, **cuts) -> DataFrame:
    """One row per document: row_id, doc_id, keep_id, group_size, kept and text_sha256 of the lower-cased text."""
    made = materialize(recipes(docs, **cuts), "recipes")
    # one number orders rows by doc_id, a null first, then by row: the greatest of a group stays
    big = F.lit(1 << 62).cast("decimal(20,0)") * F.lit(2).cast("decimal(1,0)")
    place = (F.coalesce("doc_id", F.lit(-(1 << 63))).cast("decimal(20,0)") * big + F.col("row_id")).cast("decimal(38,0)")
    salt = F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(SALTS)).cast("int")
    listed = identified(made).withColumns({"salt": salt, "place": place})
    parts = listed.groupBy("ids", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"),
                                              F.max("place").alias("best"))
    whole = parts.groupBy("ids").agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id"),
                                     F.max("best").alias("best"), F.collect_list("salt").alias("salts"))
    told = whole.select("ids", "group_size", "keep_id", "best", F.explode("salts").alias("salt"))
    return listed.join(told, ["ids", "salt"]).select(
        "row_id", "doc_id", "keep_id", "group_size", (F.col("place") == F.col("best")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, **cuts) -> DataFrame:
    """The documents that stay, with the columns of ``docs``; their texts are moved once, by row."""
    boxed = materialize(docs.select(F.monotonically_increasing_id().alias("row_id"),
                                    F.struct(*[docs[c] for c in docs.columns]).alias("row")), "recipe_documents")
    stay = groups(boxed.select("row_id", "row.doc_id", "row.text"), **cuts).where("kept").select("row_id")
    return boxed.join(stay, "row_id", "left_semi").select("row.*")
