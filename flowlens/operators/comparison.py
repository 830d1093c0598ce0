"""Phase 3, comparison: discovered APIs against registered operations.

J6 match -> C5 collisions -> C6 affinity -> C7 winner -> C9 losers -> C10 classification. Every
step is a join or grouped aggregate keyed by (method, path) or by service; nothing is collected.
The reference's nested loops (collisions x candidates) become joins on (method, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize, observed

CAND_COLS = ["service_key", "http_method", "resource_path", "request_domain", "host_ip", "server_port",
             "hit_count", "reg_api_id"]
COLL_KEY = ["http_method", "resource_path", "reg_api_id"]


def op_index(ops: DataFrame) -> DataFrame:
    """One registered operation per (method, match path): the last in (reg_api_id, raw_target) order."""
    return (ops.groupBy("http_method", "match_path")
            .agg(F.max(F.struct("reg_api_id", "raw_target")).alias("op"))
            .select("http_method", F.col("match_path").alias("resource_path"),
                    F.col("op.reg_api_id").alias("reg_api_id")))


def match(discovered: DataFrame, ops: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Discovered LEFT JOIN registered operations on (method, path); reg_api_id NULL = unmatched. ``index`` is their
    ``op_index`` where it is at hand."""
    d = discovered.select("service_key", "http_method", "resource_path",
                          T.nz(F.col("request_domain")).alias("request_domain"),
                          T.nz(F.col("host_ip")).alias("host_ip"), "server_port", "hit_count")
    return d.join(op_index(ops) if index is None else index, ["http_method", "resource_path"], "left").select(*CAND_COLS)


def collisions(cands: DataFrame) -> DataFrame:
    """Matched (method, path, api) groups seen from more than one service key."""
    return (cands.where(F.col("reg_api_id").isNotNull())
            .groupBy(*COLL_KEY)
            .agg(F.count_distinct("service_key").alias("n_services"))
            .where(F.col("n_services") > 1))


def collision_members(cands: DataFrame, coll: DataFrame) -> DataFrame:
    """(collision key, service_key) pairs of every collision."""
    return cands.join(coll.select(*COLL_KEY), COLL_KEY, "left_semi").select(*COLL_KEY, "service_key").distinct()


def affinity(cands: DataFrame, coll: DataFrame, ops: DataFrame) -> DataFrame:
    """C6 (+J7): per (collision, service key), how many operations of the collision's API the service
    was seen on. Duplicate operations on one match path count twice (as in the reference).

    The score depends on the API and the service alone, so it is counted once for each such pair, however many of the
    API's operations collide."""
    members = collision_members(cands, coll)
    seen = cands.select("service_key", F.col("http_method").alias("op_method"),
                        F.col("resource_path").alias("op_path"), F.lit(1).alias("seen"))
    probe = (members.select("reg_api_id", "service_key").distinct()
             .join(ops.select("reg_api_id", F.col("http_method").alias("op_method"),
                              F.col("match_path").alias("op_path")), "reg_api_id")
             .join(seen, ["service_key", "op_method", "op_path"], "left"))
    score = probe.groupBy("reg_api_id", "service_key").agg(
        F.coalesce(F.sum("seen"), F.lit(0)).cast("bigint").alias("score"))
    return members.join(score, ["reg_api_id", "service_key"]).select(*COLL_KEY, "service_key", "score")


def service_domain(cands: DataFrame) -> DataFrame:
    """First non-blank request domain of a service in (method, path) order."""
    return cands.groupBy("service_key").agg(
        F.min(F.when(F.col("request_domain") != "", F.struct("http_method", "resource_path", "request_domain")))
        .getField("request_domain").alias("domain"))


def resolve(cands: DataFrame, coll: DataFrame, ops: DataFrame, apis: DataFrame) -> DataFrame:
    """C7 (+J13): winner per collision, by score; a tie goes to the first sorted key whose port-stripped
    domain equals the API's endpoint host (blank equals blank); none -> ambiguous."""
    scores = materialize(affinity(cands, coll, ops), "scores")
    best = scores.groupBy(*COLL_KEY).agg(F.max("score").alias("best"))
    host = apis.select("reg_api_id", T.nz(F.col("endpoint_hostname")).alias("endpoint_host"))
    tied = (scores.join(best, COLL_KEY).where(F.col("score") == F.col("best"))
            .join(service_domain(cands), "service_key", "left")
            .join(host, "reg_api_id", "left")
            .withColumn("host_match", T.strip_port(T.nz(F.col("domain")), keep_leading=False)
                        == T.nz(F.col("endpoint_host"))))
    g = tied.groupBy(*COLL_KEY).agg(
        F.count(F.lit(1)).alias("n_tied"), F.min("service_key").alias("only_key"),
        F.min(F.when(F.col("host_match"), F.col("service_key"))).alias("host_key"),
        F.max("best").alias("best_score"))
    winner = F.when(F.col("n_tied") == 1, F.col("only_key")).otherwise(F.col("host_key"))
    status = (F.when(F.col("n_tied") == 1, F.lit("SCORE")).when(F.col("host_key").isNotNull(), F.lit("HOST"))
              .otherwise(F.lit("AMBIGUOUS")))
    return g.select(*COLL_KEY, winner.alias("winner"), status.alias("resolution"),
                    F.col("n_tied").cast("bigint").alias("n_tied"), "best_score")


def losers(cands: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every candidate at a resolved collision's (method, path) other than the winner."""
    r = resolved.where(F.col("winner").isNotNull()).select("http_method", "resource_path", "winner")
    return (cands.join(r, ["http_method", "resource_path"])
            .where(F.col("service_key") != F.col("winner")).drop("winner"))


def classify(cands: DataFrame, lost: DataFrame) -> DataFrame:
    """Unmatched or lost candidates -> DRIFT when the service keeps a retained managed op
    (first such API by (method, path)), else SHADOW; LOW confidence for losers, else HIGH."""
    key = ["service_key", "http_method", "resource_path"]
    flagged = cands.join(lost.select(*key, F.lit(True).alias("lost")), key, "left") \
        .withColumn("lost", F.coalesce(F.col("lost"), F.lit(False)))
    retained = (flagged.where(F.col("reg_api_id").isNotNull() & ~F.col("lost"))
                .groupBy("service_key")
                .agg(F.min(F.struct("http_method", "resource_path", "reg_api_id")).getField("reg_api_id")
                     .alias("managed_api_id")))
    unmanaged = flagged.where(F.col("reg_api_id").isNull() | F.col("lost"))
    out = unmanaged.join(retained, "service_key", "left")
    return out.select(
        *key, "request_domain", "host_ip", "server_port", "hit_count",
        F.when(F.col("managed_api_id").isNotNull(), F.lit("DRIFT")).otherwise(F.lit("SHADOW")).alias("classification"),
        F.when(F.col("lost"), F.lit("LOW")).otherwise(F.lit("HIGH")).alias("confidence"),
        "managed_api_id")


def compare(discovered: DataFrame, ops: DataFrame, apis: DataFrame, checkpoint: bool = True,
            counters: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The whole phase as DataFrames (ops and apis: active registered state).

    The candidate set (one row per discovered API) feeds six later steps, so it is checkpointed
    once instead of being recomputed by each of them. With ``counters`` the findings are written as well, and the
    cycle's counters (C18) are taken from the rows of both tables while they pass.
    """
    cands = match(discovered, ops)
    if counters is not None:
        cands = observed(cands, "candidates", candidate_counters(), counters)
    elif checkpoint:
        cands = materialize(cands, "candidates")
    coll = collisions(cands)
    resolved = resolve(cands, coll, ops, apis)
    lost = losers(cands, resolved)
    classified = classify(cands, lost)
    if counters is not None:
        classified = observed(classified, "classified", finding_counters(), counters)
    return {"candidates": cands, "collisions": coll, "resolved": resolved, "losers": lost, "classified": classified}


def collision_audit(cands: DataFrame, resolved: DataFrame) -> DataFrame:
    """C11: candidates at unresolved collisions; they stay managed (X4), listed here for review, with how many tie."""
    amb = resolved.where(F.col("resolution") == "AMBIGUOUS").select("http_method", "resource_path", "n_tied")
    return cands.join(amb, ["http_method", "resource_path"]).select(
        "service_key", "http_method", "resource_path", "reg_api_id", "n_tied")


def candidate_counters() -> dict[str, Column]:
    """Managed and unmatched APIs of a cycle."""
    return {"managed": F.count_if(F.col("reg_api_id").isNotNull()), "unmatched": F.count_if(F.col("reg_api_id").isNull())}


def finding_counters() -> dict[str, Column]:
    """Findings of a cycle, by class."""
    return {"unmanaged": F.count(F.lit(1)), "shadow": F.count_if(F.col("classification") == "SHADOW"),
            "drift": F.count_if(F.col("classification") == "DRIFT")}
