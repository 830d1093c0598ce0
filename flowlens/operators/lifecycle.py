"""Lifecycle of unmanaged findings (E7-E13), retention (E14-E17) and group reads.

The unmanaged state is keyed by the discovered key (service_key, http_method, resource_path); a
merge is a full outer join of the state with the cycle's classification plus per-column rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import null_safe_join

KEY = ["service_key", "http_method", "resource_path"]
GROUP = ["service_key", "classification", "managed_api_id"]
TERMINAL = ("DISMISSED", "RESOLVED", "STALE")
UNMANAGED_COLS = KEY + ["managed_api_id", "classification", "confidence", "status", "first_detected_at",
                        "last_confirmed_at", "resolved_at", "spec_generated_at",
                        "catalog_service_id", "catalog_version", "pushed_at", "created_at", "updated_at"]

UNMANAGED_SCHEMA = ("service_key string, http_method string, resource_path string, managed_api_id string, "
                    "classification string, confidence string, status string, first_detected_at timestamp_ntz, "
                    "last_confirmed_at timestamp_ntz, resolved_at timestamp_ntz, "
                    "spec_generated_at timestamp_ntz, catalog_service_id string, catalog_version string, "
                    "pushed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz")


def _ts(as_of) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def _cut(as_of, interval: str) -> Column:
    return _ts(as_of) - F.expr(f"INTERVAL {interval}")


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], UNMANAGED_SCHEMA)


def merge_unmanaged(state: DataFrame | None, classified: DataFrame, as_of) -> DataFrame:
    """Upsert of the cycle's findings.

    New -> DETECTED. Confirmed again -> DETECTED when the classification or the managed API changed
    or the row was RESOLVED/STALE, else the status is kept; resolved_at is cleared in the same cases.
    first_detected_at, spec and catalog id are kept. ``_prev_status`` keeps the status before the
    cycle (used by the updated_at rule of the cycle, deviation X9).
    """
    ts = _ts(as_of)
    if state is None:
        state = empty_state(classified.sparkSession)
    n = classified.select(*KEY, "managed_api_id", "classification", "confidence").alias("n")
    o = state.alias("o")
    j = o.join(n, KEY, "full_outer")
    has_o, has_n = F.col("o.status").isNotNull(), F.col("n.classification").isNotNull()
    reopen = (~(F.col("o.classification") == F.col("n.classification"))
              | ~F.col("o.managed_api_id").eqNullSafe(F.col("n.managed_api_id"))
              | F.col("o.status").isin("RESOLVED", "STALE"))
    status = (F.when(~has_o, F.lit("DETECTED")).when(~has_n, F.col("o.status"))
              .when(reopen, F.lit("DETECTED")).otherwise(F.col("o.status")))
    resolved_at = (F.when(~has_o, F.lit(None).cast("timestamp_ntz")).when(~has_n, F.col("o.resolved_at"))
                   .when(reopen, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("o.resolved_at")))

    def newer(c):
        return F.when(has_n, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    def kept(c, default=None):
        return F.when(has_o, F.col(f"o.{c}")).otherwise(default if default is not None else F.col(f"o.{c}"))
    return j.select(
        *KEY, newer("managed_api_id").alias("managed_api_id"), newer("classification").alias("classification"),
        newer("confidence").alias("confidence"), status.alias("status"),
        kept("first_detected_at", ts).alias("first_detected_at"),
        F.when(has_n, ts).otherwise(F.col("o.last_confirmed_at")).alias("last_confirmed_at"),
        resolved_at.alias("resolved_at"),
        *[F.col(f"o.{c}").alias(c) for c in ("spec_generated_at", "catalog_service_id",
                                            "catalog_version", "pushed_at")],
        kept("created_at", ts).alias("created_at"), F.col("o.updated_at").alias("updated_at"),
        F.col("o.status").alias("_prev_status"))


def mark_resolved(state: DataFrame, cycle_start, discovery_empty: Column | None = None) -> DataFrame:
    """Active rows not confirmed in this cycle -> RESOLVED (skipped when discovery is empty)."""
    ts = _ts(cycle_start)
    hit = ~F.col("status").isin(*TERMINAL) & (F.col("last_confirmed_at") < ts)
    if discovery_empty is not None:
        hit = hit & ~discovery_empty
    return (state.withColumn("resolved_at", F.when(hit, ts).otherwise(F.col("resolved_at")))
                 .withColumn("status", F.when(hit, F.lit("RESOLVED")).otherwise(F.col("status"))))


def mark_stale(state: DataFrame, discovered: DataFrame, after: str, as_of) -> DataFrame:
    """E9 (+J12): active rows whose discovered row was last seen before as_of - after -> STALE."""
    seen = discovered.select(*KEY, F.col("last_seen_at").alias("_last_seen"))
    j = state.join(seen, KEY, "left")
    hit = ~F.col("status").isin(*TERMINAL) & (F.col("_last_seen") < _cut(as_of, after))
    return (j.withColumn("resolved_at", F.when(hit, _ts(as_of)).otherwise(F.col("resolved_at")))
             .withColumn("status", F.when(hit, F.lit("STALE")).otherwise(F.col("status")))
             .drop("_last_seen"))


def finish_cycle(state: DataFrame, as_of) -> DataFrame:
    """updated_at of the cycle: set for new rows and rows whose status ended different from before
    the cycle; a row that ends in the status it started with keeps updated_at (deviation X9)."""
    touched = F.col("_prev_status").isNull() | ~(F.col("_prev_status") == F.col("status"))
    return (state.withColumn("updated_at", F.when(touched, _ts(as_of)).otherwise(F.col("updated_at")))
                 .drop("_prev_status").select(*UNMANAGED_COLS))


def comparison_cycle(state: DataFrame | None, classified: DataFrame, discovered: DataFrame, as_of,
                     stale_after: str = "7 days") -> DataFrame:
    """E7 -> E8 -> E9 for one comparison cycle; the whole cycle is skipped on an empty discovery."""
    merged = merge_unmanaged(state, classified, as_of)
    empty = ~discovered.select("service_key").exists()
    resolved = mark_resolved(merged, as_of, empty)
    return finish_cycle(mark_stale(resolved, discovered, stale_after, as_of), as_of)


def dismiss(state: DataFrame, keys: DataFrame, as_of) -> DataFrame:
    """Operator dismissal (terminal for E8-E11; E7 can reopen it)."""
    k = keys.select(*KEY, F.lit(True).alias("_d"))
    j = state.join(k, KEY, "left")
    return (j.withColumn("status", F.when(F.col("_d"), F.lit("DISMISSED")).otherwise(F.col("status")))
             .withColumn("updated_at", F.when(F.col("_d"), _ts(as_of)).otherwise(F.col("updated_at")))
             .drop("_d"))


def _in_group(groups: DataFrame, extra=()) -> tuple[DataFrame, Column]:
    """Join condition of a group read: same service, classification and API, where a NULL API is a group of its own,
    so a finding is in one group."""
    g = groups.select(F.col("service_key").alias("_g_sk"), F.col("classification").alias("_g_cls"),
                      F.col("managed_api_id").alias("_g_api"), *extra)
    cond = ((F.col("service_key") == F.col("_g_sk")) & (F.col("classification") == F.col("_g_cls"))
            & F.col("managed_api_id").eqNullSafe(F.col("_g_api")))
    return g, cond


def apply_specs(state: DataFrame, specs: DataFrame, as_of) -> DataFrame:
    """Active findings of a group that got a document -> SPEC_GENERATED. The document stays in the documents table
    under its group and is copied to no finding."""
    g, cond = _in_group(specs, [F.lit(True).alias("_hit")])
    j = state.join(g, cond & ~F.col("status").isin(*TERMINAL), "left")
    hit = F.col("_hit").isNotNull()
    ts = _ts(as_of)
    return j.select(*[F.when(hit, F.lit("SPEC_GENERATED")).otherwise(F.col(c)).alias(c) if c == "status"
                      else F.when(hit, ts).otherwise(F.col(c)).alias(c) if c in ("spec_generated_at", "updated_at")
                      else F.col(c) for c in UNMANAGED_COLS])


def merge_documents(documents: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Documents table, one row per group: a group's fresh document replaces its old one."""
    if documents is None:
        return fresh
    return null_safe_join(documents, fresh.select(*GROUP), GROUP, "left_anti").unionByName(fresh)


def apply_push_results(state: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """CREATE, UPDATE, REPLACE results mark every active row of the group PUSHED with the
    catalog id and version; SKIP marks only SPEC_GENERATED rows PUSHED and keeps their id."""
    ts = _ts(as_of)
    g, cond = _in_group(results, [F.col("action").alias("_act"), F.col("catalog_service_id").alias("_cid"),
                                  F.col("catalog_version").alias("_cver")])
    pushed = F.col("_act").isin("CREATE", "UPDATE", "REPLACE") & ~F.col("status").isin(*TERMINAL)
    skipped = (F.col("_act") == "SKIP") & (F.col("status") == "SPEC_GENERATED")
    j = state.join(g, cond, "left")
    hit = pushed | skipped
    cols = []
    for c in UNMANAGED_COLS:
        if c == "status":
            cols.append(F.when(hit, F.lit("PUSHED")).otherwise(F.col(c)).alias(c))
        elif c == "pushed_at":
            cols.append(F.when(pushed, ts).otherwise(F.col(c)).alias(c))
        elif c == "catalog_service_id":
            cols.append(F.when(pushed, F.col("_cid")).otherwise(F.col(c)).alias(c))
        elif c == "catalog_version":
            cols.append(F.when(pushed, F.col("_cver")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, ts).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


# ------------------------------------------------------------------------------ group reads

def detected_groups(state: DataFrame) -> DataFrame:
    """Groups with at least one DETECTED row."""
    return state.where(F.col("status") == "DETECTED").select(*GROUP).distinct()


def push_groups(state: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per SPEC_GENERATED group that has a document; the catalog id of the group, NULLS LAST. Only the group
    key and the id are aggregated; the document joins afterwards, once a group."""
    g = (state.where(F.col("status") == "SPEC_GENERATED").groupBy(*GROUP)
         .agg(F.min("catalog_service_id").alias("catalog_service_id")))
    return null_safe_join(g, documents.select(*GROUP, "openapi_spec"), GROUP)


def tracked_ids(state: DataFrame) -> DataFrame:
    """C14: distinct catalog ids referenced by the state."""
    return state.where(F.col("catalog_service_id").isNotNull()).select("catalog_service_id").distinct()


def count_by_class(state: DataFrame) -> DataFrame:
    """Findings per classification, excluding RESOLVED and STALE."""
    return (state.where(~F.col("status").isin("RESOLVED", "STALE"))
            .groupBy("classification").agg(F.count(F.lit(1)).alias("findings")))


# ------------------------------------------------------------------------------- retention

def purge_discovered(discovered: DataFrame, unmanaged: DataFrame, as_of, retention: str) -> DataFrame:
    """E14 (+J11): drop discovered rows last seen before the cut that no active finding refers to."""
    active = unmanaged.where(~F.col("status").isin(*TERMINAL)).select(*KEY)
    old = discovered.where(F.col("last_seen_at") < _cut(as_of, retention)).join(active, KEY, "left_anti")
    return discovered.join(old.select(*KEY), KEY, "left_anti")


def purge_unmanaged(state: DataFrame, as_of, retention: str) -> DataFrame:
    """Drop RESOLVED / STALE / DISMISSED findings not updated within the retention."""
    gone = F.col("status").isin(*TERMINAL) & (F.col("updated_at") < _cut(as_of, retention))
    return state.where(~gone)
