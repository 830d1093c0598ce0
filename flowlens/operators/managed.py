"""Phase 2, managed sync: API details -> API and operation rows; change detection; keyed merge.

State tables are DataFrames keyed by reg_api_id (APIs) and (reg_api_id, http_method, raw_target)
(operations), with soft delete in ``deleted_at``. Every step is a join or a column rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

API_COLS = ["reg_api_id", "api_name", "api_version", "context", "api_type", "lifecycle_status", "provider",
            "endpoint_type", "endpoint_url", "endpoint_hostname", "endpoint_port", "endpoint_basepath",
            "reg_last_updated_at", "reg_created_at"]
OP_COLS = ["reg_api_id", "http_method", "raw_target", "normalized_target", "match_path"]
# upsert keeps the first value of these
API_KEEP_FIRST = ["provider", "api_type", "reg_created_at"]


def managed_from_json(details: DataFrame, pass_through: bool = False) -> tuple[DataFrame, DataFrame]:
    """A5 + B9-B15: typed detail rows -> (API rows, operation rows)."""
    return managed_rows(with_endpoints(details), pass_through)


def with_endpoints(details: DataFrame) -> DataFrame:
    """B12 + B13: detail rows with their endpoint config (ep) and its URL (u) read, which APIs and operations both need."""
    d = details.select("*", T.endpoint_of("endpointConfig").alias("ep"))
    return d.select("*", T.parse_endpoint("ep.endpoint_url").alias("u"))


def managed_rows(d: DataFrame, pass_through: bool = False) -> tuple[DataFrame, DataFrame]:
    """B9-B11 + B14 + B15 on rows of ``with_endpoints``: (API rows, operation rows)."""
    apis = d.select(
        F.col("id").alias("reg_api_id"), T.nz(F.col("name")).alias("api_name"),
        T.nz(F.col("version")).alias("api_version"), T.nz(F.col("context")).alias("context"),
        T.nz(F.col("type")).alias("api_type"), T.nz(F.col("lifeCycleStatus")).alias("lifecycle_status"),
        T.nz(F.col("provider")).alias("provider"),
        F.col("ep.endpoint_type").alias("endpoint_type"), F.col("ep.endpoint_url").alias("endpoint_url"),
        F.col("u.host").alias("endpoint_hostname"), F.col("u.port").alias("endpoint_port"),
        F.col("u.path").alias("endpoint_basepath"),
        F.when(~T.blank("lastUpdatedTime"), T.parse_api_time("lastUpdatedTime")).alias("reg_last_updated_at"),
        F.when(~T.blank("createdTime"), T.parse_api_time("createdTime")).alias("reg_created_at"))
    ops = documented_ops(d.select(F.col("id").alias("reg_api_id"), "context", F.col("u.path").alias("basepath"),
                                  F.explode_outer("operations").alias("op")), pass_through)
    return apis, ops


def documented_ops(exploded: DataFrame, pass_through: bool) -> DataFrame:
    """B14 + B9/B10: upper-cased verbs without blank/OPTIONS/HEAD; normalized target and match path."""
    verb = F.upper(T.nz(F.col("op.verb")))
    target = T.nz(F.col("op.target"))
    norm = T.normalize_target(target)
    return (exploded.where(F.col("op").isNotNull() & ~verb.isin("", "OPTIONS", "HEAD"))
            .select("reg_api_id", verb.alias("http_method"), target.alias("raw_target"),
                    norm.alias("normalized_target"),
                    T.match_path(F.col("basepath"), F.col("context"), norm, pass_through).alias("match_path")))


def classify_sync(apis: DataFrame, state: DataFrame | None) -> DataFrame:
    """Created / updated / unchanged per current API.

    Unchanged when the stored timestamp equals the parsed one; NULL or unparsable counts as changed.
    Deviation X5: a stored row that is soft-deleted counts as changed, so it is revived.
    """
    if state is None:
        return apis.withColumn("sync_class", F.lit("created"))
    s = state.select("reg_api_id", F.col("reg_last_updated_at").alias("stored_at"),
                     F.col("deleted_at").alias("stored_deleted_at"), F.lit(True).alias("stored"))
    j = apis.join(s, "reg_api_id", "left")
    same = (F.col("reg_last_updated_at").isNotNull() & F.col("stored_at").isNotNull()
            & (F.col("reg_last_updated_at") == F.col("stored_at")) & F.col("stored_deleted_at").isNull())
    cls = F.when(F.col("stored").isNull(), F.lit("created")).when(same, F.lit("unchanged")).otherwise(F.lit("updated"))
    return j.withColumn("sync_class", cls).drop("stored_at", "stored_deleted_at", "stored")


def duplicate_op_apis(ops: DataFrame) -> DataFrame:
    """E3 guard: APIs with a duplicate (method, raw_target); the whole API is rejected."""
    return (ops.groupBy("reg_api_id", "http_method", "raw_target").count().where(F.col("count") > 1)
            .select("reg_api_id").distinct())


def merge_managed(api_state: DataFrame | None, op_state: DataFrame | None, apis: DataFrame, ops: DataFrame,
                  as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upsert changed APIs, replace their operations, touch unchanged ones, soft delete the gone.

    ``apis`` is the classified current list (classify_sync). Returns (api_state, op_state, rejects).
    Deletion (J9) is skipped when the current list is empty.
    """
    ts = F.lit(str(as_of)).cast("timestamp_ntz")
    rejects = duplicate_op_apis(ops)
    changed = apis.where(F.col("sync_class") != "unchanged").join(rejects, "reg_api_id", "left_anti")
    if api_state is None and op_state is None:
        # first sync into an empty store: every API is an insert, nothing to touch or delete
        none = F.lit(None).cast("timestamp_ntz")
        merged = changed.select(*API_COLS, none.alias("deleted_at"), ts.alias("last_synced_at"),
                                ts.alias("created_at"), ts.alias("updated_at"))
        new_ops = ops.join(changed.select("reg_api_id"), "reg_api_id", "left_semi") \
            .select(*OP_COLS, none.alias("deleted_at"))
        return merged, new_ops, rejects
    if api_state is None:
        api_state = apis.sparkSession.createDataFrame([], empty_api_state_schema())
    if op_state is None:
        op_state = apis.sparkSession.createDataFrame([], empty_op_state_schema())
    o, n = api_state.alias("o"), changed.select(*API_COLS).alias("n")
    j = o.join(n, "reg_api_id", "full_outer")
    has_n = F.col("n.api_name").isNotNull()
    has_o = F.col("o.api_name").isNotNull()
    cols = [F.col("reg_api_id")]
    for c in API_COLS[1:]:
        if c in API_KEEP_FIRST:
            cols.append(F.when(has_o, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(has_n, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    cols += [F.when(has_n, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("o.deleted_at")).alias("deleted_at"),
             F.when(has_n, ts).otherwise(F.col("o.last_synced_at")).alias("last_synced_at"),
             F.when(has_o, F.col("o.created_at")).otherwise(ts).alias("created_at"),
             F.when(has_n, ts).otherwise(F.col("o.updated_at")).alias("updated_at")]
    merged = j.select(*cols)
    # Unchanged APIs only get last_synced_at
    unchanged = apis.where(F.col("sync_class") == "unchanged").select("reg_api_id", F.lit(True).alias("touch"))
    merged = (merged.join(unchanged, "reg_api_id", "left")
              .withColumn("last_synced_at", F.when(F.col("touch"), ts).otherwise(F.col("last_synced_at")))
              .drop("touch"))
    # Operations of changed APIs are replaced as a whole
    new_ops = ops.join(changed.select("reg_api_id"), "reg_api_id", "left_semi") \
        .select(*OP_COLS, F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    kept_ops = op_state.join(changed.select("reg_api_id"), "reg_api_id", "left_anti")
    op_merged = kept_ops.unionByName(new_ops)
    # J9 + E5: active APIs missing from a non-empty current list are soft deleted, with their ops
    gone = detect_deleted(merged, apis)
    merged = (merged.join(gone.select("reg_api_id", F.lit(True).alias("gone")), "reg_api_id", "left")
              .withColumn("deleted_at", F.when(F.col("gone"), ts).otherwise(F.col("deleted_at")))
              .withColumn("updated_at", F.when(F.col("gone"), ts).otherwise(F.col("updated_at")))
              .drop("gone"))
    op_merged = (op_merged.join(gone.select("reg_api_id", F.lit(True).alias("gone")), "reg_api_id", "left")
                 .withColumn("deleted_at", F.when(F.col("gone") & F.col("deleted_at").isNull(), ts)
                             .otherwise(F.col("deleted_at")))
                 .drop("gone"))
    return merged, op_merged, rejects


def sync_counters() -> dict[str, Column]:
    """C18 (managed sync): created / updated / unchanged APIs."""
    return {c: F.count_if(F.col("sync_class") == c) for c in ("created", "updated", "unchanged")}


def detect_deleted(api_state: DataFrame, current: DataFrame) -> DataFrame:
    """Active stored APIs absent from the current list; nothing when the list is empty.

    The emptiness guard is an uncorrelated EXISTS subquery, evaluated once inside the plan.
    """
    active = api_state.where(F.col("deleted_at").isNull())
    return (active.join(current.select("reg_api_id"), "reg_api_id", "left_anti")
            .where(current.select("reg_api_id").exists()))


def active_ops(op_state: DataFrame, api_state: DataFrame) -> DataFrame:
    """Operations of non-deleted APIs, themselves not deleted."""
    live = api_state.where(F.col("deleted_at").isNull()).select("reg_api_id")
    return op_state.where(F.col("deleted_at").isNull()).join(live, "reg_api_id", "left_semi")


def count_active(api_state: DataFrame, op_state: DataFrame) -> DataFrame:
    """Active API and operation counts."""
    a = api_state.where(F.col("deleted_at").isNull()).agg(F.count(F.lit(1)).alias("active_apis"))
    o = op_state.where(F.col("deleted_at").isNull()).agg(F.count(F.lit(1)).alias("active_operations"))
    return a.select("active_apis", o.scalar().alias("active_operations"))


def ops_of(op_state: DataFrame, reg_api_id: str) -> DataFrame:
    """Active operations of one API."""
    return op_state.where((F.col("reg_api_id") == reg_api_id) & F.col("deleted_at").isNull())


def purge_ops(op_state: DataFrame, as_of, retention: str) -> DataFrame:
    """Drop operations deleted longer ago than the retention."""
    cut = F.lit(str(as_of)).cast("timestamp_ntz") - F.expr(f"INTERVAL {retention}")
    return op_state.where(~(F.col("deleted_at").isNotNull() & (F.col("deleted_at") < cut)))


def purge_managed(api_state: DataFrame, as_of, retention: str) -> DataFrame:
    """Drop APIs deleted longer ago than the retention."""
    cut = F.lit(str(as_of)).cast("timestamp_ntz") - F.expr(f"INTERVAL {retention}")
    return api_state.where(~(F.col("deleted_at").isNotNull() & (F.col("deleted_at") < cut)))


def empty_api_state_schema() -> str:
    return ("reg_api_id string, api_name string, api_version string, context string, api_type string, "
            "lifecycle_status string, provider string, endpoint_type string, endpoint_url string, "
            "endpoint_hostname string, endpoint_port int, endpoint_basepath string, "
            "reg_last_updated_at timestamp_ntz, reg_created_at timestamp_ntz, deleted_at timestamp_ntz, "
            "last_synced_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz")


def empty_op_state_schema() -> str:
    return ("reg_api_id string, http_method string, raw_target string, normalized_target string, "
            "match_path string, deleted_at timestamp_ntz")
