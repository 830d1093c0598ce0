"""Phase 5, catalog: push plan for generated documents (B24, J15, G1-G6, A8) and ownership
reconciliation of the external catalog (J14, G7, G8).

The HTTP calls of the reference become a plan table: one row per group with the action the
catalog client has to take (CREATE / UPDATE / REPLACE / SKIP) and the payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions import text as T
from .lifecycle import GROUP

SHADOW_NOTE = "[SHADOW] unregistered service %s, seen in traffic"
DRIFT_NOTE = "[DRIFT] unregistered operations of service %s, seen in traffic"


def pushable(groups: DataFrame, opts: Options) -> DataFrame:
    """Drop SHADOW groups unless push_shadow, DRIFT groups unless push_drift."""
    keep = F.lit(True)
    if not opts.push_shadow:
        keep = keep & (F.col("classification") != "SHADOW")
    if not opts.push_drift:
        keep = keep & (F.col("classification") != "DRIFT")
    return groups.where(keep)


def catalog_name(opts: Options) -> Column:
    """DRIFT -> parent API name from the document + '-Drift'; else the service key title."""
    parent = F.get_json_object(F.col("openapi_spec"),
                               f"$.info['{opts.ext_prefix}-metadata'].parent_api_name")
    return (F.when((F.col("classification") == "DRIFT") & (T.nz(parent) != ""), F.concat(parent, F.lit("-Drift")))
            .otherwise(T.title_of("service_key")))


def service_url() -> Column:
    """First server URL of the document, else http://unknown-host."""
    u = F.get_json_object(F.col("openapi_spec"), "$.servers[0].url")
    return F.coalesce(T.nullif_blank(u), F.lit("http://unknown-host"))


def push_description(opts: Options) -> Column:
    """Ownership marker then the classification note."""
    note = F.when(F.col("classification") == "SHADOW", F.format_string(SHADOW_NOTE, F.col("service_key"))) \
        .otherwise(F.format_string(DRIFT_NOTE, F.col("service_key")))
    return F.concat(F.lit(f"[{opts.owner_tag}:{opts.hostname}] "), note)


def push_plan(groups: DataFrame, catalog: DataFrame, opts: Options, as_of) -> DataFrame:
    """G1-G3 (+J15): the catalog action per pushable group.

    No catalog id -> CREATE; a CREATE whose name is already in the catalog -> UPDATE of the first
    such entry (conflict recovery); a known id present in the catalog -> UPDATE; a known id gone ->
    CREATE again if re_push_deleted, else SKIP. An UPDATE whose entry has another name or version
    -> REPLACE (delete the entry, create anew).
    """
    version = F.date_format(F.lit(str(as_of)).cast("timestamp_ntz"), "yyyy.MM.dd")
    g = pushable(groups, opts).select(*GROUP, "catalog_service_id", "openapi_spec",
                                      catalog_name(opts).alias("catalog_name"), version.alias("catalog_version"))
    by_id = catalog.select(F.col("id").alias("_id"), F.col("name").alias("_id_name"),
                           F.col("version").alias("_id_version"))
    by_name = (catalog.groupBy("name").agg(F.min(F.struct("id", "version")).alias("_first"))
               .select(F.col("name").alias("_name"), F.col("_first.id").alias("_name_id"),
                       F.col("_first.version").alias("_name_version")))
    j = (g.join(by_id, g["catalog_service_id"] == by_id["_id"], "left")
          .join(by_name, g["catalog_name"] == by_name["_name"], "left"))
    has_id = F.col("catalog_service_id").isNotNull()
    found = F.col("_id").isNotNull()
    base = (F.when(~has_id, F.lit("CREATE")).when(found, F.lit("UPDATE"))
            .when(F.lit(opts.re_push_deleted), F.lit("CREATE")).otherwise(F.lit("SKIP")))
    conflict = (base == "CREATE") & F.col("_name_id").isNotNull()
    target = F.when(base == "UPDATE", F.col("_id")).when(conflict, F.col("_name_id"))
    t_name = F.when(base == "UPDATE", F.col("_id_name")).when(conflict, F.col("_name"))
    t_version = F.when(base == "UPDATE", F.col("_id_version")).when(conflict, F.col("_name_version"))
    is_update = (base == "UPDATE") | conflict
    differs = ~(t_name == F.col("catalog_name")) | ~(t_version == F.col("catalog_version"))
    action = F.when(is_update & differs, F.lit("REPLACE")).when(is_update, F.lit("UPDATE")).otherwise(base)
    return j.select(*GROUP, "catalog_service_id", action.alias("action"), target.alias("target_id"),
                    "catalog_name", "catalog_version", service_url().alias("service_url"),
                    push_description(opts).alias("description"), "openapi_spec")


def push_results(plan: DataFrame) -> DataFrame:
    """Outcome rows for E11/E12 when every planned call succeeds: created entries get a new id
    (the plan's target for updates); the catalog client fills real ids."""
    new_id = F.concat(F.lit("new:"), F.col("catalog_name"), F.lit(":"), F.col("catalog_version"))
    cid = F.when(F.col("action") == "UPDATE", F.col("target_id")).when(F.col("action") == "SKIP",
                                                                       F.col("catalog_service_id")).otherwise(new_id)
    return plan.select(*GROUP, "action", cid.alias("catalog_service_id"), "catalog_version")


def write_push_plan(plan: DataFrame, path: str) -> None:
    """One JSON record per group (metadata + document), partitioned by action."""
    (plan.select("action", "target_id", F.struct(F.col("catalog_name").alias("name"),
                                                  F.col("catalog_version").alias("version"),
                                                  F.col("description").alias("description"),
                                                  F.col("service_url").alias("serviceUrl"),
                                                  F.lit("OAS3").alias("definitionType"),
                                                  F.lit(False).alias("mutualSSLEnabled")).alias("metadata"),
                 F.col("openapi_spec").alias("definition"))
     .write.mode("errorifexists").partitionBy("action").json(path))


def reconcile(catalog: DataFrame, tracked: DataFrame, opts: Options) -> DataFrame:
    """G7 + G8 (+J14): ownership class of every catalog entry.

    Tracked id -> ours; marker owner = this host -> ours; another owner -> other; no marker ->
    unowned (listed for deletion when cleanup_unowned).
    """
    t = tracked.select(F.col("catalog_service_id").alias("id")).distinct().withColumn("_tracked", F.lit(True))
    owner = T.owner_of("description", opts.owner_tag)
    j = catalog.join(t, "id", "left").select("id", "name", "version", owner.alias("owner"),
                                             F.coalesce(F.col("_tracked"), F.lit(False)).alias("tracked"))
    cls = (F.when(F.col("tracked"), F.lit("ours")).when(F.col("owner") == opts.hostname, F.lit("ours"))
           .when(F.col("owner") != "", F.lit("other")).otherwise(F.lit("unowned")))
    return j.select("id", "name", "version", "owner", cls.alias("ownership"),
                    ((cls == "unowned") & F.lit(bool(opts.cleanup_unowned))).alias("delete"))


def reconcile_counters() -> dict[str, Column]:
    """C18 (reconciliation): ours / other / unowned / deleted entries."""
    of = lambda name: F.count_if(F.col("ownership") == name)
    return {"ours": of("ours"), "other": of("other"), "unowned": of("unowned"), "deleted": F.count_if(F.col("delete"))}
