"""Registered queries: one per operator of the inventory, each with its DuckDB twin.

A query takes (spark, sf_dir), reads the driver tables through the fixture views and runs the
engine's own operators on the whole tables. The oracle SQL runs the same semantics in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Options
from ..operators import discovery as D
from ..session import materialize, observed
from ..sources import fixtures as fx
from .oracle import Oracle, strip_port_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, tuple[str, tuple]] = {}
OPTS: Options = DEFAULT
_oracle = Oracle(OPTS)


def query(name: str, final: str | None = None, needs=(), oracle: Oracle | None = None):
    """Register a Spark query and (unless final is None) its oracle: final SELECT + needed CTEs, of the default
    options' oracle or of another's."""
    def deco(fn):
        QUERIES[name] = fn
        if final is not None:
            ORACLE[name] = (final, tuple(needs), oracle or _oracle)
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    return {n: oracle.sql(final, needs) for n, (final, needs, oracle) in ORACLE.items()}


# ------------------------------------------------------------------------------ shared inputs

WINDOW_START, WINDOW_END = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def flows(spark, sf_dir) -> DataFrame:
    return fx.flows(spark, sf_dir)


def discovery(spark, sf_dir, start=None, end=None) -> dict[str, DataFrame]:
    return D.discover_batch(flows(spark, sf_dir), OPTS, start, end)


# --------------------------------------------------------------------------- discovery queries

@query("flow_scan",
       f"SELECT flow_id, observation_point, start_time, request_type, endpoint FROM flows "
       f"WHERE start_time >= TIMESTAMP '{WINDOW_START}' AND start_time < TIMESTAMP '{WINDOW_END}'", ["flows"])
def q_flow_scan(spark, sf_dir):
    """A1: time-bounded flow scan, half-open [start, end)."""
    return D.time_window(flows(spark, sf_dir), WINDOW_START, WINDOW_END) \
        .select("flow_id", "observation_point", "start_time", "request_type", "endpoint")


@query("observations_s",
       "SELECT flow_id, request_resource, request_type, CAST(floor(epoch(start_time)) AS BIGINT) AS start_second, "
       "ip4_0 AS source_ip, ip4_1 AS host_ip, is_internet_0 AS is_external FROM flows WHERE observation_point = 's'",
       ["flows"])
def q_observations_s(spark, sf_dir):
    """Server-network observation rows with the side columns renamed."""
    return D.observations(flows(spark, sf_dir), "s")


def _observation_sql(point: str) -> str:
    cols = ", ".join(f"{src} AS {dst}" for src, dst in D.OBS_COLUMNS[point].items())
    return ("SELECT flow_id, request_resource, request_type, CAST(floor(epoch(start_time)) AS BIGINT) AS start_second, "
            f"{cols} FROM flows WHERE observation_point = '{point}'")


@query("observations_sp", _observation_sql("s-p"), ["flows"])
def q_observations_sp(spark, sf_dir):
    """Server-process observation rows with the side columns renamed."""
    return D.observations(flows(spark, sf_dir), "s-p")


@query("observations_cp", _observation_sql("c-p"), ["flows"])
def q_observations_cp(spark, sf_dir):
    """Client-process observation rows with the side columns renamed."""
    return D.observations(flows(spark, sf_dir), "c-p")


@query("traffic_filter",
       "SELECT flow_id, request_type, endpoint, server_port, agent_id FROM sp_filtered", ["sp_filtered"])
def q_traffic_filter(spark, sf_dir):
    """B1: traffic predicate."""
    return D.traffic_filter(flows(spark, sf_dir), OPTS).select("flow_id", "request_type", "endpoint",
                                                                "server_port", "agent_id")


@query("signatures", "SELECT * FROM sigs", ["sigs"])
def q_signatures(spark, sf_dir):
    """Signature aggregation with one coherent sample row per signature."""
    return discovery(spark, sf_dir)["signatures"]


@query("top_signatures",
       "SELECT http_method, endpoint, server_port, agent_id, hit_count FROM sigs "
       "ORDER BY hit_count DESC, http_method, endpoint, server_port, agent_id LIMIT 1000", ["sigs"])
def q_top_signatures(spark, sf_dir):
    """Top-k signatures by hits (k = 1000, the per-cycle cap); the limit is the feature."""
    sigs = discovery(spark, sf_dir)["signatures"]
    return D.top_signatures(sigs, 1000).select("http_method", "endpoint", "server_port", "agent_id", "hit_count")


@query("total_hits", "SELECT CAST(coalesce(sum(hit_count), 0) AS BIGINT) AS total_hits FROM deduped", ["deduped"])
def q_total_hits(spark, sf_dir):
    """C4: cycle total of hits after dedup."""
    return D.total_hits(discovery(spark, sf_dir)["deduped"])


@query("noise_audit",
       "SELECT coalesce(reason, 'kept') AS reason, count(*) AS signatures, CAST(sum(hit_count) AS BIGINT) AS hits "
       "FROM sigs_reason GROUP BY ALL", ["sigs_reason"])
def q_noise_audit(spark, sf_dir):
    """Signatures and hits per noise reason."""
    return D.noise_audit(discovery(spark, sf_dir)["signatures"], OPTS)


OPTS_NOISE = replace(OPTS, excluded_agent_ids=(4,), excluded_ports=(8082,))


@query("noise_by_agent_and_port",
       "SELECT coalesce(reason, 'kept') AS reason, count(*) AS signatures, CAST(sum(hit_count) AS BIGINT) AS hits "
       "FROM sigs_reason GROUP BY ALL", ["sigs_reason"], Oracle(OPTS_NOISE))
def q_noise_by_agent_and_port(spark, sf_dir):
    """B3 + B4: agent and port sets switched on; the first matching rule counts."""
    return D.noise_audit(D.discover_batch(flows(spark, sf_dir), OPTS_NOISE)["signatures"], OPTS_NOISE)


_NOISE_TABLES = {
    "agent": ("nation", "SELECT n_nationkey AS agent_id FROM nation WHERE n_nationkey % 24 = 4"),
    "port": ("region", "SELECT 8080 + r_regionkey AS port FROM region WHERE r_regionkey > 1"),
    "domain": ("supplier", "SELECT concat('SVC', CAST(s_suppkey AS STRING), '.Shop.example.com') AS domain FROM supplier "
                           "WHERE s_suppkey % 4 = 3")}
_IN = {"agent": "agent_id", "port": "server_port", "domain": strip_port_sql("lower(request_domain)")}
_oracle.add("sigs_excluded", "SELECT *, CASE " + " ".join(
    f"WHEN {_IN[k]} IN (SELECT {'lower(domain)' if k == 'domain' else '*'} FROM ({sql}) x) OR coalesce(reason = '{k}', false) THEN '{k}'"
    for k, (_, sql) in _NOISE_TABLES.items()) + " ELSE reason END AS found FROM sigs_reason", ["sigs_reason"])


def _noise_tables(spark, sf_dir):
    fx.register_tables(spark, sf_dir, tuple(t for t, _ in _NOISE_TABLES.values()))
    return {kind: spark.sql(sql) for kind, (_, sql) in _NOISE_TABLES.items()}


@query("noise_by_tables", "SELECT coalesce(found, 'kept') AS reason, count(*) AS signatures, "
       "CAST(sum(hit_count) AS BIGINT) AS hits FROM sigs_excluded GROUP BY ALL", ["sigs_excluded"])
def q_noise_by_tables(spark, sf_dir):
    """Exclusion sets that come from tables, beside those of the options."""
    return D.noise_audit(discovery(spark, sf_dir)["signatures"], OPTS, _noise_tables(spark, sf_dir))


@query("kept_by_tables", "SELECT http_method, endpoint, server_port, agent_id, hit_count FROM sigs_excluded WHERE found IS NULL",
       ["sigs_excluded"])
def q_kept_by_tables(spark, sf_dir):
    """B3-B5 + B7b: signatures that no rule and no exclusion table removes."""
    parts = D.discover_batch(flows(spark, sf_dir), OPTS, exclusions=_noise_tables(spark, sf_dir))
    return parts["kept"].select("http_method", "endpoint", "server_port", "agent_id", "hit_count")


@query("noise_filtered", "SELECT http_method, endpoint, server_port, agent_id, hit_count FROM kept", ["kept"])
def q_noise_filtered(spark, sf_dir):
    """Signatures kept by the noise filter."""
    return discovery(spark, sf_dir)["kept"].select("http_method", "endpoint", "server_port", "agent_id", "hit_count")


@query("normalized_paths", "SELECT http_method, endpoint, server_port, agent_id, resource_path FROM normalized",
       ["normalized"])
def q_normalized_paths(spark, sf_dir):
    """Per-segment normalization of every kept endpoint."""
    kept = discovery(spark, sf_dir)["kept"]
    return D.normalize(kept, OPTS).select("http_method", "endpoint", "server_port", "agent_id", "resource_path")


# Patterns of users: some that Java alone reads (or reads otherwise), some that only a look at the grammar tells apart.
OPTS_USER = replace(OPTS, user_patterns=(
    r"^\++$", r"^[*+]x$", r"^item[0-9&&[]+$", r"^\h+$", r"^(?=d)daily$", r"(?i)^REPORT(?-i)s$", r"^orders?+$", r"^a{2}{3}$",
    r"^[[:lower:]\d-]{1,5}$"), exclude_patterns=(*OPTS.exclude_patterns, r"^(?P<keep>items)\z"))


@query("user_patterns", "SELECT http_method, endpoint, server_port, agent_id, resource_path FROM normalized", ["normalized"],
       Oracle(OPTS_USER))
def q_user_patterns(spark, sf_dir):
    """Patterns of users, read as RE2 reads them; those it would not compile are skipped."""
    kept = D.discover_batch(flows(spark, sf_dir), OPTS_USER)["kept"]
    return D.normalize(kept, OPTS_USER).select("http_method", "endpoint", "server_port", "agent_id", "resource_path")


@query("normalized_endpoints",
       "SELECT http_method, resource_path, CAST(sum(hit_count) AS BIGINT) AS hits, "
       "count(DISTINCT (server_port, agent_id)) AS services FROM deduped GROUP BY ALL", ["deduped"])
def q_normalized_endpoints(spark, sf_dir):
    """Minimal slice: flows -> B1 -> C1 -> B7b -> B8 -> C3; hits and services per (method, path)."""
    d = discovery(spark, sf_dir)["deduped"]
    return d.groupBy("http_method", "resource_path").agg(
        F.sum("hit_count").cast("bigint").alias("hits"),
        F.countDistinct("server_port", "agent_id").alias("services"))


@query("deduped_signatures",
       "SELECT http_method, resource_path, server_port, agent_id, hit_count, sample_path, sample_url, sample_second, "
       "request_domain, is_tls, protocol, http_version, response_code, latency_us, first_seen_at, last_seen_at "
       "FROM deduped", ["deduped"])
def q_deduped(spark, sf_dir):
    """Dedup after normalization; representative = most-hit member."""
    return discovery(spark, sf_dir)["deduped"].drop("rank")


@query("enrichable",
       "SELECT http_method, resource_path, server_port, agent_id, sample_url, "
       "regexp_full_match(sample_url, '[A-Za-z0-9/_.~:?=&%+@#,; \\[\\]-]*') AS enrichable FROM deduped", ["deduped"])
def q_enrichable(spark, sf_dir):
    """Sample URLs usable for fusion lookups (others stay un-enriched but are kept)."""
    from ..functions.text import is_enrichable
    d = discovery(spark, sf_dir)["deduped"]
    return d.select(*D.DEDUP_KEY, "sample_url", is_enrichable("sample_url").alias("enrichable"))


_KEYS = "http_method, resource_path, server_port, agent_id"


@query("fusion_sp",
       f"SELECT {_KEYS}, request_domain, k8s_service, k8s_namespace, k8s_workload, k8s_pod, k8s_cluster, k8s_node, "
       "vm_hostname, process_name, service_ip FROM fused", ["fused"])
def q_fusion_sp(spark, sf_dir):
    """Server-process attach (last row wins; domain filled only when blank)."""
    return discovery(spark, sf_dir)["fused"].select(*D.DEDUP_KEY, "request_domain", *D.SP_LAST_COLS)


@query("fusion_s", f"SELECT {_KEYS}, source_ip, host_ip, is_external FROM fused", ["fused"])
def q_fusion_s(spark, sf_dir):
    """Server-network attach (first non-blank; is_external from the first row)."""
    return discovery(spark, sf_dir)["fused"].select(*D.DEDUP_KEY, "source_ip", "host_ip", "is_external")


@query("fusion_cp", f"SELECT {_KEYS}, " + ", ".join(D.CP_COLS) + " FROM fused", ["fused"])
def q_fusion_cp(spark, sf_dir):
    """Client-process attach (first non-blank per column)."""
    return discovery(spark, sf_dir)["fused"].select(*D.DEDUP_KEY, *D.CP_COLS)


_FUSED_OUT = (["http_method", "resource_path", "server_port", "agent_id", "hit_count", "sample_path", "sample_url",
               "sample_second", "request_domain", "is_tls", "protocol", "http_version", "response_code",
               "latency_us"] + D.SP_LAST_COLS + ["source_ip", "host_ip", "is_external"] + D.CP_COLS
              + ["service_key", "service_type", "traffic_origin"])


@query("fused_signatures", "SELECT " + ", ".join(_FUSED_OUT) + " FROM fused", ["fused"])
def q_fused(spark, sf_dir):
    """J1-J4 + B16-B18: fused records with service identity."""
    return discovery(spark, sf_dir)["fused"].select(*_FUSED_OUT)


@query("service_keys", f"SELECT {_KEYS}, service_key FROM fused", ["fused"])
def q_service_keys(spark, sf_dir):
    """Six-step service key chain."""
    return discovery(spark, sf_dir)["fused"].select(*D.DEDUP_KEY, "service_key")


@query("service_types", "SELECT service_key, service_type, count(*) AS signatures FROM fused GROUP BY ALL", ["fused"])
def q_service_types(spark, sf_dir):
    """Service type per service key."""
    return discovery(spark, sf_dir)["fused"].groupBy("service_key", "service_type") \
        .agg(F.count(F.lit(1)).alias("signatures"))


@query("traffic_origins", "SELECT service_key, traffic_origin, count(*) AS signatures FROM fused GROUP BY ALL",
       ["fused"])
def q_traffic_origins(spark, sf_dir):
    """Traffic origin per service key."""
    return discovery(spark, sf_dir)["fused"].groupBy("service_key", "traffic_origin") \
        .agg(F.count(F.lit(1)).alias("signatures"))


@query("width_rejects", f"SELECT {_KEYS}, service_key, reject_reason FROM fused_reason", ["fused_reason"])
def q_width_rejects(spark, sf_dir):
    """Column-width check of every fused row (NULL reason = row fits)."""
    fused = discovery(spark, sf_dir)["fused"]
    return fused.select(*D.DEDUP_KEY, "service_key", D.width_reason(columns=set(fused.columns)).alias("reject_reason"))


@query("width_rejects_edge", f"SELECT {_KEYS}, reject_reason FROM fused_reason_edge WHERE reject_reason IS NOT NULL",
       ["fused_reason_edge"])
def q_width_rejects_edge(spark, sf_dir):
    """Rows whose host name is wider than its column are rejected with the column's name."""
    parts = D.discover_batch(fx.edge_flows(spark, sf_dir), OPTS)
    return parts["rejects"].select(*D.DEDUP_KEY, "reject_reason")


OPTS_WIDE_TOLERANCE = replace(OPTS, fusion_tolerance_ms=1500)


@query("fusion_tolerance", f"SELECT {_KEYS}, service_ip, source_ip, host_ip, is_external, source_service_ip, "
       "source_process_name, source_k8s_service, service_key FROM fused", ["fused"], Oracle(OPTS_WIDE_TOLERANCE))
def q_fusion_tolerance(spark, sf_dir):
    """A tolerance of 1500 ms, so observations of the neighbouring seconds match as well."""
    return D.discover_batch(flows(spark, sf_dir), OPTS_WIDE_TOLERANCE)["fused"].select(
        *D.DEDUP_KEY, "service_ip", "source_ip", "host_ip", "is_external", "source_service_ip", "source_process_name",
        "source_k8s_service", "service_key")


# ----------------------------------------------------------------------------- managed queries

from ..operators import comparison as C  # noqa: E402
from ..operators import managed as M  # noqa: E402
from ..sources import registry as A  # noqa: E402
from . import scenarios as S  # noqa: E402


@query("published_apis", "SELECT DISTINCT reg_api_id, api_name, api_type FROM m_pub", ["m_pub"])
def q_published(spark, sf_dir):
    """A4: published APIs of the included types."""
    return A.published(S.details(spark, sf_dir), OPTS.include_api_types) \
        .select(F.col("id").alias("reg_api_id"), F.col("name").alias("api_name"), F.col("type").alias("api_type"))


@query("managed_apis", "SELECT * FROM m_apis", ["m_apis"])
def q_managed_apis(spark, sf_dir):
    """A5 + B12, B13, B15: API rows from nested detail JSON (endpoint config, URL parse, times)."""
    return S.managed_current(spark, sf_dir, OPTS)[0]


@query("managed_ops", "SELECT * FROM m_ops", ["m_ops"])
def q_managed_ops(spark, sf_dir):
    """A5 + B9-B11, B14: operation rows with normalized target and match path."""
    return S.managed_current(spark, sf_dir, OPTS)[1]


@query("active_ops", "SELECT reg_api_id, http_method, raw_target, match_path FROM m_ops", ["m_ops"])
def q_active_ops(spark, sf_dir):
    """Active operations of active APIs after one sync."""
    api_state, op_state = S.managed_state(spark, sf_dir, OPTS)
    return M.active_ops(op_state, api_state).select("reg_api_id", "http_method", "raw_target", "match_path")


# -------------------------------------------------------------------------- comparison queries

_DISC_OUT = D.DISCOVERED_COLS


@query("discovered", "SELECT * FROM discovered", ["discovered"])
def q_discovered(spark, sf_dir):
    """E1 + E1b: discovered state after one cycle over the whole flow log (records pre-aggregated)."""
    return S.discovered(spark, sf_dir, OPTS).select(*_DISC_OUT)


@query("match_candidates", "SELECT * FROM cands", ["cands"])
def q_match(spark, sf_dir):
    """Discovered LEFT JOIN registered operations on (method, path)."""
    return S.comparison(spark, sf_dir, OPTS)["candidates"]


@query("collisions", "SELECT * FROM coll", ["coll"])
def q_collisions(spark, sf_dir):
    """Matched operations seen from more than one service."""
    return S.comparison(spark, sf_dir, OPTS)["collisions"]


@query("affinity_scores", "SELECT * FROM scores", ["scores"])
def q_affinity(spark, sf_dir):
    """C6 + J7: affinity score per (collision, service key)."""
    spark_parts = S.comparison(spark, sf_dir, OPTS)
    api_state, op_state = S.managed_state(spark, sf_dir, OPTS)
    return C.affinity(spark_parts["candidates"], spark_parts["collisions"], M.active_ops(op_state, api_state))


@query("service_domains", "SELECT * FROM sk_domain", ["sk_domain"])
def q_service_domains(spark, sf_dir):
    """First non-blank request domain per service key."""
    return C.service_domain(S.comparison(spark, sf_dir, OPTS)["candidates"])


@query("collision_resolution",
       "SELECT http_method, resource_path, reg_api_id, winner, resolution, len(tied_keys) AS n_tied, "
       "best_score FROM resolved", ["resolved"])
def q_resolution(spark, sf_dir):
    """C7 + J13: winner per collision (score, then endpoint-host tie-break, else ambiguous)."""
    return S.comparison(spark, sf_dir, OPTS)["resolved"]


@query("losers", "SELECT * FROM losers", ["losers"])
def q_losers(spark, sf_dir):
    """Candidates at resolved collisions other than the winner."""
    return S.comparison(spark, sf_dir, OPTS)["losers"]


@query("unmanaged_report",
       "SELECT service_key, http_method, resource_path, classification, confidence, managed_api_id FROM classified",
       ["classified"])
def q_unmanaged_report(spark, sf_dir):
    """Flagship: discovery + managed sync + comparison -> SHADOW / DRIFT findings with confidence."""
    return S.comparison(spark, sf_dir, OPTS)["classified"].select(
        "service_key", "http_method", "resource_path", "classification", "confidence", "managed_api_id")


@query("collision_audit",
       "SELECT c.service_key, c.http_method, c.resource_path, c.reg_api_id, len(r.tied_keys) AS n_tied "
       "FROM cands c JOIN resolved r ON c.http_method = r.http_method AND c.resource_path = r.resource_path "
       "WHERE r.resolution = 'AMBIGUOUS'", ["cands", "resolved"])
def q_collision_audit(spark, sf_dir):
    """C11: candidates at ambiguous collisions (they stay managed, X4)."""
    parts = S.comparison(spark, sf_dir, OPTS)
    return C.collision_audit(parts["candidates"], parts["resolved"])


@query("comparison_metrics",
       "SELECT (SELECT count(*) FROM cands WHERE reg_api_id IS NOT NULL) AS managed, "
       "(SELECT count(*) FROM cands WHERE reg_api_id IS NULL) AS unmatched, "
       "(SELECT count(*) FROM classified) AS unmanaged, "
       "(SELECT count(*) FROM classified WHERE classification = 'SHADOW') AS shadow, "
       "(SELECT count(*) FROM classified WHERE classification = 'DRIFT') AS drift", ["cands", "classified"])
def q_comparison_metrics(spark, sf_dir):
    """C18 (comparison): managed / unmatched / unmanaged / shadow / drift counts, observed while the phase runs."""
    api_state, op_state = S.managed_state(spark, sf_dir, OPTS)
    counters: dict[str, int] = {}
    C.compare(S.discovered(spark, sf_dir, OPTS), M.active_ops(op_state, api_state), api_state.where(F.col("deleted_at").isNull()),
              counters=counters)
    return _counted(spark, counters)


def _counted(spark, counters) -> DataFrame:
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{k} long" for k in counters))


# ------------------------------------------------------------------------- lifecycle queries

from ..operators import lifecycle as L  # noqa: E402

_U_OUT = ["service_key", "http_method", "resource_path", "managed_api_id", "classification", "confidence", "status",
          "first_detected_at", "last_confirmed_at", "resolved_at", "updated_at"]
_U_SQL = ", ".join(_U_OUT)


@query("discovered_late_merge", "SELECT service_key, http_method, resource_path, hit_count, first_seen_at, last_seen_at "
       "FROM discovered_m", ["discovered_m"])
def q_discovered_late_merge(spark, sf_dir):
    """The later half of the log merged first, then the earlier half; hits and seen times come out as in order."""
    f = flows(spark, sf_dir)
    late = materialize(D.discovered_from_flows(f, OPTS, fx.AS_OF, start=fx.STATE_SPLIT), "late_first")
    early = D.batch_records(D.discover_batch(f, OPTS, end=fx.STATE_SPLIT)["valid"])
    return D.merge_discovered(late, early, fx.AS_OF).select("service_key", "http_method", "resource_path", "hit_count",
                                                            "first_seen_at", "last_seen_at")


@query("registration_cycle", f"SELECT {_U_SQL} FROM uh2", ["uh2"])
def q_registration_cycle(spark, sf_dir):
    """E7 + E8: between two cycles the other half of the APIs is registered: findings that are now documented become
    RESOLVED, and services that gained an API change class or API and reopen."""
    return S.registration_cycle(spark, sf_dir, OPTS).select(*_U_OUT)


@query("discovered_merge", "SELECT * FROM discovered_m", ["discovered_m"])
def q_discovered_merge(spark, sf_dir):
    """Second-cycle batch merged into the first cycle's discovered state (add / overwrite / coalesce / keep)."""
    return S.lifecycle(spark, sf_dir, OPTS)["d2"].select(*D.DISCOVERED_COLS)


@query("unmanaged_merge", f"SELECT {_U_SQL} FROM u2_e7", ["u2_e7"])
def q_unmanaged_merge(spark, sf_dir):
    """Second-cycle findings merged into the first cycle's unmanaged state (status machine)."""
    return S.lifecycle(spark, sf_dir, OPTS)["e7"].select(*_U_OUT)


@query("mark_resolved", f"SELECT {_U_SQL} FROM u2_e8", ["u2_e8"])
def q_mark_resolved(spark, sf_dir):
    """Findings not confirmed in the cycle become RESOLVED."""
    return S.lifecycle(spark, sf_dir, OPTS)["e8"].select(*_U_OUT)


@query("mark_stale", f"SELECT {_U_SQL} FROM u2", ["u2"])
def q_mark_stale(spark, sf_dir):
    """E9 + J12: findings whose discovered row was last seen over 7 days ago become STALE (full cycle)."""
    return S.lifecycle(spark, sf_dir, OPTS)["u2"].select(*_U_OUT)


@query("count_by_class",
       "SELECT classification, count(*) AS findings FROM u2 WHERE status NOT IN ('RESOLVED', 'STALE') GROUP BY ALL",
       ["u2"])
def q_count_by_class(spark, sf_dir):
    """Findings per classification, excluding RESOLVED and STALE."""
    return L.count_by_class(S.lifecycle(spark, sf_dir, OPTS)["u2"])


@query("detected_groups",
       "SELECT DISTINCT service_key, classification, managed_api_id FROM u2 WHERE status = 'DETECTED'", ["u2"])
def q_detected_groups(spark, sf_dir):
    """Service groups with at least one DETECTED finding."""
    return L.detected_groups(S.lifecycle(spark, sf_dir, OPTS)["u2"])


RETENTION_AS_OF_DISCOVERED = "2024-02-20 00:00:00"
RETENTION_AS_OF_UNMANAGED = "2024-04-20 00:00:00"


@query("retention_discovered",
       "SELECT service_key, http_method, resource_path, last_seen_at FROM discovered_m d WHERE NOT ("
       f"d.last_seen_at < TIMESTAMP '{RETENTION_AS_OF_DISCOVERED}' - INTERVAL '{OPTS.retention_discovered}' "
       "AND NOT EXISTS (SELECT 1 FROM u2 u WHERE u.service_key = d.service_key AND u.http_method = d.http_method "
       "AND u.resource_path = d.resource_path AND u.status NOT IN ('RESOLVED', 'STALE', 'DISMISSED')))",
       ["discovered_m", "u2"])
def q_retention_discovered(spark, sf_dir):
    """E14 + J11: discovered rows kept by the 30-day retention (as of 2024-02-20)."""
    lc = S.lifecycle(spark, sf_dir, OPTS)
    return L.purge_discovered(lc["d2"], lc["u2"], RETENTION_AS_OF_DISCOVERED, OPTS.retention_discovered) \
        .select("service_key", "http_method", "resource_path", "last_seen_at")


@query("retention_unmanaged",
       f"SELECT {_U_SQL} FROM u2 WHERE NOT (status IN ('RESOLVED', 'STALE', 'DISMISSED') AND updated_at < "
       f"TIMESTAMP '{RETENTION_AS_OF_UNMANAGED}' - INTERVAL '{OPTS.retention_unmanaged}')", ["u2"])
def q_retention_unmanaged(spark, sf_dir):
    """Findings kept by the 90-day retention of terminal statuses (as of 2024-04-20)."""
    return L.purge_unmanaged(S.lifecycle(spark, sf_dir, OPTS)["u2"], RETENTION_AS_OF_UNMANAGED,
                             OPTS.retention_unmanaged).select(*_U_OUT)


# ------------------------------------------------------------------------------ spec queries

from ..operators import catalog as CAT  # noqa: E402
from ..operators import specs as SP  # noqa: E402

_G = "service_key, classification, managed_api_id"


@query("spec_input", "SELECT * FROM sp_input", ["sp_input"])
def q_spec_input(spark, sf_dir):
    """Active findings of DETECTED groups joined with discovered and registered rows, blanks defaulted."""
    return S.specs(spark, sf_dir, OPTS)["input"]


@query("group_stats",
       f"SELECT {_G}, first_seen_at, last_seen_at, total_hit_count, total_operations, has_tls, all_tls FROM sp_stats",
       ["sp_stats"])
def q_group_stats(spark, sf_dir):
    """C17: per-group first/last seen, hits, operation count (and TLS flags for F4)."""
    return S.specs(spark, sf_dir, OPTS)["stats"].withColumnRenamed("g_first_seen_at", "first_seen_at") \
        .withColumnRenamed("g_last_seen_at", "last_seen_at")


@query("group_rep", f"SELECT {_G}, resource_path, http_method, parent_api_name FROM sp_head", ["sp_head"])
def q_group_rep(spark, sf_dir):
    """Representative operation per group (first by path, method)."""
    return S.specs(spark, sf_dir, OPTS)["rep"].select(*L.GROUP, "resource_path", "http_method", "parent_api_name")


@query("spec_hosts", f"SELECT {_G}, hostname FROM sp_head", ["sp_head"])
def q_spec_hosts(spark, sf_dir):
    """server host name per group."""
    return S.specs(spark, sf_dir, OPTS)["rep"].select(*L.GROUP, "hostname")


@query("spec_titles", f"SELECT {_G}, title FROM sp_head", ["sp_head"])
def q_spec_titles(spark, sf_dir):
    """document title per group."""
    return S.specs(spark, sf_dir, OPTS)["rep"].select(*L.GROUP, SP.spec_title(None).alias("title"))


@query("spec_servers", f"SELECT {_G}, servers FROM sp_head", ["sp_head"])
def q_spec_servers(spark, sf_dir):
    """server URLs per group (https if any TLS op, then http if any plain op)."""
    rep = S.specs(spark, sf_dir, OPTS)["rep"]
    return rep.select(*L.GROUP, F.array_join(F.transform(SP.spec_servers(OPTS), lambda s: s["url"]), ",")
                      .alias("servers"))


@query("spec_paths_flat", f"SELECT {_G}, oas_path, http_method, operation_id, params FROM sp_paths", ["sp_paths"])
def q_spec_paths(spark, sf_dir):
    """F6 + F9 + X14: OpenAPI path template, parameters and operation per group (collapsed paths)."""
    p = S.specs(spark, sf_dir, OPTS)["paths"]
    return p.select(*L.GROUP, "oas_path", "http_method", "operation_id", F.array_join("params", ",").alias("params"))


@query("operation_ids", f"SELECT {_G}, http_method, resource_path, operation_id FROM sp_opids", ["sp_opids"])
def q_operation_ids(spark, sf_dir):
    """operation id of every finding in a spec group."""
    inp = S.specs(spark, sf_dir, OPTS)["input"]
    return inp.select(*L.GROUP, "http_method", "resource_path",
                      T_operation_id("http_method", "resource_path").alias("operation_id"))


@query("spec_rejects", f"SELECT {_G}, operations, distinct_ids FROM sp_rejects", ["sp_rejects"])
def q_spec_rejects(spark, sf_dir):
    """groups rejected for a duplicate operationId (they stay DETECTED)."""
    return S.specs(spark, sf_dir, OPTS)["rejects"]


def _twins(spark, sf_dir):
    """Findings of the flow log with twin paths: discovered, registered APIs and findings of one cycle."""
    api_state, op_state = S.managed_state(spark, sf_dir, OPTS)
    live = api_state.where(F.col("deleted_at").isNull())
    d = materialize(D.discovered_from_flows(fx.twin_flows(spark, sf_dir), OPTS, fx.AS_OF), "discovered_twins")
    classified = C.compare(d, M.active_ops(op_state, api_state), live)["classified"]
    return d, api_state, materialize(L.comparison_cycle(None, classified, d, fx.AS_OF, OPTS.stale_after), "unmanaged_twins")


@query("spec_rejects_twins", f"SELECT {_G}, operations, distinct_ids FROM sp_rejects_tw", ["sp_rejects_tw"])
def q_spec_rejects_twins(spark, sf_dir):
    """groups with paths that give one operationId are rejected."""
    d, api_state, u = _twins(spark, sf_dir)
    return SP.generate_specs(u, d, api_state, OPTS, fx.AS_OF)["rejects"]


@query("blank_samples", "SELECT http_method, resource_path, server_port, agent_id, hit_count, sample_url, sample_path FROM deduped_tw",
       ["deduped_tw"])
def q_blank_samples(spark, sf_dir):
    """A sample without a URL takes its endpoint."""
    deduped = D.discover_batch(fx.twin_flows(spark, sf_dir), OPTS)["deduped"]
    return deduped.select(*D.DEDUP_KEY, "hit_count", "sample_url", "sample_path")


@query("spec_documents")
def q_spec_documents(spark, sf_dir):
    """F3 + F8 + F10: whole OpenAPI documents per valid group (JSON text; rows-only check)."""
    return S.specs(spark, sf_dir, OPTS)["documents"]


@query("apply_specs", "SELECT service_key, http_method, resource_path, status, spec_generated_at, updated_at FROM u3",
       ["u3"])
def q_apply_specs(spark, sf_dir):
    """All active rows of a valid group get the document and SPEC_GENERATED."""
    return S.specs(spark, sf_dir, OPTS)["u3"].select("service_key", "http_method", "resource_path", "status",
                                                    "spec_generated_at", "updated_at")


# ---------------------------------------------------------------------------- catalog queries

@query("push_groups", f"SELECT {_G}, catalog_service_id FROM pp_groups", ["pp_groups"])
def q_push_groups(spark, sf_dir):
    """One row per SPEC_GENERATED group, its catalog id NULLS LAST."""
    return S.push(spark, sf_dir, OPTS)["groups"].drop("openapi_spec")


@query("push_plan",
       f"SELECT {_G}, catalog_service_id, action, target_id, catalog_name, catalog_version, service_url, description "
       "FROM pp_plan", ["pp_plan"])
def q_push_plan(spark, sf_dir):
    """B24 + J15 + G1-G6: catalog action per pushable group (CREATE / UPDATE / REPLACE / SKIP)."""
    return S.push(spark, sf_dir, OPTS)["plan"].drop("openapi_spec")


@query("push_plan_conflicts",
       f"SELECT {_G}, action, target_id, catalog_name, catalog_version, service_url, description FROM pp_plan_edge",
       ["pp_plan_edge"])
def q_push_plan_conflicts(spark, sf_dir):
    """G1 + G2 + J15: groups never pushed whose name the catalog has already: updated in the same version, else replaced."""
    sp = S.specs(spark, sf_dir, OPTS)
    groups = L.push_groups(sp["u3"].select(*L.UNMANAGED_COLS), sp["documents"])
    return CAT.push_plan(groups, fx.catalog_edge(spark, sf_dir), OPTS, S.PUSH_AS_OF).drop("openapi_spec", "catalog_service_id")


OPTS_DRIFT_ONLY = replace(OPTS, push_shadow=False, re_push_deleted=True)
OPTS_CLEANUP = replace(OPTS, cleanup_unowned=True, hostname="host-b")


@query("push_plan_drift_only", f"SELECT {_G}, action, target_id, catalog_name FROM pp_plan", ["pp_plan"], Oracle(OPTS_DRIFT_ONLY))
def q_push_plan_drift_only(spark, sf_dir):
    """B24 + G1: SHADOW groups are held back, and entries that were deleted in the catalog are pushed again."""
    groups = S.push(spark, sf_dir, OPTS)["groups"]
    plan = CAT.push_plan(groups, fx.catalog_src(spark, sf_dir), OPTS_DRIFT_ONLY, S.PUSH_AS_OF)
    return plan.select("service_key", "classification", "managed_api_id", "action", "target_id", "catalog_name")


@query("reconcile_cleanup", "SELECT * FROM rec", ["rec"], Oracle(OPTS_CLEANUP))
def q_reconcile_cleanup(spark, sf_dir):
    """G7 + G8: another host's view, which lists entries without an owner for deletion."""
    u4 = S.push(spark, sf_dir, OPTS)["u4"]
    return CAT.reconcile(fx.catalog_src(spark, sf_dir), L.tracked_ids(u4), OPTS_CLEANUP)


@query("push_results",
       "SELECT service_key, http_method, resource_path, status, catalog_service_id, catalog_version, pushed_at FROM u4",
       ["u4"])
def q_push_results(spark, sf_dir):
    """E11 + E12: planned pushes applied to the findings (PUSHED, catalog id and version)."""
    return S.push(spark, sf_dir, OPTS)["u4"].select("service_key", "http_method", "resource_path", "status",
                                                   "catalog_service_id", "catalog_version", "pushed_at")


@query("tracked_ids", "SELECT DISTINCT catalog_service_id FROM u4 WHERE catalog_service_id IS NOT NULL", ["u4"])
def q_tracked_ids(spark, sf_dir):
    """C14: catalog ids the findings refer to."""
    return L.tracked_ids(S.push(spark, sf_dir, OPTS)["u4"])


@query("reconcile", "SELECT * FROM rec", ["rec"])
def q_reconcile(spark, sf_dir):
    """J14 + G7 + G8: ownership class of every catalog entry (tracked ids from the findings)."""
    u4 = S.push(spark, sf_dir, OPTS)["u4"]
    return CAT.reconcile(fx.catalog_src(spark, sf_dir), L.tracked_ids(u4), OPTS)


@query("reconcile_metrics",
       "SELECT count(*) FILTER (WHERE ownership = 'ours') AS ours, count(*) FILTER (WHERE ownership = 'other') AS other, "
       "count(*) FILTER (WHERE ownership = 'unowned') AS unowned, count(*) FILTER (WHERE \"delete\") AS deleted FROM rec",
       ["rec"])
def q_reconcile_metrics(spark, sf_dir):
    """C18 (reconciliation): ours / other / unowned / deleted, observed while the reconciliation is written."""
    u4, counters = S.push(spark, sf_dir, OPTS)["u4"], {}
    observed(CAT.reconcile(fx.catalog_src(spark, sf_dir), L.tracked_ids(u4), OPTS), "reconciled", CAT.reconcile_counters(), counters)
    return _counted(spark, counters)


from ..functions.text import operation_id as T_operation_id  # noqa: E402


# ------------------------------------------------------------------------ managed sync queries

PURGE_AS_OF = "2024-05-15 00:00:00"
_MM_OUT = ["reg_api_id", "api_name", "api_type", "reg_last_updated_at", "deleted_at", "last_synced_at",
           "created_at", "updated_at"]


@query("sync_classes", "SELECT reg_api_id, sync_class FROM sync", ["sync"])
def q_sync_classes(spark, sf_dir):
    """Created / updated / unchanged against the previous sync (timestamp change detection)."""
    return S.managed_two_syncs(spark, sf_dir, OPTS)["classified"].select("reg_api_id", "sync_class")


@query("deleted_apis",
       "SELECT reg_api_id FROM prev_apis WHERE reg_api_id NOT IN (SELECT reg_api_id FROM m_apis)",
       ["prev_apis", "m_apis"])
def q_deleted_apis(spark, sf_dir):
    """Stored active APIs missing from the current (non-empty) published list."""
    ms = S.managed_two_syncs(spark, sf_dir, OPTS)
    return M.detect_deleted(ms["prev_api"], ms["classified"]).select("reg_api_id")


@query("managed_merge", "SELECT " + ", ".join(_MM_OUT) + " FROM mm_apis", ["mm_apis"])
def q_managed_merge(spark, sf_dir):
    """E2 + E4 + E5: API state after the second sync (upsert, touch unchanged, soft delete)."""
    return S.managed_two_syncs(spark, sf_dir, OPTS)["api_state"].select(*_MM_OUT)


@query("managed_ops_merge", "SELECT * FROM mm_ops", ["mm_ops"])
def q_managed_ops_merge(spark, sf_dir):
    """E3 + E5: operations replaced for changed APIs, cascaded soft delete for deleted ones."""
    return S.managed_two_syncs(spark, sf_dir, OPTS)["op_state"].select(
        "reg_api_id", "http_method", "raw_target", "match_path", "deleted_at")


@query("count_active",
       "SELECT (SELECT count(*) FROM mm_apis WHERE deleted_at IS NULL) AS active_apis, "
       "(SELECT count(*) FROM mm_ops WHERE deleted_at IS NULL) AS active_operations", ["mm_apis", "mm_ops"])
def q_count_active(spark, sf_dir):
    """Active APIs and operations after the second sync."""
    ms = S.managed_two_syncs(spark, sf_dir, OPTS)
    return M.count_active(ms["api_state"], ms["op_state"])


@query("purge_managed",
       "SELECT reg_api_id, deleted_at FROM mm_apis WHERE NOT (deleted_at IS NOT NULL AND deleted_at < "
       f"TIMESTAMP '{PURGE_AS_OF}' - INTERVAL '{OPTS.retention_managed}')", ["mm_apis"])
def q_purge_managed(spark, sf_dir):
    """APIs kept by the 90-day retention of soft-deleted rows (as of 2024-05-15)."""
    ms = S.managed_two_syncs(spark, sf_dir, OPTS)
    return M.purge_managed(ms["api_state"], PURGE_AS_OF, OPTS.retention_managed).select("reg_api_id", "deleted_at")


@query("purge_ops",
       "SELECT reg_api_id, http_method, raw_target, deleted_at FROM mm_ops WHERE NOT (deleted_at IS NOT NULL AND "
       f"deleted_at < TIMESTAMP '{PURGE_AS_OF}' - INTERVAL '{OPTS.retention_managed}')", ["mm_ops"])
def q_purge_ops(spark, sf_dir):
    """Operations kept by the 90-day retention of soft-deleted rows (as of 2024-05-15)."""
    ms = S.managed_two_syncs(spark, sf_dir, OPTS)
    return M.purge_ops(ms["op_state"], PURGE_AS_OF, OPTS.retention_managed) \
        .select("reg_api_id", "http_method", "raw_target", "deleted_at")


# ------------------------------------------------- registered side that grows with the scale factor

_oracle.add("wide", fx.WIDE_SRC_SQL)
_WIDE_OK = "status = 'PUBLISHED' AND type = 'HTTP'"
# expected values stated per shape of input
_oracle.add("wide_apis", f"""
SELECT id AS reg_api_id, type AS api_type, context,
  CASE CAST(substr(id, 3) AS BIGINT) % 8 WHEN 3 THEN '' WHEN 1 THEN 'address' ELSE 'http' END AS endpoint_type,
  CASE CAST(substr(id, 3) AS BIGINT) % 8 WHEN 0 THEN 'svc' || CAST(substr(id, 3) AS BIGINT) % 12 || '.shop.example.com'
    WHEN 1 THEN 'h' || substr(id, 3) || '.example.com' WHEN 2 THEN 'a' || substr(id, 3) || '.example.com'
    WHEN 4 THEN '2001:db8::1' ELSE '' END AS endpoint_hostname,
  CASE CAST(substr(id, 3) AS BIGINT) % 8 WHEN 0 THEN 8080 WHEN 1 THEN 443 WHEN 2 THEN 80 WHEN 4 THEN 9443 ELSE 0 END AS endpoint_port,
  CASE CAST(substr(id, 3) AS BIGINT) % 8 WHEN 0 THEN '/base' WHEN 2 THEN '/x y' WHEN 4 THEN '/v1' ELSE '' END AS endpoint_basepath,
  CASE CAST(substr(id, 3) AS BIGINT) % 7 WHEN 0 THEN TIMESTAMP '2024-01-05 05:00:00.25' WHEN 1 THEN TIMESTAMP '2024-01-05 10:30:00.25'
    WHEN 2 THEN TIMESTAMP '2024-01-05 12:30:00' WHEN 3 THEN TIMESTAMP '2024-01-05 09:30:00.5' WHEN 4 THEN TIMESTAMP '2024-01-05 10:30:00'
    WHEN 5 THEN TIMESTAMP '2024-01-05 10:30:00' END AS reg_last_updated_at
FROM wide WHERE {_WIDE_OK}""", ["wide"])


def _wide_published(spark, sf_dir):
    return A.published(A.parse_details(fx.wide_details_json(spark, sf_dir)), OPTS.include_api_types)


def _wide(spark, sf_dir, pass_through=False):
    return M.managed_from_json(_wide_published(spark, sf_dir), pass_through)


@query("wide_apis", "SELECT * FROM wide_apis", ["wide_apis"])
def q_wide_apis(spark, sf_dir):
    """A4 + A5 + B12 + B13 + B15: lifecycle states, endpoint configs (object, array, not JSON, none), hosts with IPv6,
    ports given, implied and broken, escaped paths, and the accepted time formats, one API per part."""
    return _wide(spark, sf_dir)[0].select("reg_api_id", "api_type", "context", "endpoint_type", "endpoint_hostname",
                                         "endpoint_port", "endpoint_basepath", "reg_last_updated_at")


@query("wide_ops_context", f"""
SELECT id AS reg_api_id, v.http_method, v.raw_target, v.normalized_target,
  CASE CAST(substr(id, 3) AS BIGINT) % 8 WHEN 0 THEN '/base' WHEN 2 THEN '/x y' WHEN 4 THEN '/v1' ELSE '' END
  || CASE CAST(substr(id, 3) AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE '/ctx' || substr(id, 3) END || v.tail AS match_path
FROM wide, (VALUES ('GET', '/orders/{{orderId}}', '/orders/{{id}}', '/orders/{{id}}'), ('POST', '//orders', '//orders', '/orders'))
  v(http_method, raw_target, normalized_target, tail)
WHERE {_WIDE_OK}
UNION ALL
SELECT id, 'GET', '/orders/{{orderId}}', '/orders/{{id}}',
  CASE CAST(substr(id, 3) AS BIGINT) % 8 WHEN 0 THEN '/base' WHEN 2 THEN '/x y' WHEN 4 THEN '/v1' ELSE '' END
  || CASE CAST(substr(id, 3) AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE '/ctx' || substr(id, 3) END || '/orders/{{id}}'
FROM wide WHERE {_WIDE_OK} AND repeats""".replace("{{", "{").replace("}}", "}"), ["wide"])
def q_wide_ops_context(spark, sf_dir):
    """B9-B11 + B14 with context pass-through: documented operations and their match paths."""
    return _wide(spark, sf_dir, pass_through=True)[1]


def _wide_synced(spark, sf_dir):
    read = materialize(M.with_endpoints(_wide_published(spark, sf_dir)), "wide_documents")
    apis, ops = (materialize(t, f"wide_{n}") for t, n in zip(M.managed_rows(read), ("apis", "ops"), strict=True))
    return M.merge_managed(None, None, M.classify_sync(apis, None), ops, fx.AS_OF)


@query("wide_sync_rejects", f"SELECT id AS reg_api_id FROM wide WHERE {_WIDE_OK} AND repeats", ["wide"])
def q_wide_sync_rejects(spark, sf_dir):
    """APIs that document one operation twice are rejected as a whole."""
    return _wide_synced(spark, sf_dir)[2]


@query("wide_sync_counts", f"SELECT (SELECT count(*) FROM wide WHERE {_WIDE_OK} AND NOT repeats) AS active_apis, "
       f"(SELECT 2 * count(*) FROM wide WHERE {_WIDE_OK} AND NOT repeats) AS active_operations", ["wide"])
def q_wide_sync_counts(spark, sf_dir):
    """E2 + E3 + C16: counts after the sync of all registered APIs; rejected ones are not in."""
    api_state, op_state, _ = _wide_synced(spark, sf_dir)
    return M.count_active(api_state, op_state)


_oracle.add("m_ops_all", f"""
SELECT reg_api_id, http_method, raw_target, match_path FROM m_ops
UNION ALL
SELECT id, v.http_method, v.raw_target,
  CASE CAST(substr(id, 3) AS BIGINT) % 8 WHEN 0 THEN '/base' WHEN 2 THEN '/x y' WHEN 4 THEN '/v1' ELSE '' END || v.tail
FROM wide, (VALUES ('GET', '/orders/{{orderId}}', '/orders/{{id}}'), ('POST', '//orders', '/orders')) v(http_method, raw_target, tail)
WHERE {_WIDE_OK} AND NOT repeats""".replace("{{", "{").replace("}}", "}"), ["m_ops", "wide"])
_oracle.add("m_apis_all", "SELECT reg_api_id, endpoint_hostname FROM m_apis UNION ALL SELECT reg_api_id, endpoint_hostname FROM wide_apis "
            "JOIN wide ON id = reg_api_id WHERE NOT repeats", ["m_apis", "wide_apis", "wide"])
_oracle.clone(Oracle.COMPARISON_CHAIN, "inc", {"discovered": "discovered_m", "m_ops": "m_ops_all", "m_apis": "m_apis_all"})


@query("incremental_comparison", "SELECT service_key, http_method, resource_path, request_domain, host_ip, server_port, hit_count, "
       "classification, confidence, managed_api_id FROM classified_inc", ["classified_inc"])
def q_incremental_comparison(spark, sf_dir):
    """C5-C10 between cycles: a whole comparison with the operations of every other nation API, then only what changes
    when all nation and part APIs are registered, and then only what the second half of the traffic touches."""
    from ..operators import incremental as INC
    d1, d2 = S.discovery_cycles(spark, sf_dir, OPTS)
    api_state, op_state = S.managed_state(spark, sf_dir, OPTS)
    wide_api, wide_op, _ = _wide_synced(spark, sf_dir)
    columns = ["reg_api_id", "http_method", "raw_target", "match_path"]
    few = M.active_ops(op_state, api_state).select(*columns)
    ops = materialize(few.unionByName(M.active_ops(wide_op, wide_api).select(*columns)), "all_ops")
    apis = api_state.select("reg_api_id", "endpoint_hostname")
    every = materialize(apis.unionByName(wide_api.select("reg_api_id", "endpoint_hostname")), "all_apis")
    half = few.where(F.substring("reg_api_id", 5, 3).cast("int") % 2 == 0)
    nothing = d1.limit(0)
    first = C.compare(d1, half, apis)
    second = INC.compare_changes(first, nothing, half, ops, apis, every)
    touched = d2.where(F.col("updated_at") == F.lit(fx.AS_OF).cast("timestamp_ntz"))
    third = INC.compare_changes(second, touched, ops, ops, every, every)
    return third["classified"].select(*D.DISCOVERED_KEY, "request_domain", "host_ip", "server_port", "hit_count", "classification",
                                      "confidence", "managed_api_id")


@query("operations_of_api", f"SELECT id AS reg_api_id, unnest(['GET', 'POST']) AS http_method FROM wide "
       f"WHERE {_WIDE_OK} AND NOT repeats AND id = (SELECT max(id) FROM wide WHERE {_WIDE_OK} AND NOT repeats)", ["wide"])
def q_operations_of_api(spark, sf_dir):
    """Operations of one API, the last by id."""
    api_state, op_state, _ = _wide_synced(spark, sf_dir)
    op_state = materialize(op_state, "wide_ops")
    newest = op_state.agg(F.max("reg_api_id")).first()[0]
    return M.ops_of(op_state, newest).select("reg_api_id", "http_method")


@query("catalog_listing", "SELECT * FROM catalog_src", ["catalog_src"])
def q_catalog_listing(spark, sf_dir):
    """Catalog listing read back from a JSON snapshot."""
    import uuid
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlens-catalog/{uuid.uuid4().hex}"
    fx.catalog_src(spark, sf_dir).write.json(path)
    return A.read_catalog(spark, path)


# --------------------------------------------------------------------------- result sets (A2/A3)

from ..sources import results as R  # noqa: E402


@query("result_set_flatten", "SELECT * FROM result_rows", ["result_rows"])
def q_result_flatten(spark, sf_dir):
    """A2 + A3: column-oriented result bodies -> rows -> lenient typed columns (short rows: absent = 0 / '')."""
    flat = R.flatten_result(fx.result_src(spark, sf_dir), "body", keep=["event_id"])
    return R.coerce(flat, {"request_type": "string", "hits": "long"}).select("event_id", F.col("row_idx").cast("bigint"),
                                                                            "request_type", "hits")


@query("result_set_types", """
SELECT event_id, event_id % 5 IN (0, 2) AS ok, CASE event_id % 6 WHEN 0 THEN TIMESTAMP '2024-01-02 03:04:05'
  WHEN 1 THEN make_timestamp((1704067200 + event_id) * 1000000) WHEN 2 THEN TIMESTAMP '2024-01-02 03:04:05'
  WHEN 3 THEN TIMESTAMP '2024-01-01 21:34:05' END AS t FROM events""")
def q_result_set_types(spark, sf_dir):
    """A3: lenient booleans and times of a result set."""
    flat = R.flatten_result(fx.typed_src(spark, sf_dir), "body", keep=["event_id"])
    return R.coerce(flat, {"ok": "bool", "t": "time"}).select("event_id", "ok", "t")


# ------------------------------------------------------------------------- streaming

from ..streaming import state as STATE  # noqa: E402
from ..streaming import stream as ST  # noqa: E402
from ..streaming.stream import advance_watermark  # noqa: E402

_SPLIT, _AS_OF = fx.STATE_SPLIT, fx.AS_OF
_SPLIT_AT = datetime.fromisoformat(_SPLIT)
FRESH_AFTER = "20 minutes"


def _wm_update(spark, pipeline, end, hits_df):
    return hits_df.select(F.lit(pipeline).alias("pipeline"), F.lit(str(end)).cast("timestamp_ntz").alias("end"),
                          F.col(hits_df.columns[0]).cast("long").alias("n"))


def _ends(spark, sf_dir):
    """Ends of the two discovery windows: the last minute with traffic before the split, and of the whole log; and the
    newest row's time, at which the windows are asked for."""
    minute = F.date_trunc("minute", F.max("start_time"))
    f = flows(spark, sf_dir)
    newest = f.agg(minute.alias("m"), F.max("start_time").alias("t")).first()
    return f.where(F.col("start_time") < F.lit(_SPLIT).cast("timestamp_ntz")).agg(minute).first()[0], newest["m"], newest["t"]


def _watermarks(spark, sf_dir):
    f = flows(spark, sf_dir)
    first, last, _ = _ends(spark, sf_dir)
    h1 = D.total_hits(D.discover_batch(f, OPTS, end=_SPLIT)["deduped"])
    h2 = D.total_hits(D.discover_batch(f, OPTS, start=_SPLIT)["deduped"])
    w1 = advance_watermark(None, _wm_update(spark, ST.DISCOVERY, first, h1))
    apis, _ = S.managed_current(spark, sf_dir, OPTS)
    synced = apis.agg(F.count(F.lit(1)).alias("n"))
    w2 = advance_watermark(w1, _wm_update(spark, ST.DISCOVERY, last, h2))
    w2 = advance_watermark(w2, _wm_update(spark, ST.MANAGED, first, synced))
    return w1, w2


_PIPES = f"(VALUES ('{ST.DISCOVERY}'), ('{ST.MANAGED}')) p(pipeline)"
_FIRST_END = f"(SELECT date_trunc('minute', max(start_time)) FROM flows WHERE start_time < TIMESTAMP '{_SPLIT}')"
_LAST_END = "(SELECT date_trunc('minute', max(start_time)) FROM flows)"
_NOW = "(SELECT max(start_time) FROM flows)"
_FIRST = f"{_NOW} - INTERVAL '{OPTS.poll_interval}' - INTERVAL '{OPTS.safety_lag}'"


@query("next_window",
       f"SELECT p.pipeline, date_trunc('second', coalesce(w.last_watermark_end, {_FIRST})) AS window_start, "
       f"date_trunc('second', {_NOW} - INTERVAL '{OPTS.safety_lag}') AS window_end, "
       f"{_NOW} - INTERVAL '{OPTS.safety_lag}' > coalesce(w.last_watermark_end, {_FIRST}) AS runnable "
       f"FROM {_PIPES} LEFT JOIN (SELECT '{ST.DISCOVERY}' AS pipeline, {_FIRST_END} AS last_watermark_end) w "
       "ON w.pipeline = p.pipeline", ["flows"])
def q_next_window(spark, sf_dir):
    """Next incremental window per pipeline at the newest row's time, from the watermark state after the first
    cycle; the managed pipeline has not run yet."""
    w1, _ = _watermarks(spark, sf_dir)
    pipes = spark.createDataFrame([(ST.DISCOVERY,), (ST.MANAGED,)], "pipeline string")
    return ST.next_window(w1, pipes, _ends(spark, sf_dir)[2], OPTS)


@query("watermark_state",
       f"SELECT '{ST.DISCOVERY}' AS pipeline, {_LAST_END} AS last_watermark_end, "
       "CAST((SELECT sum(hit_count) FROM deduped_w1) + (SELECT sum(hit_count) FROM deduped_w2) AS BIGINT) AS records "
       f"UNION ALL SELECT '{ST.MANAGED}', {_FIRST_END}, (SELECT count(*) FROM m_apis)",
       ["flows", "deduped_w1", "deduped_w2", "m_apis"])
def q_watermark_state(spark, sf_dir):
    """Watermark end set and record counter added per cycle (hits for discovery, APIs for managed)."""
    return _watermarks(spark, sf_dir)[1]


_LIMIT = f"{OPTS.managed_fresh_factor} * INTERVAL '{OPTS.managed_sync_interval}'"


@query("is_fresh",
       f"SELECT 'soon' AS asked, {_FIRST_END} > {_FIRST_END} + INTERVAL '{FRESH_AFTER}' - {_LIMIT} AS fresh "
       f"UNION ALL SELECT 'at the newest row', {_FIRST_END} > {_NOW} - {_LIMIT}", ["flows"])
def q_is_fresh(spark, sf_dir):
    """Comparison gate on the managed sync's age (3 x its interval), soon after the sync and at the newest row."""
    from datetime import timedelta
    _, w2 = _watermarks(spark, sf_dir)
    first, _, newest = _ends(spark, sf_dir)
    soon = first + timedelta(minutes=int(FRESH_AFTER.split()[0]))
    return ST.is_fresh(w2, soon, OPTS).select(F.lit("soon").alias("asked"), "fresh").unionByName(
        ST.is_fresh(w2, newest, OPTS).select(F.lit("at the newest row").alias("asked"), "fresh"))


def _stream_folder(spark, sf_dir):
    """A folder of its own in the shared one, with the flow log in day folders. A day is written in parts by the number of
    rows, as a task sorts what it writes and a stream sorts what it reads of a file: neither grows with the log."""
    import uuid
    from ..session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlens-stream/{uuid.uuid4().hex}"
    src = flows(spark, sf_dir).withColumn("day", F.to_date("start_time"))
    log = src.agg(F.count("*").alias("n"), F.count_distinct("day").alias("days")).first()
    parts = max(1, log["n"] // (max(1, log["days"]) * ST.FILE_ROWS))
    src.repartition(max(8, parts * log["days"]), "day", F.pmod(F.xxhash64("flow_id"), F.lit(parts))) \
        .write.option("maxRecordsPerFile", ST.FILE_ROWS).partitionBy("day").parquet(f"{base}/flows")
    return base


@query("stream_discovered", "SELECT service_key, http_method, resource_path, service_type, hit_count, first_seen_at, "
       "last_seen_at FROM discovered_ws", ["discovered_ws"])
def q_stream_discovered(spark, sf_dir):
    """The flow log's days replayed in event order as 5-minute cycles by one query, the records merged by the
    stateful operator of another; result = its discovered state."""
    base = _stream_folder(spark, sf_dir)
    ST.replay(spark, f"{base}/flows", base, f"{base}/replay", OPTS)
    ST.govern(spark, base, f"{base}/govern", OPTS).awaitTermination()
    return STATE.discovered(spark, f"{base}/govern").select(
        "service_key", "http_method", "resource_path", "service_type", "hit_count", "first_seen_at", "last_seen_at")


_CYCLE_COLS = ["resource_path", "server_port", "hit_count", "sample_path", "sample_url", "sample_second", "request_domain",
               *D.SP_LAST_COLS, "source_ip", "host_ip", "is_external", *D.CP_COLS, "service_type", "traffic_origin"]


@query("stream_fused", "SELECT make_timestamp(agent_id // 1000 * 300000000) AS cycle, http_method, agent_id % 1000 AS agent_id, "
       "CASE WHEN starts_with(service_key, 'agent-') THEN 'agent-' || (agent_id % 1000) || ':' || server_port "
       "ELSE service_key END AS service_key, " + ", ".join(_CYCLE_COLS) + " FROM fused_cyc", ["fused_cyc"])
def q_stream_fused(spark, sf_dir):
    """J1-J4 in the stream: one stateful aggregate holds signatures and observations of the open windows, and a closed
    window is fused without a second look at the log; result = the fused signatures of every closed cycle. S3: the rows of
    the second day that arrive once more, under other paths, come behind the watermark and change nothing."""
    base = _stream_folder(spark, sf_dir)
    schema = spark.read.parquet(f"{base}/flows").schema
    late = spark.read.parquet(f"{base}/flows").where("day = DATE '2024-01-02'").withColumns(
        {c: F.concat(F.lit("/late"), c) for c in ("endpoint", "request_resource")})
    late = materialize(late, "late_flows")

    def sink(spark, base, parts, end, name):
        parts["fused"].drop("rank").write.mode("overwrite").parquet(f"{base}/fused/batch={name}")
    for _ in range(2):
        ST.discover_stream(spark, f"{base}/flows", schema, base, f"{base}/windows", OPTS, sink=sink).awaitTermination()
        late.write.mode("append").partitionBy("day").parquet(f"{base}/flows")
    return spark.read.parquet(f"{base}/fused").select("cycle", "http_method", "agent_id", "service_key", *_CYCLE_COLS)


@query("stream_idle", f"SELECT '{ST.DISCOVERY}' AS pipeline, make_timestamp(CAST((epoch_us(max(start_time)) + 86400000000 - 120000000) "
       "// 300000000 * 300000000 AS BIGINT)) AS last_watermark_end, (SELECT CAST(sum(hit_count) AS BIGINT) FROM deduped) AS records "
       "FROM sp_filtered", ["sp_filtered", "deduped"])
def q_stream_idle(spark, sf_dir):
    """S5 + E6: after the whole log comes a day with noise alone; it closes the log's last windows, its own close without a
    signature, and the pipeline's end moves on."""
    base = _stream_folder(spark, sf_dir)
    log = spark.read.parquet(f"{base}/flows")
    newest = D.traffic_filter(log, OPTS).orderBy(F.desc("start_time")).limit(1)
    noise = [newest.withColumns({"start_time": F.col("start_time") + F.expr("INTERVAL 1 day") - F.expr(f"INTERVAL {m} minutes"),
                                 "endpoint": F.lit("/healthz"), "request_resource": F.lit("/healthz")}) for m in (600, 0)]
    noise = materialize(noise[0].unionByName(noise[1]).withColumn("day", F.to_date("start_time")), "noise")
    for rows in (None, noise):
        if rows is not None:
            rows.write.mode("append").partitionBy("day").parquet(f"{base}/flows")
        ST.discover_stream(spark, f"{base}/flows", log.schema, base, f"{base}/windows", OPTS).awaitTermination()
    return ST.pipelines(spark, base)


@query("stream_findings", "SELECT service_key, http_method, resource_path, managed_api_id, classification, confidence, status, "
       "first_detected_at, last_confirmed_at, resolved_at FROM us2", ["us2"])
def q_stream_findings(spark, sf_dir):
    """A comparison after the days before the split and one at the end, each on the state of the stream and
    let through by the managed sync's age; result = the findings of the stateful operator."""
    base = _stream_folder(spark, sf_dir)
    api_state, op_state = S.managed_state(spark, sf_dir, OPTS)
    ops, live = M.active_ops(op_state, api_state), api_state.where(F.col("deleted_at").isNull())
    for until in (_SPLIT_AT, None):
        end = ST.replay(spark, f"{base}/flows", base, f"{base}/replay", OPTS, until=until)
        ST.govern(spark, base, f"{base}/govern", OPTS).awaitTermination()
        ST.log_cycle(spark, base, ST.MANAGED, end, live.agg(F.count("*").alias("n")), f"sync-{end:%Y%m%d%H%M}")
        ST.compare_cycle(spark, base, STATE.discovered(spark, f"{base}/govern"), ops, live, end, OPTS)
        ST.govern(spark, base, f"{base}/govern", OPTS).awaitTermination()
    return STATE.findings(spark, f"{base}/govern").select(*D.DISCOVERED_KEY, *STATE.VERDICT_COLS, "status", "first_detected_at",
                                                          "last_confirmed_at", "resolved_at")


QUIET_UNTIL = datetime(2024, 2, 20)


@query("stream_expired", "SELECT d.service_key, d.http_method, d.resource_path, d.last_seen_at, CASE WHEN c.classification IS NOT NULL "
       "THEN 'STALE' END AS status FROM discovered_ws d LEFT JOIN classified_ws c ON d.service_key = c.service_key "
       "AND d.http_method = c.http_method AND d.resource_path = c.resource_path "
       f"WHERE d.last_seen_at >= TIMESTAMP '{QUIET_UNTIL}' - INTERVAL '{OPTS.retention_discovered}'", ["discovered_ws", "classified_ws"])
def q_stream_expired(spark, sf_dir):
    """E9 + E14 by timers: after the log's end and one comparison, cycles without traffic let three weeks pass; findings go
    stale, and rows that were not seen for the retention go with no scan; result = what is left, with its finding's status."""
    base = _stream_folder(spark, sf_dir)
    api_state, op_state = S.managed_state(spark, sf_dir, OPTS)
    live = api_state.where(F.col("deleted_at").isNull())
    end = ST.replay(spark, f"{base}/flows", base, f"{base}/replay", OPTS)
    ST.govern(spark, base, f"{base}/govern", OPTS).awaitTermination()
    ST.log_cycle(spark, base, ST.MANAGED, end, 1, "sync")
    ST.compare_cycle(spark, base, STATE.discovered(spark, f"{base}/govern"), M.active_ops(op_state, api_state), live, end, OPTS)
    ST.log_cycle(spark, base, ST.DISCOVERY, QUIET_UNTIL, 0, "quiet")
    ST.govern(spark, base, f"{base}/govern", OPTS).awaitTermination()
    left = STATE.discovered(spark, f"{base}/govern").select(*D.DISCOVERED_KEY, "last_seen_at")
    return left.join(STATE.findings(spark, f"{base}/govern").select(*D.DISCOVERED_KEY, "status"), D.DISCOVERED_KEY, "left")


@query("sync_metrics", "SELECT sync_class, count(*) AS apis FROM sync GROUP BY ALL", ["sync"])
def q_sync_metrics(spark, sf_dir):
    """C18 (managed sync): created / updated / unchanged counts of the second sync, observed while its classes are written."""
    counters: dict[str, int] = {}
    observed(S.managed_two_syncs(spark, sf_dir, OPTS)["classified"], "sync_classes", M.sync_counters(), counters)
    return _counted(spark, counters).select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("sync_class"), F.col(k).alias("apis")) for k in counters])).alias("c")).select("c.*").where("apis > 0")


@query("dismissed_cycle", f"SELECT {_U_SQL} FROM u2d", ["u2d"])
def q_dismissed_cycle(spark, sf_dir):
    """Dismissed findings are terminal for E8/E9 and reopen only on a classification or API change."""
    return S.dismissed_cycle(spark, sf_dir, OPTS).select(*_U_OUT)


_META_FIELDS = ["service_key", "service_type", "classification", "first_seen_at", "last_seen_at", "process_name",
                "parent_api_name", "parent_api_version", "k8s_namespace", "k8s_service", "k8s_workload", "k8s_pod",
                "vm_hostname", "host_ip", "service_ip", "traffic_origin"]


def _meta_oracle() -> str:
    stype = "CASE WHEN h.service_type = '' THEN 'UNKNOWN' ELSE h.service_type END"
    k8s = [f"CASE WHEN {stype} = 'KUBERNETES' THEN nullif(h.{c}, '') END AS {c}"
           for c in ("k8s_namespace", "k8s_service", "k8s_workload", "k8s_pod")]
    return (f"SELECT h.service_key AS group_key, h.classification AS group_class, h.managed_api_id AS group_api, "
            f"'{OPENAPI_VERSION}' AS openapi, h.title, strftime(TIMESTAMP '{_AS_OF}', '%Y.%m.%d') AS version, "
            "CASE WHEN h.has_tls THEN 'https://' ELSE 'http://' END || h.hostname AS server0, "
            f"h.service_key, {stype} AS service_type, h.classification, "
            "strftime(s.first_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS first_seen_at, "
            "strftime(s.last_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at, "
            "s.total_hit_count, s.total_operations, nullif(h.process_name, '') AS process_name, "
            "CASE WHEN h.classification = 'DRIFT' THEN nullif(h.parent_api_name, '') END AS parent_api_name, "
            "CASE WHEN h.classification = 'DRIFT' THEN nullif(h.parent_api_version, '') END AS parent_api_version, "
            + ", ".join(k8s) + ", "
            f"CASE WHEN {stype} = 'LEGACY' THEN nullif(h.vm_hostname, '') END AS vm_hostname, "
            "nullif(h.host_ip, '') AS host_ip, nullif(h.service_ip, '') AS service_ip, "
            "nullif(h.traffic_origin, '') AS traffic_origin "
            "FROM sp_head h JOIN sp_stats s ON s.service_key = h.service_key AND s.classification = h.classification "
            "AND s.managed_api_id IS NOT DISTINCT FROM h.managed_api_id "
            "WHERE EXISTS (SELECT 1 FROM sp_good g WHERE g.service_key = h.service_key "
            "AND g.classification = h.classification AND g.managed_api_id IS NOT DISTINCT FROM h.managed_api_id)")


from ..config import OPENAPI_VERSION  # noqa: E402


@query("spec_metadata", _meta_oracle(), ["sp_head", "sp_stats", "sp_good"])
def q_spec_metadata(spark, sf_dir):
    """F3 + F4 + F10: the generated documents parsed back: version, title, first server, metadata block
    (keys omitted when blank or not applicable to the service type)."""
    docs = S.specs(spark, sf_dir, OPTS)["documents"]
    doc = F.col("openapi_spec")
    meta = f"$.info['{OPTS.ext_prefix}-metadata']"
    return docs.select(
        F.col("service_key").alias("group_key"), F.col("classification").alias("group_class"),
        F.col("managed_api_id").alias("group_api"),
        F.get_json_object(doc, "$.openapi").alias("openapi"), F.get_json_object(doc, "$.info.title").alias("title"),
        F.get_json_object(doc, "$.info.version").alias("version"),
        F.get_json_object(doc, "$.servers[0].url").alias("server0"),
        *[F.get_json_object(doc, f"{meta}.{c}").alias(c) for c in _META_FIELDS],
        F.get_json_object(doc, f"{meta}.total_hit_count").cast("bigint").alias("total_hit_count"),
        F.get_json_object(doc, f"{meta}.total_operations").cast("bigint").alias("total_operations"))


@query("spec_operations",
       "SELECT p.service_key AS group_key, p.classification AS group_class, p.managed_api_id AS group_api, p.oas_path, "
       "lower(p.http_method) AS method, p.operation_id, upper(p.http_method) || ' ' || p.resource_path AS summary, "
       "CASE WHEN p.response_code > 0 THEN CAST(p.response_code AS VARCHAR) ELSE 'default' END AS response_key, "
       "CAST(p.hit_count AS BIGINT) AS hit_count, p.is_tls AS observed_tls, p.params "
       "FROM sp_paths p WHERE EXISTS (SELECT 1 FROM sp_good g WHERE g.service_key = p.service_key "
       "AND g.classification = p.classification AND g.managed_api_id IS NOT DISTINCT FROM p.managed_api_id)",
       ["sp_paths", "sp_good"])
def q_spec_operations(spark, sf_dir):
    """The paths object of every generated document parsed back, one row per operation."""
    docs = S.specs(spark, sf_dir, OPTS)["documents"]
    parsed = docs.select(F.col("service_key").alias("group_key"), F.col("classification").alias("group_class"),
                         F.col("managed_api_id").alias("group_api"),
                         F.from_json("openapi_spec", "struct<paths: map<string, map<string, string>>>")
                         .getField("paths").alias("paths"))
    items = parsed.select("group_key", "group_class", "group_api", F.explode("paths").alias("oas_path", "item"))
    names = F.transform(F.from_json(F.col("item").getItem("parameters"), "array<struct<name: string>>"),
                        lambda p: p["name"])
    ops = items.select("group_key", "group_class", "group_api", "oas_path",
                       F.coalesce(F.array_join(names, ","), F.lit("")).alias("params"),
                       F.explode(F.map_filter("item", lambda k, v: k != "parameters")).alias("method", "op"))
    traffic = f"$['{OPTS.ext_prefix}-traffic']"
    return ops.select(
        "group_key", "group_class", "group_api", "oas_path", "method",
        F.get_json_object("op", "$.operationId").alias("operation_id"),
        F.get_json_object("op", "$.summary").alias("summary"),
        F.map_keys(F.from_json(F.get_json_object("op", "$.responses"), "map<string, string>"))[0].alias("response_key"),
        F.get_json_object("op", f"{traffic}.hit_count").cast("bigint").alias("hit_count"),
        F.get_json_object("op", f"{traffic}.observed_tls").cast("boolean").alias("observed_tls"), "params")


def _document_texts_oracle() -> str:
    return ("SELECT p.service_key AS group_key, p.classification AS group_class, p.managed_api_id AS group_api, p.oas_path, "
            "lower(p.http_method) AS method, "
            f"CASE WHEN h.classification = 'SHADOW' THEN '{_quoted(SHADOW_TEXT)}' "
            f"ELSE printf('{_quoted(DRIFT_TEXT)}', h.service_key, h.parent_api_name, h.parent_api_version) END AS document_text, "
            f"CASE WHEN p.sample_url <> '' THEN printf('{SAMPLE_TEXT}', upper(p.http_method), p.sample_url) "
            f"ELSE '{SEEN_TEXT}' END AS operation_text, "
            f"CASE WHEN p.response_code > 0 THEN printf('{STATUS_TEXT}', p.response_code) ELSE '{ANY_STATUS_TEXT}' END AS answer_text, "
            "CASE WHEN p.latency_us > 0 THEN CAST(p.latency_us AS BIGINT) END AS latency_us, "
            "strftime(p.first_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS first_seen_at, "
            "strftime(p.last_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at, "
            f"strftime(TIMESTAMP '{_AS_OF}', '%Y-%m-%dT%H:%M:%SZ') AS generated_at, '4' AS phase "
            "FROM sp_paths p JOIN sp_head h ON h.service_key = p.service_key AND h.classification = p.classification "
            "AND h.managed_api_id IS NOT DISTINCT FROM p.managed_api_id "
            "WHERE EXISTS (SELECT 1 FROM sp_good g WHERE g.service_key = p.service_key "
            "AND g.classification = p.classification AND g.managed_api_id IS NOT DISTINCT FROM p.managed_api_id)")


def _quoted(text: str) -> str:
    return text.replace("'", "''")


from .oracle import ANY_STATUS_TEXT, DRIFT_TEXT, SAMPLE_TEXT, SEEN_TEXT, SHADOW_TEXT, STATUS_TEXT  # noqa: E402


@query("spec_document_texts", _document_texts_oracle(), ["sp_paths", "sp_head", "sp_good"])
def q_spec_document_texts(spark, sf_dir):
    """F2 + F8 + F10: the generated documents parsed back: description, operation and response texts, latency, seen times
    and the extension block, one row per operation."""
    docs = S.specs(spark, sf_dir, OPTS)["documents"]
    doc = F.col("openapi_spec")
    head = docs.select(
        F.col("service_key").alias("group_key"), F.col("classification").alias("group_class"),
        F.col("managed_api_id").alias("group_api"), F.get_json_object(doc, "$.info.description").alias("document_text"),
        F.get_json_object(doc, f"$['{OPTS.ext_prefix}'].generated_at").alias("generated_at"),
        F.get_json_object(doc, f"$['{OPTS.ext_prefix}'].phase").alias("phase"),
        F.from_json(doc, "struct<paths: map<string, map<string, string>>>").getField("paths").alias("paths"))
    items = head.select("*", F.explode("paths").alias("oas_path", "item")).drop("paths")
    ops = items.select("*", F.explode(F.map_filter("item", lambda k, v: k != "parameters")).alias("method", "op")).drop("item")
    traffic = f"$['{OPTS.ext_prefix}-traffic']"
    answers = F.from_json(F.get_json_object("op", "$.responses"), "map<string, struct<description: string>>")
    return ops.select(
        "group_key", "group_class", "group_api", "oas_path", "method", "document_text",
        F.get_json_object("op", "$.description").alias("operation_text"),
        F.map_values(answers)[0]["description"].alias("answer_text"),
        F.get_json_object("op", f"{traffic}.sample_latency_us").cast("bigint").alias("latency_us"),
        F.get_json_object("op", f"{traffic}.first_seen_at").alias("first_seen_at"),
        F.get_json_object("op", f"{traffic}.last_seen_at").alias("last_seen_at"), "generated_at", "phase")
