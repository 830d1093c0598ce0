"""DuckDB twins of the registered queries (the driver's correctness gate).

Each step is a CTE over the pre-registered driver tables; a query's SQL is the chain of CTEs it
needs plus a final SELECT. The oracle states the reference semantics in the most direct form
(window ``row_number`` picks, per-row first match), not the Spark plan's form, so the two sides
check each other. Strings here are DuckDB SQL: no backslash escapes in literals, RE2 regexes.
"""

from __future__ import annotations

import re

from ..config import DEFAULT, DISCOVERED_WIDTHS, Options
from ..sources import fixtures as fx


# Upsert rules of the discovered table, stated from its definition and not taken from the operators: columns that keep
# their first value, that take the newest, that take the newest non-NULL, and whose blanks are stored as NULL.
KEY_COLUMNS = ["service_key", "http_method", "resource_path"]
NEWEST = ["k8s_pod", "k8s_node", "service_ip", "traffic_origin", "sample_url", "response_code", "latency_us", "agent_name"]
NEWEST_KNOWN = ["source_ip", "host_ip", "is_external", "source_service_ip", "source_k8s_pod", "source_k8s_service"]
FIRST = ["service_type", "protocol", "is_tls", "http_version", "server_port", "process_name", "k8s_namespace",
         "k8s_workload", "k8s_service", "k8s_cluster", "vm_hostname", "request_domain", "source_process_name",
         "source_k8s_namespace", "source_k8s_cluster", "source_vm_hostname", "sample_path", "agent_id"]
BLANK_IS_NULL = ["source_ip", "host_ip", "source_service_ip", "source_process_name", "source_k8s_pod",
                 "source_k8s_namespace", "source_k8s_service", "source_k8s_cluster", "source_vm_hostname"]
TIMES_AND_HITS = ["first_seen_at", "last_seen_at", "hit_count"]
#: What a document's input takes from the discovered row.
FINDING_FACTS = ["service_type", "protocol", "is_tls", "http_version", "server_port", "process_name", "k8s_namespace", "k8s_service",
                 "k8s_workload", "k8s_cluster", "k8s_pod", "k8s_node", "vm_hostname", "request_domain", "service_ip", "host_ip",
                 "traffic_origin", "sample_url", "sample_path", "agent_name", "response_code", "latency_us", "hit_count",
                 "first_seen_at", "last_seen_at"]
#: Notes of catalog entries, and when the scenarios dismiss and push.
SHADOW_LEAD, DRIFT_LEAD = "[SHADOW] unregistered service ", "[DRIFT] unregistered operations of service "
SEEN_END = ", seen in traffic"
DISMISS_AT, PUSH_AS_OF = "2024-01-15 01:00:00", "2024-01-30 12:00:00"
#: Texts of the generated documents.
SHADOW_TEXT = "Nothing that this service offers is registered; the operations below were seen in traffic (SHADOW)."
DRIFT_TEXT = ("Service %s is registered as '%s %s'. The operations below were seen in its traffic but are absent from that "
              "registration (DRIFT).")
SEEN_TEXT, SAMPLE_TEXT = "Seen in traffic.", "Seen in traffic, for example %s %s"
STATUS_TEXT, ANY_STATUS_TEXT = "Answered with status %d", "Answered"
ALL_COLUMNS = KEY_COLUMNS + FIRST + NEWEST + NEWEST_KNOWN + TIMES_AND_HITS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def alt(patterns) -> str | None:
    ps = list(patterns)
    return "|".join(f"(?:{p})" for p in ps) if ps else None


# ------------------------------------------------------------------------ scalar expression twins

def nz(e: str) -> str:
    return f"coalesce({e}, '')"


def strip_port_sql(e: str, keep_leading: bool = True) -> str:
    rx = "^.+:[^:]*$" if keep_leading else ":[^:]*$"
    return f"(CASE WHEN regexp_matches({e}, {q(rx)}) THEN regexp_replace({e}, ':[^:]*$', '') ELSE {e} END)"


def is_dns_sql(e: str) -> str:
    return f"({e} NOT IN ('', 'localhost', '0.0.0.0') AND contains({e}, '.') AND regexp_matches({e}, '[A-Za-z]'))"


def is_loopback_sql(e: str) -> str:
    return f"({nz(e)} IN ('', '127.0.0.1', '0.0.0.0', '::1'))"


def normalize_path_sql(e: str, opts: Options) -> str:
    excl = alt(opts.usable_patterns(opts.exclude_patterns))
    ids = alt(opts.usable_patterns(opts.builtin_patterns) + opts.usable_patterns(opts.user_patterns))
    excl_t = f"regexp_matches(s, {q(excl)})" if excl else "false"
    ids_t = f"regexp_matches(s, {q(ids)})" if ids else "false"
    cond = f"(CASE WHEN s = '' THEN false WHEN strlen(s) > 255 THEN true WHEN {excl_t} THEN false ELSE {ids_t} END)"
    segs = f"string_split(CASE WHEN starts_with({e}, '/') THEN substr({e}, 2) ELSE {e} END, '/')"
    return (f"(CASE WHEN {e} IN ('', '/') THEN {e} "
            f"WHEN list_bool_or(list_transform({segs}, lambda s: {cond})) "
            f"THEN '/' || array_to_string(list_transform({segs}, lambda s: CASE WHEN {cond} THEN '{{id}}' ELSE s END), '/') "
            f"ELSE {e} END)")


def normalize_target_sql(e: str) -> str:
    segs = f"string_split(CASE WHEN starts_with({e}, '/') THEN substr({e}, 2) ELSE {e} END, '/')"
    cond = "(length(s) > 2 AND starts_with(s, '{') AND ends_with(s, '}'))"
    return (f"(CASE WHEN {e} = '' THEN {e} WHEN list_bool_or(list_transform({segs}, lambda s: {cond})) "
            f"THEN '/' || array_to_string(list_transform({segs}, lambda s: CASE WHEN {cond} THEN '{{id}}' ELSE s END), '/') "
            f"ELSE {e} END)")


def trim_suffix_sql(e: str) -> str:
    return f"(CASE WHEN ends_with({e}, '/') THEN left({e}, length({e}) - 1) ELSE {e} END)"


def match_path_sql(base: str, target: str) -> str:
    """B10 without context pass-through (the default)."""
    r = f"(CASE WHEN {base} <> '' THEN {trim_suffix_sql(base)} ELSE '' END || {target})"
    r = f"(CASE WHEN starts_with({r}, '/') THEN {r} ELSE '/' || {r} END)"
    r = f"(CASE WHEN length({r}) > 1 THEN {trim_suffix_sql(r)} ELSE {r} END)"
    return f"regexp_replace({r}, '/{{2,}}', '/', 'g')"


def width_reason_sql(cols) -> str:
    arms = " ".join(f"WHEN length({nz(c)}) > {n} THEN {q(c)}" for c, n in DISCOVERED_WIDTHS.items() if c in cols)
    return f"(CASE {arms} ELSE NULL END)"


def epoch_sec(e: str) -> str:
    return f"CAST(floor(epoch({e})) AS BIGINT)"


# ------------------------------------------------------------------------------------ CTE graph

class Oracle:
    def __init__(self, opts: Options = DEFAULT):
        self.opts = opts
        self.ctes: dict[str, tuple[str, tuple]] = {}
        self._define()

    def add(self, name: str, sql: str, deps=()):
        self.ctes[name] = (sql, tuple(deps))

    def clone(self, names, sfx: str, mapping: dict):
        """Copy a chain of CTEs under a suffix, re-pointing its inputs (mapping: old -> new name)."""
        rename = {n: f"{n}_{sfx}" for n in names}
        rename.update(mapping)
        rx = re.compile(r"\b(" + "|".join(map(re.escape, sorted(rename, key=len, reverse=True))) + r")\b")
        for n in names:
            sql, deps = self.ctes[n]
            self.add(rename[n], rx.sub(lambda m: rename[m.group(1)], sql), [rename.get(d, d) for d in deps])

    def sql(self, final: str, needs) -> str:
        order: list[str] = []

        def visit(n):
            if n in order:
                return
            for d in self.ctes[n][1]:
                visit(d)
            order.append(n)
        for n in needs:
            visit(n)
        if not order:
            return final
        body = ",\n".join(f"{n} AS (\n{self.ctes[n][0]}\n)" for n in order)
        return f"WITH {body}\n{final}"

    # -------------------------------------------------------------------------------- discovery
    def _define(self):
        o = self.opts
        self.add("flows", fx.FLOWS_SQL_DUCK)
        self.add("sp_filtered", f"""
SELECT * FROM flows
WHERE observation_point = {q(o.observation_point)} AND protocol = {o.protocol}
  AND l7_protocol_str IN {in_list(o.l7_protocols)} AND direction_score >= {o.min_direction_score}
  AND endpoint <> '' AND request_type <> ''""", ["flows"])
        self.add("sigs", f"""
SELECT http_method, endpoint, server_port, agent_id, hit_count,
  coalesce(nullif(request_resource, ''), endpoint) AS sample_url,
  {epoch_sec('start_time')} AS sample_second,
  coalesce(request_domain, '') AS request_domain, coalesce(is_tls, false) AS is_tls,
  coalesce(nullif(l7_protocol_str, ''), 'HTTP') AS protocol, coalesce(version, '') AS http_version,
  coalesce(CAST(response_code AS INTEGER), 0) AS response_code,
  coalesce(CAST(response_duration AS BIGINT), 0) AS latency_us,
  start_time AS first_seen_at, last_seen_at
FROM (
  SELECT request_type AS http_method, *,
    count(*) OVER w AS hit_count, max(start_time) OVER w AS last_seen_at,
    row_number() OVER (PARTITION BY request_type, endpoint, server_port, agent_id ORDER BY start_time, flow_id) AS rn
  FROM sp_filtered
  WINDOW w AS (PARTITION BY request_type, endpoint, server_port, agent_id)) x
WHERE rn = 1""", ["sp_filtered"])
        rules = []
        if o.excluded_agent_ids:
            rules.append(f"WHEN agent_id IN {in_list(o.excluded_agent_ids)} THEN 'agent'")
        if o.excluded_ports:
            rules.append(f"WHEN server_port IN {in_list(o.excluded_ports)} THEN 'port'")
        if o.excluded_domains:
            rules.append(f"WHEN {strip_port_sql('lower(request_domain)')} IN "
                         f"{in_list([d.lower() for d in o.excluded_domains])} THEN 'domain'")
        if o.path_exact:
            rules.append(f"WHEN endpoint IN {in_list(o.path_exact)} THEN 'path_exact'")
        if o.path_patterns:
            ors = " OR ".join(f"contains(lower(endpoint), {q(p.lower())})" for p in o.path_patterns)
            rules.append(f"WHEN {ors} THEN 'path_pattern'")
        reason = f"(CASE {' '.join(rules)} ELSE NULL END)" if rules else "CAST(NULL AS VARCHAR)"
        self.add("sigs_reason", f"SELECT *, {reason} AS reason FROM sigs", ["sigs"])
        self.add("kept", "SELECT * EXCLUDE (reason) FROM sigs_reason WHERE reason IS NULL", ["sigs_reason"])
        self.add("normalized", f"SELECT *, {normalize_path_sql('endpoint', o)} AS resource_path, endpoint AS sample_path "
                               "FROM kept", ["kept"])
        self.add("deduped", """
SELECT http_method, resource_path, server_port, agent_id, total_hits AS hit_count,
  endpoint AS sample_path, sample_url, sample_second, request_domain, is_tls, protocol, http_version,
  response_code, latency_us, min_first AS first_seen_at, max_last AS last_seen_at,
  -hit_count AS r_neg_hits, http_method AS r_m, endpoint AS r_e, server_port AS r_p, agent_id AS r_a
FROM (
  SELECT *, CAST(sum(hit_count) OVER w AS BIGINT) AS total_hits, min(first_seen_at) OVER w AS min_first,
    max(last_seen_at) OVER w AS max_last,
    row_number() OVER (PARTITION BY http_method, resource_path, server_port, agent_id
                       ORDER BY hit_count DESC, endpoint) AS rn
  FROM normalized
  WINDOW w AS (PARTITION BY http_method, resource_path, server_port, agent_id)) x
WHERE rn = 1""", ["normalized"])
        # Every observation row goes to its first matching signature (brute force)
        self.add("fusion_match", f"""
SELECT * FROM (
  SELECT f.*, d.http_method AS k_http_method, d.resource_path AS k_resource_path,
    d.server_port AS k_server_port, d.agent_id AS k_agent_id,
    row_number() OVER (PARTITION BY f.flow_id ORDER BY d.r_neg_hits, d.r_m, d.r_e, d.r_p, d.r_a) AS rn
  FROM (SELECT *, {epoch_sec('start_time')} AS sec FROM flows WHERE observation_point IN ('s-p', 's', 'c-p')) f
  JOIN deduped d
    ON f.request_resource = d.sample_url AND f.request_type = d.http_method
   AND (abs(f.sec - d.sample_second) <= {o.fusion_tolerance_ms // 1000} OR f.sec IS NULL OR d.sample_second IS NULL)
  WHERE regexp_full_match(d.sample_url, '[A-Za-z0-9/_.~:?=&%+@#,; \\[\\]-]*')) x
WHERE rn = 1""", ["flows", "deduped"])
        first = lambda v, cond: f"arg_min({v}, (start_time, flow_id)) FILTER (WHERE {cond})"
        self.add("fusion_attach", f"""
SELECT k_http_method AS http_method, k_resource_path AS resource_path, k_server_port AS server_port,
  k_agent_id AS agent_id,
  arg_max({{'k8s_service': pod_service_1, 'k8s_namespace': pod_ns_1, 'k8s_workload': pod_group_1,
            'k8s_pod': pod_1, 'k8s_cluster': pod_cluster_1, 'k8s_node': pod_node_1, 'vm_hostname': chost_1,
            'process_name': process_kname_1, 'service_ip': ip4_1}}, (start_time, flow_id))
    FILTER (WHERE observation_point = 's-p') AS sp,
  {first('request_domain', "observation_point = 's-p' AND request_domain <> ''")} AS sp_domain,
  {first('ip4_0', "observation_point = 's' AND ip4_0 <> ''")} AS source_ip,
  {first('ip4_1', "observation_point = 's' AND ip4_1 <> ''")} AS host_ip,
  {first('coalesce(is_internet_0, false)', "observation_point = 's'")} AS is_external,
  {first('ip4_0', "observation_point = 'c-p' AND ip4_0 <> ''")} AS source_service_ip,
  {first('process_kname_0', "observation_point = 'c-p' AND process_kname_0 <> ''")} AS source_process_name,
  {first('pod_0', "observation_point = 'c-p' AND pod_0 <> ''")} AS source_k8s_pod,
  {first('pod_ns_0', "observation_point = 'c-p' AND pod_ns_0 <> ''")} AS source_k8s_namespace,
  {first('pod_service_0', "observation_point = 'c-p' AND pod_service_0 <> ''")} AS source_k8s_service,
  {first('pod_cluster_0', "observation_point = 'c-p' AND pod_cluster_0 <> ''")} AS source_k8s_cluster,
  {first('chost_0', "observation_point = 'c-p' AND chost_0 <> ''")} AS source_vm_hostname
FROM fusion_match
GROUP BY ALL""", ["fusion_match"])
        sp_cols = ["k8s_service", "k8s_namespace", "k8s_workload", "k8s_pod", "k8s_cluster", "k8s_node",
                   "vm_hostname", "process_name", "service_ip"]
        cp_cols = ["source_service_ip", "source_process_name", "source_k8s_pod", "source_k8s_namespace",
                   "source_k8s_service", "source_k8s_cluster", "source_vm_hostname"]
        self.add("fused_raw", f"""
SELECT d.http_method, d.resource_path, d.server_port, d.agent_id, d.hit_count, d.sample_path, d.sample_url,
  d.sample_second, d.is_tls, d.protocol, d.http_version, d.response_code, d.latency_us,
  d.first_seen_at, d.last_seen_at, d.r_neg_hits, d.r_m, d.r_e, d.r_p, d.r_a,
  CASE WHEN d.request_domain = '' THEN coalesce(a.sp_domain, '') ELSE d.request_domain END AS request_domain,
  {', '.join(f"coalesce(a.sp.{c}, '') AS {c}" for c in sp_cols)},
  coalesce(a.source_ip, '') AS source_ip, coalesce(a.host_ip, '') AS host_ip, a.is_external,
  {', '.join(f"coalesce(a.{c}, '') AS {c}" for c in cp_cols)},
  CAST(NULL AS VARCHAR) AS agent_name
FROM deduped d LEFT JOIN fusion_attach a
  ON d.http_method = a.http_method AND d.resource_path = a.resource_path
 AND d.server_port = a.server_port AND d.agent_id = a.agent_id""", ["deduped", "fusion_attach"])
        dom = strip_port_sql("request_domain")
        port = "CAST(server_port AS VARCHAR)"
        self.add("fused", f"""
SELECT *,
  CASE WHEN k8s_service <> '' THEN CASE WHEN k8s_namespace <> '' THEN k8s_namespace || '/' || k8s_service ELSE k8s_service END
       WHEN k8s_workload <> '' THEN CASE WHEN k8s_namespace <> '' THEN k8s_namespace || '/' || k8s_workload ELSE k8s_workload END
       WHEN request_domain <> '' AND {is_dns_sql(dom)} THEN {dom}
       WHEN NOT {is_loopback_sql('host_ip')} THEN host_ip || ':' || {port}
       WHEN NOT {is_loopback_sql('service_ip')} THEN service_ip || ':' || {port}
       WHEN coalesce(agent_name, '') <> '' THEN agent_name || ':' || {port}
       ELSE 'agent-' || CAST(agent_id AS VARCHAR) || ':' || {port} END AS service_key,
  CASE WHEN k8s_service <> '' OR k8s_workload <> '' THEN 'KUBERNETES' WHEN k8s_pod <> '' THEN 'CONTAINER'
       ELSE 'LEGACY' END AS service_type,
  CASE WHEN source_k8s_service <> '' THEN 'SERVICE_TO_SERVICE' WHEN source_k8s_pod <> '' THEN 'CONTAINER_TO_SERVICE'
       WHEN source_process_name <> '' OR source_service_ip <> '' THEN 'INTERNAL'
       WHEN is_external THEN 'EXTERNAL' WHEN NOT is_external THEN 'INTERNAL' ELSE 'UNKNOWN' END AS traffic_origin
FROM fused_raw""", ["fused_raw"])
        self.add("fused_reason", "SELECT *, " + width_reason_sql(DISCOVERED_WIDTHS) + " AS reject_reason FROM fused",
                 ["fused"])
        self.add("fused_valid", "SELECT * EXCLUDE (reject_reason) FROM fused_reason WHERE reject_reason IS NULL",
                 ["fused_reason"])
        self._define_state()
        self._define_managed()
        self._define_comparison()
        self._define_cycles()
        self._define_specs()
        self._define_catalog()
        self._define_managed_sync()
        self.add("result_src", fx.RESULT_SRC_SQL)
        cell = "json_extract(body, '$.values[' || row_idx || '][' || (list_position(cols, {name}) - 1) || ']')"
        rt, hits = cell.format(name="'request_type'"), cell.format(name="'hits'")
        self.add("result_rows", f"""
SELECT event_id, row_idx,
  CASE WHEN json_type({rt}) = 'VARCHAR' THEN json_extract_string({rt}, '$')
       WHEN {rt} IS NULL OR json_type({rt}) = 'NULL' THEN '' ELSE CAST({rt} AS VARCHAR) END AS request_type,
  CASE WHEN json_type({hits}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(trunc(CAST({hits} AS DOUBLE)) AS BIGINT)
       ELSE 0 END AS hits
FROM (SELECT event_id, body, CAST(json_extract(body, '$.columns') AS VARCHAR[]) AS cols,
        unnest(range(CAST(json_array_length(body, '$.values') AS BIGINT))) AS row_idx
      FROM result_src) x""", ["result_src"])

    # ------------------------------------------------------------------ discovered state
    def _define_state(self):
        def v(c):
            return f"nullif({c}, '')" if c in BLANK_IS_NULL else c
        keep = ", ".join(f"'{c}': {v(c)}" for c in FIRST)
        over = ", ".join(f"'{c}': {v(c)}" for c in NEWEST)
        coal = ",\n  ".join(
            f"arg_max({{'v': {v(c)}}}, rk) FILTER (WHERE {v(c)} IS NOT NULL).v AS {c}" for c in NEWEST_KNOWN)
        cols = ", ".join(
            (f"f.{c}" if c in FIRST else f"l.{c}" if c in NEWEST else c) + f" AS {c}" for c in ALL_COLUMNS)
        # one cycle's records per discovered key; `fused_src` is the fused row set of that cycle
        self.batch_sql = f"""
SELECT {cols} FROM (
SELECT service_key, http_method, resource_path,
  arg_min({{{keep}}}, rk) AS f, arg_max({{{over}}}, rk) AS l,
  {coal},
  CAST(sum(hit_count) AS BIGINT) AS hit_count, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at
FROM (SELECT *, (r_neg_hits, r_m, r_e, r_p, r_a) AS rk FROM fused_src) x
GROUP BY ALL) y"""
        self.add("discovered", self.batch_sql.replace("fused_src", "fused_valid"), ["fused_valid"])

    # ------------------------------------------------------------------------- managed (A4, A5)
    def _define_managed(self):
        o = self.opts
        self.add("managed_src", fx.MANAGED_SRC_SQL_DUCK)
        types = f"AND api_type IN {in_list(o.include_api_types)}" if o.include_api_types else ""
        self.add("m_pub", f"SELECT * FROM managed_src WHERE lifecycle_status = 'PUBLISHED' {types}", ["managed_src"])
        self.add("m_apis", self.apis_sql("m_pub"), ["m_pub"])
        self.add("m_ops", f"""
SELECT reg_api_id, http_method, raw_target, normalized_target,
  {match_path_sql('endpoint_basepath', 'normalized_target')} AS match_path
FROM (
  SELECT s.reg_api_id, upper(s.verb) AS http_method, s.target AS raw_target,
    {normalize_target_sql('s.target')} AS normalized_target, a.endpoint_basepath
  FROM m_pub s JOIN m_apis a ON s.reg_api_id = a.reg_api_id
  WHERE upper(s.verb) NOT IN ('', 'OPTIONS', 'HEAD')) x""", ["m_pub", "m_apis"])

    def apis_sql(self, src: str) -> str:
        scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
        tparse = "timezone('UTC', strptime(last_updated, '%Y-%m-%dT%H:%M:%S.%g%z'))"
        return f"""
SELECT DISTINCT reg_api_id, api_name, api_version, context, api_type, lifecycle_status, 'admin' AS provider,
  'http' AS endpoint_type, endpoint_url,
  regexp_extract(endpoint_url, '{scheme}([^/:]*)', 1) AS endpoint_hostname,
  CASE WHEN regexp_extract(endpoint_url, '{scheme}[^/]*:([0-9]+)', 1) <> ''
       THEN CAST(regexp_extract(endpoint_url, '{scheme}[^/]*:([0-9]+)', 1) AS INTEGER)
       WHEN starts_with(lower(endpoint_url), 'https:') THEN 443 ELSE 80 END AS endpoint_port,
  {trim_suffix_sql(f"regexp_extract(endpoint_url, '{scheme}[^/]*([^?#]*)', 1)")} AS endpoint_basepath,
  {tparse} AS reg_last_updated_at, {tparse} AS reg_created_at
FROM {src}"""

    # ------------------------------------------------------------------ comparison
    def _define_comparison(self):
        self.add("op_pick", """
SELECT http_method, match_path AS resource_path, reg_api_id FROM (
  SELECT *, row_number() OVER (PARTITION BY http_method, match_path ORDER BY reg_api_id DESC, raw_target DESC) AS rn
  FROM m_ops) x WHERE rn = 1""", ["m_ops"])
        self.add("cands", """
SELECT d.service_key, d.http_method, d.resource_path, coalesce(d.request_domain, '') AS request_domain,
  coalesce(d.host_ip, '') AS host_ip, d.server_port, d.hit_count, p.reg_api_id
FROM discovered d LEFT JOIN op_pick p ON d.http_method = p.http_method AND d.resource_path = p.resource_path""",
                 ["discovered", "op_pick"])
        self.add("coll", """
SELECT http_method, resource_path, reg_api_id, count(DISTINCT service_key) AS n_services
FROM cands WHERE reg_api_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT service_key) > 1""", ["cands"])
        self.add("scores", """
SELECT k.http_method, k.resource_path, k.reg_api_id, k.service_key, CAST(count(d.service_key) AS BIGINT) AS score
FROM (SELECT DISTINCT c.http_method, c.resource_path, c.reg_api_id, c.service_key
      FROM cands c JOIN coll USING (http_method, resource_path, reg_api_id)) k
JOIN m_ops o ON o.reg_api_id = k.reg_api_id
LEFT JOIN cands d ON d.service_key = k.service_key AND d.http_method = o.http_method AND d.resource_path = o.match_path
GROUP BY ALL""", ["cands", "coll", "m_ops"])
        self.add("sk_domain", """
SELECT service_key, arg_min(request_domain, (http_method, resource_path)) FILTER (WHERE request_domain <> '') AS domain
FROM cands GROUP BY ALL""", ["cands"])
        self.add("resolved", f"""
SELECT http_method, resource_path, reg_api_id,
  CASE WHEN count(*) = 1 THEN min(service_key) ELSE min(service_key) FILTER (WHERE host_match) END AS winner,
  CASE WHEN count(*) = 1 THEN 'SCORE' WHEN bool_or(host_match) THEN 'HOST' ELSE 'AMBIGUOUS' END AS resolution,
  list_sort(list(service_key)) AS tied_keys, max(score) AS best_score
FROM (
  SELECT s.*, {strip_port_sql("coalesce(dm.domain, '')", keep_leading=False)} = coalesce(a.endpoint_hostname, '') AS host_match
  FROM (SELECT *, max(score) OVER (PARTITION BY http_method, resource_path, reg_api_id) AS best FROM scores) s
  LEFT JOIN sk_domain dm ON dm.service_key = s.service_key
  LEFT JOIN m_apis a ON a.reg_api_id = s.reg_api_id
  WHERE s.score = s.best) t
GROUP BY ALL""", ["scores", "sk_domain", "m_apis"])
        self.add("losers", """
SELECT c.* FROM cands c JOIN resolved r ON c.http_method = r.http_method AND c.resource_path = r.resource_path
WHERE r.winner IS NOT NULL AND c.service_key <> r.winner""", ["cands", "resolved"])
        self.add("classified", """
SELECT c.service_key, c.http_method, c.resource_path, c.request_domain, c.host_ip, c.server_port, c.hit_count,
  CASE WHEN m.managed_api_id IS NOT NULL THEN 'DRIFT' ELSE 'SHADOW' END AS classification,
  CASE WHEN c.lost THEN 'LOW' ELSE 'HIGH' END AS confidence, m.managed_api_id
FROM (SELECT c.*, l.service_key IS NOT NULL AS lost FROM cands c
      LEFT JOIN losers l ON c.service_key = l.service_key AND c.http_method = l.http_method
                        AND c.resource_path = l.resource_path) c
LEFT JOIN (SELECT service_key, arg_min(reg_api_id, (http_method, resource_path)) AS managed_api_id
           FROM (SELECT c.* FROM cands c WHERE c.reg_api_id IS NOT NULL
                 AND NOT EXISTS (SELECT 1 FROM losers l WHERE l.service_key = c.service_key
                                 AND l.http_method = c.http_method AND l.resource_path = c.resource_path)) r
           GROUP BY ALL) m ON m.service_key = c.service_key
WHERE c.reg_api_id IS NULL OR c.lost""", ["cands", "losers"])

    # ------------------------------------------------------- two cycles: discovery, comparison, E7-E9
    DISCOVERY_CHAIN = ("sp_filtered", "sigs", "sigs_reason", "kept", "normalized", "deduped", "fusion_match",
                       "fusion_attach", "fused_raw", "fused", "fused_reason", "fused_valid", "discovered")
    COMPARISON_CHAIN = ("op_pick", "cands", "coll", "scores", "sk_domain", "resolved", "losers", "classified")

    def _define_cycles(self):
        split, as_of = q(fx.STATE_SPLIT), q(fx.AS_OF)
        self.add("flows_w1", f"SELECT * FROM flows WHERE start_time < TIMESTAMP {split}", ["flows"])
        self.add("flows_w2", f"SELECT * FROM flows WHERE start_time >= TIMESTAMP {split}", ["flows"])
        self.clone(self.DISCOVERY_CHAIN, "w1", {"flows": "flows_w1"})
        self.clone(self.DISCOVERY_CHAIN, "w2", {"flows": "flows_w2"})
        on = " AND ".join(f"o.{k} = n.{k}" for k in KEY_COLUMNS)

        def rule(c):
            if c in KEY_COLUMNS:
                return f"coalesce(o.{c}, n.{c})"
            if c == "first_seen_at":
                return "least(o.first_seen_at, n.first_seen_at)"
            if c == "last_seen_at":
                return "greatest(o.last_seen_at, n.last_seen_at)"
            if c in NEWEST:
                return f"CASE WHEN n.http_method IS NOT NULL THEN n.{c} ELSE o.{c} END"
            if c in NEWEST_KNOWN:
                return f"CASE WHEN n.http_method IS NOT NULL THEN coalesce(n.{c}, o.{c}) ELSE o.{c} END"
            if c == "hit_count":
                return "coalesce(o.hit_count, 0) + coalesce(n.hit_count, 0)"
            return f"CASE WHEN o.http_method IS NOT NULL THEN o.{c} ELSE n.{c} END"
        self.add("discovered_m", "SELECT " + ", ".join(f"{rule(c)} AS {c}" for c in ALL_COLUMNS)
                 + f" FROM discovered_w1 o FULL OUTER JOIN discovered_w2 n ON {on}", ["discovered_w1", "discovered_w2"])
        # the windows that a stream over the whole log has closed
        self.add("stream_end", "SELECT make_timestamp(CAST((epoch_us(max(start_time)) - 120000000) // 300000000 * 300000000 "
                 "AS BIGINT)) AS t FROM sp_filtered", ["sp_filtered"])
        self.add("flows_ws", "SELECT * FROM flows WHERE start_time < (SELECT t FROM stream_end)", ["flows", "stream_end"])
        self.clone(self.DISCOVERY_CHAIN, "ws", {"flows": "flows_ws"})
        # each 5-minute cycle of them alone: agents get other numbers in other cycles, so nothing meets across cycles
        self.add("flows_cyc", "SELECT * REPLACE (agent_id + 1000 * CAST(epoch_us(start_time) // 300000000 AS BIGINT) AS agent_id) "
                 "FROM flows_ws", ["flows_ws"])
        self.clone(self.DISCOVERY_CHAIN, "cyc", {"flows": "flows_cyc"})
        self.add("flows_w2s", "SELECT * FROM flows_w2 WHERE start_time < (SELECT t FROM stream_end)", ["flows_w2", "stream_end"])
        self.clone(self.DISCOVERY_CHAIN, "w2s", {"flows": "flows_w2s"})
        self.add("discovered_ms", "SELECT " + ", ".join(f"{rule(c)} AS {c}" for c in ALL_COLUMNS)
                 + f" FROM discovered_w1 o FULL OUTER JOIN discovered_w2s n ON {on}", ["discovered_w1", "discovered_w2s"])
        self.add("flows_edge", "SELECT * REPLACE (CASE WHEN agent_id = 3 THEN repeat('d', "
                 f"{fx.EDGE_DOMAIN_WIDTH}) ELSE request_domain END AS request_domain) FROM flows", ["flows"])
        self.clone(self.DISCOVERY_CHAIN, "edge", {"flows": "flows_edge"})
        self.add("flows_tw", fx.TWIN_SQL, ["flows"])
        self.clone(self.DISCOVERY_CHAIN, "tw", {"flows": "flows_tw"})
        self.clone(self.COMPARISON_CHAIN, "tw", {"discovered": "discovered_tw"})
        self.clone(self.COMPARISON_CHAIN, "w1", {"discovered": "discovered_w1"})
        # registered side that grows between the cycles: findings are resolved, and classes change
        self.add("m_ops_half", "SELECT * FROM m_ops WHERE CAST(substr(reg_api_id, 5, 3) AS INTEGER) % 2 = 0", ["m_ops"])
        self.clone(self.COMPARISON_CHAIN, "h1", {"discovered": "discovered_w1", "m_ops": "m_ops_half"})
        self.clone(self.COMPARISON_CHAIN, "m", {"discovered": "discovered_m"})
        self.add("u0", "SELECT CAST(NULL AS VARCHAR) AS service_key, CAST(NULL AS VARCHAR) AS http_method, "
                 "CAST(NULL AS VARCHAR) AS resource_path, CAST(NULL AS VARCHAR) AS managed_api_id, "
                 "CAST(NULL AS VARCHAR) AS classification, CAST(NULL AS VARCHAR) AS confidence, "
                 "CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS first_detected_at, "
                 "CAST(NULL AS TIMESTAMP) AS last_confirmed_at, CAST(NULL AS TIMESTAMP) AS resolved_at, "
                 "CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at WHERE 1 = 0")
        self.cycle("u1", "u0", "classified_w1", "discovered_w1", fx.STATE_SPLIT)
        self.cycle("u2", "u1", "classified_m", "discovered_m", fx.AS_OF)
        self.clone(self.COMPARISON_CHAIN, "ms", {"discovered": "discovered_ms"})
        self.clone(self.COMPARISON_CHAIN, "ws", {"discovered": "discovered_ws"})
        self.cycle("us2", "u1", "classified_ms", "discovered_ms", "(SELECT t FROM stream_end)")
        self.cycle("ut", "u0", "classified_tw", "discovered_tw", fx.AS_OF)
        self.cycle("uh1", "u0", "classified_h1", "discovered_w1", fx.STATE_SPLIT)
        self.cycle("uh2", "uh1", "classified_m", "discovered_m", fx.AS_OF)
        self.add("u1d", f"""
SELECT * REPLACE (CASE WHEN confidence = 'LOW' THEN 'DISMISSED' ELSE status END AS status,
                  CASE WHEN confidence = 'LOW' THEN TIMESTAMP {q(DISMISS_AT)} ELSE updated_at END AS updated_at)
FROM u1""", ["u1"])
        self.cycle("u2d", "u1d", "classified_m", "discovered_m", fx.AS_OF)

    def cycle(self, name, prev, classified, disc, as_of):
        ts = as_of if as_of.startswith("(") else f"TIMESTAMP {q(as_of)}"  # a time, or a subquery for one
        deps = ["stream_end"] if "stream_end" in ts else []
        after = self.opts.stale_after
        on = " AND ".join(f"o.{k} = n.{k}" for k in ("service_key", "http_method", "resource_path"))
        reopen = ("(o.classification <> n.classification OR o.managed_api_id IS DISTINCT FROM n.managed_api_id "
                  "OR o.status IN ('RESOLVED', 'STALE'))")
        self.add(f"{name}_e7", f"""
SELECT coalesce(o.service_key, n.service_key) AS service_key, coalesce(o.http_method, n.http_method) AS http_method,
  coalesce(o.resource_path, n.resource_path) AS resource_path,
  CASE WHEN n.service_key IS NOT NULL THEN n.managed_api_id ELSE o.managed_api_id END AS managed_api_id,
  CASE WHEN n.service_key IS NOT NULL THEN n.classification ELSE o.classification END AS classification,
  CASE WHEN n.service_key IS NOT NULL THEN n.confidence ELSE o.confidence END AS confidence,
  CASE WHEN o.service_key IS NULL THEN 'DETECTED' WHEN n.service_key IS NULL THEN o.status
       WHEN {reopen} THEN 'DETECTED' ELSE o.status END AS status,
  CASE WHEN o.service_key IS NULL THEN {ts} ELSE o.first_detected_at END AS first_detected_at,
  CASE WHEN n.service_key IS NOT NULL THEN {ts} ELSE o.last_confirmed_at END AS last_confirmed_at,
  CASE WHEN o.service_key IS NULL THEN NULL WHEN n.service_key IS NULL THEN o.resolved_at
       WHEN {reopen} THEN NULL ELSE o.resolved_at END AS resolved_at,
  CASE WHEN o.service_key IS NULL THEN {ts} ELSE o.created_at END AS created_at,
  o.updated_at, o.status AS prev_status
FROM {prev} o FULL OUTER JOIN {classified} n ON {on}""", [prev, classified, *deps])
        self.add(f"{name}_e8", f"""
SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'RESOLVED' ELSE status END AS status,
                                CASE WHEN hit THEN {ts} ELSE resolved_at END AS resolved_at)
FROM (SELECT *, status NOT IN ('DISMISSED', 'RESOLVED', 'STALE') AND last_confirmed_at < {ts}
        AND EXISTS (SELECT 1 FROM {disc}) AS hit FROM {name}_e7) x""", [f"{name}_e7", disc, *deps])
        self.add(f"{name}_e9", f"""
SELECT * EXCLUDE (hit, d_last) REPLACE (CASE WHEN hit THEN 'STALE' ELSE status END AS status,
                                        CASE WHEN hit THEN {ts} ELSE resolved_at END AS resolved_at)
FROM (SELECT u.*, d.last_seen_at AS d_last,
        coalesce(u.status NOT IN ('DISMISSED', 'RESOLVED', 'STALE')
                 AND d.last_seen_at < {ts} - INTERVAL '{after}', false) AS hit
      FROM {name}_e8 u LEFT JOIN {disc} d ON u.service_key = d.service_key AND u.http_method = d.http_method
       AND u.resource_path = d.resource_path) x""", [f"{name}_e8", disc, *deps])
        self.add(name, f"""
SELECT * EXCLUDE (prev_status) REPLACE (
  CASE WHEN prev_status IS NULL OR prev_status <> status THEN {ts} ELSE updated_at END AS updated_at)
FROM {name}_e9""", [f"{name}_e9", *deps])

    # ------------------------------------------------------------------------ specs (J8, C17, F*)
    def _define_specs(self):
        term = "('DISMISSED', 'RESOLVED', 'STALE')"
        key_on = "u.service_key = d.service_key AND u.http_method = d.http_method AND u.resource_path = d.resource_path"
        grp_on = ("g.service_key = u.service_key AND g.classification = u.classification "
                  "AND g.managed_api_id IS NOT DISTINCT FROM u.managed_api_id")
        ints = {"server_port", "response_code", "latency_us", "hit_count"}

        def meta(c):
            if c in ("first_seen_at", "last_seen_at"):
                return f"d.{c}"
            if c in ints:
                return f"coalesce(d.{c}, 0) AS {c}"
            if c == "is_tls":
                return "coalesce(d.is_tls, false) AS is_tls"
            return f"coalesce(d.{c}, '') AS {c}"
        self.add("sp_groups", "SELECT DISTINCT service_key, classification, managed_api_id FROM u2 WHERE status = 'DETECTED'",
                 ["u2"])
        self.add("sp_input", f"""
SELECT u.managed_api_id, u.service_key, u.http_method, u.resource_path, u.classification, u.confidence,
  {', '.join(meta(c) for c in FINDING_FACTS)},
  coalesce(a.api_name, '') AS parent_api_name, coalesce(a.api_version, '') AS parent_api_version
FROM u2 u JOIN discovered_m d ON {key_on}
LEFT JOIN m_apis a ON a.reg_api_id = u.managed_api_id
WHERE u.status NOT IN {term} AND EXISTS (SELECT 1 FROM sp_groups g WHERE {grp_on})""",
                 ["u2", "discovered_m", "m_apis", "sp_groups"])
        self.add("sp_stats", """
SELECT service_key, classification, managed_api_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at,
  CAST(sum(hit_count) AS BIGINT) AS total_hit_count, count(*) AS total_operations,
  bool_or(is_tls) AS has_tls, bool_and(is_tls) AS all_tls
FROM sp_input GROUP BY ALL""", ["sp_input"])
        dom = strip_port_sql("request_domain", keep_leading=False)
        self.add("sp_head", f"""
SELECT r.*, s.has_tls, s.all_tls,
  CASE WHEN r.classification = 'DRIFT' AND r.parent_api_name <> '' THEN r.parent_api_name || '-Drift'
       ELSE replace(replace(r.service_key, '/', '-'), ':', '-') END AS title,
  CASE WHEN s.has_tls AND NOT s.all_tls THEN 'https://' || r.hostname || ',http://' || r.hostname
       WHEN s.has_tls THEN 'https://' || r.hostname ELSE 'http://' || r.hostname END AS servers
FROM (
  SELECT *,
    CASE WHEN k8s_service <> '' AND k8s_namespace <> '' THEN k8s_service || '.' || k8s_namespace
         WHEN k8s_service <> '' THEN k8s_service
         WHEN request_domain <> '' AND contains({dom}, '.') AND regexp_matches({dom}, '[A-Za-z]')
              AND {dom} NOT IN ('localhost', '0.0.0.0') THEN {dom}
         WHEN request_domain <> '' AND {dom} NOT IN ('', '127.0.0.1', '0.0.0.0') THEN {dom}
         WHEN host_ip NOT IN ('', '127.0.0.1', '0.0.0.0') THEN host_ip
         WHEN service_ip NOT IN ('', '127.0.0.1', '0.0.0.0') THEN service_ip
         ELSE 'unknown-host' END AS hostname
  FROM (SELECT *, row_number() OVER (PARTITION BY service_key, classification, managed_api_id
                                     ORDER BY resource_path, http_method) AS rn FROM sp_input) x
  WHERE rn = 1) r
JOIN sp_stats s ON s.service_key = r.service_key AND s.classification = r.classification
 AND s.managed_api_id IS NOT DISTINCT FROM r.managed_api_id""", ["sp_input", "sp_stats"])
        opid = ("regexp_replace(regexp_replace(replace(replace(replace(lower(http_method) || '-' || resource_path, "
                "'/', '-'), '{', ''), '}', ''), '^-+|-+$', '', 'g'), '-{2,}', '-', 'g')")
        self.add("sp_opids", f"SELECT *, {opid} AS operation_id FROM sp_input", ["sp_input"])
        segs = "string_split(trim(resource_path, '/'), '/')"
        nth = f"len(list_filter(list_slice({segs}, 1, i), lambda y: y = '{{id}}'))"
        names = f"list_transform({segs}, lambda s, i: CASE WHEN s = '{{id}}' THEN CASE WHEN {nth} = 1 THEN 'id' ELSE 'id' || CAST({nth} AS VARCHAR) END END)"
        self.add("sp_paths_all", f"""
SELECT *, '/' || array_to_string(list_transform({names}, lambda n, i: coalesce('{{' || n || '}}', {segs}[i])), '/') AS oas_path,
  array_to_string(list_filter({names}, lambda n: n IS NOT NULL), ',') AS params
FROM sp_opids""", ["sp_opids"])
        self.add("sp_paths", """
SELECT * EXCLUDE (keep_path) FROM (
  SELECT *, max(resource_path) OVER (PARTITION BY service_key, classification, managed_api_id, oas_path) AS keep_path
  FROM sp_paths_all) x WHERE resource_path = keep_path""", ["sp_paths_all"])
        self.add("sp_rejects", """
SELECT service_key, classification, managed_api_id, count(*) AS operations, count(DISTINCT operation_id) AS distinct_ids
FROM sp_paths GROUP BY ALL HAVING count(*) <> count(DISTINCT operation_id)""", ["sp_paths"])
        self.add("sp_good", """
SELECT * FROM sp_groups g WHERE NOT EXISTS (SELECT 1 FROM sp_rejects r WHERE r.service_key = g.service_key
  AND r.classification = g.classification AND r.managed_api_id IS NOT DISTINCT FROM g.managed_api_id)""",
                 ["sp_groups", "sp_rejects"])
        self.clone(("sp_groups", "sp_input", "sp_stats", "sp_opids", "sp_paths_all", "sp_paths", "sp_rejects"), "tw",
                   {"u2": "ut", "discovered_m": "discovered_tw"})
        ts = f"TIMESTAMP {q(fx.AS_OF)}"
        self.add("u3", f"""
SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'SPEC_GENERATED' ELSE status END AS status,
  CASE WHEN hit THEN {ts} ELSE spec_generated_at END AS spec_generated_at,
  CASE WHEN hit THEN {ts} ELSE updated_at END AS updated_at)
FROM (SELECT u.*, CAST(NULL AS TIMESTAMP) AS spec_generated_at,
        u.status NOT IN {term} AND EXISTS (SELECT 1 FROM sp_good g WHERE g.service_key = u.service_key
          AND g.classification = u.classification
          AND (g.managed_api_id IS NULL OR g.managed_api_id = u.managed_api_id)) AS hit
      FROM u2 u) x""", ["u2", "sp_good"])

    # ------------------------------------------------------------------- catalog (C13, G*, E11/12)
    def _define_catalog(self):
        o = self.opts
        term = "('DISMISSED', 'RESOLVED', 'STALE')"
        self.add("catalog_src", fx.CATALOG_SRC_SQL)
        self.add("u3s", """
SELECT * REPLACE (CASE WHEN classification = 'DRIFT'
  THEN 'cat-' || lpad(CAST((length(service_key) * 2) % 50 AS VARCHAR), 3, '0') END AS catalog_service_id)
FROM (SELECT *, CAST(NULL AS VARCHAR) AS catalog_service_id FROM u3) x""", ["u3"])
        version = f"strftime(TIMESTAMP {q(PUSH_AS_OF)}, '%Y.%m.%d')"
        self.add("pp_groups", f"""
SELECT DISTINCT ON (service_key, classification, managed_api_id) service_key, classification, managed_api_id,
  catalog_service_id
FROM u3s WHERE status = 'SPEC_GENERATED'
ORDER BY service_key, classification, managed_api_id, catalog_service_id NULLS LAST, resource_path, http_method""",
                 ["u3s"])
        keep = ["TRUE"]
        if not o.push_shadow:
            keep.append("g.classification <> 'SHADOW'")
        if not o.push_drift:
            keep.append("g.classification <> 'DRIFT'")
        note = (f"CASE WHEN g.classification = 'SHADOW' THEN {q(SHADOW_LEAD)} || g.service_key || {q(SEEN_END)} "
                f"ELSE {q(DRIFT_LEAD)} || g.service_key || {q(SEEN_END)} END")
        base = ("CASE WHEN g.catalog_service_id IS NULL THEN 'CREATE' WHEN c.id IS NOT NULL THEN 'UPDATE' "
                f"WHEN {str(bool(o.re_push_deleted)).upper()} THEN 'CREATE' ELSE 'SKIP' END")
        self.add("pp_plan", f"""
SELECT *,
  CASE WHEN is_update AND (t_name IS DISTINCT FROM catalog_name OR t_version IS DISTINCT FROM catalog_version) THEN 'REPLACE'
       WHEN is_update THEN 'UPDATE' ELSE base END AS action
FROM (
  SELECT g.service_key, g.classification, g.managed_api_id, g.catalog_service_id, h.catalog_name,
    {version} AS catalog_version,
    CASE WHEN h.has_tls THEN 'https://' ELSE 'http://' END || h.hostname AS service_url,
    {q(f"[{o.owner_tag}:{o.hostname}] ")} || {note} AS description,
    {base} AS base,
    CASE WHEN {base} = 'UPDATE' THEN c.id WHEN {base} = 'CREATE' AND n.id IS NOT NULL THEN n.id END AS target_id,
    CASE WHEN {base} = 'UPDATE' THEN c.name WHEN {base} = 'CREATE' AND n.id IS NOT NULL THEN n.name END AS t_name,
    CASE WHEN {base} = 'UPDATE' THEN c.version WHEN {base} = 'CREATE' AND n.id IS NOT NULL THEN n.version END AS t_version,
    {base} = 'UPDATE' OR ({base} = 'CREATE' AND n.id IS NOT NULL) AS is_update
  FROM pp_groups g
  JOIN (SELECT service_key, classification, managed_api_id, has_tls, hostname,
          CASE WHEN classification = 'DRIFT' AND parent_api_name <> '' THEN parent_api_name || '-Drift'
               ELSE replace(replace(service_key, '/', '-'), ':', '-') END AS catalog_name FROM sp_head) h
    ON h.service_key = g.service_key AND h.classification = g.classification
   AND h.managed_api_id IS NOT DISTINCT FROM g.managed_api_id
  LEFT JOIN catalog_src c ON c.id = g.catalog_service_id
  LEFT JOIN (SELECT name, min(id) AS id, arg_min(version, id) AS version FROM catalog_src GROUP BY name) n
    ON n.name = h.catalog_name
  WHERE {' AND '.join(keep)}) x""", ["pp_groups", "sp_head", "catalog_src"])
        # findings that were never pushed, against a catalog with entries of their names
        self.add("catalog_edge", fx.CATALOG_EDGE_SQL)
        self.add("u3n", "SELECT *, CAST(NULL AS VARCHAR) AS catalog_service_id FROM u3", ["u3"])
        self.clone(("pp_groups", "pp_plan"), "edge", {"u3s": "u3n", "catalog_src": "catalog_edge"})
        pts = f"TIMESTAMP {q(PUSH_AS_OF)}"
        self.add("pp_results", """
SELECT service_key, classification, managed_api_id, action, catalog_version,
  CASE WHEN action = 'UPDATE' THEN target_id WHEN action = 'SKIP' THEN catalog_service_id
       ELSE 'new:' || catalog_name || ':' || catalog_version END AS catalog_service_id
FROM pp_plan""", ["pp_plan"])
        self.add("u4", f"""
SELECT * EXCLUDE (act, cid, cver, pushed, skipped) REPLACE (
  CASE WHEN pushed OR skipped THEN 'PUSHED' ELSE status END AS status,
  CASE WHEN pushed THEN cid ELSE catalog_service_id END AS catalog_service_id,
  CASE WHEN pushed THEN cver ELSE catalog_version END AS catalog_version,
  CASE WHEN pushed THEN {pts} ELSE pushed_at END AS pushed_at)
FROM (
  SELECT u.*, CAST(NULL AS VARCHAR) AS catalog_version, CAST(NULL AS TIMESTAMP) AS pushed_at,
    r.action AS act, r.catalog_service_id AS cid, r.catalog_version AS cver,
    coalesce(r.action IN ('CREATE', 'UPDATE', 'REPLACE') AND u.status NOT IN {term}, false) AS pushed,
    coalesce(r.action = 'SKIP' AND u.status = 'SPEC_GENERATED', false) AS skipped
  FROM u3s u LEFT JOIN pp_results r ON r.service_key = u.service_key AND r.classification = u.classification
   AND (r.managed_api_id IS NULL OR u.managed_api_id = r.managed_api_id)) x""", ["u3s", "pp_results"])
        owner = f"regexp_extract(description, {q('^[[]' + o.owner_tag + ':(.+?)[]]')}, 1)"
        self.add("rec", f"""
SELECT id, name, version, owner,
  CASE WHEN tracked THEN 'ours' WHEN owner = {q(o.hostname)} THEN 'ours' WHEN owner <> '' THEN 'other'
       ELSE 'unowned' END AS ownership,
  {str(bool(o.cleanup_unowned)).upper()} AND NOT tracked AND owner = '' AS "delete"
FROM (SELECT c.id, c.name, c.version, {owner} AS owner,
        EXISTS (SELECT 1 FROM u4 t WHERE t.catalog_service_id = c.id) AS tracked FROM catalog_src c) x""",
                 ["catalog_src", "u4"])

    # ---------------------------------------------------------- managed two syncs
    def _define_managed_sync(self):
        n = "CAST(substr(reg_api_id, 5, 3) AS INTEGER)"
        prev, now = f"TIMESTAMP {q(fx.STATE_SPLIT)}", f"TIMESTAMP {q(fx.AS_OF)}"
        self.add("prev_src", f"""
SELECT * REPLACE (CASE WHEN {n} % 3 = 2 THEN '2023-12-31T00:00:00.000+0000' ELSE last_updated END AS last_updated)
FROM managed_src WHERE {n} % 3 <> 0""", ["managed_src"])
        self.add("prev_apis", self.apis_sql("prev_src"), ["prev_src"])
        self.add("prev_ops", f"""
SELECT reg_api_id, http_method, raw_target, {match_path_sql('endpoint_basepath', 'normalized_target')} AS match_path
FROM (SELECT s.reg_api_id, upper(s.verb) AS http_method, s.target AS raw_target,
        {normalize_target_sql('s.target')} AS normalized_target, a.endpoint_basepath
      FROM prev_src s JOIN prev_apis a ON s.reg_api_id = a.reg_api_id
      WHERE upper(s.verb) NOT IN ('', 'OPTIONS', 'HEAD')) x""", ["prev_src", "prev_apis"])
        self.add("sync", """
SELECT a.reg_api_id, a.api_name, a.api_type, a.reg_last_updated_at,
  CASE WHEN p.reg_api_id IS NULL THEN 'created' WHEN a.reg_last_updated_at = p.reg_last_updated_at THEN 'unchanged'
       ELSE 'updated' END AS sync_class
FROM m_apis a LEFT JOIN prev_apis p ON a.reg_api_id = p.reg_api_id""", ["m_apis", "prev_apis"])
        changed = "s.sync_class IN ('created', 'updated')"
        self.add("mm_apis", f"""
SELECT coalesce(s.reg_api_id, p.reg_api_id) AS reg_api_id,
  CASE WHEN {changed} THEN s.api_name ELSE p.api_name END AS api_name,
  CASE WHEN p.reg_api_id IS NOT NULL THEN p.api_type ELSE s.api_type END AS api_type,
  CASE WHEN {changed} THEN s.reg_last_updated_at ELSE p.reg_last_updated_at END AS reg_last_updated_at,
  CASE WHEN s.reg_api_id IS NULL AND EXISTS (SELECT 1 FROM m_apis) THEN {now} END AS deleted_at,
  CASE WHEN s.reg_api_id IS NOT NULL THEN {now} ELSE {prev} END AS last_synced_at,
  CASE WHEN p.reg_api_id IS NOT NULL THEN {prev} ELSE {now} END AS created_at,
  CASE WHEN {changed} OR s.reg_api_id IS NULL THEN {now} ELSE {prev} END AS updated_at
FROM sync s FULL OUTER JOIN prev_apis p ON s.reg_api_id = p.reg_api_id""", ["sync", "prev_apis", "m_apis"])
        self.add("mm_ops", f"""
SELECT o.reg_api_id, o.http_method, o.raw_target, o.match_path, CAST(NULL AS TIMESTAMP) AS deleted_at
FROM m_ops o JOIN sync s ON s.reg_api_id = o.reg_api_id WHERE s.sync_class <> 'unchanged'
UNION ALL
SELECT o.reg_api_id, o.http_method, o.raw_target, o.match_path,
  CASE WHEN s.reg_api_id IS NULL THEN {now} END AS deleted_at
FROM prev_ops o LEFT JOIN sync s ON s.reg_api_id = o.reg_api_id
WHERE s.reg_api_id IS NULL OR s.sync_class = 'unchanged'""", ["m_ops", "sync", "prev_ops"])
