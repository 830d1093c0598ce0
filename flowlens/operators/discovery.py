"""Phase 1, discovery: flow log -> API signatures -> noise filter -> normalization -> dedup -> fusion.

Shuffles: the signature aggregate (C1, map-side partial), dedup (C3, on few rows), the evidence aggregate of the
observation rows (J2-J4, map-side partial, after the rows of other URLs were dropped), which is partitioned as the fusion
join needs it (J1, equi join on (url, method, epoch second)), and the merge of a signature's evidence. Regexes run on
distinct endpoints, never on raw flows. A stream aggregates signatures and evidence of a window in one pass (``roles``).
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DISCOVERED_WIDTHS, Options
from ..functions import text as T
from ..session import materialize

SIG_KEY = ["http_method", "endpoint", "server_port", "agent_id"]
DEDUP_KEY = ["http_method", "resource_path", "server_port", "agent_id"]
DISCOVERED_KEY = ["service_key", "http_method", "resource_path"]

# Per observation point, the flow columns read and the names the engine gives them.
OBS_COLUMNS = {
    "s-p": {"ip4_1": "server_ip", "pod_service_1": "k8s_service", "pod_ns_1": "k8s_namespace",
            "pod_group_1": "k8s_workload", "pod_1": "k8s_pod", "pod_cluster_1": "k8s_cluster",
            "pod_node_1": "k8s_node", "chost_1": "vm_hostname", "process_kname_1": "process_name",
            "request_domain": "request_domain", "endpoint": "endpoint", "l7_protocol_str": "l7_protocol_str",
            "is_tls": "is_tls", "version": "version", "response_code": "response_code",
            "response_duration": "response_duration", "server_port": "server_port", "agent_id": "agent_id"},
    "s": {"ip4_0": "source_ip", "ip4_1": "host_ip", "is_internet_0": "is_external"},
    "c-p": {"ip4_0": "source_service_ip", "process_kname_0": "source_process_name", "pod_0": "source_k8s_pod",
            "pod_ns_0": "source_k8s_namespace", "pod_service_0": "source_k8s_service",
            "pod_cluster_0": "source_k8s_cluster", "chost_0": "source_vm_hostname"},
}

FUSION_SIDE_COLUMNS = ["request_domain", "ip4_0", "ip4_1", "is_internet_0", "pod_service_1", "pod_ns_1",
                       "pod_group_1", "pod_1", "pod_cluster_1", "pod_node_1", "chost_1", "process_kname_1",
                       "process_kname_0", "pod_0", "pod_ns_0", "pod_service_0", "pod_cluster_0", "chost_0"]
SP_LAST_COLS = ["k8s_service", "k8s_namespace", "k8s_workload", "k8s_pod", "k8s_cluster", "k8s_node",
                "vm_hostname", "process_name", "service_ip"]
CP_COLS = ["source_service_ip", "source_process_name", "source_k8s_pod", "source_k8s_namespace",
           "source_k8s_service", "source_k8s_cluster", "source_vm_hostname"]

# Upsert column classes of the discovered table.
OVERWRITE_COLS = ["k8s_pod", "k8s_node", "service_ip", "traffic_origin", "sample_url", "response_code",
                  "latency_us", "agent_name"]
COALESCE_COLS = ["source_ip", "host_ip", "is_external", "source_service_ip", "source_k8s_pod",
                 "source_k8s_service"]
NULL_WHEN_BLANK = ["source_ip", "host_ip", "source_service_ip", "source_process_name", "source_k8s_pod",
                   "source_k8s_namespace", "source_k8s_service", "source_k8s_cluster", "source_vm_hostname"]
DISCOVERED_COLS = [
    "service_key", "http_method", "resource_path", "service_type", "protocol", "is_tls", "http_version",
    "server_port", "process_name", "k8s_pod", "k8s_namespace", "k8s_workload", "k8s_service", "k8s_cluster",
    "k8s_node", "vm_hostname", "request_domain", "service_ip", "source_ip", "host_ip", "is_external",
    "source_service_ip", "source_process_name", "source_k8s_pod", "source_k8s_namespace",
    "source_k8s_service", "source_k8s_cluster", "source_vm_hostname", "traffic_origin", "sample_url",
    "sample_path", "agent_id", "agent_name", "response_code", "latency_us", "first_seen_at",
    "last_seen_at", "hit_count"]
KEEP_COLS = [c for c in DISCOVERED_COLS
             if c not in DISCOVERED_KEY + OVERWRITE_COLS + COALESCE_COLS + ["first_seen_at", "last_seen_at",
                                                                           "hit_count"]]


def epoch_second(c) -> Column:
    """Whole epoch seconds of a (wall-clock UTC) timestamp, truncating sub-second digits."""
    return F.unix_seconds(T.col(c).cast("timestamp"))


# ------------------------------------------------------------------------------------- A1, A1b, B1

def read_flows(spark, path: str, start=None, end=None) -> DataFrame:
    """A1: flow log scan, optionally bounded to [start, end) on whole seconds (pushed to the scan). A log in ``day``
    folders is pruned to the days of the window."""
    flows = spark.read.parquet(path)
    if "day" in flows.columns:
        if start is not None:
            flows = flows.where(F.col("day") >= F.to_date(F.lit(str(start)).cast("timestamp_ntz")))
        if end is not None:
            flows = flows.where(F.col("day") <= F.to_date(F.lit(str(end)).cast("timestamp_ntz")))
    return time_window(flows, start, end)


def time_window(flows: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        flows = flows.where(F.col("start_time") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        flows = flows.where(F.col("start_time") < F.lit(str(end)).cast("timestamp_ntz"))
    return flows


def observations(flows: DataFrame, point: str) -> DataFrame:
    """Rows of one observation point with the point's side columns renamed."""
    cols = [F.col("flow_id"), F.col("request_resource"), F.col("request_type"),
            epoch_second("start_time").alias("start_second")]
    cols += [F.col(src).alias(dst) for src, dst in OBS_COLUMNS[point].items()]
    return flows.where(F.col("observation_point") == point).select(*cols)


def is_traffic(opts: Options) -> Column:
    """B1: observation point, L4 protocol, L7 protocols, direction score; method and endpoint present.

    Written on raw columns so every conjunct reaches the parquet scan as a pushed filter.
    """
    return ((F.col("observation_point") == opts.observation_point)
            & (F.col("protocol") == opts.protocol)
            & F.col("l7_protocol_str").isin(list(opts.l7_protocols))
            & (F.col("direction_score") >= opts.min_direction_score)
            & (F.col("endpoint") != "") & (F.col("request_type") != ""))


def traffic_filter(flows: DataFrame, opts: Options, start=None, end=None) -> DataFrame:
    return time_window(flows.where(is_traffic(opts)), start, end)


# --------------------------------------------------------------------------------- C1, C2, C4

def signature_aggregates(rows: Column | None = None) -> list[Column]:
    """Hits, newest time and one coherent sample, the earliest row by (start_time, flow_id), of the given rows of a
    group (all of them by default)."""
    of = (lambda c: c) if rows is None else (lambda c: F.when(rows, c))
    sample = F.struct("start_time", "flow_id", "request_resource", "request_domain", "is_tls",
                      "l7_protocol_str", "version", "response_code", "response_duration")
    return [F.count(of(F.lit(1))).alias("hit_count"), F.min(of(sample)).alias("s"),
            F.max(of(F.col("start_time"))).alias("last_seen_at")]


def signature_rows(groups: DataFrame, *lead: Column | str) -> DataFrame:
    """A3b and B2 on aggregated signatures."""
    out = groups.select(
        *lead, *SIG_KEY, "hit_count",
        F.coalesce(T.nullif_blank(F.col("s.request_resource")), F.col("endpoint")).alias("sample_url"),
        epoch_second("s.start_time").alias("sample_second"),
        T.nz(F.col("s.request_domain")).alias("request_domain"),
        F.coalesce(F.col("s.is_tls"), F.lit(False)).alias("is_tls"),
        F.coalesce(T.nullif_blank(F.col("s.l7_protocol_str")), F.lit("HTTP")).alias("protocol"),
        T.nz(F.col("s.version")).alias("http_version"),
        F.coalesce(F.col("s.response_code").cast("int"), F.lit(0)).alias("response_code"),
        F.coalesce(F.col("s.response_duration").cast("bigint"), F.lit(0)).alias("latency_us"),
        F.col("s.start_time").alias("first_seen_at"), "last_seen_at")
    return out.where(~T.blank("http_method") & ~T.blank("endpoint") & (F.col("hit_count") > 0))


def signatures(filtered: DataFrame, cycle: str | None = None) -> DataFrame:
    """C1 (+A3b, B2): group by method, endpoint, port, agent; count; one coherent sample row.

    The sample is taken inside the same aggregate as the count (partial aggregation on the map side; no second pass over
    the flows). With ``cycle`` (an interval such as '5 minutes') the aggregate is also per tumbling event-time window.
    """
    keys = [F.col("request_type").alias("http_method"), "endpoint", "server_port", "agent_id"]
    if cycle is None:
        return signature_rows(filtered.groupBy(*keys).agg(*signature_aggregates()))
    # windows are defined on TIMESTAMP; the session time zone is UTC
    win = F.window(F.col("start_time").cast("timestamp"), cycle).alias("win")
    return signature_rows(filtered.groupBy(win, *keys).agg(*signature_aggregates()), *cycle_columns())


def cycle_columns() -> list[Column]:
    return [F.col("win.start").cast("timestamp_ntz").alias("cycle"), F.col("win.end").cast("timestamp_ntz").alias("cycle_end")]


def signature_order() -> list[Column]:
    """Total order of the source query (hits descending), ties by the signature key."""
    return [F.desc("hit_count"), F.asc("http_method"), F.asc("endpoint"), F.asc("server_port"),
            F.asc("agent_id")]


def top_signatures(sigs: DataFrame, k: int | None) -> DataFrame:
    """The k most-hit signatures (TakeOrderedAndProject); k=None keeps all.

    With a ``cycle`` column the cap applies per cycle: a row_number filter that Spark plans as a
    window group limit, so each task keeps only its local top k before the shuffle.
    """
    if k is None:
        return sigs
    if "cycle" in sigs.columns:
        from pyspark.sql import Window
        w = Window.partitionBy("cycle").orderBy(*signature_order())
        return sigs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
    return sigs.orderBy(*signature_order()).limit(k)


def total_hits(sigs: DataFrame) -> DataFrame:
    """C4: cycle total of hits."""
    return sigs.agg(F.coalesce(F.sum("hit_count"), F.lit(0)).cast("bigint").alias("total_hits"))


# ---------------------------------------------------------------------------------- B3-B7b

#: Kinds of exclusion tables: the signature's side of the key, and whether it is compared as text in lower case.
EXCLUDABLE = {"agent": lambda: F.col("agent_id").cast("long"), "port": lambda: F.col("server_port").cast("long"),
              "domain": lambda: T.domain_key("request_domain")}


def excluded(sigs: DataFrame, exclusions: dict[str, DataFrame], how: str) -> DataFrame:
    """B3-B5 for sets of any size: signatures joined with tables whose first column holds excluded agents, ports or
    domains. ``how`` is left_anti, or left to mark the hits in columns in_agent, in_port and in_domain.

    No side is declared small: Spark broadcasts a table once its written size has turned out to allow it, and shuffles
    both sides beyond that.
    """
    for kind, table in exclusions.items():
        value = F.col(table.columns[0])
        keys = table.select((F.lower(value) if kind == "domain" else value.cast("long")).alias("_x")).where("_x is not null")
        keys = keys.distinct() if how == "left_anti" else keys.distinct().withColumn(f"in_{kind}", F.lit(True))
        sigs = sigs.withColumn("_key", EXCLUDABLE[kind]()).join(keys, F.col("_key") == F.col("_x"), how).drop("_key", "_x")
    return sigs


def noise_reason(opts: Options, marked=()) -> Column:
    """First matching noise rule in the reference order, NULL when the signature is kept. ``marked`` are the kinds
    whose hits ``excluded`` has marked."""
    rules = []
    inline = {"agent": [*opts.excluded_agent_ids], "port": [*opts.excluded_ports], "domain": [d.lower() for d in opts.excluded_domains]}
    for kind, values in inline.items():
        tests = [EXCLUDABLE[kind]().isin(values)] if values else []
        tests += [F.coalesce(F.col(f"in_{kind}"), F.lit(False))] if kind in marked else []
        if tests:
            rules.append((reduce(or_, tests), kind))
    if opts.path_exact:
        rules.append((F.col("endpoint").isin(list(opts.path_exact)), "path_exact"))
    if opts.path_patterns:
        low = F.lower(T.nz(F.col("endpoint")))
        rules.append((reduce(or_, [low.contains(p.lower()) for p in opts.path_patterns]), "path_pattern"))
    expr = None
    for cond, name in rules:
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.lit(None).cast("string") if expr is None else expr


def drop_noise(sigs: DataFrame, opts: Options, exclusions: dict[str, DataFrame] | None = None) -> DataFrame:
    """Keep signatures that no noise rule and no exclusion table removes."""
    return excluded(sigs.where(noise_reason(opts).isNull()), exclusions or {}, "left_anti")


def noise_audit(sigs: DataFrame, opts: Options, exclusions: dict[str, DataFrame] | None = None) -> DataFrame:
    """Count of signatures and hits per noise reason ('kept' for survivors)."""
    marked = excluded(sigs, exclusions or {}, "left")
    return (marked.withColumn("reason", F.coalesce(noise_reason(opts, tuple(exclusions or ())), F.lit("kept")))
            .groupBy("reason")
            .agg(F.count(F.lit(1)).alias("signatures"), F.sum("hit_count").cast("bigint").alias("hits")))


# -------------------------------------------------------------------------------------- B8, C3

def normalize(sigs: DataFrame, opts: Options) -> DataFrame:
    """B8 on the distinct signatures: resource_path = normalized endpoint, sample_path = endpoint."""
    return sigs.select("*", T.normalize_path("endpoint", opts).alias("resource_path"),
                       F.col("endpoint").alias("sample_path"))


def dedup(sigs: DataFrame) -> DataFrame:
    """Merge signatures that collapsed to one (method, resource_path, port, agent).

    Hits add up; the representative is the first row of the source order (most hits, ties by
    endpoint). ``rank`` is the representative's position key in that order, used by fusion (J1).
    """
    rep = F.struct((-F.col("hit_count")).alias("neg_hits"), F.col("endpoint"), "sample_url", "sample_second",
                   "request_domain", "is_tls", "protocol", "http_version", "response_code", "latency_us")
    cyc = ["cycle"] if "cycle" in sigs.columns else []
    g = sigs.groupBy(*cyc, *DEDUP_KEY).agg(
        F.sum("hit_count").cast("bigint").alias("hit_count"), F.min(rep).alias("r"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return g.select(
        *cyc, *DEDUP_KEY, "hit_count",
        F.col("r.endpoint").alias("sample_path"), F.col("r.sample_url").alias("sample_url"),
        F.col("r.sample_second").alias("sample_second"), F.col("r.request_domain").alias("request_domain"),
        F.col("r.is_tls").alias("is_tls"), F.col("r.protocol").alias("protocol"),
        F.col("r.http_version").alias("http_version"), F.col("r.response_code").alias("response_code"),
        F.col("r.latency_us").alias("latency_us"), "first_seen_at", "last_seen_at",
        F.struct(*[F.col(c) for c in cyc], F.col("r.neg_hits").alias("neg_hits"), F.col("http_method").alias("m"),
                 F.col("r.endpoint").alias("e"), F.col("server_port").alias("p"),
                 F.col("agent_id").alias("a")).alias("rank"))


# ---------------------------------------------------------------------------------- J1 - J4

NO_TIME = -(1 << 40)  # stands for the second of a row without a time
POINTS = ("s-p", "s", "c-p")
URL_BITS = 1 << 27  # at most, of the filter by sample URLs: 2^21 words of 64 bits are broadcast


def _ntz(second: int) -> Column:
    return F.lit(str(datetime(1970, 1, 1) + timedelta(seconds=second))).cast("timestamp_ntz")


def _evidence() -> dict[str, tuple]:
    """Per output, whether the first or the last row by (start_time, flow_id) counts, which rows, and their value."""
    sp, s, cp = (F.col("observation_point") == p for p in POINTS)
    named = lambda c: T.nz(F.col(c)) != ""
    server = F.struct(*[T.nz(F.col(src)).alias(dst) for src, dst in zip(
        ["pod_service_1", "pod_ns_1", "pod_group_1", "pod_1", "pod_cluster_1", "pod_node_1", "chost_1", "process_kname_1",
         "ip4_1"], SP_LAST_COLS, strict=True)])
    client = dict(zip(CP_COLS, ["ip4_0", "process_kname_0", "pod_0", "pod_ns_0", "pod_service_0", "pod_cluster_0", "chost_0"],
                      strict=True))
    return {"sp": (F.max, sp, server), "sp_domain": (F.min, sp & named("request_domain"), F.col("request_domain")),
            "source_ip": (F.min, s & named("ip4_0"), F.col("ip4_0")), "host_ip": (F.min, s & named("ip4_1"), F.col("ip4_1")),
            "is_external": (F.min, s, F.coalesce(F.col("is_internet_0"), F.lit(False))),
            **{dst: (F.min, cp & named(src), F.col(src)) for dst, src in client.items()}}


def evidence_aggregates(rows: Column | None = None) -> list[Column]:
    """One (start_time, flow_id, value) an output, of the given observation rows of a group; ``merged_evidence`` joins
    such groups."""
    both = (lambda c: c) if rows is None else (lambda c: c & rows)
    return [pick(F.when(both(cond), F.struct("start_time", "flow_id", value.alias("v")))).alias(name)
            for name, (pick, cond, value) in _evidence().items()]


def evidence_names() -> list[str]:
    return list(_evidence())


def merged_evidence() -> list[Column]:
    return [pick(name)["v"].alias(name) for name, (pick, _, _) in _evidence().items()]


def _candidates(sigs: DataFrame) -> DataFrame:
    """Signatures whose sample URL may be looked up (B23), with their place in the source order and key."""
    keys = (["cycle"] if "cycle" in sigs.columns else []) + DEDUP_KEY
    return (sigs.where(T.is_enrichable("sample_url"))
            .select(F.col("sample_url").alias("url"), F.col("http_method").alias("method"), F.col("sample_second").alias("sec"),
                    *[c for c in ("cycle",) if c in sigs.columns],
                    F.struct("rank", *[F.col(k).alias(f"k_{k}") for k in keys]).alias("w")))


def sampled_urls(rows: DataFrame, cand: DataFrame, n: int) -> DataFrame:
    """Rows whose (url, method) is among the candidates', and a share of others (about one in 16).

    A bit for each hash of a sample URL, 16 for each of the ``n`` candidates but ``URL_BITS`` at most, in words of 64 bits
    that are broadcast: a table whose size has a bound whatever the input. The join drops rows before they are shuffled.
    """
    bits = min(URL_BITS, 1 << max(10, (16 * n - 1).bit_length()))
    place = F.pmod(F.xxhash64("url", "method"), F.lit(bits))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    marks = (cand.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mark"))
             .groupBy("word").agg(F.bit_or("mark").alias("marks")))
    hit = F.call_function("shiftright", F.col("marks"), bit).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("word", word).join(F.broadcast(marks), "word").where(hit).drop("word", "marks")


def sample_bounds(sigs: DataFrame):
    """One row over the signatures that may be looked up: lo and hi second, n, and how many have no time (untimed)."""
    return _candidates(sigs).agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"), F.count("*").alias("n"),
                                 F.count(F.when(F.col("sec").isNull(), 1)).alias("untimed")).first()


def observation_evidence(flows: DataFrame, sigs: DataFrame, opts: Options, known=None) -> DataFrame:
    """J1b and J2-J4 on a flow log: evidence by (url, method, sec) of the rows that can meet one of the signatures;
    ``known`` are their bounds."""
    slack, known = opts.fusion_tolerance_ms // 1000, known or sample_bounds(sigs)
    rows = (flows.where(F.col("observation_point").isin(*POINTS))
            .select("flow_id", "start_time", "observation_point", F.col("request_resource").alias("url"),
                    F.col("request_type").alias("method"),
                    F.coalesce(epoch_second("start_time"), F.lit(NO_TIME).cast("long")).alias("sec"), *FUSION_SIDE_COLUMNS))
    if known["untimed"] == 0 and known["lo"] is not None:
        rows = rows.where(F.col("start_time").isNull() | (
            (F.col("start_time") >= _ntz(known["lo"] - slack)) & (F.col("start_time") < _ntz(known["hi"] + slack + 1))))
    return sampled_urls(rows, _candidates(sigs), known["n"]).groupBy("url", "method", "sec").agg(*evidence_aggregates())


def fuse(sigs: DataFrame, evidence: DataFrame, opts: Options, untimed: bool = False) -> DataFrame:
    """Attach server-process, server-network and client-process observations to signatures.

    ``evidence`` has observation rows aggregated by (url, method, sec), as all rows of one second meet the same signature:
    the first (by ``rank``, in each cycle) with their URL and method whose sample time is within the tolerance; an unknown
    time on either side matches any time. Times are whole epoch seconds, so a tolerance is that many whole seconds. The
    first signature per (url, method, second) is picked on the signature side, where a tolerance of t seconds repeats a row
    2t + 1 times; evidence without a time meets the first signature of the (url, method) under a second of its own. So
    everything meets in one inner equi join. Only where signatures are ``untimed`` are the seconds of the evidence looked up
    by (url, method) first. Evidence of a stream bears the cycle of its window and meets that cycle's signatures alone.
    """
    slack = opts.fusion_tolerance_ms // 1000
    keys = (["cycle"] if "cycle" in sigs.columns else []) + DEDUP_KEY
    cand = _candidates(sigs)
    lead = [c for c in ("cycle",) if c in cand.columns]
    same = [c for c in lead if c in evidence.columns]
    at = [*same, "url", "method", "sec"]
    no_time = F.lit(NO_TIME).cast("long")
    near = cand.where(F.col("sec").isNotNull()).withColumn(
        "sec", F.explode(F.sequence(F.col("sec") - slack, F.col("sec") + slack)) if slack else F.col("sec"))
    pick = near.union(cand.withColumn("sec", no_time))
    if untimed:
        seconds = evidence.select(*at)
        anytime = cand.where(F.col("sec").isNull()).drop("sec").join(seconds, [*same, "url", "method"])
        pick = pick.unionByName(anytime.select(*pick.columns))
    pick = pick.groupBy(*lead, "url", "method", "sec").agg(F.min("w").alias("w"))
    matched = evidence.join(pick.drop(*[c for c in lead if c not in same]), at)

    att = matched.groupBy(*[F.col("w").getField(f"k_{k}").alias(k) for k in keys]).agg(*merged_evidence())
    j = sigs.join(att, keys, "left")
    out = j.select(
        *[c for c in sigs.columns if c != "request_domain"],
        F.when(T.blank(F.col("request_domain")), T.nz(F.col("sp_domain")))
         .otherwise(F.col("request_domain")).alias("request_domain"),
        *[T.nz(F.col("sp").getField(c)).alias(c) for c in SP_LAST_COLS],
        T.nz(F.col("source_ip")).alias("source_ip"), T.nz(F.col("host_ip")).alias("host_ip"),
        F.col("is_external"),
        *[T.nz(F.col(c)).alias(c) for c in CP_COLS],
        F.lit(None).cast("string").alias("agent_name"))
    return with_service_identity(out)


def roles(flows: DataFrame, opts: Options) -> DataFrame:
    """A row for each role of a flow row: as traffic under its signature, as observation under (url, method, second).

    Adds kind, http_method, path (endpoint or URL), key_port, key_agent and sec, so that one aggregate serves both. With a
    fusion tolerance, an observation near the edge of a cycle is also one of the neighbouring cycle (``role_time``).
    """
    port, agent = flows.schema["server_port"].dataType, flows.schema["agent_id"].dataType
    at = F.col("start_time").cast("timestamp")
    role = F.struct(F.lit("signature").alias("kind"), F.col("request_type").alias("http_method"), F.col("endpoint").alias("path"),
                    F.col("server_port").alias("key_port"), F.col("agent_id").alias("key_agent"),
                    F.lit(None).cast("long").alias("sec"), at.alias("role_time"))

    def seen(time: Column) -> Column:
        return F.struct(F.lit("observation").alias("kind"), F.col("request_type").alias("http_method"),
                        F.col("request_resource").alias("path"), F.lit(None).cast(port).alias("key_port"),
                        F.lit(None).cast(agent).alias("key_agent"), epoch_second("start_time").alias("sec"),
                        time.alias("role_time"))

    is_seen = F.col("observation_point").isin(*POINTS)
    made = [F.when(is_traffic(opts), role), F.when(is_seen, seen(at))]
    slack = opts.fusion_tolerance_ms // 1000
    if slack:
        win, step = F.window_time(F.window(at, opts.poll_interval)), F.expr("INTERVAL 1 microsecond")
        end = win + step
        begin = end - F.expr(f"INTERVAL {opts.poll_interval}")
        wide = F.expr(f"INTERVAL {slack} seconds")
        made += [F.when(is_seen & (at + wide >= end), seen(end)), F.when(is_seen & (at - wide < begin), seen(begin - step))]
    tagged = flows.where(is_traffic(opts) | is_seen).withColumn("role", F.explode(F.array_compact(F.array(*made))))
    return tagged.select("*", "role.*").drop("role")


# ------------------------------------------------------------------------------ B16 - B18

def service_key() -> Column:
    """k8s service -> workload -> DNS host -> host ip:port -> service ip:port -> agent."""
    ns, svc, wl = F.col("k8s_namespace"), F.col("k8s_service"), F.col("k8s_workload")
    port = F.col("server_port").cast("string")
    dom = T.strip_port("request_domain", keep_leading=True)

    def scoped(name):
        return F.when(T.nz(ns) != "", F.concat(ns, F.lit("/"), name)).otherwise(name)
    return (F.when(T.nz(svc) != "", scoped(svc))
            .when(T.nz(wl) != "", scoped(wl))
            .when((T.nz(F.col("request_domain")) != "") & T.is_dns_name(dom), dom)
            .when(~T.is_loopback("host_ip"), F.concat(F.col("host_ip"), F.lit(":"), port))
            .when(~T.is_loopback("service_ip"), F.concat(F.col("service_ip"), F.lit(":"), port))
            .when(T.nz(F.col("agent_name")) != "", F.concat(F.col("agent_name"), F.lit(":"), port))
            .otherwise(F.concat(F.lit("agent-"), F.col("agent_id").cast("string"), F.lit(":"), port)))


def service_type() -> Column:
    """B17."""
    return (F.when((T.nz(F.col("k8s_service")) != "") | (T.nz(F.col("k8s_workload")) != ""), F.lit("KUBERNETES"))
            .when(T.nz(F.col("k8s_pod")) != "", F.lit("CONTAINER")).otherwise(F.lit("LEGACY")))


def traffic_origin() -> Column:
    """B18."""
    return (F.when(T.nz(F.col("source_k8s_service")) != "", F.lit("SERVICE_TO_SERVICE"))
            .when(T.nz(F.col("source_k8s_pod")) != "", F.lit("CONTAINER_TO_SERVICE"))
            .when((T.nz(F.col("source_process_name")) != "") | (T.nz(F.col("source_service_ip")) != ""),
                  F.lit("INTERNAL"))
            .when(F.col("is_external") == F.lit(True), F.lit("EXTERNAL"))
            .when(F.col("is_external") == F.lit(False), F.lit("INTERNAL"))
            .otherwise(F.lit("UNKNOWN")))


def with_service_identity(df: DataFrame) -> DataFrame:
    return df.select("*", service_key().alias("service_key"), service_type().alias("service_type"),
                     traffic_origin().alias("traffic_origin"))


# ------------------------------------------------------------------------------------ B22

def width_reason(widths=DISCOVERED_WIDTHS, columns=None) -> Column:
    """First column whose text is longer than its VARCHAR width, NULL when the row fits."""
    expr = None
    for c, n in widths.items():
        if columns is not None and c not in columns:
            continue
        cond = F.char_length(T.nz(F.col(c))) > n
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return F.lit(None).cast("string") if expr is None else expr


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, rejected rows with reason). The batch goes on without the rejects."""
    tagged = df.withColumn("reject_reason", width_reason(columns=set(df.columns)))
    return (tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.where(F.col("reject_reason").isNotNull()))


# ------------------------------------------------------------------------------- pipeline

def discover_batch(flows: DataFrame, opts: Options, start=None, end=None, cycle: str | None = None,
                   exclusions: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A1 -> B1 -> C1 -> C2 -> B7b -> B8 -> C3 -> J1-J4 -> B16-B18 -> B22, as lazy DataFrames.

    ``cycle`` replays the range as tumbling cycles of that length (batch twin of the stream).
    """
    windowed = time_window(flows, start, end)
    sigs = signatures(traffic_filter(windowed, opts), cycle)
    top = top_signatures(sigs, opts.max_signatures)
    kept = drop_noise(top, opts, exclusions)
    # the cycle's signature set is read by four branches of the fusion plan; writing it once keeps
    # the flow log to a single aggregation pass instead of one per branch
    deduped = materialize(dedup(normalize(kept, opts)), "signatures")
    known = sample_bounds(deduped)
    fused = fuse(deduped, observation_evidence(windowed, deduped, opts, known), opts, known["untimed"] > 0)
    good, rejects = split_valid(fused)
    return {"signatures": sigs, "top": top, "kept": kept, "deduped": deduped, "fused": fused,
            "valid": good, "rejects": rejects}


def after_signatures(sigs: DataFrame, evidence: DataFrame, opts: Options) -> dict[str, DataFrame]:
    """C2 -> B7b -> B8 -> C3 -> J1-J4 -> B22 on already aggregated signatures and evidence (stream side)."""
    kept = drop_noise(top_signatures(sigs, opts.max_signatures), opts)
    deduped = materialize(dedup(normalize(kept, opts)), "signatures")
    fused = fuse(deduped, evidence, opts)
    good, rejects = split_valid(fused)
    return {"kept": kept, "deduped": deduped, "fused": fused, "valid": good, "rejects": rejects}


def batch_records(valid: DataFrame) -> DataFrame:
    """Fused rows sharing a discovered key in one cycle become one record.

    Hits add; first-write columns come from the first row (by fusion rank), overwrite columns from
    the last, coalesce columns from the last non-NULL. Blank source columns read as NULL (1.3).
    """
    v = valid.select(*[T.nullif_blank(F.col(c)).alias(c) if c in NULL_WHEN_BLANK else F.col(c)
                       for c in valid.columns])
    first = F.min(F.struct(F.col("rank"), *[F.col(c) for c in KEEP_COLS])).alias("f")
    last = F.max(F.struct(F.col("rank"), *[F.col(c) for c in OVERWRITE_COLS])).alias("l")
    coal = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("rank"), F.col(c).alias("v"))))["v"].alias(c)
            for c in COALESCE_COLS]
    g = v.groupBy(*DISCOVERED_KEY).agg(first, last, *coal,
                                        F.sum("hit_count").cast("bigint").alias("hit_count"),
                                        F.min("first_seen_at").alias("first_seen_at"),
                                        F.max("last_seen_at").alias("last_seen_at"))
    return g.select(*DISCOVERED_KEY, *[F.col(f"f.{c}").alias(c) for c in KEEP_COLS],
                    *[F.col(f"l.{c}").alias(c) for c in OVERWRITE_COLS], *COALESCE_COLS,
                    "first_seen_at", "last_seen_at", "hit_count").select(*DISCOVERED_COLS)


def merge_discovered(state: DataFrame | None, batch: DataFrame, as_of) -> DataFrame:
    """Discovered upsert. Hits add; overwrite / coalesce(new, old) / keep-first per column.

    ``batch`` is the output of batch_records. Seen times are event times, so a batch of older rows never moves
    last_seen_at back or leaves first_seen_at too late. One outer join on the key.
    """
    ts = F.lit(str(as_of)).cast("timestamp_ntz")
    if state is None:
        return batch.withColumn("created_at", ts).withColumn("updated_at", ts)
    o, n = state.alias("o"), batch.alias("n")
    j = o.join(n, DISCOVERED_KEY, "full_outer")
    has_o = F.col("o.http_method").isNotNull()
    has_n = F.col("n.http_method").isNotNull()

    def pick(c):
        if c in OVERWRITE_COLS:
            return F.when(has_n, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c in COALESCE_COLS:
            return F.when(has_n, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}"))
        if c == "hit_count":
            return F.coalesce(F.col("o.hit_count"), F.lit(0)) + F.coalesce(F.col("n.hit_count"), F.lit(0))
        if c == "first_seen_at":
            return F.least("o.first_seen_at", "n.first_seen_at")
        if c == "last_seen_at":
            return F.greatest("o.last_seen_at", "n.last_seen_at")
        return F.when(has_o, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    cols = [F.col(k) for k in DISCOVERED_KEY] + [pick(c).alias(c) for c in DISCOVERED_COLS if c not in DISCOVERED_KEY]
    cols.append(F.when(has_o, F.col("o.created_at")).otherwise(ts).alias("created_at"))
    cols.append(F.when(has_n, ts).otherwise(F.col("o.updated_at")).alias("updated_at"))
    return j.select(*cols)


def discovered_from_flows(flows: DataFrame, opts: Options, as_of, start=None, end=None,
                          state: DataFrame | None = None) -> DataFrame:
    """One discovery cycle over [start, end) merged into ``state`` (None = empty state)."""
    parts = discover_batch(flows, opts, start, end)
    return merge_discovered(state, batch_records(parts["valid"]), as_of)
