"""Options that change results, with the defaults of the shipped configuration file.

Code defaults alone would give no noise filter and no normalization, so the file values are the
dataclass defaults. Durations are Spark interval text (``7 days``), not a duration mini-language.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from .functions.re2 import to_java

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the reference configuration for identical results)
# ---------------------------------------------------------------------------------------------

# Noise filter: case-insensitive substrings of the endpoint.
NOISE_PATH_PATTERNS = (
    "/health", "/healthz", "/ping", "/ready", "/readiness",
    "/liveness", "/actuator",
    "/agent.Synchronizer", "/grpc.health.v1.HealthService",
    "/controller.", "/tagrecorder.",
    "/metadata", "/machine", "/vmSettings", "/vmAgentLog",
    "/latest/meta-data", "/computeMetadata",
    "/apis/", "/api/v1/",
    "/favicon.ico", "/.well-known", "/swagger", "/openapi",
    "/robots.txt", "/.env",
)
# Noise filter: exact endpoints (case-sensitive).
NOISE_PATH_EXACT = ("/", "/version", "/metrics")
# Noise filter: excluded domains (lower-cased, port stripped before the test).
NOISE_DOMAINS = ("169.254.169.254",)

# Path normalization: segments matching one of these become {id}.
BUILTIN_ID_PATTERNS = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9a-fA-F]{24,}$",
    r"^[0-9]+$",
    r"^[A-Za-z0-9_-]{20,}={0,2}$",
    r"^[A-Z]{2,5}-[A-Z0-9-]{3,}$",
    r"^(?=.*[0-9])[a-zA-Z0-9]{8,}$",
)
# Path normalization: segments matching one of these are never replaced.
EXCLUDE_PATTERNS = (
    r"^v?[0-9]+\.[0-9]+(\.[0-9]+)?$",
    r"^v[0-9]+$",
    r"^api$",
)

# Column widths of the discovered table (VARCHAR(n)); longer values reject the row.
DISCOVERED_WIDTHS = {
    "service_key": 255, "http_method": 10, "resource_path": 1000, "service_type": 20,
    "protocol": 20, "http_version": 10, "process_name": 255, "k8s_pod": 255,
    "k8s_namespace": 255, "k8s_workload": 255, "k8s_service": 255, "k8s_cluster": 255,
    "k8s_node": 255, "vm_hostname": 255, "request_domain": 255, "service_ip": 45,
    "source_ip": 45, "host_ip": 45, "source_service_ip": 45, "source_process_name": 255,
    "source_k8s_pod": 255, "source_k8s_namespace": 255, "source_k8s_service": 255,
    "source_k8s_cluster": 255, "source_vm_hostname": 255, "traffic_origin": 30,
    "sample_url": 2000, "sample_path": 1000, "agent_name": 255,
}

# Multi-format API timestamps, tried in this order (Spark datetime patterns).
API_TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSZ",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ssZ",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]Z",
    "yyyy-MM-dd HH:mm:ss",
)

OPENAPI_VERSION = "3.0.3"

@dataclass(frozen=True)
class Options:
    # traffic filter (B1)
    observation_point: str = "s-p"
    protocol: int = 6
    l7_protocols: tuple = ("HTTP", "HTTP2")
    min_direction_score: int = 200
    # signature cap (C2); None = no cap (stream and backfill default, see README)
    max_signatures: int | None = None
    # noise filter
    excluded_agent_ids: tuple = ()
    excluded_ports: tuple = ()
    excluded_domains: tuple = NOISE_DOMAINS
    path_exact: tuple = NOISE_PATH_EXACT
    path_patterns: tuple = NOISE_PATH_PATTERNS
    # normalization
    builtin_patterns: tuple = BUILTIN_ID_PATTERNS
    user_patterns: tuple = ()
    exclude_patterns: tuple = EXCLUDE_PATTERNS
    allow_lookaround: bool = False
    # fusion (J1)
    fusion_tolerance_ms: int = 500
    # managed sync
    context_pass_through: bool = False
    include_api_types: tuple = ("HTTP",)
    # comparison / lifecycle
    stale_after: str = "7 days"
    retention_discovered: str = "30 days"
    retention_managed: str = "90 days"
    retention_unmanaged: str = "90 days"
    managed_fresh_factor: int = 3
    managed_sync_interval: str = "10 minutes"
    # spec content
    include_k8s_metadata: bool = True
    include_legacy_metadata: bool = True
    include_network_metadata: bool = True
    include_sample_urls: bool = True
    include_traffic_stats: bool = True
    server_url_override: str = ""
    ext_prefix: str = "x-discovery"
    tool_version: str = "dev"
    # catalog (G1-G8)
    push_shadow: bool = True
    push_drift: bool = True
    re_push_deleted: bool = False
    owner_tag: str = "OWN"
    hostname: str = "host-a"
    cleanup_unowned: bool = False
    # streaming
    poll_interval: str = "5 minutes"
    safety_lag: str = "2 minutes"

    def with_(self, **kw) -> "Options":
        return replace(self, **kw)

    def usable_patterns(self, patterns) -> list[str]:
        """Patterns the reference would compile; with allow_lookaround every pattern is kept."""
        return [p for p in patterns if self.allow_lookaround or to_java(p) is not None]


DEFAULT = Options()
